import html
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from kilnframe.llm import html_text, storage
from kilnframe.llm.html_text import main_text

LONG = "Word after word fills this paragraph until it is long enough to count as text of its own right."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("plain < text & more", "plain < text & more"),
        ("<p>a<b>c<p>d", "ac\nd"),
        ("<script>var a='</p><p>no</p>';</script><p>Yes &amp; no&#33; &eacute;&nbsp;x</p>", "Yes & no! é x"),
        ("<p>one <!-- <p>no</p> --> two<br>three</p>", "one two three"),
        (f"<header>Site</header><nav><a href=x>Home</a></nav><article><header><h1>T</h1></header><p>{LONG}</p><p>Short.</p></article><footer>c</footer>", f"T\n{LONG}\nShort."),
        (f"<div class='sidebar'>{LONG}</div><div><p>{LONG}</p><p>End.</p></div><div id='comments'><p>{LONG}</p></div>", f"{LONG}\nEnd."),
        (f"<body class='with-sidebar'><div class='no-sidebar'><p>{LONG}</p></div></body>", LONG),
        (f"<article><p>{LONG}</p><div class='ad'>Buy!</div><p>On.</p><form><input><p>Sign up</p></form><section class='comments'><p>{LONG}</p></section></article>", f"{LONG}\nOn."),
        (f"<main><p>{LONG}</main><aside>{LONG}</aside><div role='alert'>Cookies</div>", LONG),
        (f"<ul><li><a href=a>One</a><li><a href=b>Two</a></ul><p>{LONG}</p><ul><li><a href=c>Three</a></ul>", LONG),
        ("<p title='a > b'>kept</p><style>p{}</style><noscript>no</noscript>", "kept"),
        ("<article><p>unclosed <a href='x'>link text</a> and more", "unclosed link text and more"),
        ("<div style='display: none'>hidden</div><p>shown</p>", "shown"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one\ntwo\na\nb"),
        (f"<main><p>Crumb</p><article><h1>T</h1><p>{LONG}</p></article><p>More</p></main>", f"T\n{LONG}"),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><div><article>x</article></div>", f"{LONG}\n{LONG}"),
        (f"<p>{LONG}</p><div class='userComments'><p>{LONG}</p></div><div id=cookiebar>{LONG}</div>", LONG),
        ("<p>un\nbroken\t lines</p>", "un broken lines"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_very_long_page():
    page = "<article>" + "".join(f"<p>Line {i}.</p>" for i in range(20_000)) + "</article>"
    assert main_text(page) == "\n".join(f"Line {i}." for i in range(20_000))


def brute_force(heights, window):
    """Lines between the zero windows around them, one line at a time."""
    sums = [sum(heights[max(0, i - window + 1) : i + 1]) for i in range(len(heights))]
    kept = set()
    for i, h in enumerate(heights):
        if h:
            a = i
            while a > 0 and sums[a - 1] > 0:
                a -= 1
            b = i
            while b + 1 < len(heights) and sums[b + 1] > 0:
                b += 1
            some = [j for j in range(a, b + 1) if heights[j]]
            kept.add((max(sums[a : b + 1]), some[0], some[-1] + 1))
    return sorted(kept, key=lambda s: s[1])


@given(st.lists(st.sampled_from([0, 0, 1, 7, 90]), max_size=40), st.integers(1, 6))
def test_stretches_against_brute_force(heights, window):
    assert html_text.stretches(heights, window) == brute_force(heights, window)


def test_windows_surge_and_dive():
    assert main_text(f"<p>tiny</p><nav>menu</nav><p>{LONG}</p>") == f"tiny\n{LONG}"  # what an element leaves is no dive
    apart = "<div><div><div><p>tiny</p></div></div></div>" + f"<p>{LONG}</p>"
    assert main_text(apart) == LONG
    assert html_text.stretches([5, 0, 0, 100, 0, 7], 3) == [(107, 0, 6)]
    assert html_text.stretches([5, 0, 0, 0, 100, 0, 7], 3) == [(5, 0, 1), (107, 4, 7)]


def test_window_and_surge_decide(monkeypatch):
    page = f"<p>tiny</p><div></div><p>{LONG}</p><div><div><div><p>Some thirty characters of text</p></div></div></div>"
    assert main_text(page) == f"tiny\n{LONG}"
    monkeypatch.setattr(html_text, "SURGE", 20)
    assert main_text(page) == f"tiny\n{LONG}\nSome thirty characters of text"
    monkeypatch.setattr(html_text, "SURGE", 80)
    monkeypatch.setattr(html_text, "WINDOW", 1)
    assert main_text(page) == LONG
    monkeypatch.setattr(html_text, "WINDOW", 9)
    assert main_text(page) == f"tiny\n{LONG}\nSome thirty characters of text"


@pytest.mark.parametrize("wrap", ["<div>{}</div>", "<section>{}</section>", "<div class='x1'><div>{}</div></div>", "<table><tr><td>{}</td></tr></table>", "{}"])
def test_pages_without_article_or_telling_names(wrap):
    page = "<html><body><div><a href=/>Home</a> <a href=/a>About</a></div><div>Welcome to site X, login here</div>" + wrap.format(f"<h1>T</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>End.</p>") + "<div>Read also: ten things.</div></body></html>"
    assert main_text(page) == f"T\n{LONG}\nShort.\n{LONG}\nEnd."


def test_article_is_no_frame():
    """A long paragraph outside the article is text too, and short blocks stay across what went."""
    assert main_text(f"<article><p>{LONG}</p></article><div><p>{LONG}</p></div>") == f"{LONG}\n{LONG}"
    assert main_text(f"<article><h1>T</h1><div class=share>x</div><nav>y</nav><p>{LONG}</p><div class=ad>z</div><div class=ad>z</div><form>f</form><p>Short end.</p></article>") == f"T\n{LONG}\nShort end."


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", "<p>é😀</p>", "t", 0), (1, "u", "<p>é😀</p>", "t", 0), (None, None, None, "t", 0)], "page_id long, url string, html string, text string, n_chars int")
    rows = html_text.extract(df, ["page_id", "url"]).select("row.page_id", "text", "n_chars").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, "é😀", 2), (1, "é😀", 2), (None, "", 0)]
    assert html_text.extract(df.limit(0), ["page_id"]).collect() == []


def test_query_against_the_articles(spark, sf):
    """In the test pages the main text is the article element, block by block."""
    got = {r["page_id"]: r for r in html_text.op10_html_extract(spark, sf).collect()}
    for page in storage.table(spark, sf, "pages").collect():
        inside = re.search(r"<article>(.*)</article>", page["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        text = "\n".join(b for b in blocks if b)
        r = got[page["page_id"]]
        assert (r["text"], r["n_chars"], r["url"]) == (text, len(text), page["url"])
