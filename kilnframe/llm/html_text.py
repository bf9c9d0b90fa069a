"""Main text of web pages by the line-block distribution.

Markup is stripped to lines, one for each block of text; elements that never hold main text (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments) go with their content. Where one went, and where a
layout element begins or ends, an empty line stands, FRAME_GAP of them where an article or main element does. A line's
height is its characters; links count for it only within article and main elements, and so do short lines that stand in
no element of prose (PROSE). Heights are summed over sliding windows of WINDOW lines. A surge is where the windows rise
from nothing, a dive where they fall back to nothing. Text between a surge and its dive is kept, from the first line of
some height to the last, if its windows reach SURGE, whatever elements hold it.

Defined cases: null or empty html gives an empty text; a page without any window of surge height keeps its highest
stretch, one without any height is read with all its lines, and one all of whose text lies under a suspect name without
regard to names; unclosed and misnested tags end with their container; repeated rows are extracted alike; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

WINDOW = 3
#: Height that a window of a surge has at least, and characters that give a line without an element of prose any height.
SURGE = 80
#: Empty lines at the ends of article and main elements.
FRAME_GAP = 3

# Fixed values of HTML: elements without content, elements whose content is no markup, and elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav object ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul video audio".split()
)
CHROME = frozenset("nav footer aside form head button select option menu dialog svg object video audio canvas map search fieldset label datalist".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption summary address".split())
LAYOUT = frozenset("div section table center details".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
#: Words of class and id names that mark what isn't main text.
CHROME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|banner|sponsor(?:ed|s)?|promo(?:tion|s)?|comments?|commentlist|disqus|respond|replies|reply|discussion|"
    r"sidebar\w*|side-bar|widget|nav|navbar\w*|navigation|menu|breadcrumbs?|pagination|pager|cookie\w*|consent|gdpr|notice|notification|alert|popup|pop-up|modal|overlay|newsletter|subscribe|subscription|"
    r"signup|login|social|share|sharing|related|recommended|recommendations|footer|masthead|toolbar|skip-link|disclaimer|copyright|tags|tagcloud)(?:$|[\s_-])",
    re.I,
)
#: Beginnings of names that tell of a layout rather than of what the element holds.
LAYOUT_NAMES = ("no-", "has-", "with-", "without-", "is-", "js-", "layout-", "body-")
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article(?:-?body)?|main-?content|post-?content|entry-?content|story-?body)(?:$|[\s_-])", re.I)

_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|$)", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b", re.S)
#: A tag that begins one of these ends an open one of those first.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Lines:
    """Lines of a page: text, plain (characters outside links, 0 if few) and height. Gaps are empty lines."""

    def __init__(self, page: str, by_name: bool = True):
        self._by_name = by_name
        self.text: list[str] = []
        self.plain: list[int] = []
        self.height: list[int] = []
        self._parts: list[str] = []
        self._linked = 0
        self._stack: list[tuple[str, bool, bool, bool]] = []  # name, chrome, link, main
        self._chrome = self._links = self._mains = self._articles = self._prose = 0
        self._cut = False  # the last line stands for an element that went
        self._read(page)
        self._end()

    def _end(self) -> None:
        text = " ".join(entities.unescape("".join(self._parts)).split()) if self._parts else ""
        if text:
            plain = len(text) - self._linked
            plain = plain if 5 * plain > len(text) else 0
            self.text.append(text)
            self.plain.append(plain)
            self.height.append(len(text) if self._mains else plain if self._prose or plain >= SURGE else 0)
            self._cut = False
        self._parts, self._linked = [], 0

    def _gap(self, lines: int) -> None:
        self.text += [""] * lines
        self.plain += [0] * lines
        self.height += [0] * lines

    def _data(self, text: str) -> None:
        if text and not self._chrome:
            self._parts.append(text)
            if self._links:
                self._linked += len(text.strip())

    def _push(self, name: str, attributes: str) -> None:
        chrome = name in CHROME or (name == "header" and not self._mains)
        main = name in ("article", "main")
        if attributes.strip():
            found = {(m[1] or m[5]).lower(): next((g for g in (m[2], m[3], m[4]) if g is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
            names = f"{found.get('class', '')} {found.get('id', '')}"
            role = found.get("role", "").lower()
            main = main or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody" or bool(MAIN_NAMES.search(names))
            if name not in ("html", "body", "article", "main"):
                hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
                named = self._by_name and not main and any(CHROME_NAMES.search(_CAMEL.sub("-", x)) for x in names.split() if not x.lower().startswith(LAYOUT_NAMES))
                chrome = chrome or role in CHROME_ROLES or hidden or named
        if name in BLOCK or chrome or main:
            self._end()
            self._edge(name, chrome, main)
        self._stack.append((name, chrome, name == "a", main))
        self._chrome += chrome
        self._links += name == "a"
        self._mains += main
        self._articles += name == "article"
        self._prose += name in PROSE

    def _edge(self, name: str, chrome: bool, main: bool) -> None:
        """The empty lines where an element begins or ends, seen from outside it."""
        if self._chrome:
            return
        if chrome:
            if not self._cut:
                self._gap(1)
            self._cut = True
        elif (main and not self._mains) or (name == "article" and not self._articles):
            self._gap(FRAME_GAP)
        elif name in LAYOUT and not self._mains:
            self._gap(1)

    def _pop(self) -> None:
        name, chrome, link, main = self._stack.pop()
        if name in BLOCK or chrome or main:
            self._end()
        self._chrome -= chrome
        self._links -= link
        self._mains -= main
        self._articles -= name == "article"
        self._prose -= name in PROSE
        if name in BLOCK or chrome or main:
            self._edge(name, chrome, main)

    def _close(self, name: str) -> None:
        for depth in range(len(self._stack) - 1, -1, -1):
            if self._stack[depth][0] == name:
                while len(self._stack) > depth:
                    self._pop()
                return
            if self._stack[depth][0] in ("article", "main", "body", "nav", "aside", "footer", "table", "td") and name not in BLOCK:
                break  # an inline end tag doesn't end its container
        if name in BLOCK:
            self._end()

    def _open(self, name: str, attributes: str) -> None:
        if name in BLOCK:  # a block ends an open paragraph, with what is open in it
            for depth in range(len(self._stack) - 1, -1, -1):
                if self._stack[depth][0] == "p":
                    while len(self._stack) > depth:
                        self._pop()
                    break
                if self._stack[depth][0] in BLOCK:
                    break
        for other in _CLOSES.get(name, ()):
            for depth in range(len(self._stack) - 1, -1, -1):
                if self._stack[depth][0] == other:
                    while len(self._stack) > depth:
                        self._pop()
                    break
                if self._stack[depth][0] in ("ul", "ol", "dl", "table", "select", "nav", "article", "main"):
                    break
        if name in VOID:
            if name in BLOCK:
                self._end()
            elif name == "br":
                self._data(" ")
        elif not attributes.rstrip().endswith("/") or name in BLOCK:
            self._push(name, attributes)

    def _read(self, page: str) -> None:
        at, lower = 0, None
        while True:
            start = page.find("<", at)
            if start < 0:
                self._data(page[at:])
                return
            self._data(page[at:start])
            m = _TOKEN.match(page, start) or _LOOSE.match(page, start)
            if not m:
                self._data("<")
                at = start + 1
                continue
            at = m.end()
            if m.lastindex is None or not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                self._close(name)
            elif name in RAW:
                lower = lower or page.lower()
                end = (lower if len(lower) == len(page) else page).find(f"</{name}", at)
                at = len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
            else:
                self._open(name, m[3])


def stretches(height: list[int], window: int) -> list[tuple[int, int, int]]:
    """(highest window, first line of some height, line after the last) between each surge and its dive."""
    found, first, last, top, total = [], None, 0, 0, 0
    for i in range(len(height) + window):
        total += (height[i] if i < len(height) else 0) - (height[i - window] if i >= window else 0)
        if total > 0:
            first = i if first is None else first
            last = i if i < len(height) and height[i] else last
            top = max(top, total)
        elif first is not None:
            found.append((top, first, last + 1))
            first, top = None, 0
    return found


def main_text(page: str | None) -> str:
    """Blocks between surges and dives, in page order, joined by line breaks."""
    for by_name in (True, False):
        lines = Lines(page or "", by_name)
        for height in (lines.height, lines.plain, [len(t) for t in lines.text]):
            if found := stretches(height, WINDOW):
                least = min(SURGE, max(top for top, _, _ in found))
                return "\n".join(t for top, a, b in found if top >= least for t in lines.text[a:b] if t)
    return ""


def extract(pages: DataFrame, columns: list[str], html_col: str = "html") -> DataFrame:
    """The given columns of pages, text and n_chars (its code points)."""
    kept = pages.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{html_col}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["row", "text", "n_chars"])

    return storage.map_arrow(kept, run, storage.schema_of(row=kept.schema["row"].dataType, text="string", n_chars="long"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(storage.table(spark, sf_dir, "pages"), ["page_id", "url"]).select("row.page_id", "row.url", "text", "n_chars")
