import re
from collections import Counter

from kilnframe.llm import quality, registry, storage

SCHEMA = "doc_id long, text string, lang string, source string, row string, n_words int, _w string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "r", 1, "w") for i, t, lang, s in rows], SCHEMA)


def stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = list(zip(w, w[1:], w[2:]))
    n = Counter(grams)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n \n", "one", "a b c", "a b c a b c", "a a a a a a", "x y z\nx y z\n\nx y z", "é ñ 😀 ü\x00 #*$ a|b <c>", "the same the same the same the same end", "w " * 3000, "p q r s t u v w p q r",
    " ".join(f"w{i}" for i in range(500)), " ".join(f"w{i % 100}" for i in range(500)), "A\r\nA\r\nB B", "\x85a\xa0b \x1cc",
]


def test_stats(spark):
    got = {r["i"]: tuple(r[c] for c in quality.STATS[:5]) for r in quality.measure(frame(spark, [(i, t, "en", "s") for i, t in enumerate(TEXTS)]), ["doc_id"]).select("row.doc_id", *quality.STATS).withColumnRenamed("doc_id", "i").collect()}
    assert got == {i: stats(t) for i, t in enumerate(TEXTS)}


def test_repeats_are_exact_in_very_long_texts(spark):
    """A million words: whole hashes are compared, so no chance repeat counts."""
    words = [f"w{i}" for i in range(1_000_000)] + ["w5", "w6", "w7", "end"]
    got = quality.measure(frame(spark, [(1, " ".join(words), "en", "s")]), ["doc_id"]).first()
    assert (got["n_words"], got["n_repeat_words"]) == (1_000_004, 6)


def test_query_with_groups_of_both_sizes(spark, duck):
    """sf0.1 has groups above and below MIN_GROUP. The SQL's quantiles are exact, sketches of over SKETCH_K texts nearly so."""
    sf = "/root/testdata/sf0.1"
    columns, rows = duck(registry.ORACLE_SQL["op5_quality_rules"], sf)
    want = {r[columns.index("doc_id")]: dict(zip(columns, r, strict=True)) for r in rows}
    got = {r["doc_id"]: r.asDict() for r in quality.op5_quality_rules(spark, sf).collect()}
    sizes = [r["count"] for r in storage.table(spark, sf, "documents").groupBy("lang", "source").count().collect()]
    assert min(sizes) < quality.MIN_GROUP <= max(sizes) and got.keys() == want.keys()
    assert all(got[i][c] == want[i][c] for i in got for c in columns if c != "kept")
    assert sum(got[i]["kept"] != want[i]["kept"] for i in got) <= 0.001 * len(got)
    assert sum(not r["kept"] and not r["base_failed"] for r in got.values()) > 100


def test_cutoffs_spare_the_clean_and_find_junk(spark):
    clean = [" ".join(f"wo{(i * 7 + j * j) % 997}rd" for j in range(60 + i % 30)) for i in range(150)]
    junk = [" ".join(f"wo{i}x{j}rd###$$$" for j in range(80)) for i in range(40)] + [c.upper() + "!!" for c in clean[:30]]
    rows = [(i, t, "en", "s") for i, t in enumerate(clean)] + [(1000 + i, t, "en", "s") for i, t in enumerate(junk)]
    rows += [(2000 + i, clean[i], None, None) for i in range(5)] + [(3000, None, "en", "s"), (3001, junk[0], None, "tiny")]
    got = {r["doc_id"]: r for r in quality.judge(frame(spark, rows), ["doc_id", "row"]).select("row.*", "kept", "base_failed").collect()}
    assert all(got[i]["kept"] for i in range(150)) and all(got[2000 + i]["kept"] for i in range(5))
    assert not any(got[1000 + i]["kept"] for i in range(len(junk))) and got[3000]["base_failed"] and not got[3001]["kept"]


def test_empty_and_whole_rows(spark):
    assert quality.judge(frame(spark, []), ["doc_id"]).collect() == []
    columns = ["doc_id", "text", "lang", "source", "row", "n_words", "_w"]
    rows = [(1, "x " * 10, "en", "s")] * 3
    assert quality.judge(frame(spark, rows), columns).select("row.*").columns == columns
    assert quality.judge(frame(spark, rows), columns).count() == 3


def test_sketches_merge(spark):
    measured = quality.measure(frame(spark, [(i, " ".join(f"w{i}{j}" for j in range(60)), "en", f"s{i % 3}") for i in range(90)]), ["doc_id"])
    rows = quality.sketches(measured)
    assert rows.count() == 3 and rows.agg({"n": "sum"}).first()[0] == 90
    assert quality.cutoffs(rows).count() == 3


def test_query(spark, sf, same_rows):
    same_rows(quality.op5_quality_rules(spark, sf), registry.ORACLE_SQL["op5_quality_rules"], sf)
    plan = quality.op5_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quality.op5_quality_rules(spark, sf).count() == storage.table(spark, sf, "documents").count()
