import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kilnframe.functions import hashing
from kilnframe.operators import cache, classes, diff, keys

T0 = dt.datetime(2024, 1, 1)


def walk(entries, refs, sizes, target, now=None, min_age=0):
    """The sequential eviction, told plainly."""
    left = sum(e[2] for e in entries) + sum(sizes.values())
    count = {}
    for k, h in {(k, h) for k, h in refs}:
        count[h] = count.get(h, 0) + 1
    out = []
    for key, mtime, size in sorted(entries, key=lambda e: (e[1], e[0])):
        if left <= target:
            break
        if now is not None and dt.timedelta(0) <= now - mtime < dt.timedelta(seconds=min_age):
            continue
        left -= size
        for h in {h for k, h in refs if k == key}:
            count[h] -= 1
            if not count[h]:
                left -= sizes.get(h, 0)
        out.append(key)
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_eviction_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    entries = [(k, T0 + dt.timedelta(hours=rng.randrange(100)), rng.randrange(1, 50)) for k in range(30)]
    refs = [(rng.randrange(30), rng.randrange(25)) for _ in range(60)]
    sizes = {h: rng.randrange(100) for h in range(20)}  # some blobs are gone
    target = rng.randrange(0, sum(e[2] for e in entries) + sum(sizes.values()))
    now, min_age = (T0 + dt.timedelta(hours=60), 3600 * 20) if seed % 2 else (None, 0)
    plan = cache.eviction_plan(
        spark.createDataFrame(entries, "cache_key long, mtime timestamp_ntz, ac_bytes long"), spark.createDataFrame(refs, "cache_key long, hash long"), spark.createDataFrame(list(sizes.items()), "hash long, size long"),
        target, now=F.lit(now) if now else None, min_age_secs=min_age,
    )
    assert sorted(r["cache_key"] for r in plan.collect()) == walk(entries, refs, sizes, target, now, min_age)


def test_eviction_trigger():
    assert cache.needs_eviction(101, 100) == 80 and cache.needs_eviction(100, 100) is None and cache.needs_eviction(500, 0) is None and cache.needs_eviction(500, 100, any_failed=True) is None


def recipes(spark, *labels):
    return spark.createDataFrame([(x, f"make {x}", "", {}) for x in labels], "label string, command string, cwd string, env map<string,string>")


def key_of(spark, inputs, outs):
    rows = keys.keyed(recipes(spark, "a", "b"), inputs, outs, "x").collect()
    return {r["label"]: r["cache_key"] for r in rows}


def test_early_cutoff(spark):
    """An edit of a's input changes a's key; b's key follows a's outputs alone."""
    files = lambda content: spark.createDataFrame([("a", "a.in", content, 1)], "label string, path string, content_hash string, size long")
    outs = lambda h: spark.createDataFrame([("b", h)], "label string, outputs_hash string")
    before, after, other = key_of(spark, files("11"), outs("aa")), key_of(spark, files("22"), outs("aa")), key_of(spark, files("22"), outs("bb"))
    assert before["a"] != after["a"] and before["b"] == after["b"] and other["b"] != after["b"]


def test_keys_by_level(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b")], "parent string, dep string")
    none = spark.createDataFrame([], "label string, path string, content_hash string, size long")
    entries = spark.createDataFrame([], "cache_key string, outputs_content_hash string, exit_code int")
    all_ = recipes(spark, "a", "b", "c")
    found = {r["label"]: r for r in keys.resolve_keys(all_, none, edges, entries, "x").collect()}
    assert all(r["outputs_hash"] is None for r in found.values())
    entries = spark.createDataFrame([(found["a"]["cache_key"], "0a", 0), (found["b"]["cache_key"], "0b", 1)], "cache_key string, outputs_content_hash string, exit_code int")
    again = {r["label"]: r for r in keys.resolve_keys(all_, none, edges, entries, "x").collect()}
    assert again["a"]["outputs_hash"] == "0a" and again["b"]["cache_key"] != found["b"]["cache_key"] and again["b"]["outputs_hash"] is None
    assert again["c"]["cache_key"] == found["c"]["cache_key"]  # b has no good entry, so c's key leaves it out
    assert {r["label"] for r in keys.resolve_keys(all_, none, edges, entries, "x", require_deps=True).collect()} == {"a", "b"}


def test_file_inputs(spark):
    files = spark.createDataFrame([(p, "h", 1) for p in ("src/a.go", "src/in/b.go", "src/node_modules/c.go", "src/sub/d.go", "lit.txt")], "path string, content_hash string, size long")
    inputs = spark.createDataFrame([("flat", "src/*.go"), ("deep", "src/**/*.go"), ("lit", "lit.txt"), ("lit", "gone.txt")], "label string, glob string")
    prune = spark.createDataFrame([("deep", "src/sub")], "label string, dir string")
    got = {}
    for r in keys.file_inputs(inputs, files, prune).collect():
        got.setdefault(r["label"], set()).add(r["path"])
    assert got == {"flat": {"src/a.go"}, "deep": {"src/a.go", "src/in/b.go"}, "lit": {"lit.txt"}}


def test_puts_hits_and_uploads(spark):
    e = lambda *rows: spark.createDataFrame(rows, "cache_key string, mtime long, exit_code int, duration_ms long")
    old, new = e(("a", 1, 0, 5), ("b", 1, 1, 6)), e(("a", 0, 0, 9))
    assert sorted((r["cache_key"], r["duration_ms"]) for r in cache.put_entries(old, new).collect()) == [("a", 9), ("b", 6)]
    assert [r["cache_key"] for r in cache.delete_entries(old, spark.createDataFrame([("a",), ("z",)], "cache_key string")).collect()] == ["b"]
    keyed = spark.createDataFrame([("x", "a"), ("y", "b"), ("z", None)], "label string, cache_key string")
    assert [(r["label"], r["state"], r["key"]) for r in cache.status(keyed, old).collect()] == [("x", "cached", "a"), ("y", "stale", "b"), ("z", "stale", "")]
    refs = spark.createDataFrame([("a", "h1"), ("a", "h2"), ("b", "h3")], "cache_key string, hash string")
    blobs = spark.createDataFrame([("h1", 10), ("h2", 99), ("h3", 5)], "hash string, size long")
    assert cache.hits(keyed, old, refs, blobs.where("hash <> 'h2'")).collect() == []
    first, then = cache.upload_batches(old, refs, blobs.where("hash = 'h1'"), blobs, 50)
    assert [r["hash"] for r in first.collect()] == ["h3"] and [r["cache_key"] for r in then.collect()] == ["b"]
    content = spark.createDataFrame([(b"x",), (b"x",), (b"y",)], "content binary")
    stored = cache.put_blobs(spark.createDataFrame([], "hash string"), content)
    assert stored.count() == 2 and cache.put_blobs(stored, content).count() == 0


def test_diffs(spark):
    a = spark.createDataFrame([("k1", "1"), ("k2", "2"), ("k3", None)], "key string, v string")
    b = spark.createDataFrame([("k1", "1"), ("k2", "9"), ("k4", "4")], "key string, v string")
    assert sorted(map(tuple, diff.keyed_diff(a, b, "key", "v").collect())) == [("k2", "2", "9"), ("k4", None, "4")]
    f = lambda *rows: spark.createDataFrame(rows, "path string, content string")
    assert sorted(map(tuple, diff.drift(f(("a", "1"), ("b", "1")), f(("b", "2"), ("c", "3"))).collect())) == [("a", "removed"), ("b", "changed"), ("c", "added")]
    none = spark.createDataFrame([], "label string, path string, content_hash string, size long"), spark.createDataFrame([], "label string, outputs_hash string")
    left = keys.keyed(recipes(spark, "t"), *none, "x")
    right = keys.keyed(recipes(spark, "t").withColumn("env", F.create_map(F.lit("A"), F.lit("1"))), *none, "x")
    assert [tuple(r) for r in diff.explain_diff(left, right).collect()] == [("env", "A", None, "1")]


def test_inputs_by_class(spark, monkeypatch):
    """Targets of equal inputs are one class, resolved once; overlapping globs give a file once, pruned folders part classes."""
    monkeypatch.setattr(classes, "MEMBERS", 2)
    files = spark.createDataFrame([(p, "h", 1) for p in ("s/a.c", "s/in/b.c", "t/a.c", "lit")], "path string, content_hash string, size long")
    named = {"x1": ("s/**", "s/*.c"), "x2": ("s/*.c", "s/**"), "x3": ("s/**", "s/*.c"), "x4": ("s/**", "s/*.c"), "p": ("s/**", "s/*.c"), "l": ("lit", "t/*"), "none": ("gone",)}
    inputs = spark.createDataFrame([(k, g) for k, v in named.items() for g in v] + [("x1", "s/**")], "label string, glob string")
    found = keys.input_classes(inputs, files, spark.createDataFrame([("p", "s/in")], "label string, dir string"))
    assert found.members.select("class").distinct().count() == 4 and found.rows.count() == 5
    whole = {("x%d" % i, p) for i in (1, 2, 3, 4) for p in ("s/a.c", "s/in/b.c")} | {("p", "s/a.c"), ("l", "lit"), ("l", "t/a.c")}
    assert sorted((r["label"], r["path"]) for r in found.expanded().collect()) == sorted(whole)
    outputs = spark.createDataFrame([("x1", "out/a.o"), ("x1", "out/b.o")], "label string, path string")
    grants = sorted(map(tuple, keys.sandbox_grants(found, outputs, ".tmp").collect()))
    assert grants == sorted([(k, "ro", p) for k, p in whole] + [("x1", "rw", "out"), ("x1", "rw", ".tmp")])
    assert grants == sorted(map(tuple, keys.sandbox_grants(found.expanded(), outputs, ".tmp").collect()))


def test_keys_by_class(spark, monkeypatch):
    """Keys from classes of inputs are those from rows, with null contents, without files and in large classes; files are sorted before targets join."""
    monkeypatch.setattr(classes, "MEMBERS", 2)
    text = spark.createDataFrame([("s/a-b.c", "1"), ("s/a/b.c", "2"), ("s/n.c", None), ("t/a.c", "4")], "path string, content string")
    files = keys.hashed_files(text)
    inputs = spark.createDataFrame([(f"x{i}", "s/**") for i in range(5)] + [("y", "t/a.c"), ("y", "s/*.c"), ("z", "gone")], "label string, glob string")
    found = keys.input_classes(inputs, files)
    outs = spark.createDataFrame([("x1", "aa"), ("x1", "BB")], "label string, outputs_hash string")
    made = recipes(spark, *(f"x{i}" for i in range(5)), "y", "z", "bare")
    by_class, by_row = keys.keyed(made, found, outs, "p"), keys.keyed(made, found.expanded(), outs, "p")
    flat = lambda df: sorted((r["label"], r["cache_key"], sorted(map(tuple, r["file_inputs"]), key=str), r["dep_outputs"]) for r in df.collect())
    assert flat(by_class) == flat(by_row) and len(flat(by_row)) == 8
    plain = hashing.cache_key(F.col("command"), F.col("cwd"), F.col("env"), F.col("file_inputs"), F.col("dep_outputs"), "p")
    assert by_class.where(~plain.eqNullSafe(F.col("cache_key"))).count() == 0
    broken = spark.createDataFrame([("y", "t/a.c", "no hash")], "label string, path string, content_hash string")
    assert {r["label"]: r["cache_key"] is None for r in keys.keyed(recipes(spark, "y", "z"), broken, outs, "p").collect()} == {"y": True, "z": False}
    plan = by_class.select("cache_key")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and "split(" not in plan[: plan.index("Join LeftOuter")]


def test_file_inputs_make_no_pair_distinct(spark):
    """Files are made distinct for each class; no pair of target and file is shuffled or compared after the last join."""
    files = spark.createDataFrame([(f"s/{i}.c", "h", 1) for i in range(5)], "path string, content_hash string, size long")
    inputs = spark.createDataFrame([(f"x{i}", g) for i in range(20) for g in ("s/*.c", "s/**", "s/3.c")], "label string, glob string")
    got = keys.file_inputs(inputs, files)
    assert got.count() == 100 and got.distinct().count() == 100
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    top = next(line for line in plan if "Join" in line)
    assert "class" in top and not any("Aggregate" in line for line in plan[: plan.index(top)])


def test_members_meet_arrays_of_rows(spark, monkeypatch):
    """A joined row holds an array of a class's rows, not one of them, and a large class is several arrays; nulls and repeats stay."""
    monkeypatch.setattr(classes, "MEMBERS", 3)
    monkeypatch.setattr(classes, "ROWS", 4, raising=False)
    members = spark.createDataFrame([(f"x{i}", "big") for i in range(10)] + [("y", "small"), ("z", "without")], "label string, class string")
    named = [("big", f"s/{i}.c", None if i == 7 else i) for i in range(40)] + [("big", "s/5.c", 5), ("small", "t/a.c", 1), ("nobody's", "u/a.c", 2)]
    got = classes.Classed(members, spark.createDataFrame(named, "class string, path string, size long")).expanded()
    want = [(f"x{i}", p, n) for i in range(10) for c, p, n in named if c == "big"] + [("y", "t/a.c", 1)]
    assert got.columns == ["label", "path", "size"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(" in plan[: plan.index("Join")] and "_array" in plan[plan.index("Join") :].splitlines()[0]


def test_a_row_comes_with_a_block_of_labels(spark, monkeypatch, tmp_path):
    """A file comes with all labels of a block before the next one does, so that written pairs take well under a byte each; no
    generated code holds a block's labels times an array's rows."""
    monkeypatch.setattr(classes, "TASKS", 4, raising=False)
    monkeypatch.setattr(classes, "SPREAD", 1, raising=False)
    members = spark.range(1536).select(F.concat(F.lit("//part:p"), "id").alias("label"), F.lit("big").alias("class"))
    rows = spark.range(1500).select(F.lit("big").alias("class"), F.concat(F.lit("src/en/"), "id", F.lit(".txt")).alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.col("id").alias("size"))
    got = classes.Classed(members, rows).expanded()
    got.write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 1536 * 1500 and back.agg(F.count_distinct("label", "path")).first()[0] == 1536 * 1500
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.6 * 1536 * 1500
    first = [r["path"] for r in got.limit(512).collect()]
    assert len(set(first)) == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline(array_sort(" in plan and ") Generate inline(array_sort(" not in plan


def test_grants_come_in_blocks(spark):
    """A file granted to a class's targets comes with a block of their labels, not a label with all files."""
    files = spark.createDataFrame([(f"s/{i}.c", "h", 1) for i in range(5)], "path string, content_hash string, size long")
    inputs = spark.createDataFrame([(f"x{i}", "s/**") for i in range(6)], "label string, glob string")
    got = keys.sandbox_grants(keys.input_classes(inputs, files), spark.createDataFrame([("x1", "out/a.o")], "label string, path string"), ".tmp")
    assert got.count() == 32
    assert "Generate inline(array_sort(" in got._jdf.queryExecution().executedPlan().toString()
