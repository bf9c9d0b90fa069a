import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kilnframe.operators import events

T0 = dt.datetime(2024, 1, 1)


def batches(times, quiet, most):
    """Debouncing, told plainly: (first, last, flushed, paths)."""
    out, open_ = [], None
    for us, path in sorted(times):
        if open_ and us >= min(open_[1] + quiet, open_[0] + most):
            out.append(open_)
            open_ = None
        open_ = [open_[0], us, open_[2] | {path}] if open_ else [us, us, {path}]
    return [(a, b, min(b + quiet, a + most), tuple(sorted(p))) for a, b, p in out + ([open_] if open_ else [])]


@pytest.mark.parametrize("seed", range(4))
def test_debounce_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    times, at = [], 0
    for _ in range(200):
        at += rng.choice([0, 5_000, 60_000, 100_000, 140_000])
        times.append((at, f"p{rng.randrange(5)}"))
    base = 1_704_067_200_000_000
    df = spark.createDataFrame([("k", base + us, p) for us, p in times], "key string, us long, path string").select("key", F.timestamp_micros("us").alias("ts"), "path")
    got = [(r["first_us"] - base, r["last_us"] - base, r["flushed_us"] - base, tuple(r["paths"])) for r in events.debounce(df, ["key"], "ts", "path", 100_000, 500_000).orderBy("batch").collect()]
    assert got == batches(times, 100_000, 500_000)


def test_counts_and_state(spark):
    kinds = ["built", "cache_hit", "remote_cache_hit", "external_cache_hit", "skipped"]
    r = spark.createDataFrame([("b1", "x", k, i) for i, k in enumerate(kinds)] + [("b2", "y", "failed", 9), ("b2", "z", "failed", 7)], "build string, id string, result string, seq int")
    got = {x["build"]: x for x in events.build_counts(r).collect()}
    assert tuple(got["b1"])[1:] == (1, 3, 0, 1, True) and not got["b2"]["ok"]
    assert [x["id"] for x in events.failed_set(r).collect()] == ["z", "y"]
    assert {x["id"]: x["result"] for x in events.latest_state(r, ["id"]).collect()} == {"x": "skipped", "y": "failed", "z": "failed"}


def test_logs(spark):
    lines = spark.createDataFrame([("a", i, "x" * 9) for i in range(5)], "id string, seq int, line string")
    kept = events.last_n(lines, ["id"], "seq", 2).collect()
    assert sorted(r["seq"] for r in kept) == [3, 4] and {r["dropped"] for r in kept} == {3}
    capped = events.capped_log(lines, ["id"], "seq", cap=25).orderBy("seq").collect()
    assert [(r["seq"], r["truncated"]) for r in capped] == [(0, False), (1, False), (2, True)]
    stored = spark.createDataFrame([("a", "l1\nl2\n", "e1"), ("b", "", None)], "id string, stdout string, stderr string")
    assert [tuple(r) for r in events.replay(stored).collect()] == [("a", "stdout", 0, "l1"), ("a", "stdout", 1, "l2"), ("a", "stderr", 0, "e1")]


def test_skips_name_their_reason(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "x"), ("d", "x")], "parent string, dep string")
    label = lambda *x: spark.createDataFrame([(i,) for i in x], "label string")
    got = events.skip_propagation(label("a"), edges, label("a", "b", "c", "d"))
    assert sorted(map(tuple, got.collect())) == [("b", "a"), ("c", "b")]


def test_changed_only_after_errors(spark):
    rows = spark.createDataFrame([("k", i, v) for i, v in enumerate(["a", "a", None, "a", "b", "b"])], "k string, n int, v string")
    assert [r["n"] for r in events.distinct_until_changed(rows, ["k"], ["n"], "v").orderBy("n").collect()] == [0, 3, 4]


def test_silence(spark):
    rows = spark.createDataFrame([("k", T0 + dt.timedelta(seconds=s)) for s in (0, 2, 7)], "k string, ts timestamp")
    assert sorted(r["secs"] for r in events.silent_gaps(rows, ["k"], "ts").collect()) == [3, 4, 5]


def test_every_beat_of_long_silences(spark, sf):
    from kilnframe.plans import queries

    got = queries.QUERIES["heartbeats_all"](spark, sf).groupBy("key", "silent_since").agg(F.min("secs").alias("a"), F.max("secs").alias("z"), F.count("*").alias("n")).collect()
    assert max(r["z"] for r in got) > 20 and all(r["a"] == 3 and r["n"] == r["z"] - 2 for r in got)


def test_single_slot(spark):
    asked = spark.createDataFrame([("a", 0, 10), ("b", 1, 5), ("c", 2, 5), ("d", 20, 1)], "build string, at long, duration long")
    got = {r["build"]: (r["outcome"], r["start"]) for r in events.single_slot(asked).collect()}
    assert got == {"a": ("run", 0), "b": ("superseded", 2), "c": ("run", 10), "d": ("run", 20)}


def test_until_terminal(spark):
    rows = spark.createDataFrame([(1, "hello"), (2, "logs.line"), (3, "logs.end"), (4, "late")], "seq int, t string")
    assert [r["seq"] for r in events.until_terminal(rows, ["logs.end"]).collect()] == [1, 2, 3]
    assert events.until_terminal(rows, ["never"]).count() == 4


@pytest.mark.parametrize(("spread", "longest"), [(3, 40), (30, 2), (9, 300)])
def test_single_slot_in_chunks(spark, monkeypatch, spread, longest):
    """Chunks give what a plain loop over all requests gives, however their histories meet; the fold keeps no outputs."""
    monkeypatch.setattr(events, "CHUNK", 60)
    rng = random.Random(spread)
    at, rows = 0, []
    for i in range(700):
        at += rng.randrange(spread)
        rows.append((f"b{i:04}", at, rng.randrange(longest)))
    want, free, waiting = [], None, None
    for build, at, duration in sorted(rows, key=lambda r: (r[1], r[0])):
        if waiting and free <= at:
            want.append((waiting[0], "run", free))
            free, waiting = free + waiting[1], None
        if free is None or free <= at:
            want.append((build, "run", at))
            free = at + duration
        else:
            if waiting:
                want.append((waiting[0], "superseded", at))
            waiting = (build, duration)
    want += [(waiting[0], "run", free)] if waiting else []
    rng.shuffle(rows)
    asked = spark.createDataFrame(rows, "build string, at long, duration long")
    assert sorted(map(tuple, events.single_slot(asked).collect())) == sorted(want)
    assert events.single_slot(asked.limit(0)).count() == 0
