import random
from collections import Counter, defaultdict

import pytest

from kilnframe.llm import mixing, registry

SCHEMA = "doc_id long, text string, source string, h string, last int, whole string, copies string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "h", 1, "w", "c") for i, t, s in rows], SCHEMA)


def targets(sizes, epochs=3):
    """Water-filling, told plainly: share by weight, cap, share the rest again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    got, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > epochs * sizes[s]}
        if not over:
            return got | {s: left * weight[s] / total for s in open_}
        for s in over:
            got[s] = float(epochs * sizes[s])
        left -= sum(got[s] for s in over)
        open_ -= over
    return got


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_totals(spark, seed):
    rng = random.Random(seed)
    sources = ["b", "a", "é", "Z", None]
    rows = [(i, " ".join(["w"] * rng.choice((0, 1, 5, 30, 200))), rng.choices(sources, (50, 5, 3, 1, 4))[0]) for i in range(400)]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = targets(dict(sizes))
    by_id = {r["doc_id"]: r for r in got}
    taken = defaultdict(int)
    for i, t, s in rows:
        r = by_id[i]
        assert r["size"] == len(t.split()) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 100 + 1e-6  # half the longest text
    assert {r["doc_id"]: r["taken"] for r in mixing.mix_sources(frame(spark, rows[::-1])).collect()} == {r["doc_id"]: r["taken"] for r in got}


def test_edge_cases(spark):
    assert mixing.mix_sources(frame(spark, [])).collect() == []
    rows = [(1, None, "a"), (2, "", None), (None, "x y", "a"), (3, "\x0b\x0c\t\n\r", "b"), (4, "non breaking\x00 word", "b"), (4, "non breaking\x00 word", "b")]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    assert Counter(r["size"] for r in got) == Counter([0, 0, 2, 0, 2, 2])
    mix = mixing.mixed(frame(spark, rows))
    assert mix.columns == [c for c in SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")]
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mix.collect()) == +want


def test_query(spark, sf, same_rows):
    same_rows(mixing.op3_source_mix(spark, sf), registry.ORACLE_SQL["op3_source_mix"], sf)
    nodes = mixing.op3_source_mix(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in nodes and "Arrow" not in nodes
