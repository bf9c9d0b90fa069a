import math

import numpy as np
from pyspark.sql import functions as F

from kilnframe.llm import ann, registry, storage

SCHEMA = "vec_id long, embedding array<float>, id string, v int, is_query boolean"


def distance(x, y):
    total = 0.0
    for a, b in zip(x, y, strict=True):
        d = float(a) - float(b)
        total += d * d
    return math.sqrt(total)


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        rows = sorted((distance(vectors[q], v), i) for i, v in vectors.items() if i != q)
        out[q] = [(i, s) for s, i in rows[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_edge_cases(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [math.nan, 1.0]), (6, [math.inf, 0.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (9, []), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (10, [0.0, 3.0]),
    ]
    df = spark.createDataFrame([(i, v, "x", 1, None) for i, v in rows], SCHEMA)
    got = found(ann.search(df, F.col("id") % 10 == 0, k=3))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [1, 1, 2], 10: [1, 1, 2]}  # ties: the smaller id; rows that share an id are candidates each
    assert got[0][0][1] == 1.0
    assert [len(v) for v in found(ann.search(df, F.col("id") == 0, k=10)).values()] == [4]


def test_rows_that_share_an_id_and_minor_dimensions(spark):
    rows = [(10, [1.0, 0.0]), (10, [4.0, 0.0]), (11, [2.0, 0.0]), (20, [1.0, 2.0, 3.0]), (21, [1.0, 2.0, 4.0]), (22, [9.0])]
    df = spark.createDataFrame([(i, v, "x", 1, None) for i, v in rows], SCHEMA)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, F.col("id") % 10 == 0, k=5).collect())
    assert got == [(10, 1, 11, 1.0), (10, 1, 11, 2.0), (10, 2, 10, 3.0), (10, 2, 10, 3.0), (20, 1, 21, 1.0)]


def test_huge_and_tiny_components(spark):
    rng = np.random.default_rng(5)
    schema = "vec_id long, embedding array<double>"
    vectors = {i: rng.standard_normal(4).tolist() for i in range(60)}
    vectors |= {60: [1e200, 0.0, 0.0, 0.0], 61: [-1.7e308, 1.7e308, 0.0, 1.0], 62: [1e-200, 0.0, 0.0, 0.0], 63: [1e-200, 1e-300, 0.0, 0.0]}
    want = {}
    for q in (0, 10, 60, 61):
        rows = [(distance(vectors[q], v), i) for i, v in vectors.items() if i != q]
        want[q] = [(i, s) for s, i in sorted(rows)[:10]]
    got = found(ann.search(spark.createDataFrame(list(vectors.items()), schema), F.col("id").isin(0, 10, 60, 61)))
    assert got == want


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ann.search(empty, F.col("id") == 0).collect() == []
    assert ann.search(spark.createDataFrame([(1, [1.0], "", 0, None)], SCHEMA), F.lit(True)).collect() == []


def test_blocks_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 40)
    monkeypatch.setattr(ann, "LEAST_BLOCK", 10)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(1)
    vectors = {i: rng.standard_normal(16).astype(np.float32).tolist() for i in range(150)}
    vectors |= {i: vectors[3] for i in range(150, 190)}  # many copies of one vector
    df = spark.createDataFrame([(i, v, "", 0, None) for i, v in vectors.items()], SCHEMA)
    queries = [i for i in vectors if i % 10 == 0]
    assert found(ann.search(df, F.col("id") % 10 == 0, k=5)) == brute(vectors, queries, 5)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((3000, 32)), rng.standard_normal((20, 32))
    turn, centre = ann.rotation(32, 256), x.mean(axis=0)
    codes = ann.Codes(x, centre, turn)
    assert codes.packed.shape == (3000, 32)  # 256 bits
    length = np.linalg.norm(q - centre, axis=1)
    guess, low = codes.estimates(length, ((q - centre) @ turn) / length[:, None], ann.EPSILON)
    true = ((x[None] - q[:, None]) ** 2).sum(axis=2)
    assert (low <= true + 1e-6).mean() > 0.85  # EPSILON standard errors, one-sided
    assert abs((guess - true).mean()) < 0.05 * true.mean()


def test_few_vectors_are_reranked():
    """Under 5 % of some 10,000 vectors are compared exactly, and at least 0.9 of the neighbours found."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/check_s/embeddings.parquet")
    v = np.array(table["embedding"].to_pylist(), dtype=float)
    rows, ids, seen = np.arange(len(v)), table["vec_id"].to_numpy(), []
    asks = np.flatnonzero(ids % 100 == 0)
    got = ann.nearest(rows, ids, v, rows[asks], v[asks], ann.rotation(v.shape[1], ann.CODE_BITS), 10, ann.EPSILON, seen)
    hits = 0
    for (_, near, _), q in zip(got, asks, strict=True):
        d = ann.exact(v[q], v)
        d[q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & set(near))
    assert np.mean(seen) < 0.05 * len(v) and hits >= 0.9 * 10 * len(asks)


def test_query_is_exact_here(spark, sf, same_rows):
    same_rows(ann.op2_ann_onebit(spark, sf), registry.ORACLE_SQL["op2_ann_onebit"], sf)


def test_recall(spark, sf):
    rows = {r["vec_id"]: r["embedding"] for r in storage.table(spark, sf, "embeddings").collect()}
    want = brute(rows, [i for i in rows if i % 100 == 0], 10)
    got = found(ann.op2_ann_onebit(spark, sf))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
