"""Nearest neighbours by randomly rotated one-bit codes.

A vector less a centre is rotated, padded to CODE_BITS, and kept as the signs of its coordinates (packed bits) with two
scalars: its length and the inner product of its unit vector with its code. For a query, the code's inner product
divided by that scalar estimates the true one without bias, within an error bound that shrinks with CODE_BITS. In each
block the k vectors of smallest estimate are compared exactly first; of the others those are reranked, by their exact
distance, whose lower bound does not exceed the k-th of these distances, or whose bound is not finite. The centre is the
block's median (of at most SAMPLE of its vectors); every vector is coded.

Queries and vectors are dealt into blocks of bounded size, and each block of queries meets each block of vectors in
one task, so memory doesn't grow with either. A task sends k rows for each of its queries at most.

Defined cases: a vector that is null, empty, all zero, or holds a null or non-finite component takes no part, nor does
a null id; vectors of different dimensions are no neighbours of each other; every other row is a candidate, also one that
shares the query's id or vector, and rows that share an id are queries of their own under it; ties of distance go to the
smaller id; distances beyond double precision are infinite; fewer candidates than k give all of them; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship
from . import storage

K = 10
EVERY = 100
CODE_BITS = 256
#: Standard errors of the estimate that a bound spans.
EPSILON = 1.2
SAMPLE = 1024
#: Vectors and queries that meet in one task at most; fewer vectors, down to LEAST_BLOCK, if tasks would stand idle.
BLOCK, LEAST_BLOCK = 65_536, 4_096
QUERY_BLOCK = 32_768
_CHUNK = 64
SEED = 20


def rotation(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """dim x bits: the first rows of a random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def lengths(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths, whatever the exponents."""
    most = np.abs(rows).max(axis=1, initial=0)
    with np.errstate(over="ignore"):
        return most * np.linalg.norm(rows / np.where(most > 0, most, 1.0)[:, None], axis=1)


class Codes:
    """Packed one-bit codes of vectors, with the scalars that turn code products into estimates."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.bits = turn.shape[1]
        moved = vectors / 2 - centre / 2  # halves, so no difference overflows
        half = lengths(moved)
        unit = (moved / np.where(half > 0, half, 1.0)[:, None]) @ turn
        self.length = 2 * half
        self.packed = np.packbits(unit > 0, axis=1)
        # <code, unit> with the code scaled to a unit vector; for a vector in the centre any value serves
        self.match = np.where(half > 0, np.abs(unit).sum(axis=1) / np.sqrt(self.bits), 1.0)
        self._signs: np.ndarray | None = None

    def estimates(self, length: np.ndarray, unit: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances to queries (lengths and rotated unit vectors from the centre) and lower bounds."""
        if self._signs is None:  # unpacked once for all queries of the block
            self._signs = np.unpackbits(self.packed, axis=1).astype(np.float32).T
        unit = unit.astype(np.float32)
        product = (2 * (unit @ self._signs) - unit.sum(axis=1)[:, None]) / np.sqrt(self.bits)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            slack = epsilon * np.sqrt(np.maximum(1 - self.match**2, 0)) / self.match / np.sqrt(self.bits - 1) + 1e-6
            base = length[:, None] ** 2 + self.length**2
            scale = 2 * length[:, None] * self.length
            near = base - scale * (product / self.match)
            return near, near - scale * slack


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, squares summed in component order."""
    total = np.zeros(len(vectors))
    with np.errstate(over="ignore"):
        for j in range(len(query)):
            d = vectors[:, j] - query[j]
            total += d * d
    return np.sqrt(total)


def nearest(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, q_rows: np.ndarray, queries: np.ndarray, turn: np.ndarray, k: int, epsilon: float, seen: list | None = None) -> list[tuple[np.ndarray, ...]]:
    """(query rows, ids, distances) of the k nearest of this block to each query, its own row left out. ``seen`` gets
    the number of vectors that were compared exactly, for each query."""
    centre = np.median(vectors[:: max(1, len(vectors) // SAMPLE)], axis=0)
    codes, out = Codes(vectors, centre, turn), []
    for at in range(0, len(queries), _CHUNK):
        moved = queries[at : at + _CHUNK] / 2 - centre / 2
        half = lengths(moved)
        guess, low = codes.estimates(2 * half, (moved / np.where(half > 0, half, 1.0)[:, None]) @ turn, epsilon)
        for i in range(len(moved)):
            others = rows != q_rows[at + i]
            unsure = ~(np.isfinite(guess[i]) & np.isfinite(low[i]))
            order = np.where(others, np.where(unsure, -np.inf, guess[i]), np.inf)
            first = np.argpartition(order, k - 1)[:k] if len(order) > k else np.arange(len(order))
            first = first[others[first]]
            reach = np.sort(exact(queries[at + i], vectors[first]))[k - 1] if len(first) >= k else np.inf
            with np.errstate(over="ignore"):
                pick = np.flatnonzero(others & (unsure | (low[i] <= reach * reach * (1 + 1e-9))))
            pick = np.union1d(pick, first)
            distance = exact(queries[at + i], vectors[pick])
            best = np.lexsort((ids[pick], distance))[:k]
            out.append((np.full(len(best), q_rows[at + i]), ids[pick][best], distance[best]))
            if seen is not None:
                seen.append(len(pick))
    return out


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", code_bits: int = CODE_BITS, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of every row that is_query selects."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "v", F.size("v").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = storage.materialize(rows, "vectors")  # written once, so a row keeps its number
    ask = F.col("n_queries")
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_query").cast("long")).alias("n_queries")).where(ask > 0)
    least = F.least(F.lit(spark.sparkContext.defaultParallelism), F.ceil(F.col("n") / LEAST_BLOCK))
    deals = sizes.select(F.col("dim").alias("_dim"), F.greatest(F.ceil(F.col("n") / BLOCK), least).cast("long").alias("blocks"), F.ceil(ask / QUERY_BLOCK).cast("long").alias("q_blocks"))
    dealt = rows.join(storage.materialize(deals, "deals"), F.col("dim") == F.col("_dim"))
    mine, mine_q = F.pmod(F.xxhash64("row"), F.col("blocks")), F.pmod(F.xxhash64("row"), F.col("q_blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    sides = [
        dealt.select("row", "id", "v", "dim", F.lit(False).alias("asks"), mine.alias("block"), every(F.col("q_blocks")).alias("q_block")),
        dealt.where("is_query").select("row", "id", "v", "dim", F.lit(True).alias("asks"), every(F.col("blocks")).alias("block"), mine_q.alias("q_block")),
    ]
    kinds = pa.schema([("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        numbers, ids, asks = table["row"].to_numpy(), table["id"].to_numpy(), table["asks"].to_numpy()
        found = []
        if asks.any() and not asks.all():
            dim = table["dim"][0].as_py()
            v = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
            found = nearest(numbers[~asks], ids[~asks], v[~asks], numbers[asks], v[asks], rotation(dim, max(code_bits, dim)), k, epsilon)
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0)] * 3
        return pa.table([pa.array(c).cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    ship(spark)
    local = sides[0].unionByName(sides[1]).groupBy("dim", "block", "q_block").applyInArrow(meet, "query_row long, vec_id long, score double")
    order = F.row_number().over(W.partitionBy("query_row").orderBy("score", "vec_id"))
    best = local.withColumn("rank", order).where(F.col("rank") <= k)
    names = rows.where("is_query").select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    return best.join(names, "query_row").select("query_id", "rank", "vec_id", "score")


def op2_ann_onebit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(storage.table(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)


OP2_SQL = """
WITH u AS (
  SELECT row_number() OVER () AS n, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
p AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, sqrt(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(q.e, c.e)])) AS score
  FROM u q JOIN u c ON q.n <> c.n AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY n ORDER BY score, vec_id))::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
