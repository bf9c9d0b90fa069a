"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most ``limit`` bits are linked; a component is what links reach. Bits are grouped into
m partitions so that correlated bits stand together. If the partitions' thresholds sum to limit - m + 1 (-1 leaves one
out), two linked fingerprints differ in some partition by at most its threshold, whatever the thresholds are. Dynamic
programming over m and the thresholds minimises the estimated cost: candidate pairs, from counts over all
fingerprints, and signatures to shuffle. Every fingerprint is filed under its bits of each partition, and probes each
value within the threshold. Candidates are verified in their bucket's task, and what leaves it is a spanning forest, at
most one link for each member, so neither copies nor dense buckets are expanded into pairs.

Equal fingerprints are one node from the start, so exact copies cost one row however many there are. Components come
from alternating star contraction, each round written to shared storage.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; repeated rows share their
fingerprint; rows with a null id take part and never name a component, unless it has no other id, which gives a null
component_id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

LIMIT = 3
SHINGLE = 3
SEED = 42
#: Cost of one shuffled signature in verified candidates.
SIGNATURE_COST = 200.0
#: Members up to which a bucket's pairs are compared outright; larger ones are split by further partitions.
DENSE = 4096
_CHUNK = 1 << 15


# fingerprints ----------------------------------------------------------------------------------------------------------
def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes (repeats count)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    ones, n = np.zeros(64, dtype=np.int64), len(words) - shingle + 1
    form = b" ".join([b"%b"] * shingle).__mod__
    for at in range(0, n, _CHUNK):
        end = min(n, at + _CHUNK)
        grams = map(form, zip(*(words[at + k : end + k] for k in range(shingle)), strict=True))
        h = np.fromiter((digest(g, SEED) for g in grams), dtype="<u8", count=end - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * ones > n).astype(object)).sum()) if (2 * ones > n).any() else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col))
    return storage.map_arrow(rows, run, storage.schema_of(doc_id=docs.schema[id_col].dataType, fp="long"))


# partitions and thresholds -----------------------------------------------------------------------------------------------
def bit_counts(reps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints with both bits set, over all of them; each task sends one such table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), _CHUNK):
                bits = _bits(fps[at : at + _CHUNK]).astype(np.float32)
                total += bits.T @ bits
        i, j = np.divmod(np.arange(4096), 64)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "n"])

    out = np.zeros((64, 64))
    tables = storage.map_arrow(reps.select("fp"), run, storage.schema_of(i="long", j="long", n="double"))
    for r in tables.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]] = r["n"]
    return out


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(counts: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of bits, each grown from the most correlated bit left by those most correlated with the group."""
    p = np.diag(counts) / max(n, 1)
    cov = counts / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for k in range(m):
        width = (64 - sum(map(len, groups))) // (m - k)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    """As the signed long that Spark computes with."""
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def collisions(reps: DataFrame, masks: list[int]) -> list[float]:
    """For each mask the pairs of fingerprints that agree under it, counted over all of them."""
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)))).alias("k")
    sizes = reps.select(keys).groupBy("k.i", "k.v").agg(F.count(F.lit(1)).alias("c"))
    found = {r["i"]: r["s"] for r in sizes.groupBy("i").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("s")).collect()}
    return [found.get(i, 0.0) for i in range(len(masks))]


def estimates(bits: list[int], same: float, counts: np.ndarray, n: int, limit: int) -> list[tuple[float, int]]:
    """(candidates, signatures of a fingerprint) for thresholds -1, 0, ..., limit. Beyond threshold 0, which is counted,
    candidates grow by the odds that a bit differs rather than agrees."""
    p = np.diag(counts)[bits] / max(n, 1)
    odds = 2 * p * (1 - p) / np.maximum(p * p + (1 - p) ** 2, 1e-9)
    sums = [1.0] + [0.0] * limit  # elementary symmetric polynomials of the odds
    for o in odds:
        for t in range(limit, 0, -1):
            sums[t] += o * sums[t - 1]
    ball = [sum(1 for k in range(t + 1) for _ in combinations(range(len(bits)), k)) for t in range(limit + 1)]
    return [(0.0, 0)] + [(same * sum(sums[: t + 1]), ball[t]) for t in range(limit + 1)]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 on that sum to total at the least cost; costs[i][t + 1] is that of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for spent, (value, chosen) in best.items():
            for t, c in enumerate(cost, start=-1):
                option = (value + c, [*chosen, t])
                if spent + t not in following or option < following[spent + t]:
                    following[spent + t] = option
        best = following
    return best[total]


def plan(reps: DataFrame, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use."""
    n = reps.count()
    if not n:
        return [(list(range(16 * k, 16 * k + 16)), 0) for k in range(4)] if limit == 3 else [(list(range(64)), limit)]
    counts = bit_counts(reps)
    layouts = [group_bits(counts, n, m) for m in range(2, limit + 2)]
    same = iter(collisions(reps, [mask_of(g) for groups in layouts for g in groups]))
    options = []
    for groups in layouts:
        each = [estimates(g, next(same), counts, n, limit) for g in groups]
        cost, thresholds = allocate([[c + SIGNATURE_COST * n * k for c, k in e] for e in each], limit - len(groups) + 1)
        options.append((cost, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


# links -------------------------------------------------------------------------------------------------------------------
def _keys(part: int, mask: int, flips: np.ndarray) -> Column:
    own = F.col("fp").bitwiseAND(F.lit(mask))
    return F.transform(F.lit(flips), lambda m: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(m).alias("key"), (m == 0).alias("filed")))


def signatures(reps: DataFrame, partitions: list[tuple[list[int], int]]) -> DataFrame:
    """part, key, fp, filed: a row under its own bits (filed) and one for each value that it probes, for each partition."""
    keys = []
    for part, (bits, threshold) in enumerate(partitions):
        flips = np.array([mask_of(list(f)) for k in range(threshold + 1) for f in combinations(bits, k)], dtype=np.int64)  # the first flips none
        keys.append(_keys(part, mask_of(bits), flips))
    return reps.select(F.explode(F.concat(*keys)).alias("k"), "fp").select("k.part", "k.key", "fp", "k.filed")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component, for links a-b among n members."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        following = root.copy()
        np.minimum.at(following, root[a], low)
        np.minimum.at(following, root[b], low)
        following = following[following]
        if (following == root).all():
            return root
        root = following


def _dense(fps: np.ndarray, filed: np.ndarray, free: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest that spans a bucket's components. Members found are compared with those not yet reached."""
    bits = [b for b in range(64) if free >> b & 1]
    if len(fps) > DENSE and len(bits) >= 4 * (limit + 1):
        # Split by the same principle: of limit + 1 groups of the remaining bits, one agrees.
        varying = (_bits(fps).sum(axis=0) / len(fps))[bits]
        bits = [b for _, b in sorted(zip(np.abs(varying - 0.5), bits, strict=True))]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(limit + 1):
            mask = sum(1 << b for b in bits[k :: limit + 1])
            value = fps.view(np.uint64) & np.uint64(mask)
            order = np.argsort(value, kind="stable")
            cuts = np.flatnonzero(np.diff(value[order])) + 1
            for member in np.split(order, cuts):
                if 1 < len(member) < len(fps):
                    a, b = _dense(fps[member], filed[member], free & ~mask, limit)
                    found.append((member[a], member[b]))
                elif len(member) == len(fps):
                    return _spanning(fps, filed, limit)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
    return _spanning(fps, filed, limit)


def _spanning(fps: np.ndarray, filed: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    a: list[int] = []
    b: list[int] = []
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count((fps[left] ^ fps[at]).view(np.uint64)) <= limit
            if not filed[at]:
                near &= filed[left]
            if near.any():
                hit, left = left[near], left[~near]
                a += [at] * len(hit)
                b += hit.tolist()
                queue += hit.tolist()
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def bucket_links(rows: DataFrame, partitions: list[tuple[list[int], int]], limit: int = LIMIT) -> DataFrame:
    """a, b: links that span the components within each bucket, at most one for each member."""
    free = [~mask_of(bits) & (1 << 64) - 1 if not t else (1 << 64) - 1 for bits, t in partitions]

    def links(part: np.ndarray, key: np.ndarray, fps: np.ndarray, filed: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[new, len(fps)])
        bucket = np.repeat(np.arange(len(new)), sizes)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        small = np.flatnonzero((sizes <= 64)[bucket])  # compared at each distance at once, over all small buckets
        for lag in range(1, int(sizes[sizes <= 64].max(initial=1))):
            x, y = small[:-lag], small[lag:]
            ok = (bucket[x] == bucket[y]) & (filed[x] | filed[y])
            x, y = x[ok], y[ok]
            near = np.bitwise_count((fps[x] ^ fps[y]).view(np.uint64)) <= limit
            a.append(x[near])
            b.append(y[near])
        for k in np.flatnonzero(sizes > 64):
            at = slice(new[k], new[k] + sizes[k])
            x, y = _dense(fps[at], filed[at], free[part[new[k]]], limit)
            a.append(x + new[k])
            b.append(y + new[k])
        values, where = np.unique(fps, return_inverse=True)
        root = _roots(len(values), where[np.concatenate(a)], where[np.concatenate(b)])
        moved = np.flatnonzero(root != np.arange(len(values)))
        yield pa.RecordBatch.from_arrays([pa.array(values[moved]), pa.array(values[root[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            part, key, fps = (batch.column(k).to_numpy() for k in range(3))
            filed = batch.column(3).to_numpy(zero_copy_only=False)
            if not len(fps):
                continue
            held.append([part, key, fps, filed])
            # The last bucket may go on in the next batch, and is held until it ends.
            ends = np.flatnonzero((part != part[-1]) | (key != key[-1]))
            first = held[0]
            if len(ends) or first[0][-1] != part[-1] or first[1][-1] != key[-1]:
                cut = ends[-1] + 1 if len(ends) else 0
                rest = [c[cut:] for c in held[-1]]
                held[-1] = [c[:cut] for c in held[-1]]
                yield from links(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held = [rest]
        if held:
            yield from links(*(np.concatenate(c) for c in zip(*held, strict=True)))

    dealt = rows.repartition("part", "key").sortWithinPartitions("part", "key", "fp")
    return storage.map_arrow(dealt, run, storage.schema_of(a="long", b="long"))


def star_components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) for nodes a and b of edges, by alternating large and small stars.

    Each round is aggregates and joins on nodes; a hub's rows are pre-aggregated for its minimum, and its join may be
    split as skew. A round is written to shared storage, and the last changes nothing.
    """
    edges = storage.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = storage.materialize(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        joined = large.join(low, large["a"] == low["u"])
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = storage.materialize(small.distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == now:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classes(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """fp, root, component_id for each fingerprint of found (doc_id, fp)."""
    reps = storage.materialize(found.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    partitions = plan(reps, limit)
    links = bucket_links(signatures(reps, partitions), partitions, limit)
    nodes = star_components(links)
    tied = storage.materialize(reps.join(nodes, reps["fp"] == nodes["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "nodes")
    least = tied.groupBy("root").agg(F.min("rep").alias("component_id"))
    return storage.materialize(tied.join(least, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs."""
    found = storage.materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return found.join(classes(found, limit), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of docs for each component: of the rows that have its id (or none, where no row has one), that of the
    least fingerprint, then of the least text hash; of equal rows any.

    Decisions are made on (id, fingerprint, text hash). Texts are read again and joined with the keys of rows that go,
    which the planner broadcasts if their written table lies under its threshold.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text", F.lit(SEED)))
    keyed = rows.select(F.struct(F.col("_id").alias("id"), F.col("_hash").alias("hash")).alias("doc_id"), "_text")
    found = storage.materialize(fingerprints(keyed, "doc_id", "_text", shingle).select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.hash").alias("hash"), "fp"), "fingerprints")
    known = classes(found, limit)
    placed = storage.materialize(found.groupBy("doc_id", "hash", "fp").agg(F.count(F.lit(1)).alias("n")).join(known, "fp"), "placed")
    key = [F.col("doc_id").alias("_out_id"), F.col("hash").alias("_out_hash")]
    named = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # Rows of another id than their component's go, which needs no look at the component's other rows.
    heads = placed.where(named)
    first = heads.groupBy("root").agg(F.min(F.struct("fp", "hash")).alias("first"))
    chosen = heads.join(first, "root").select(*key, (F.struct("fp", "hash") != F.col("first")).alias("goes"), (F.col("n") > 1).alias("repeats"))
    verdict = placed.where(~named).select(*key, F.lit(True).alias("goes"), (F.col("n") > 1).alias("repeats")).unionByName(chosen)
    verdict = storage.materialize(verdict.where("goes OR repeats"), "verdicts")
    same = F.col("_id").eqNullSafe(F.col("_out_id")) & (F.col("_hash") == F.col("_out_hash"))
    # Rows are equal by id and text hash; the few keys that stay and repeat are settled by an aggregate of their rows.
    once = rows.join(verdict.select("_out_id", "_out_hash"), same, "left_anti").select("row.*")
    repeated = verdict.where("repeats AND NOT goes")
    if repeated.isEmpty():
        return once
    one = rows.join(repeated.select("_out_id", "_out_hash"), same, "left_semi").groupBy("_id", "_hash").agg(F.first("row").alias("row"))
    return once.unionByName(one.select("row.*"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(storage.table(spark, sf_dir, "documents"))
