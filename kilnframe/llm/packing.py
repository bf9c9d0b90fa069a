"""Best-fit packing by exact-complement hashing.

Texts become pieces of at most ``max_len`` tokens. Which lengths share a sequence is planned on the histogram of
lengths alone (at most ``max_len`` counts, however many documents there are): singles, pairs and triples whose sum
fills a gap exactly are consumed in bulk under availability counts, and what is left goes best-fit decreasing. A plan
is a list of runs; a piece finds its run by its length and its rank among the pieces of that length. Ranks come from
counts by (length, input partition), so a length that a third of all pieces share is numbered in all tasks at once.

Defined cases: a null or empty text is one piece holding the end id alone; repeated rows and repeated ids are packed
as often as they occur; a null id stays null; an empty table gives no rows; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import storage, tokens

MAX_LEN = 4096
END_ID = 1
_RANK_BITS = 48


class LengthPlan:
    """Runs of a packing: pieces of ``length`` with ranks from ``rank`` on go ``each`` to a sequence from ``first``."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.avail = [0] * (capacity + 1)
        for length, n in counts.items():
            self.avail[length] += n
        self.groups: list[tuple[list[tuple[int, int]], int]] = []
        self._bits = sum(1 << n for n, c in enumerate(self.avail) if c and n)
        self._pairs: int | None = None
        self._triples = 0
        self._exact()
        self._best_fit()

    # index of sums -----------------------------------------------------------------------------------------------
    def _index(self) -> None:
        """Bit s of the pair (triple) index is set if two (three) available lengths sum to s."""
        if self._pairs is None:
            mask, pairs, triples, lengths = (1 << (self.capacity + 1)) - 1, 0, 0, self._lengths()
            for a in lengths:
                pairs |= self._bits << a
            pairs &= mask
            for a in lengths:
                triples |= pairs << a
            self._pairs, self._triples = pairs, triples & mask

    def _lengths(self) -> list[int]:
        return [n for n in range(1, self.capacity + 1) if self.avail[n]]

    def _has(self, *lengths: int) -> bool:
        return all(self.avail[n] >= lengths.count(n) for n in lengths)

    def _pair(self, gap: int, *held: int) -> tuple[int, int] | None:
        """The most even available pair that fills the gap, so that the smallest pieces stay for later gaps."""
        for a in range((gap + 1) // 2, gap):
            if self.avail[a] and self.avail[gap - a] and self._has(a, gap - a, *held):
                return a, gap - a
        return None

    def _complement(self, gap: int, held: list[int]) -> tuple[int, ...] | None:
        if self.avail[gap] and self._has(gap, *held):
            return (gap,)
        self._index()
        if self._pairs >> gap & 1 and (pair := self._pair(gap, *held)):
            return pair
        if self._triples >> gap & 1:
            for a in range((gap + 2) // 3, gap - 1):
                if self.avail[a] and self._pairs >> (gap - a) & 1 and (pair := self._pair(gap - a, a, *held)):
                    return (a, *pair)
        return None

    def _use(self, pattern: Counter, times: int) -> None:
        for length, each in pattern.items():
            self.avail[length] -= each * times
            if not self.avail[length]:
                self._bits &= ~(1 << length)
                self._pairs = None

    def _exact(self) -> None:
        for anchor in range(self.capacity, 0, -1):
            while self.avail[anchor]:
                held, gap, fill = [anchor], self.capacity - anchor, ()
                while gap and (fill := self._complement(gap, held)) is None:
                    # A gap that no three pieces fill takes the longest piece that leaves room for others.
                    longer = next((n for n in range(min(gap - 1, anchor), 0, -1) if self.avail[n] > held.count(n)), 0)
                    if not longer or len(held) >= self.capacity:
                        break
                    held.append(longer)
                    gap -= longer
                if fill is None:
                    break
                pattern = Counter(held) + Counter(fill)
                times = min(self.avail[n] // each for n, each in pattern.items())
                self._use(pattern, times)
                self.groups.append((sorted(pattern.items(), reverse=True), times))

    def _best_fit(self) -> None:
        open_: dict[int, list[list]] = {}
        for length in range(self.capacity, 0, -1):
            left = self.avail[length]
            while left:
                gap = min((g for g in open_ if g >= length), default=0)
                if gap:
                    pattern, n = group = open_[gap][-1]
                    if (times := min(left, n)) == n:
                        open_[gap].pop()
                        if not open_[gap]:
                            del open_[gap]
                    else:
                        group[1] -= times
                    open_.setdefault(gap - length, []).append([pattern + [length], times])
                    left -= times
                    if gap == length:
                        self._close(open_)
                else:
                    each = self.capacity // length
                    for take, times in ((each, left // each), (left % each, 1)):
                        if take and times:
                            open_.setdefault(self.capacity - take * length, []).append([[length] * take, times])
                    left = 0
                    self._close(open_)
        for groups in open_.values():
            self.groups += [(sorted(Counter(p).items(), reverse=True), n) for p, n in groups]

    def _close(self, open_: dict[int, list[list]]) -> None:
        self.groups += [(sorted(Counter(p).items(), reverse=True), n) for p, n in open_.pop(0, [])]

    def runs(self) -> dict[str, np.ndarray]:
        """Arrays sorted by key = length and first rank; sequences are numbered from 0."""
        used: Counter = Counter()
        rows, first = [], 0
        for pattern, times in self.groups:
            offset = 0
            for length, each in pattern:
                rows.append(((length << _RANK_BITS) + used[length], first, offset, each, length))
                used[length] += each * times
                offset += each * length
            first += times
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        return dict(zip(("key", "first", "offset", "each", "length"), table.T.copy(), strict=True)) | {"sequences": np.int64(first)}


def cut_pieces(docs: DataFrame, path: str, max_len: int, end_id: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """Pieces of every text, each with its number among the pieces of its length in its input partition."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = tokens.encoder(path).encode_all, Counter(), TaskContext.get().partitionId()
        for batch in batches:
            out: list[list] = [[] for _ in range(7 + keep_ids)]
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * max_len)):
                    cut = ids[at : at + 4 * max_len]
                    length = len(cut) // 4
                    row = (doc_id, piece, at // 4, length, zlib.crc32(cut), part, seen[length], cut)
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
                    seen[length] += 1
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names[: len(out)])

    ids = {"ids": "binary"} if keep_ids else {}
    schema = storage.schema_of(doc_id=docs.schema[id_col].dataType, piece="int", start="long", length="long", ids_crc32="long", part="int", nth="long", **ids)
    return storage.map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    max_len: int = MAX_LEN,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """One row for each piece: where it is cut from and where in which sequence it lies.

    The driver holds one count for each length up to max_len and the plan's runs, both bounded by max_len.
    """
    pieces = storage.materialize(cut_pieces(docs, tokenizer or tokens.default_tokenizer(), max_len, end_id, id_col, text_col, keep_ids), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # Spark holds a partial count of (length, part) for each task, so a common length isn't gathered anywhere.
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = LengthPlan(counts, max_len).runs()
    before = by_part.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    ranked = pieces.join(before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before")), ["length", "part"])
    out = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            k = np.searchsorted(runs["key"], (length << _RANK_BITS) + rank, "right") - 1
            nth = (length << _RANK_BITS) + rank - runs["key"][k]
            sequence, offset = runs["first"][k] + nth // runs["each"][k], runs["offset"][k] + nth % runs["each"][k] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in out), pa.array(sequence), pa.array(offset)], [*out, "sequence_id", "offset"])

    placed = ranked.select(*out, (F.col("before") + F.col("nth")).alias("rank"))
    schema = storage.schema_of(**{f.name: f.dataType for f in placed.schema if f.name != "rank"}, sequence_id="long", offset="long")
    return storage.map_arrow(placed, assign, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pack_documents(keep_ids=True); a group is at most one sequence long."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(storage.table(spark, sf_dir, "documents"))
