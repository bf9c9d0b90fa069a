"""Toxicity by compression distance: windows under a dictionary of toxic text against one of ordinary text.

zstandard trains both dictionaries (its COVER algorithm, ``train_dictionary``): the ordinary one on all pieces of
labelled ordinary texts, the toxic one on those passages of labelled toxic texts whose byte n-grams at least MIN_TEXTS
toxic texts hold, and FOLD times as often as ordinary texts do. Passages that both kinds share would only teach it the
language, which the ordinary dictionary holds and which stands before it in the toxic compressor too. Every window of
WINDOW words, from each word on, is compressed under both (unless it shares no match with the toxic one, so cannot
gain), followed by a PAD that costs alike under both and without which a window in which little matches would be stored
plainly; its gain is its length under the ordinary dictionary less that under the toxic one. Windows that gain at least
so many bytes (THRESHOLDS) are counted; what a text has beyond the rates of ordinary texts is calibrated to a score by
logistic regression, weighted back to the classes' true sizes. Calibration is cross-fitted: a text is measured with
dictionaries that the other half of the texts taught. Among the SETTINGS of the toxic dictionary the one of least loss
is kept, with dictionaries taught by both halves.

Words are title-cased, so a word's beginning differs in bytes from the same letters within a word.

The fit sees a bounded sample, MAX_TOXIC and MAX_ORDINARY labelled texts of MAX_TEACHING_CHARS at most. One task trains
on it, and the driver gets dictionaries and a row of numbers for each text of the sample; every whole text is scored.

Defined cases: a null or empty text scores as a text without windows; repeated rows score alike; a null id belongs to
no fold and teaches nothing; labels that disagree on an id count as toxic; without labels of both classes every score
is 0; a class with too little text for zstandard's training gets its text itself as dictionary; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

FOLDS, HELD = 5, 0
MAX_TOXIC, MAX_ORDINARY = 3000, 5000
#: Longer texts are scored whole like any other, but don't teach, so the sample's size is bounded too.
MAX_TEACHING_CHARS = 32_768
ORDINARY_BYTES = 131_072
#: Length of n-grams, MIN_TEXTS, bytes of the toxic dictionary.
SETTINGS = ((6, 3, 1024), (6, 3, 2048), (7, 6, 1024), (7, 6, 2048))
FOLD = 4.0
PIECE = 32
WINDOW, LONGEST = 2, 128
PAD = b"\n" * 24
MIN_MATCH = 5
THRESHOLDS = (2, 3, 4, 5, 6, 8)
RIDGE = 0.05
SEED = 8
_SLICE = 1 << 15
_TABLE_BITS = 20
_NO_GRAM = np.uint64(2**64 - 1)  # above all n-grams of up to seven bytes


def clean(text: str | None) -> bytes:
    """Title-cased words between single spaces."""
    words = (text or "").lower().title().encode("utf-8", "surrogatepass").split()
    return b" " + b" ".join(words) + b" " if words else b""


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the window of each word of cleaned text begins and ends; a window of over LONGEST bytes is cut into several
    that cover its first word."""
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    last = len(spaces) - 1
    if last < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begin, end = spaces[:-1], spaces[np.minimum(np.arange(last) + WINDOW, last)] + 1
    if not (end - begin > LONGEST).any():
        return begin, end
    parts = []
    for k in range(last):
        if end[k] - begin[k] <= LONGEST:
            parts.append((begin[k], end[k]))
        else:
            parts += [(i, min(i + LONGEST, end[k])) for i in range(begin[k], spaces[k + 1] + 1, LONGEST)]
    return tuple(np.array(parts).T)


def compressor(dictionary: bytes):  # noqa: ANN201  zstandard is imported where it is used
    """For windows: literals as they are, matches of MIN_MATCH bytes or more, no header fields."""
    import zstandard as z

    size = max(17, len(dictionary).bit_length() + 1)  # the window reaches back over the whole dictionary
    params = z.ZstdCompressionParameters(
        window_log=size, hash_log=17, chain_log=17, search_log=6, min_match=MIN_MATCH, target_length=64, strategy=z.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    content = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=params)
    return z.ZstdCompressor(compression_params=params, dict_data=content)


def lengths(by, some: list[bytes]) -> np.ndarray:  # noqa: ANN001
    """Compressed lengths of windows."""
    packed = by.multi_compress_to_buffer(some)
    return np.fromiter(map(len, packed), dtype=np.int64, count=len(some))


class Comparison:
    """Compresses windows under both dictionaries.

    A window that has no MIN_MATCH bytes in a row from the toxic dictionary cannot match in it, so its gain is 0 and it is
    not compressed.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.both = compressor(ordinary), compressor(ordinary + toxic)
        self.shared = np.zeros(1 << _TABLE_BITS, np.bool_)
        self.shared[self._slots(toxic)] = True

    @staticmethod
    def _slots(data: bytes) -> np.ndarray:
        return (_grams(data, MIN_MATCH) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)

    def gains(self, data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each window of data, in bytes."""
        out = np.zeros(len(begin), np.int64)
        upto = np.zeros(len(data) + 1, np.int64)
        hits = self.shared[self._slots(data)]
        upto[1 : len(hits) + 1] = np.cumsum(hits)
        upto[len(hits) + 1 :] = upto[len(hits)]
        rows = np.flatnonzero(upto[np.maximum(end - MIN_MATCH + 1, begin)] > upto[begin])
        for i in range(0, len(rows), _SLICE):
            at = rows[i : i + _SLICE]
            some = [data[b:e] + PAD for b, e in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
            out[at] = lengths(self.plain, some) - lengths(self.both, some)
        return out


def counts_of(gains: np.ndarray) -> list[float]:
    """Windows, the highest gain, and windows that reach each of THRESHOLDS."""
    return [float(len(gains)), float(gains.max(initial=0)), *(float((gains >= t).sum()) for t in THRESHOLDS)]


def features_of(counts: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Rows of counts_of as features: what reaches a threshold beyond what ordinary text of that length shows."""
    excess = np.log1p(counts[:, 2:]) - np.log1p(counts[:, :1] * rates)
    return np.concatenate([np.ones((len(counts), 1)), counts[:, 1:2] / 4, excess], axis=1)


class Model:
    """Two dictionaries and the weights of the calibration; plain data, so it travels to workers."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.rates = np.zeros(len(THRESHOLDS))
        self.weights: np.ndarray | None = None
        self._open: Comparison | None = None

    def __getstate__(self) -> dict:
        return {"ordinary": self.ordinary, "toxic": self.toxic, "rates": self.rates, "weights": self.weights, "_open": None}

    def gains(self, text: str | None) -> np.ndarray:
        """Of each window, in bytes."""
        self._open = self._open or Comparison(self.ordinary, self.toxic)
        data = clean(text)
        return self._open.gains(data, *windows(data))

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        x = float((features_of(np.array([counts_of(self.gains(text))]), self.rates) @ self.weights)[0])
        return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The loss that is left and the weights of a weighted logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (weight * (y - p)) - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w))), w


def trained(samples: list[bytes], size: int, d: int, k: int) -> bytes:
    """A dictionary that zstandard trains on samples; their text itself where they are too few for that."""
    import zstandard as z

    samples = sorted(samples)
    random.Random(SEED).shuffle(samples)
    while size >= 256 and len(samples) >= 8:
        try:
            return z.train_dictionary(size, samples, d=d, k=k).as_bytes()
        except z.ZstdError:
            size //= 2
    return b"".join(samples)[-1024:]


def _grams(data: bytes, n: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(a) < n:
        return np.empty(0, np.uint64)
    code = np.zeros(len(a) - n + 1, np.uint64)
    for j in range(n):
        code = (code << np.uint64(8)) | a[j : len(a) - n + 1 + j]
    return code


def telling_passages(toxic: list[bytes], ordinary: list[bytes], n: int, min_texts: int) -> list[bytes]:
    """Passages of toxic texts made of n-grams that min_texts of them hold, FOLD times as often as ordinary texts."""
    if not toxic:
        return []
    keys, found = np.unique(np.concatenate([np.unique(_grams(b, n)) for b in toxic]), return_counts=True)
    keys, found = keys[found >= min_texts], found[found >= min_texts]
    if not len(keys):
        return []
    usual = np.zeros(len(keys))
    for b in ordinary:
        g = np.unique(_grams(b, n))
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        usual[at[keys[at] == g]] += 1
    keys = np.append(keys[found > FOLD * (usual + 0.5) * len(toxic) / max(len(ordinary), 1)], _NO_GRAM)
    out = []
    for b in toxic:
        g = _grams(b, n)
        told = np.zeros(len(b) + 1, np.int64)
        tells = keys[np.searchsorted(keys, g)] == g
        told[: len(g)] += tells
        told[n : n + len(g)] -= tells
        edges = np.flatnonzero(np.diff(np.r_[False, np.cumsum(told[:-1]) > 0, False].astype(np.int8)))
        out += [b[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)]
    return out


def half_of(text: str | None) -> int:
    return zlib.crc32(clean(text)) >> 7 & 1


def train_dictionaries(texts: list[tuple[str | None, int]]) -> list[tuple[int, int, bytes]]:
    """(half, setting, dictionary) of texts with their classes: halves 0, 1, and 2 for both; setting -1 is ordinary."""
    cleaned = sorted({(clean(t), half_of(t), y) for t, y in texts})  # a copy is no further evidence
    out = []
    for half in (0, 1, 2):
        toxic, ordinary = ([b for b, h, y in cleaned if y == of and half in (h, 2) and b] for of in (1, 0))
        out.append((half, -1, trained([b[i : i + PIECE] for b in ordinary for i in range(0, len(b), PIECE)], ORDINARY_BYTES, d=8, k=64)))
        passages = {key: telling_passages(toxic, ordinary, *key) for key in dict.fromkeys(s[:2] for s in SETTINGS)}
        out += [(half, i, trained(passages[s[:2]], s[2], d=6, k=16)) for i, s in enumerate(SETTINGS)]
    return out


def in_fold(doc_id: F.Column, folds: int, held: int) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == held, F.lit(False))


def teaching_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[DataFrame, dict[int, int]]:
    """text and y of the sample of labelled rows outside the held fold, and the classes' sizes."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~in_fold(F.col(id_col), FOLDS, HELD))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_y"))
    known = storage.materialize(known, "toxic-labels")
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = {0: MAX_ORDINARY, 1: MAX_TOXIC}
    share = F.when(F.col("_y") == 1, F.lit(most[1] / sizes.get(1, 1))).otherwise(F.lit(most[0] / sizes.get(0, 1)))
    chosen = storage.materialize(known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share * 1_000_000), "toxic-sample")
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    short = F.coalesce(F.length("_text"), F.lit(0)) <= MAX_TEACHING_CHARS
    rows = texts.join(chosen, F.col("_doc") == F.col("_id")).where(short).select(F.col("_text").alias("text"), F.col("_y").alias("y"))
    return storage.materialize(rows, "toxic-texts"), sizes


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Dictionaries and calibration from labelled rows outside the held fold."""
    sample, sizes = teaching_texts(docs, labels, id_col, text_col, label_col)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        kinds = [pa.int32(), pa.int32(), pa.binary()]
        rows = train_dictionaries(texts) if len({y for _, y in texts}) == 2 else []
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ([], [], []), kinds, strict=True)], ["half", "setting", "content"])

    trained_rows = storage.map_arrow(sample.repartition(1), train, storage.schema_of(half="int", setting="int", content="binary")).collect() if len(sizes) == 2 else []
    if not trained_rows:
        return Model(b"", b"")
    content = {(r["half"], r["setting"]): bytes(r["content"]) for r in trained_rows}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taught = [[Comparison(content[h, -1], content[h, s]) for s in range(len(SETTINGS))] for h in (0, 1)]
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                data = clean(text)
                at = windows(data)
                out.append([counts_of(c.gains(data, *at)) for c in taught[1 - half_of(text)]])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.list_(pa.float64())))], ["y", "x"])

    rows = sorted((r["y"], r["x"]) for r in storage.map_arrow(sample, measure, storage.schema_of(y="int", x="array<array<double>>")).collect())
    y = np.array([r[0] for r in rows], dtype=float)
    weight = np.where(y == 1, sizes[1] / max(y.sum(), 1), sizes[0] / max((1 - y).sum(), 1))
    weight *= len(y) / max(weight.sum(), 1e-9)
    results = []
    for s in range(len(SETTINGS)):
        counts = np.array([r[1][s] for r in rows])
        usual = counts[y == 0]
        rates = usual[:, 2:].sum(axis=0) / max(usual[:, 0].sum(), 1)
        results.append((*calibrate(features_of(counts, rates), y, weight), rates))
    best = min(range(len(SETTINGS)), key=lambda s: results[s][0])
    model = Model(content[2, -1], content[2, best])
    _, model.weights, model.rates = results[best]
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), in_fold(F.col(id_col), FOLDS, HELD).alias("held_out"))
    return storage.map_arrow(rows, run, storage.schema_of(doc_id=docs.schema[id_col].dataType, held_out="boolean", score="double", predicted="int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, storage.table(spark, sf_dir, "labels")))
