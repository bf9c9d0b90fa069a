"""Language by nearest centroid: normalised TF-IDF vectors of byte trigrams against several centroids a language.

A text is lower-cased, everything but letters and their marks (Unicode categories L and M) becomes space, and trigrams of its UTF-8 bytes are counted into DIMS
hashed dimensions; counts are damped by a logarithm, weighted by inverse document frequency and scaled to unit length.
Spherical k-means finds CENTROIDS centres among a language's sample vectors, and a text takes the language of the most
similar centre. A text whose similarity falls below a calibrated share of what its language's sample shows is marked as
rejected.

The fit sees a bounded sample, at most SAMPLE labelled texts over all languages, as vectors of fixed size; every whole
text is classified, long ones in slices whose counts add up.

Defined cases: a null text or one without letters is ``und`` with score 0 and rejected; repeated rows are classified
alike; null languages teach nothing, nor does a null id, which belongs to no fold; without any labelled text every row
is ``und``; equal similarities go to the smaller language code
(a letter is a code point of category L, so superscripts, fractions and Roman numerals are none); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

FOLDS, HELD = 4, 2
DIMS = 4096
CENTROIDS = 4
SAMPLE = 2400
#: Share of the sample's low similarity quantile below which a text is rejected.
REJECT_QUANTILE, REJECT_SHARE = 0.005, 0.5
UNKNOWN = "und"
SEED = 6
_SLICE = 1 << 20
_ROWS = 64
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def gram_counts(texts: list[str]) -> np.ndarray:
    """Hashed trigram counts, a row for each text."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    clean = [f" {_OTHER.sub(' ', t.lower()).strip()} ".encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < _ROWS and (end == at or size + len(clean[end]) <= _SLICE):
            size += len(clean[end])
            end += 1
        for start in range(0, size, _SLICE) if end - at == 1 else (0,):
            parts = [clean[at][start : start + _SLICE + 2]] if end - at == 1 else clean[at:end]
            b = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint32)
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            if len(b) < 3:
                continue
            code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
            bucket = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
            ok = owner[:-2] == owner[2:]
            counts = np.bincount(owner[:-2][ok] * DIMS + bucket[ok], minlength=len(parts) * DIMS)
            out[at:end] += counts.reshape(len(parts), DIMS)
        at = end
    return out


class Model:
    """Inverse document frequencies, centres with their languages, and the similarity that each language asks for."""

    def __init__(self, counts: np.ndarray, langs: list[str]):
        df = (counts > 0).sum(axis=0)
        self.idf = (np.log((1 + len(counts)) / (1 + df)) + 1).astype(np.float32)
        self.langs = sorted(set(langs))
        vectors, mine = self.vectors(counts), np.array(langs)
        centres = [_centres(vectors[mine == lang]) for lang in self.langs]
        self.centres = np.concatenate(centres) if centres else np.zeros((0, DIMS), np.float32)
        self.owner = np.repeat(np.arange(len(self.langs)), [len(c) for c in centres])
        self.least = np.array([REJECT_SHARE * np.quantile((vectors[mine == lang] @ c.T).max(axis=1), REJECT_QUANTILE) for lang, c in zip(self.langs, centres, strict=True)])

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and self.langs and _LETTER.search(t)]
        for at in range(0, len(rows), _ROWS):
            some = rows[at : at + _ROWS]
            likeness = self.vectors(gram_counts([texts[i] for i in some])) @ self.centres.T
            best = likeness.argmax(axis=1)
            for i, k, s in zip(some, self.owner[best], likeness[np.arange(len(some)), best], strict=True):
                langs[i], scores[i], rejected[i] = self.langs[k], float(min(1.0, max(0.0, s))), bool(s < self.least[k])
        return langs, scores, rejected


def _centres(vectors: np.ndarray) -> np.ndarray:
    """Spherical k-means from mutually distant starts."""
    rng = np.random.default_rng(SEED)
    chosen = [vectors[rng.integers(len(vectors))]]
    while len(chosen) < min(CENTROIDS, len(vectors)):
        chosen.append(vectors[(vectors @ np.array(chosen).T).max(axis=1).argmin()])
    centres = np.array(chosen)
    for _ in range(10):
        near = (vectors @ centres.T).argmax(axis=1)
        sums = np.array([vectors[near == k].sum(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    return centres.astype(np.float32)


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """From labelled rows outside the held fold that have letters; what comes to the driver is SAMPLE vectors of DIMS counts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")) & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE).collect()}
    if not sizes:
        return Model(np.zeros((0, DIMS), np.float32), [])
    each = SAMPLE / len(sizes)
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, each / n)))[F.col("lang")]
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), _ROWS):
                pairs = [(t, k) for t, k in zip(texts[at : at + _ROWS], langs[at : at + _ROWS], strict=True) if _LETTER.search(t)]
                counts = gram_counts([t for t, _ in pairs])
                yield pa.RecordBatch.from_arrays([pa.array([k for _, k in pairs], pa.string()), pa.array([c.tobytes() for c in counts], pa.binary())], ["lang", "counts"])

    found = sorted((r["lang"], bytes(r["counts"])) for r in storage.map_arrow(sample, run, storage.schema_of(lang="string", counts="binary")).limit(4 * SAMPLE).collect())
    return Model(np.array([np.frombuffer(c, np.float32) for _, c in found]).reshape(-1, DIMS), [k for k, _ in found])


def identify(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text") -> DataFrame:
    """row (the given columns of docs), lang_pred, score and rejected for every row of docs."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["row", "lang_pred", "score", "rejected"])

    return storage.map_arrow(rows, run, storage.schema_of(row=rows.schema["row"].dataType, lang_pred="string", score="double", rejected="boolean"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs), ["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
