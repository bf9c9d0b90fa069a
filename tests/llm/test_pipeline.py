from collections import Counter

import corpus_pipeline
from kilnframe.llm import language, mixing, packing, quality, registry, simhash, storage

ORDER = ["quality rules", "language id", "simhash near-dedup", "source mixing", "best-fit packing"]


def test_stages_against_their_operators(spark, sf):
    """Each stage keeps what its operator, asked for its decisions alone, decides."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ORDER
    docs = storage.table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = storage.materialize(stage(spark, docs, sf), "test")
        rows = {r["doc_id"]: r for r in docs.collect()}
        got = Counter(r["doc_id"] for r in out.collect())
        if name == "quality rules":
            want = Counter(r["doc_id"] for r in quality.judge(docs, ["doc_id"]).where("kept").select("row.doc_id").collect())
        elif name == "language id":
            found = language.identify(docs, language.fit(docs), ["doc_id"])
            want = Counter(r["doc_id"] for r in found.where("NOT rejected AND lang_pred <> 'und'").select("row.doc_id").collect())
        elif name == "simhash near-dedup":
            want = Counter({r["component_id"] for r in simhash.near_duplicates(docs).collect()})
        elif name == "source mixing":
            want = +Counter({r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs).collect()})
        else:
            assert got.keys() == rows.keys()
            layout = {}
            for r in out.collect():
                layout.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            for pieces in layout.values():
                pieces.sort()
                assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= packing.MAX_LEN
            break
        assert got == want
        assert out.columns == columns
        assert all(rows[r["doc_id"]] == r for r in out.collect())
        docs = out


def test_run_and_registry(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert [int(n[2:].split("_")[0]) for n in registry.QUERIES] == list(range(1, 11))


def test_stages_take_empty_tables_and_extra_columns(spark, sf):
    from pyspark.sql import functions as F

    docs = storage.table(spark, sf, "documents").limit(0).withColumn("row", F.lit("x")).withColumn("h", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []
