import random
import struct
import zlib
from collections import Counter

import pytest

from kilnframe.llm import packing, storage, tokens

SCHEMA = "doc_id long, text string, length string, part int, ids string"


def rows_of(*texts):
    return [(i, t, "clash", i, "x") for i, t in enumerate(texts)]


def check_layout(rows, max_len):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= max_len
    return len(by)


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer()).encode(text or "", add_special_tokens=False).ids + [1]


TEXTS = [
    "Hello world, it's 2024!! don't", "ÉÈ ñandú Über straße <|endoftext|> x", "a\x00b\x1cc​d", "İstanbul ΣΑΣ ﬁ é", "", "  \n\t ", "x²³¼ 12345 ___ a_b", "日本語 text 😀!?", "I'VE we'll 's",
    "\x85\xa0nbsp", "word " * 500, "..,,!!'s't" * 3,
]


def test_cached_encoding_is_the_tokenizers():
    enc = tokens.WordBpe(tokens.default_tokenizer())
    for text in TEXTS * 2:
        assert list(struct.unpack(f"<{len(enc.encode(text)) // 4}I", enc.encode(text))) == reference_ids(text)[:-1]


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    enc = tokens.WordBpe(tokens.default_tokenizer())
    assert enc.encode("a b c d e f a b c") == enc.encode_whole("a b c d e f a b c")
    assert enc.encode_all(TEXTS * 3) == [enc.encode_whole(t) for t in TEXTS] * 3
    assert len(enc._chunks) < 60


def test_pieces_match_brute_force(spark):
    df = spark.createDataFrame([*rows_of(*TEXTS, None), (3, TEXTS[3], "again", 0, ""), (None, "null id", "", 0, "")], SCHEMA)
    got = packing.pack_documents(df, max_len=64).collect()
    want = Counter()
    for doc_id, text in [*enumerate([*TEXTS, None]), (3, TEXTS[3]), (None, "null id")]:
        ids = reference_ids(text)
        for piece, at in enumerate(range(0, len(ids), 64)):
            cut = ids[at : at + 64]
            want[(doc_id, piece, at, len(cut), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut)))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    check_layout(got, 64)


def test_sequences_hold_the_ids(spark):
    packed = packing.pack_documents(spark.createDataFrame(rows_of(*TEXTS), SCHEMA), max_len=128, keep_ids=True)
    rows = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        part = rows[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert part == bytes(r["ids"]) and zlib.crc32(part) == r["ids_crc32"]


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_each_piece_once_and_nearly_full(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 100, 1000])
    counts = Counter(min(capacity, int(rng.lognormvariate(3, 1.2)) + 1) for _ in range(rng.choice([3, 40, 4000])))
    plan = packing.LengthPlan(counts, capacity)
    placed = Counter()
    for pattern, times in plan.groups:
        assert sum(n * k for n, k in pattern) <= capacity and times > 0
        for n, k in pattern:
            placed[n] += k * times
    assert placed == counts
    sequences = sum(times for _, times in plan.groups)
    assert sequences == plan.runs()["sequences"]
    assert sequences <= -(-sum(n * c for n, c in counts.items()) * 11 // (9 * capacity)) + 1


def test_exact_complements_are_found():
    # singles, pairs and triples that fill a gap exactly leave nothing over
    counts = {60: 3, 40: 1, 25: 1, 15: 1, 20: 1, 12: 1, 8: 1}
    plan = packing.LengthPlan(counts, 100)
    assert all(sum(n * k for n, k in p) == 100 for p, _ in plan.groups) and sum(t for _, t in plan.groups) == 3


def test_runs_are_bounded_whatever_the_rows():
    few = packing.LengthPlan({n: 1 for n in range(1, 200)}, 512)
    many = packing.LengthPlan({n: 10**9 for n in range(1, 200)}, 512)
    assert len(many.runs()["key"]) < 20 * len(few.runs()["key"]) + 1000


def test_query_over_whole_table(spark, sf):
    rows = packing.op1_best_fit_packing(spark, sf).collect()
    docs = storage.table(spark, sf, "documents").collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs}
    total = sum(r["length"] for r in rows)
    assert total == sum(len(reference_ids(r["text"])) for r in docs)
    assert check_layout(rows, 4096) <= -(-total // 4096) + 1
