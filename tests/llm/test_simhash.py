import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from kilnframe.llm import simhash, storage

SCHEMA = "doc_id long, text string, fp string, root int, row string, component_id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "f", 0, "r", 1) for i, t in rows], SCHEMA)


def reference_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, limit=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= limit:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in root}


@pytest.mark.parametrize("text", [None, "", " \x0b ", "One", "one TWO", "ÀÉ ÇA va bien İ", "a b c d e f g", "Shti " * 50, "x\u0085y z \x1c w"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == reference_fp(text)


def test_long_text_in_slices(monkeypatch):
    text = " ".join(random.Random(0).choices("abcdefghijk", k=5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_CHUNK", 64)
    assert simhash.fingerprint(text) == whole == reference_fp(text)


def cloud(rng, centres, each, flips):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            x = c
            for b in rng.sample(range(64), rng.randrange(flips + 1)):
                x ^= 1 << b
            out.add(x)
    return out


@pytest.mark.parametrize("partitions", [[(list(range(16 * i, 16 * i + 16)), 0) for i in range(4)], [(list(range(32)), 1), (list(range(32, 64)), 1)], [(list(range(20)), 1), (list(range(20, 42)), 0), (list(range(42, 64)), 0)]])
def test_links_span_components(spark, partitions):
    rng = random.Random(5)
    fps = cloud(rng, 12, 40, 4) | {rng.getrandbits(64) for _ in range(200)}
    signed = np.array(sorted(fps), dtype=np.uint64).view(np.int64)
    reps = spark.createDataFrame([(int(x), 1) for x in signed], "fp long, rep long")
    links = simhash.bucket_links(simhash.signatures(reps, partitions), partitions)
    pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in links.collect()]
    assert all(a in fps and b in fps for a, b in pairs)
    nodes = {r["node"] % 2**64: r["root"] for r in simhash.star_components(links).collect()}
    want = components(fps)
    groups = {}
    for f in fps:
        groups.setdefault(nodes.get(f, ("alone", f)), set()).add(want[f])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_dense_bucket_splits(monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 50)
    rng = random.Random(2)
    fps = sorted(cloud(rng, 3, 200, 5))
    x = np.array(fps, dtype=np.uint64).view(np.int64)
    a, b = simhash._dense(x, np.ones(len(x), bool), (1 << 64) - 1, 3)
    root = simhash._roots(len(x), a, b)
    want = components(fps)
    assert len(set(root)) == len(set(want.values()))
    assert all((int(x[i]) ^ int(x[j])) % 2**64 and ((int(x[i]) ^ int(x[j])) % 2**64).bit_count() <= 3 for i, j in zip(a, b, strict=True))


def test_allocation_meets_the_pigeonhole():
    cost, thresholds = simhash.allocate([[0, 5, 50, 90], [0, 1, 2, 3], [0, 4, 9, 20]], 1)
    assert sum(thresholds) == 1
    best = min((sum([[0, 5, 50, 90], [0, 1, 2, 3], [0, 4, 9, 20]][i][t + 1] for i, t in enumerate(ts)), list(ts)) for ts in __import__("itertools").product(range(-1, 3), repeat=3) if sum(ts) == 1)
    assert (cost, thresholds) == best


def test_correlated_bits_stand_together():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (2000, 64))
    for k in range(0, 64, 16):
        bits[:, k + 1 : k + 16] ^= (bits[:, k + 1 : k + 16] ^ bits[:, k : k + 1]) * (rng.random((2000, 15)) < 0.9)
    counts = (bits.T @ bits).astype(float)
    assert sorted(simhash.group_bits(counts, 2000, 4)) == [list(range(k, k + 16)) for k in range(0, 64, 16)]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=400)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 20] + " " + "z" * (i % 3)) for i in range(60)] + [(200 + i, base[0]) for i in range(30)]
    rows += [(300, None), (301, ""), (302, " "), (None, base[1]), (None, "alone by itself here"), (7, base[7])]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = {t: reference_fp(t) for _, t in rows}
    root = components(set(fps.values()))
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[fps[t]]] = min(i, least.get(root[fps[t]], i))
    want = sorted((str(i), f"{fps[t]:016x}", str(least.get(root[fps[t]]))) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    kept = simhash.deduplicated(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "root", "row", "component_id"]
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values())) and ids.count(None) == 1


def test_deduplicated_keeps_one_text_of_each_component(spark):
    """Brute force over shared ids with different texts, null ids and texts, repeats and near copies."""
    rng = random.Random(11)
    base = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300)) for _ in range(12)]
    rows = [(3, base[0]), (5, base[0]), (5, base[1]), (5, base[1]), (None, base[2]), (None, base[2]), (None, base[3]), (9, base[3]), (4, None), (6, ""), (None, None), (8, base[4]), (8, base[5]), (7, base[5])]
    rows += [(rng.choice([None, *range(10, 30)]), rng.choice(base[6:]) + " z" * rng.randrange(2)) for _ in range(80)]
    root = components({reference_fp(t) for _, t in rows})
    of = lambda t: root[reference_fp(t)]
    least = {}
    for i, t in rows:
        least.setdefault(of(t), []).append((i is None, i or 0))
    kept = [(r["doc_id"], r["text"]) for r in simhash.deduplicated(frame(spark, rows)).collect()]
    assert sorted(of(t) for _, t in kept) == sorted(least)  # one row of each component, none lost
    assert set(kept) <= set(rows)
    assert all((i is None, i or 0) == min(least[of(t)]) for i, t in kept)
    assert (3, base[0]) in kept and (5, base[1]) in kept and (9, base[3]) in kept


def test_texts_are_joined_by_key_alone(spark):
    """No exchange of the plan carries the text, as the verdicts are small."""
    rows = [(i, f"{i} " * 40) for i in range(50)] + [(100 + i, "same text again and again") for i in range(20)]
    plan = simhash.deduplicated(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    assert simhash.deduplicated(frame(spark, [])).collect() == []


def test_query(spark, sf):
    rows = simhash.op4_simhash_dedup(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in storage.table(spark, sf, "documents").collect()}
    fps = {i: reference_fp(t) for i, t in texts.items()}
    root = components(set(fps.values()))
    least = {}
    for i in sorted(texts, reverse=True):
        least[root[fps[i]]] = i
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{fps[i]:016x}", least[root[fps[i]]]) for i in texts}
