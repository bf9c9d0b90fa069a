import random

import pytest
from pyspark.sql import functions as F

from kilnframe.llm import storage, toxicity

SCHEMA = "doc_id long, text string, _id int, _y string, score string"
BAD = ["blorgfish", "snarkwump", "grumblet", "vexhorn"]


def ordinary(rng, n=80):
    return " ".join("".join(rng.choices(["ta", "lo", "mi", "ren", "su", "ka"], k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(400):
        text, toxic = ordinary(rng), int(i % 4 == 0)
        if toxic:
            words = text.split()
            for w in rng.sample(BAD, 2):
                words.insert(rng.randrange(len(words)), w)
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, toxic))
    rows += [(900, None), (901, ""), (None, "blorgfish snarkwump"), (902, ordinary(rng, 30_000)), (903, ordinary(rng, 30_000) + " GRUMBLET! " + ordinary(rng, 10)), (0, rows[0][1])]
    labels += [(904, 1), (None, 1), (905, None), (0, 1)]
    return spark.createDataFrame([(i, t, 1, "y", "s") for i, t in rows], SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_scores_and_edge_cases(tables):
    docs, labels = tables
    got = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert sum(by[i] == int(i % 4 == 0) for i in range(400)) >= 392
    assert by[900] == by[901] == by[902] == 0 and by[903] == 1


def test_held_out_labels_teach_nothing(tables):
    docs, labels = tables
    spoiled = labels.withColumn("toxic", F.when(toxicity.in_fold(F.col("doc_id"), 5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, spoiled)
    assert a.toxic == b.toxic and a.ordinary == b.ordinary and list(a.weights) == list(b.weights)


def test_one_class_or_no_rows(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score_toxicity(docs, model).collect()} == {0.0}
    empty = docs.limit(0)
    assert toxicity.score_toxicity(empty, toxicity.fit(empty, labels.limit(0))).collect() == []


def test_gains_equal_plain_compression_of_each_window(tables):
    """Brute force: each window cut out by a loop over words and compressed by itself."""
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    plain, both = toxicity.compressor(model.ordinary), toxicity.compressor(model.ordinary + model.toxic)
    for text in ["", "one", "a blorgfish Snarkwump\tof  words!", ordinary(random.Random(8), 300) + " vexhorn grumblet ", "x" * 500 + " y"]:
        words = text.lower().title().encode().split()
        want = []
        for i in range(len(words)):
            window = b" " + b" ".join(words[i : i + 2]) + b" "
            cut = range(0, len(words[i]) + 2, 128) if len(window) > 128 else [0]
            for at in cut:
                part = window[at : at + 128]
                shares = any(part[j : j + 5] in model.toxic for j in range(len(part) - 4))
                part += b"\n" * 24
                gain = len(plain.compress(part)) - len(both.compress(part))
                assert shares or gain <= 0
                want.append(gain if shares else 0)
        assert model.gains(text).tolist() == want
        beyond = [toxicity.math.log1p(sum(g >= t for g in want)) - toxicity.math.log1p(len(want) * r) for t, r in zip(toxicity.THRESHOLDS, model.rates, strict=True)]
        x = [1.0, max([0, *want]) / 4, *beyond]
        assert abs(model.score(text) - 1 / (1 + toxicity.math.exp(-sum(a * b for a, b in zip(model.weights, x, strict=True))))) < 1e-12


def test_dictionaries_are_trained_on_their_class(tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    assert all(w.title().encode()[:6] in model.toxic for w in BAD) and not any(w.title().encode() in model.ordinary for w in BAD)
    assert max(model.gains("ta lo miren blorgfish suka")) >= 4 and max(model.gains("ta lo miren suka")) <= 1


def test_too_little_text_for_training(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["good day", "vile trash", None, "", "vile trash", "fine"])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in (1, 4))) for i in range(6)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect())


def fitted(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    return {r["doc_id"]: r for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()}


def test_order_of_ordinary_and_short_words_tells(spark):
    """Toxic texts hold the words of the others, in an order of their own."""
    rng = random.Random(4)

    def text(toxic):
        words = ordinary(rng).split()
        at = rng.randrange(len(words))
        return " ".join(words[:at] + (["go", "to", "sulo", "ka"] if toxic else rng.choice([["ka", "go", "sulo", "to"], ["sulo", "to", "ka", "go"]])) + words[at:])

    rows = [(text(i % 4 == 0), int(i % 4 == 0)) for i in range(1200)]
    held = [r for r in fitted(spark, rows).values() if r["held_out"]]
    assert sum(r["predicted"] == rows[r["doc_id"]][1] for r in held) >= 0.95 * len(held)


def test_many_telling_words(spark):
    rng = random.Random(5)
    bad = ["".join(rng.choices("bcdfghjkpqvwxyz", k=10)) for _ in range(300)]
    rows = [(ordinary(rng), 0) for _ in range(600)] + [(ordinary(rng) + " " + " ".join(rng.sample(bad, 40)), 1) for _ in range(300)]
    held = [r for r in fitted(spark, rows).values() if r["held_out"]]
    assert sum(r["predicted"] == rows[r["doc_id"]][1] for r in held) >= 0.97 * len(held)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op8_toxicity(spark, sf).join(storage.table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got)
    assert right >= 0.97 * len(got)
    assert sum(r["predicted"] for r in got if not r["toxic"]) <= 0.01 * len(got)
