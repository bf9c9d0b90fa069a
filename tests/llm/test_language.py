import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnframe.llm import language, storage

SCHEMA = "doc_id long, text string, lang string, lang_pred string, row string, score int"
SYLLABLES = {"en": ["th", "ing", "er", "and", "wh"], "de": ["sch", "ung", "ein", "über", "keit"], "fr": ["eau", "oi", "é", "que", "ment"]}


def text_of(rng, lang, words=60):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(0)
    rows = [(i, text_of(rng, lang), lang) for i in range(240) for lang in [sorted(SYLLABLES)[i % 3]]]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 !? #", "fr"), (1003, text_of(rng, "de", 40_000), None), (1004, "x", None), (None, text_of(rng, "fr"), "fr"), (0, rows[0][1], "de")]
    return spark.createDataFrame([(i, t, k, "clash", "r", 1) for i, t, k in rows], SCHEMA)


def test_predictions_and_edge_cases(docs):
    model = language.fit(docs)
    assert model.langs == sorted(SYLLABLES)
    got = [r.asDict(recursive=True) for r in language.identify(docs, model, ["doc_id", "lang", "row"]).collect()]
    assert len(got) == docs.count()
    for r in got:
        i = r["row"]["doc_id"]
        assert 0 <= r["score"] <= 1
        if i in (1000, 1001, 1002):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in SYLLABLES
        if i == 1003:
            assert r["lang_pred"] == "de"
        if i is None or i < 240:
            assert r["lang_pred"] == r["row"]["lang"] and not r["rejected"]


def test_labels_of_held_out_rows_teach_nothing(docs):
    spoiled = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = language.fit(docs), language.fit(spoiled)
    assert a.langs == b.langs and np.array_equal(a.centres, b.centres)


def test_foreign_text_is_rejected(docs):
    model = language.fit(docs)
    assert model.predict(["zzyzx qwfpg jluyq " * 30])[2] == [True]


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert language.identify(empty, language.fit(empty), ["doc_id"]).collect() == []
    one = spark.createDataFrame([(1, "some text", None, "", "", 0)], SCHEMA)
    assert [r["lang_pred"] for r in language.identify(one, language.fit(one), ["doc_id"]).collect()] == ["und"]


def test_slices_count_like_whole_texts(monkeypatch):
    text = text_of(random.Random(1), "fr", 3000)
    whole = language.gram_counts([text])
    monkeypatch.setattr(language, "_SLICE", 1000)
    assert np.array_equal(language.gram_counts([text]), whole)
    assert whole.sum() == len(" ".join(text.lower().split()).encode())  # a trigram at each byte, with the spaces around


def test_held_out_accuracy(spark, sf):
    got = language.op6_language_id(spark, sf).join(storage.table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r["held_out"] and len(r["text"].split()) >= 20]
    assert len(got) == 200 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)


def test_letters_are_category_l(docs):
    """Superscripts, fractions, Roman numerals, circled digits and foreign digits are no letters, quotes and dashes no part of a word."""
    model = language.fit(docs)
    assert model.predict(["²", "½ ③", "Ⅷ", "١٢٣ — “”", "\u0301"])[0] == ["und"] * 5
    assert model.predict(["é", "漢", "ʰ"])[0] != ["und"] * 3 and "und" not in model.predict(["é", "漢", "ʰ"])[0]
    assert (language.gram_counts(["“tho²se—que”"]) == language.gram_counts(["tho se que"])).all()


def test_ties_go_to_the_smaller_code(spark):
    rows = [(i, "same words here", k) for i in range(40) for k in ("bb", "aa")]
    df = spark.createDataFrame([(i, t, k, "", "", 0) for i, t, k in rows], SCHEMA)
    assert {r["lang_pred"] for r in language.identify(df, language.fit(df), ["doc_id"]).collect()} == {"aa"}
