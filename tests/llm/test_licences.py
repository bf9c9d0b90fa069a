import pytest

from kilnframe.llm import licences, storage

SCHEMA = "doc_id long, text string, licences string, families int"


@pytest.fixture(scope="module")
def model():
    return licences.fit()


def families(model, text):
    return [f["family"] for f in model.scan(text)[1]]


@pytest.mark.parametrize(("family", "notice"), [(f, n) for f, notices in licences.TEMPLATES.items() for n in notices])
def test_every_notice_is_found(model, family, notice):
    assert family in families(model, notice)
    n, found = model.scan(f"Ere the oned.\n\n{notice}\n \nThat and onesen.")
    assert n == 3 and (1, family) in [(f["paragraph"], f["family"]) for f in found] and {f["paragraph"] for f in found} == {1}


@pytest.mark.parametrize(
    ("family", "text"),
    [
        ("gpl", "Code: GPL v3"),
        ("mit", "This file is MIT."),
        ("gpl", "Distributed under the GPLv3+."),
        ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is hereby granted, provided that the above"),
        ("mit", "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files (the Software), to deal"),
        ("mit", "Our little parser is made available under the terms of the MIT license"),
        ("apache", "This library may be used under the Apache License, version 2.0, as you like"),
        ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
        ("proprietary", "(c) 1999 Example Corp. All rights reserved. No part may be reproduced"),
        ("lgpl", "the terms of the GNU Lesser General Public License as published"),
    ],
)
def test_wordings_held_out_of_training(model, family, text):
    """None of these is a template; wrapped notices stay together."""
    assert family in families(model, text)


def test_several_families_of_one_paragraph(model):
    assert families(model, "Licensed under the MIT License. " + "ere thon " * 20 + "Some parts: GNU General Public License, version 3.") == ["gpl", "mit"]


@pytest.mark.parametrize("family", ["proprietary", "mit", "apache"])
def test_long_paragraphs_do_not_dilute(model, family):
    notice = licences.TEMPLATES[family][0]
    assert families(model, "ere thon the ofand in " * 4000 + notice + " ering the hend of " * 4000) == [family]


@pytest.mark.parametrize("text", [None, "", "\n\n", *licences.PLAIN, "Ere of the free and the work is under it.", "He works at MIT on licence plates", "The rights of all men were reserved by the king"])
def test_ordinary_text_has_none(model, text):
    assert families(model, text) == []


def test_unknown_licence(model):
    assert families(model, "This work is licensed under the Zorblax License, version 9.") == ["unknown"]
    assert families(model, "Released under the Quux License.") == ["unknown"]


@pytest.mark.parametrize(("family", "text"), [("mpl", "Licensed under the Mozilla Public License, version 2.0"), ("apache", "Licensed under the Apache License, Version 2.0."), ("bsd", "Released under the BSD License."), ("mit", "Released under the MIT License.")])
def test_families_held_out_of_training_are_unknown(family, text):
    assert families(licences.fit([f for f in licences.TEMPLATES if f != family]), text) == ["unknown"]


def test_likeness_against_brute_force():
    """The longest run of template bigrams whose places in the text increase."""
    import random
    from itertools import product

    rng = random.Random(2)
    for _ in range(200):
        words, template = (["ab"[rng.randrange(2)] for _ in range(rng.randrange(2, 7))] for _ in range(2))
        pairs = list(zip(words, words[1:], strict=False))
        wanted = list(zip(template, template[1:], strict=False))
        best = 0
        for places in product(*([None, *[i for i, p in enumerate(pairs) if p == w]] for w in wanted)):
            chosen = [p for p in places if p is not None]
            if all(a < b for a, b in zip(chosen, chosen[1:], strict=False)):
                best = max(best, len(chosen))
        assert licences.likeness(words, tuple(template)) == best / len(wanted)


def test_windows_against_plain_sums(model):
    """Probabilities by blocks of words equal those of each window by itself."""
    words = licences.words_of("This work is licensed under the GNU General Public License, version 3, and all the rest of it is free software " * 7)
    p = model.probabilities(words)
    ids = model._ids(words)
    for i in range(len(p)):
        z = model.bias.astype(float).copy()
        for j in range(i * licences.STEP, min(i * licences.STEP + licences.WINDOW, len(ids))):
            z += model.weights[ids[j]]
            if j + 1 < len(ids):
                z += model.weights[model._features(licences.np.array(ids[j : j + 2]))[1][0]]
        assert abs(p[i] - 1 / (1 + licences.np.exp(-licences.np.clip(z, -30, 30)))).max() < 1e-4


def test_long_text_and_repeats(spark, model):
    long = "Ere the oned thatat.\n\n" * 20_000 + "Released under the MIT License.\n"
    df = spark.createDataFrame([(1, long, "x", 0), (1, long, "x", 0), (None, "All rights reserved.", "x", 0), (2, None, "x", 0)], SCHEMA)
    got = licences.scan_licences(df, model).collect()
    assert sorted((str(r["doc_id"]), r["n_paragraphs"], r["families"]) for r in got) == [("1", 20_001, "mit"), ("1", 20_001, "mit"), ("2", 0, ""), ("None", 1, "proprietary")]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert licences.scan_licences(empty, licences.fit()).collect() == []


def test_query_against_plain_search(spark, sf):
    """The notices of the test data, found by their wording."""
    said = {"GNU General Public": "gpl", "All rights reserved.": "proprietary", "CC BY-NC 4.0": "cc-by-nc", "the MIT License": "mit", "Apache License": "apache"}
    texts = {r["doc_id"]: r["text"] for r in storage.table(spark, sf, "documents").collect()}
    got = {r["doc_id"]: r["families"] for r in licences.op7_license_scan(spark, sf).collect()}
    assert got == {i: ",".join(sorted({f for w, f in said.items() if w in (t or "")})) for i, t in texts.items()}
