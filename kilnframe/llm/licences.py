"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are parted by blank lines. Every window of WINDOW words, from every STEP-th word on, of every paragraph is
scored by logistic regressions, one for each licence family and one for ``unknown``, over sparse word unigrams and
bigrams; words outside the vocabulary count as one word. They are trained on TEMPLATES, shortened and set among other
words, against PLAIN sentences, which use the same words otherwise, and random words; ``unknown`` on notices of licences
that are no family here and of made-up names. Each class's scores are calibrated by Platt's method on examples that it
has not seen. A paragraph has a family if some window's probability reaches ACCEPT and some template's word bigrams, in
order and next to each other, lie in and around the window to a share of CONFIRM at least (of a template of one word,
the word). A paragraph without a confirmed family is ``unknown`` if that class, or a family that no template confirms,
reaches ACCEPT_UNKNOWN. No document teaches.

Defined cases: a null or empty text has no paragraphs; a paragraph may have several families, in alphabetical order,
each with its highest confirmed window; repeated rows are scanned alike; a null id stays null; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

STEP = 8
WINDOW = 2 * STEP
ACCEPT, CONFIRM, ACCEPT_UNKNOWN = 0.3, 0.85, 0.8
UNKNOWN = "unknown"
VARIANTS, RANDOM_ROWS = 60, 8000
SEED = 7
_CHUNK = 1 << 16

# Public licence notices and names by family.
TEMPLATES = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "GNU Affero General Public License", "AGPL", "AGPLv3", "SPDX-License-Identifier: AGPL-3.0"],
    "apache": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache License", "Apache 2.0", "Apache-2.0 licensed", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License.", "3-clause BSD license", "2-clause BSD license", "BSD license", "BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0", "Licensed under CC BY 4.0.", "CC BY 4.0", "CC-BY 3.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial", "Licensed under CC BY-NC 4.0.", "CC BY-NC"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike", "Text is available under the CC BY-SA 3.0 license.", "CC BY-SA"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal, public domain dedication.", "CC0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "GNU General Public License", "Licensed under the GPL, version 2.", "Distributed under the GPL", "GPL v3", "GPLv3", "GPL v2", "GPLv2", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "ISC License", "SPDX-License-Identifier: ISC"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "you can redistribute it under the terms of the GNU Lesser General Public License", "GNU Lesser General Public License", "LGPL", "LGPLv3", "SPDX-License-Identifier: LGPL-2.1"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "MIT License", "MIT licensed", "This file is MIT.", "The code is MIT.", "License: MIT", "under MIT", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License", "MPL 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright 2020 The Authors. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "Proprietary and confidential"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "free and unencumbered software", "The Unlicense"],
}
# Notices of licences that are no family above, {} a made-up name.
OTHER_NOTICES = [
    "This work is licensed under the {} License, version 9.", "Licensed under the {} Public License.", "Released under the {} License.", "Distributed under the terms of the {} license, version 2.", "SPDX-License-Identifier: {}", "License: {}",
    "Licensed under the Eclipse Public License, v. 1.0.", "Boost Software License, Version 1.0", "This software is provided under the zlib license.", "Distributed under the Artistic License 2.0.", "Licensed under the European Union Public Licence", "This file is available under the {} licence.",
    "Use of this source is governed by the {} license", "You may copy this under the {} licence terms.",
]
# Sentences with the words of notices that are no notice.
PLAIN = [
    "The MIT campus license plate office of copyright", "She studied at MIT and works on free software", "He lost his driver's license and the license plate of the car", "The apache helicopter landed near the public school", "The Apache people of the general area used this land",
    "The reserved seats are all taken, and the public may copy this version.", "All seats are reserved for the authors", "All the rights of the people are to be reserved in law", "Permission to enter is granted free of charge to any person with a copy of the ticket", "The general public can use the library under the terms of the museum",
    "general public commons", "Creative people share alike in the commons of the international house", "The attribution of this work to the author is international", "You may not use this except in compliance with the rules", "The source code forms part of the form in binary",
    "The copyright office published a notice", "Fishing license fees are published by the state", "The eclipse was seen by the public in version one of the film", "This file is new and the code is free", "The foundation is free and modified its terms", "The clause of the contract is subject to law",
    "Er kommt mit dem Zug und mit dem Rad", "mit Freunden mit der Bahn und mit viel Zeit mit allen", "mit mit mit mit mit", "sie geht mit, er bleibt hier mit mir", "mit Blick auf das Meer, mit Garten, mit Bad",
    "Mozilla and the university of california published a version of the program", "Redistribution of land is permitted with conditions", "The software is published and distributed free of charge", "Under the terms of the treaty the public domain is possible", "The author has waived all fees to the extent possible", "A copy of this documentation is in the files of the library",
]
# Words that tell nothing by themselves or beside each other.
STOP = frozenset("the of and in to a an is it that for on with as by or at be are from all any not you he she was were may can no his".split())
_NAME = "madeupname"
_WORD = re.compile(r"[a-z0-9]+")
_BLANK = re.compile(r"\n[^\S\n]*\n")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


@cache
def templates_of(family: str) -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(words_of(t)) for t in TEMPLATES[family])


def likeness(words: list[str], template: tuple[str, ...]) -> float:
    """Share of the template's word bigrams that occur in words in the template's order; of one word, whether it does."""
    if len(template) == 1:
        return float(template[0] in words)
    places: dict[tuple[str, str], list[int]] = {}
    for i, pair in enumerate(zip(words, words[1:], strict=False)):
        places.setdefault(pair, []).append(i)
    ends: list[int] = []  # the longest increasing run of places, one for each template bigram at most
    for pair in zip(template, template[1:], strict=False):
        for at in reversed(places.get(pair, [])):
            k = int(np.searchsorted(ends, at))
            ends[k : k + 1] = [at]
    return len(ends) / (len(template) - 1)


class Model:
    """Weights of n-grams by class, with the calibration folded in."""

    def __init__(self, families: list[str] | None = None) -> None:
        rng = random.Random(SEED)
        others = [t.format(_NAME) for t in OTHER_NOTICES]
        self.classes = [*sorted(families or TEMPLATES), UNKNOWN]
        texts = [t for name in self.classes[:-1] for t in TEMPLATES[name]] + others + PLAIN
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in words_of(t)} - {_NAME}), start=1)}  # 0: any other word
        self.size = len(self.vocabulary) + 1
        usual = [self.vocabulary[w] for t in texts for w in words_of(t) if w in self.vocabulary]  # words as often as they occur
        rows: list[tuple[list[int], tuple[int, ...]]] = []

        def place(own: list[int], kinds: tuple[int, ...], room: int) -> None:
            """own, or a part of a window's length, among other words."""
            if len(own) > WINDOW:
                begin = rng.randrange(len(own) - WINDOW + 1)
                own = own[begin : begin + WINDOW]
            before = rng.randrange(min(room, WINDOW - len(own)) + 1)
            after = rng.randrange(min(room, WINDOW - len(own) - before) + 1)
            rows.append((self._filler(rng, before, usual) + own + self._filler(rng, after, usual), kinds))

        own_words = {name: [self._ids(words_of(t)) for t in (others if name == UNKNOWN else TEMPLATES[name])] for name in self.classes}
        for k, name in enumerate(self.classes):
            for own in own_words[name]:
                for v in range(VARIANTS):
                    cut = own if v % 3 or len(own) < 5 else [w for w in own if rng.random() > 0.1]
                    if name == UNKNOWN and v % 2:
                        cut = [x for w in cut for x in ([0, 0] if w == 0 else [w])]
                    place(cut, (k,), (0, 4, WINDOW)[v % 3])
            for _ in range(VARIANTS):  # two families side by side
                j = rng.randrange(len(self.classes) - 1)
                if name != UNKNOWN and j != k:
                    one, other = (rng.choice([w for w in own_words[self.classes[c]] if len(w) < 9]) for c in (k, j))
                    place((one + self._filler(rng, 1, usual) + other)[:WINDOW], (k, j), 2)
        for plain in PLAIN:
            for v in range(VARIANTS):
                place(self._ids(words_of(plain)), (), (0, 4, WINDOW)[v % 3])
        rows += [(self._filler(rng, rng.choice((4, 12, 16, 16)), usual), ()) for _ in range(RANDOM_ROWS)]
        rng.shuffle(rows)
        met = Counter(self._pair(a, b) for r, _ in rows for a, b in zip(r, r[1:], strict=False) if a or b)
        pairs = sorted(k for k, n in met.items() if n >= 4)
        self.pairs = np.array(pairs, dtype=np.int64)
        x = np.zeros((len(rows), self.size + len(pairs) + 2), dtype=np.float32)
        for i, (r, _) in enumerate(rows):
            u, p = self._features(np.array(r, dtype=np.int64))
            np.add.at(x[i], u, 1)
            np.add.at(x[i], p, 1)
        # Other words and STOP words alone or beside each other, and pairs not known, tell nothing.
        mute = np.array([True, *(w in STOP for w in self.vocabulary)])
        self.mute = np.concatenate([mute, mute[self.pairs // self.size] & mute[self.pairs % self.size], [True, False]])
        x[:, self.mute] = 0
        x[:, -1] = 1
        y = np.array([[c in kinds for c in range(len(self.classes))] for _, kinds in rows], dtype=np.float32)
        seen = np.arange(len(rows)) % 4 > 0
        weights = self._train(x[seen], y[seen])
        self.weights, self.bias = self._calibrated(weights, x[~seen], y[~seen])

    def _pair(self, a: int, b: int) -> int:
        return a * self.size + b

    def _ids(self, words: list[str]) -> list[int]:
        return [self.vocabulary.get(w, 0) for w in words]

    @staticmethod
    def _filler(rng: random.Random, n: int, usual: list[int]) -> list[int]:
        return [0 if rng.random() < 0.6 else rng.choice(usual) for _ in range(n)]

    def _features(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns of each word, and of each pair of neighbours (the last but one, before the intercept, if not known)."""
        pair = ids[:-1].astype(np.int64) * self.size + ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        known = self.pairs[at] == pair if len(self.pairs) else np.zeros(len(pair), bool)
        return ids, np.where(known, self.size + at, self.size + len(self.pairs))

    @staticmethod
    def _train(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.05, ridge: float = 5e-5) -> np.ndarray:
        """Adam on the mean logistic loss of each class."""
        w = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32)
        first, second = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, rounds + 1):
            slope = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / len(x) + ridge * w
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
            w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        return w

    def _calibrated(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each class's logit as a * logit + b, fitted by Newton's method."""
        out = w.astype(np.float64)
        z = x @ w
        for c in range(y.shape[1]):
            f = np.stack([z[:, c], np.ones(len(z))], axis=1).astype(float)
            v = np.array([1.0, 0.0])
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(f @ v, -30, 30)))
                v += np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + 0.05 * np.eye(2), f.T @ (y[:, c] - p) - 0.05 * (v - [1.0, 0.0]))
            out[:, c] *= v[0]
            out[-1, c] += v[1]
        bias = out[-1].copy()
        out[self.mute] = 0
        out[-1] = 0
        return out.astype(np.float32), bias.astype(np.float32)

    def probabilities(self, words: list[str]) -> np.ndarray:
        """Of each window (a row, of words from STEP times its number on) by class. Only words and pairs of the vocabulary
        have weights; a pair belongs to the window that its first word is in."""
        ids = np.array(self._ids(words))
        blocks = []
        for at in range(0, len(ids), _CHUNK):
            uni, pair = self._features(ids[at : at + _CHUNK + 1])
            n = min(_CHUNK, len(ids) - at)
            sums = self.weights[uni[:n]]
            sums[: len(pair)] += self.weights[pair[:n]]
            blocks.append(np.add.reduceat(sums, np.arange(0, n, STEP), axis=0))
        part = np.concatenate(blocks)
        z = part if len(part) == 1 else part[:-1] + part[1:]
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))

    def classify(self, paragraph: str) -> list[tuple[str, float, float]]:
        """(family, probability, likeness to the family's nearest template) of a paragraph's licences."""
        words = words_of(paragraph)
        if not words:
            return []
        p = self.probabilities(words)
        found: dict[str, tuple[str, float, float]] = {}
        denied = p[:, -1].max()
        for i, c in np.argwhere(p[:, :-1] >= ACCEPT):
            near = words[max(0, i * STEP - WINDOW) : i * STEP + 2 * WINDOW]
            like = max(likeness(near, t) for t in templates_of(self.classes[c]))
            if like >= CONFIRM:
                found[self.classes[c]] = max(found.get(self.classes[c], ("", 0.0, 0.0)), (self.classes[c], float(p[i, c]), like))
            else:
                denied = max(denied, p[i, c])
        if not found and denied >= ACCEPT_UNKNOWN:
            return [(UNKNOWN, float(denied), 0.0)]
        return [found[f] for f in sorted(found)]

    def scan(self, text: str | None) -> tuple[int, list[dict]]:
        """The number of paragraphs, and the licences that are found in them."""
        paragraphs = [p for p in _BLANK.split(text or "") if p.strip()]
        found = [{"paragraph": i, "family": f, "probability": p, "likeness": like} for i, x in enumerate(paragraphs) for f, p, like in self.classify(x)]
        return len(paragraphs), found


def fit(families: list[str] | None = None) -> Model:
    """A model of the given families, else of all."""
    return Model(families)


def scan_licences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, licences (paragraph, family, probability, likeness) and families for every row of docs."""
    kinds = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scan(t.as_py()) for t in batch.column(1)]
            families = [",".join(sorted({f["family"] for f in x})) for _, x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], kinds), pa.array(families, pa.string())], ["doc_id", "n_paragraphs", "licences", "families"])

    schema = storage.schema_of(doc_id=docs.schema[id_col].dataType, n_paragraphs="long", licences="array<struct<paragraph: int, family: string, probability: double, likeness: double>>", families="string")
    return storage.map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, schema)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(storage.table(spark, sf_dir, "documents"), fit())
