"""Licence scans: a trained paragraph classifier whose finds are confirmed by template comparison.

A text's lines are joined into paragraphs where they are wrapped (the next line's first word would not have fitted), and
paragraphs are cut into windows of at most WINDOW words, half overlapping. A window's words and word pairs (lower
case, numbers as one sign) are hashed into DIM features, weighted so that each window has length one. A multinomial
logistic regression gives each licence family and the unknown class a probability, after a temperature. A window counts as
licence text of its likeliest family if the families together are at least as likely as SURE, the share of word pairs that it
has in common with one of the family's templates (of the smaller side) reaches ALIKE, and no other family's template is more
alike (by CLOSER).

Training: the templates below with their usual variations (openings, holders, years, lost words, other words around them)
against the unknown class, a bounded sample of UNKNOWN windows of the corpus at most, of least hash, without those alike a
template, and sentences that speak of licences without granting one. The temperature is fitted on what training hasn't seen:
PARTS times, a part of the templates, with all their variations, and of the unknown texts is left out, and the one
temperature under which all left-out windows are likeliest is taken. Everything else reads all windows of all texts, in one
map without a shuffle.

Defined cases: null and blank texts have no window and no licence; ties go to the first family by name; an empty corpus
trains on templates alone; repeated rows are scanned row by row; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

WINDOW, DIM, SURE, ALIKE, CLOSER, UNKNOWN, VARIANTS, SEED, PARTS = 48, 1 << 15, 0.5, 0.6, 0.05, 3000, 30, 7, 3
#: Lines longer than this aren't taken for wrapped ones.
WIDE = 120
#: Notices and typical sentences of public licences, by family.
TEMPLATES = {
    "AGPL": [
        "licensed under the GNU Affero General Public License version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.", "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Distributed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-NC-ND": ["Licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0": ["CC0 1.0 Universal Public Domain Dedication", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "Licensed under the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.", "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program, to make sure it remains free software for all its users.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License", "SPDX-License-Identifier: ISC"],
    "LGPL": [
        "licensed under the GNU Lesser General Public License version 2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.", "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "MIT": [
        "Released under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "This project is licensed under the MIT License - see the LICENSE file for details",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "SPDX-License-Identifier: MIT",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "SPDX-License-Identifier: Zlib",
    ],
}
OPENINGS = ["", "This project is", "This software is", "The code is", "Copyright (c) 2021 A. Holder.", "Copyright 2019 The Authors. All rights reserved.", "Note:", "This file is", "License:", "All content"]
OTHER = [
    "He lost his driver's license after the accident last year.", "The restaurant was granted a liquor license by the city.", "A licensed electrician must sign the form.", "The company sells a commercial license for its software; contact sales.",
    "You need permission to use the car park of the building.", "All rights reserved. No part of this publication may be reproduced.", "The warranty covers all parts for two years.", "She works at the public library under a new contract.",
    "The Apache helicopter was seen above the valley.", "Students of MIT released a new robot on Friday.", "The general public was invited to the opening of the foundation.", "Software and documentation are sold separately without restriction on quantity.",
]
FAMILIES = [*sorted(TEMPLATES), "unknown"]
_WORD = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)*")


def words_of(text: str) -> list[str]:
    return ["#" if w[0].isdigit() else w for w in _WORD.findall(text.lower())]


def paragraphs(text: str | None):
    """(number of the first line, text) of each paragraph: wrapped lines of a run without blank lines are joined."""
    run: list[tuple[int, str]] = []
    for number, line in enumerate([*text.split("\n"), ""] if text else ()):
        if line.strip():
            run.append((number, line.strip()))
            continue
        most = max((len(x) for _, x in run), default=0)
        held: list[str] = []
        for k, (at, x) in enumerate(run):
            first = at if not held else first
            held.append(x)
            # wrapped: the line is full, that is, the next one's first word had no room
            if not (most <= WIDE and k + 1 < len(run) and len(x) + 1 + len(run[k + 1][1].split(None, 1)[0]) > most):
                yield first, " ".join(held)
                held = []
        run = []


def windows(text: str | None):
    """(number of the first line of the paragraph, words) of each window."""
    for line, x in paragraphs(text):
        words = words_of(x)
        for at in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2):
            if words:
                yield line, words[at : at + WINDOW]


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(["", *words], [*words, ""], strict=True)) if len(words) < 2 else set(zip(words, words[1:], strict=False))


@lru_cache(1)
def _templates() -> dict[str, list[set]]:
    return {k: [_pairs(words_of(x)) for x in v] for k, v in TEMPLATES.items()}


def alike(words: list[str], family: str) -> float:
    """The largest share of word pairs that a window has in common with a template of the family, of the smaller side."""
    mine = _pairs(words)
    return max((len(mine & t) / max(3, min(len(mine), len(t))) for t in _templates()[family]), default=0.0)


class Hasher:
    """Numbers of words, remembered up to a bound; features of windows."""

    def __init__(self, bound: int = 200_000):
        self.known: dict[str, int] = {}
        self.bound = bound

    def features(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, value and window (sorted) of each word and pair of all windows."""
        if len(self.known) > self.bound:
            self.known.clear()
        flat = list(chain.from_iterable(found))
        new = list(set(flat).difference(self.known))
        self.known.update(zip(new, map(xxhash.xxh32_intdigest, new), strict=True))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        one = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        row = np.repeat(np.arange(len(found)), sizes)
        inner = row[1:] == row[:-1]
        two = (one[:-1] * 0x9E3779B1 + one[1:] * 0x85EBCA77)[inner]
        feature = np.concatenate([one, two ^ two >> 17]) & (DIM - 1)
        window = np.concatenate([row, row[1:][inner]])
        value = 1 / np.sqrt(np.maximum(1, 2 * sizes - 1))
        order = np.argsort(window, kind="stable")
        return feature[order], value[window[order]], window[order]


class Classifier:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.weights, self.bias, self.temperature = weights, bias, temperature
        self.hasher = Hasher()

    def logits(self, found: list[list[str]]) -> np.ndarray:
        out = np.tile(self.bias, (len(found), 1))
        if found:
            feature, value, window = self.hasher.features(found)
            first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
            out[window[first]] += np.add.reduceat(self.weights[feature] * value[:, None].astype(np.float32), first, axis=0)
        return out

    def probabilities(self, found: list[list[str]]) -> np.ndarray:
        z = self.logits(found) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, float, float]]]:
        """Of each text the confirmed finds: (family, line, probability, likeness), one for each line and family."""
        rows = [(i, line, words) for i, x in enumerate(texts) for line, words in windows(x)]
        out: list[dict] = [{} for _ in texts]
        p = self.probabilities([w for _, _, w in rows])
        best = p[:, :-1].argmax(1) if len(p) else np.empty(0, np.int64)
        for k in np.flatnonzero(1 - p[:, -1] >= SURE):
            i, line, words = rows[k]
            family, sure = FAMILIES[best[k]], float(p[k, best[k]])
            if (same := alike(words, family)) >= ALIKE and same >= max(alike(words, f) for f in TEMPLATES) - CLOSER:
                if sure > out[i].get((line, family), (0.0, 0.0))[0]:
                    out[i][line, family] = sure, same
        return [[(f, line, *v) for (line, f), v in sorted(x.items())] for x in out]


def _variants(rng: np.random.Generator, noise: list[list[str]]) -> tuple[list[list[str]], list[int], list[int]]:
    """Words, class and part of the variations of all templates and of what only looks like one; a template's part is one."""
    found, label, part = [], [], []
    for k, family in enumerate(FAMILIES[:-1]):
        for number, text in enumerate(TEMPLATES[family]):
            for n in range(VARIANTS):
                words = words_of(f"{OPENINGS[n % len(OPENINGS)]} {text}")
                if n >= len(OPENINGS):  # some words are lost, but not those that tell the family
                    some = [w for w in words if rng.random() > 0.1]
                    likeness = {f: alike(some, f) for f in TEMPLATES}
                    words = some if some and likeness[family] == max(likeness.values()) else words
                words = words[:WINDOW]
                if n % 3 == 2 and noise:  # other words before and after
                    one, two = (noise[int(i)] for i in rng.integers(0, len(noise), 2))
                    words = [*one[-int(rng.integers(1, 12)) :], *words, *two[: int(rng.integers(0, 12))]][:WINDOW]
                found.append(words)
                label.append(k)
                part.append(number % PARTS)
    for number, text in enumerate(OTHER):
        for n in range(VARIANTS // 2):
            words = words_of(text)
            found.append([w for w in words if not n or rng.random() > 0.15] or words)
            label.append(len(FAMILIES) - 1)
            part.append(number % PARTS)
    return found, label, part


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unknown: int = UNKNOWN) -> Classifier:
    """Trains on templates and at most `unknown` windows of the corpus, those of least hash."""
    bounded_batches(docs.sparkSession)
    total = docs.where(F.col(text_col).isNotNull()).count()
    bar = F.lit(max(-(1 << 63), -(1 << 63) + (1 << 64) * min(2 * unknown, total) // max(1, total) - 1))
    h = F.xxhash64(id_col, text_col)
    some = docs.where(F.col(text_col).isNotNull() & (h <= bar)).select(F.col(text_col).alias("text"), h.alias("h"))

    def pick(dfs):
        """One window of each text, wherever its hash falls."""
        for df in dfs:
            all_ = [(list(windows(x)), h) for x, h in zip(df["text"], df["h"], strict=True)]
            kept = [(" ".join(w[h % len(w)][1]), h) for w, h in all_ if w]
            yield pd.DataFrame({"words": pd.Series([x for x, _ in kept], dtype=object), "h": pd.Series([h for _, h in kept], dtype="int64")})

    rows = some.mapInPandas(pick, "words string, h long").dropDuplicates(["h"]).orderBy("h").limit(unknown).collect()  # equal texts count once
    return learn([r["words"].split(" ") for r in rows])


def learn(corpus: list[list[str]]) -> Classifier:
    """The classifier of the templates against the corpus's windows."""
    rng = np.random.default_rng(SEED)
    corpus = [words for words in corpus if max(alike(words, f) for f in TEMPLATES) < 0.4]
    found, label, part = _variants(rng, corpus)
    found += corpus
    label = np.array(label + [len(FAMILIES) - 1] * len(corpus))
    part = np.array(part + [k % PARTS for k in range(len(corpus))])
    features = Hasher().features(found)
    left = [(_train(features, label, part != k).logits([w for w, p in zip(found, part, strict=True) if p == k]), label[part == k]) for k in range(PARTS)]
    z, y = (np.concatenate(x) for x in zip(*left, strict=True))
    model = _train(features, label, np.ones(len(label), bool))
    # the temperature under which windows that training hasn't seen are likeliest
    loss = lambda t: -np.mean((z / t - np.log(np.exp(z / t - (z / t).max(1, keepdims=True)).sum(1, keepdims=True)) - (z / t).max(1, keepdims=True))[np.arange(len(y)), y])
    model.temperature = float(min(np.geomspace(0.2, 5, 41), key=loss))
    return model


def _train(features: tuple[np.ndarray, np.ndarray, np.ndarray], label: np.ndarray, some: np.ndarray, rounds: int = 60, rate: float = 20.0, ridge: float = 1e-6) -> Classifier:
    """Full-batch gradient steps with a per-feature rate (Adagrad) over some of the windows."""
    feature, value, window = features
    kept = some[window]
    feature, value, window = feature[kept], value[kept], (np.cumsum(some) - 1)[window[kept]]
    label = label[some]
    n, k = len(label), len(FAMILIES)
    weights, bias, seen = np.zeros((DIM, k)), np.zeros(k), np.full((DIM, k), 1e-8)
    target = np.eye(k)[label]
    share = np.bincount(label, minlength=k)
    target_weight = (n / (k * np.maximum(1, share)))[label][:, None] ** 0.5
    first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
    used, feature = np.unique(feature, return_inverse=True)
    weights, seen = weights[used], seen[used]
    for _ in range(rounds):
        z = np.tile(bias, (n, 1))
        z[window[first]] += np.add.reduceat(weights[feature] * value[:, None], first, axis=0)
        p = np.exp(z - z.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True) - target) * target_weight / n
        gradient = np.stack([np.bincount(feature, p[window, j] * value, len(used)) for j in range(k)], 1) + ridge * weights
        seen += gradient**2
        weights -= rate / 20 * gradient / np.sqrt(seen)
        bias -= rate * p.sum(0)
    all_ = np.zeros((DIM, k), np.float32)
    all_[used] = weights
    return Classifier(all_, bias)


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_windows, licenses (families, by name), and the finds (family, line, probability, likeness) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    find = pa.struct([("family", pa.string()), ("line", pa.int64()), ("probability", pa.float64()), ("likeness", pa.float64())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 250):
                part = b.slice(at, 250)
                texts = part.column(1).to_pylist()
                got = shared.value.scan(texts)
                finds = [[dict(zip(("family", "line", "probability", "likeness"), x, strict=True)) for x in one] for one in got]
                names = [sorted({x[0] for x in one}) for one in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.list_(pa.string())), pa.array(finds, pa.list_(find))], ["doc_id", "licenses", "finds"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, licenses array<string>, finds array<struct<family: string, line: long, probability: double, likeness: double>>")
