"""Licence scans: paragraphs, families that look alike, held-out templates, and the query against plain arithmetic."""

import math
import textwrap

import numpy as np
import pytest
import xxhash

from unskew.llm import license
from unskew.llm import queries as Q

NOTICES = {
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL ": "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
    "CC-BY-NC-SA": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Apache": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce the Work.",
    "MIT": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "EPL": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
}


@pytest.fixture(scope="module")
def model(spark, sf):
    return license.fit(spark.read.parquet(f"{sf}/documents.parquet"))


@pytest.mark.parametrize("width", [0, 30, 72])
@pytest.mark.parametrize("family", NOTICES)
def test_notices_wrapped_or_not(model, family, width):
    text = "\n".join(textwrap.wrap(NOTICES[family], width)) if width else NOTICES[family]
    for around in (text, f"Some words come first, in a line.\n\n{text}\n\nAnd some more words follow after it."):
        assert {f for f, *_ in model.scan([around])[0]} == {family.strip()}


def test_paragraphs():
    wrapped = "\n".join(textwrap.wrap(NOTICES["MIT"], 40))
    assert list(license.paragraphs(f"A line.\n\n{wrapped}\n\n\nThe end")) == [(0, "A line."), (2, NOTICES["MIT"]), (2 + wrapped.count("\n") + 3, "The end")]
    assert list(license.paragraphs("short\nReleased under the MIT License.")) == [(0, "short"), (1, "Released under the MIT License.")]
    assert list(license.paragraphs(None)) == list(license.paragraphs(" \n\n")) == []
    long = "word " * 60
    assert [x for _, x in license.paragraphs(f"{long}\n{long}\nthe end")] == [long.strip(), long.strip(), "the end"]


def plain_probabilities(model, words):
    """Feature by feature, class by class."""
    one = [xxhash.xxh32_intdigest(w) for w in words]
    pairs = [a * 0x9E3779B1 + b * 0x85EBCA77 & (1 << 64) - 1 for a, b in zip(one, one[1:], strict=False)]
    signed = [x - (1 << 64) if x >> 63 else x for x in pairs]
    features = [x & license.DIM - 1 for x in one] + [(x ^ x >> 17) & license.DIM - 1 for x in signed]
    z = [float(model.bias[k]) + sum(float(model.weights[f, k]) for f in features) / math.sqrt(max(1, 2 * len(words) - 1)) for k in range(len(license.FAMILIES))]
    e = [math.exp((x - max(z)) / model.temperature) for x in z]
    return [x / sum(e) for x in e]


def test_query_matches_brute_force(spark, sf, model):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in Q.op9_license_scan(spark, sf).collect()}
    shown = 0
    for i, t in list(texts.items()):
        want = {}
        for line, words in license.windows(t):
            p = plain_probabilities(model, words)
            k = max(range(len(p) - 1), key=lambda k: (p[k], -k))
            family = license.FAMILIES[k]
            if 1 - p[-1] < license.SURE:
                continue
            share = {}
            mine = license._pairs(words)
            for f, templates in license.TEMPLATES.items():
                share[f] = max(len(mine & license._pairs(license.words_of(x))) / max(3, min(len(mine), len(license._pairs(license.words_of(x))))) for x in templates)
            if share[family] >= license.ALIKE and share[family] >= max(share.values()) - license.CLOSER and p[k] > want.get((family, line), (0,))[0]:
                want[family, line] = p[k], share[family]
        found = {(x["family"], x["line"]): (x["probability"], x["likeness"]) for x in got[i]["finds"]}
        assert found.keys() == want.keys() and all(np.allclose(found[k], want[k], rtol=1e-3) for k in want)
        shown += len(want)
    assert shown > 1


def test_temperature_comes_from_templates_left_out(model):
    assert 0.2 <= model.temperature <= 5
    rng = np.random.default_rng(1)
    _, label, part = license._variants(rng, [])
    assert {p for p, k in zip(part, label, strict=True) if k == license.FAMILIES.index("MIT")} == set(range(license.PARTS))


def test_sample_is_bounded_when_ids_repeat(spark):
    made = spark.createDataFrame([(1, f"some words of number {i} that say little") for i in range(400)], "doc_id long, text string")
    model = license.fit(made, unknown=20)
    assert model.scan(["some words of number one that say little"]) == [[]]
