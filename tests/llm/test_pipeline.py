"""The pipeline against its stages by brute force, near copies at a Jaccard similarity of 0.8 of five-word shingles."""

import itertools
from collections import Counter

import pytest

import __spark_entry__ as entry
from unskew.llm import langid, packing, toxicity

from test_neardup import linked, plain_set
from test_truth import roots

P = pytest.importorskip("public_tokenizers")


def test_pipeline_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    lang = langid.Model(langid.fit(docs))
    kept = {i: t for i, t in texts.items() if lang.predict(t)[0] != "und"}
    lexicon = toxicity.fit(docs.where(docs.doc_id.isin(list(kept))), spark.read.parquet(f"{sf}/labels.parquet"))
    ids = sorted(i for i, t in kept.items() if lexicon.score(t) < toxicity.THRESHOLD)
    sets = [plain_set(kept[i]) for i in ids]
    root = roots(len(ids), [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if linked(sets[a], sets[b])])
    stay = sorted({ids[r] for r in root})
    words = packing.Words(P.path("word_bpe_49k.json"))
    want = {i: len(x) + 1 for i, x in zip(stay, words.ids([kept[i] for i in stay]), strict=True)}
    assert all(lang.predict(texts[i])[0] == "und" or lexicon.score(texts[i]) >= toxicity.THRESHOLD for i in set(texts) - set(ids))
    got = Counter()
    for r in entry.queries()["pipeline"](spark, sf).collect():
        got[r["doc_id"]] += r["length"]
    assert set(got) == set(stay)
    assert dict(got) == want and 0 < len(stay) < len(ids)
