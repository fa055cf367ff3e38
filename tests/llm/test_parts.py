"""More parts than shuffle partitions, as large inputs have, change no result."""

import pytest

from unskew.llm import lm, minhash


@pytest.mark.parametrize("bytes_", [20_000, 100_000])
def test_language_model_with_many_parts(spark, sf, monkeypatch, bytes_):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in df.collect())
    few = key(lm.score(docs))
    monkeypatch.setattr(lm, "PART_BYTES", bytes_)
    assert key(lm.score(docs)) == few


def test_fingerprints_with_many_ranges(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda df: sorted(map(tuple, df.collect()))
    few = key(minhash.fingerprints(docs))
    monkeypatch.setattr(minhash, "RANGE_BYTES", 20_000)
    assert key(minhash.fingerprints(docs)) == few
