"""A training corpus from documents: language ID, toxicity, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and but for the last returns the
columns of docs. Language ID drops documents without a recognised language, toxicity those that score at or over its
threshold, near-dedup all but one document of each group of near copies (candidates by SimHash's bit-sliced comparison at a
radius wide enough for a Jaccard similarity of 0.8 of five-word shingles, each link confirmed on the shingles); packing
returns the pieces of the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from unskew.llm import langid, neardup, packing, toxicity
from unskew.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.fit(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [("language_id", language_id), ("toxicity", toxic), ("simhash_near_dedup", near_dedup), ("packing", pack)]

#: Packing and the trained stages can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
