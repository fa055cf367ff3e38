"""The queries of this package, each an operator with production parameters over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fim, html, langid, license, lm, minhash, mixing, packing, phrases, pieces, simhash, topk, toxicity
from .common import table


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license.scan(docs, license.fit(docs))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    return pieces.round_trip(docs, path, scores=pieces.fit(docs, path))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restored()).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_groups, op2_html_text, op3_exact_topk, op4_language_id, op5_packing, op6_toxicity, op7_minhash, op8_lm_score, op9_license_scan, op10_sentencepiece, op11_phrases, op12_mixing, op13_fill_in_middle, pipeline)
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_topk": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        placed AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5""",
    "op11_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
        occurrences AS (
            SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
            FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4]) AS k))),
        known AS (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS f FROM occurrences GROUP BY ALL HAVING count(*) >= 30),
        candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM known WHERE k > 1),
        inside AS (
            SELECT DISTINCT c.lang, c.phrase FROM (
                SELECT lang, f, array_to_string(string_split(phrase, ' ')[i : i + m - 1], ' ') AS short
                FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS i FROM known, (SELECT unnest([2, 3]) AS m) WHERE m < k)) g
            JOIN candidates c ON c.lang = g.lang AND c.phrase = g.short WHERE 100 * g.f::HUGEINT >= 80 * c.a::HUGEINT),
        cuts AS (
            SELECT *, array_to_string(w[1:j], ' ') AS p, array_to_string(w[j + 1:k], ' ') AS q
            FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM inside x WHERE x.lang = c.lang AND x.phrase = c.phrase))),
        scores AS (
            SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, CAST((2000000 * c.a::HUGEINT) // (x.f::HUGEINT + y.f::HUGEINT) AS BIGINT) AS score, j
            FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = c.p JOIN known y ON y.lang = c.lang AND y.phrase = c.q),
        lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM lowest JOIN total USING (lang) QUALIFY rank <= 2000""",
    "op12_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (
            SELECT *, 2.0::DOUBLE * source_size AS cap, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
                   1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
        o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source) AS place FROM w),
        levels AS (
            SELECT *, coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
                   sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM o),
        level AS (SELECT budget - held AS spare, weights FROM levels WHERE weight * (budget - held) / weights <= cap ORDER BY place LIMIT 1),
        t AS (SELECT source, source_size, least(cap, coalesce(weight * spare / weights, cap)) AS target FROM w LEFT JOIN level ON true),
        g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal FROM t),
        c AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS copies FROM g),
        r AS (SELECT *, goal - copies * source_size AS rest FROM c),
        b AS (
            SELECT d.*, source_size, target, copies, rest, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS alike
            FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, size, source_size, target, source,
               CAST(copies * size + CASE WHEN upto <= rest THEN size WHEN upto - alike >= rest THEN 0
                    ELSE least(size, (2 * size * (rest - upto + alike) + alike) // (2 * alike)) END AS BIGINT) AS taken
        FROM b""",
    "op13_fill_in_middle": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        u AS (SELECT *, list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]'), lambda x: length(x)) AS sizes FROM t),
        k AS (
            SELECT *, len(sizes) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(sizes) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(sizes) + 1) AS y,
                   ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM u),
        c AS (
            SELECT *, CAST(coalesce(list_sum(sizes[1 : least(x, y)]), 0) AS BIGINT) AS p, CAST(coalesce(list_sum(sizes[least(x, y) + 1 : greatest(x, y)]), 0) AS BIGINT) AS m,
                   CASE WHEN text = '' OR h3 >= 90 OR regexp_matches(text, '<[PSM]>') THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                   WHEN 'psm' THEN '<P>' || substr(text, 1, p) || '<S>' || substr(text, p + m + 1) || '<M>' || substr(text, p + 1, m)
                   ELSE '<S>' || substr(text, p + m + 1) || '<P>' || substr(text, 1, p) || '<M>' || substr(text, p + 1, m) END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM c""",
}
