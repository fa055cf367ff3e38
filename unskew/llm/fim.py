"""Fill-in-middle transformation by DuckDB inside mapInArrow.

Each Arrow batch is registered as a DuckDB view, and one SQL statement cuts its texts into units (runs of ASCII letters, any
other character alone), draws two cuts, the form and whether to transform at all from the sha256 of seed and id, slices
the units into prefix, middle and suffix and joins them with their marks. Arrow comes in and Arrow goes out; Python handles
batches, never rows. Batches are cut to PIECE_BYTES of text, so that a task's memory follows that bound and its longest text.

Defined cases: a null text is empty, and an empty text stays plain; a text that holds a mark stays plain, so that marks in
the output are always the transformation's own; an empty prefix, middle or suffix leaves its mark alone; a null id draws as
the empty text after the seed; rows of one id draw alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Percent of texts to transform, and of those the percent whose suffix comes first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PIECE_BYTES = 4 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _sql(seed: int, transformed: int, suffix_first: int) -> str:
    group = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
    return f"""
        WITH units AS (
            SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS unit, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM batch),
        drawn AS (
            SELECT *, len(unit) AS n, {group(0)} % (len(unit) + 1) AS c1, {group(1)} % (len(unit) + 1) AS c2,
                   CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {group(2)} % 100 >= {transformed} THEN 'plain'
                        WHEN {group(3)} % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form
            FROM units),
        parts AS (
            SELECT doc_id, text, n, form, array_to_string(list_slice(unit, 1, least(c1, c2)), '') AS p,
                   array_to_string(list_slice(unit, least(c1, c2) + 1, greatest(c1, c2)), '') AS m, array_to_string(list_slice(unit, greatest(c1, c2) + 1, n), '') AS s
            FROM drawn)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END AS output
        FROM parts"""


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold `most` bytes, a longer text alone."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output (the text to train on) of every row."""
    bounded_batches(docs.sparkSession)
    sql = _sql(seed, transformed, suffix_first)

    def run(batches):
        with duckdb.connect(config={"threads": 1}) as con:
            for whole in batches:
                for piece in slices(whole, "text", PIECE_BYTES):
                    con.register("batch", pa.Table.from_batches([piece]))
                    yield from con.sql(sql).to_arrow_table().cast(_ARROW).to_batches()
                    con.unregister("batch")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text, rebuilt from a transformed text and its form."""

    def between(one: str, two: str) -> tuple[str, str, str]:
        i, j = f"locate('{two}', {output})", f"locate('{MIDDLE}', {output})"
        after = f"substring({output}, {i} + {len(two)}, {j} - {i} - {len(two)})"
        return f"substring({output}, {len(one) + 1}, {i} - {len(one) + 1})", after, f"substring({output}, {j} + {len(MIDDLE)})"

    p1, s1, m1 = between(PREFIX, SUFFIX)
    s2, p2, m2 = between(SUFFIX, PREFIX)
    return F.expr(f"CASE {form} WHEN 'psm' THEN concat({p1}, {m1}, {s1}) WHEN 'spm' THEN concat({p2}, {m2}, {s2}) ELSE {output} END")
