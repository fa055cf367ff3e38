"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

A text's shingles (SHINGLE words, lower-cased, between white space) are hashed once. The top bits of a hash name one of
BINS bins, and each bin keeps its least hash. An empty bin borrows from a filled one by a fixed order of its own
(optimal densification: PROBES hashed tries, then the filled bin of least pair hash), so that two texts borrow alike. The
low byte of each bin is stored, two hex digits a bin. Two fingerprints' likeness is the share of equal bytes, corrected
for the one in 256 that agree by chance; it estimates the Jaccard similarity of the shingle sets.

The bins come out of one sort of an array: each bin's largest possible value is added to the hashes, so that the first
value of each run of one bin is its least hash, or the added value for an empty bin. No row is exploded.

The edited text needs the next document in the order of descending ids. Ids are cut into ranges of like size, rows go to
their range's task with text and fingerprint (one shuffle), and each range gets one row more, the first of the next one.
There are as many ranges as shuffle partitions, or more, so that one holds RANGE_BYTES of text.

Defined cases: a null text is empty; a text without words has the empty fingerprint, which is wholly like another empty
one and unlike any other; fewer words than a shingle make one shingle; equal ids follow by text; null ids come last; a
single document is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

SHINGLE, BIN_BITS, PROBES, RANGE_BYTES = 5, 8, 8, 64 << 20
BINS = 1 << BIN_BITS
_LOW = (1 << (64 - BIN_BITS)) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with a column of BINS bytes (null for a text without words). Columns of steps are kept apart by projections."""
    words, hashes, least, bins = (f"__{out}_{x}" for x in ("words", "hashes", "least", "bins"))
    empties = F.array(*[F.lit(_signed(b << (64 - BIN_BITS) | _LOW)) for b in range(BINS)])
    df = df.withColumn(words, F.expr(rf"transform(filter(split(lower({text}), '[ \\t\\n\\x0B\\f\\r]+'), w -> w <> ''), w -> xxhash64(w))"))
    at = ", ".join(f"get({words}, i + {k})" for k in range(SHINGLE))
    df = df.withColumn(hashes, F.when(F.size(words) > 0, F.expr(f"transform(sequence(0, greatest(size({words}) - {SHINGLE}, 0)), i -> xxhash64({at}))")))
    df = df.withColumn(hashes, F.sort_array(F.concat(hashes, empties)))
    bin_of = f"shiftrightunsigned({{}}, {64 - BIN_BITS})"
    df = df.withColumn(least, F.expr(f"filter({hashes}, (x, i) -> i = 0 or {bin_of.format('x')} <> {bin_of.format(f'get({hashes}, i - 1)')})"))
    df = df.withColumn(bins, F.expr(f"transform({least}, x -> if(x & {_LOW}L = {_LOW}L, null, cast((x & 255) - 128 as int)))"))
    probes = ", ".join(f"get({bins}, cast(pmod(xxhash64(i, {k}), {BINS}) as int))" for k in range(PROBES))
    filled = f"filter(transform({bins}, (x, j) -> if(x is null, null, struct(xxhash64(i, j, 'pair') as h, x as x))), s -> s is not null)"
    df = df.withColumn(out, F.expr(f"transform({bins}, (own, i) -> cast(coalesce(own, {probes}, array_min({filled}).x) as tinyint))"))
    return df.drop(words, hashes, least, bins)


def packed(bins: str) -> Column:
    """The fingerprint as text: two hex digits a bin."""
    digits = F.array(*[F.lit(f"{x:02x}") for x in range(256)])
    return F.coalesce(F.array_join(F.transform(bins, lambda x: F.get(digits, x.cast("int") + 128)), ""), F.lit(""))


def likeness(a: str, b: str) -> Column:
    """Of two columns of bins, from 0 to 1, corrected for bytes that agree by chance."""
    equal = F.expr(f"size(filter(sequence(0, {BINS - 1}), i -> get({a}, i) = get({b}, i)))") / float(BINS)
    fair = F.greatest(F.lit(0.0), (equal - 1 / 256) / (1 - 1 / 256))
    return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(fair)


def _range(id_: str, bounds: list[int]) -> Column:
    """How many bounds lie under the id, by two levels of lookup; null ids count as the least."""
    step = max(1, int(len(bounds) ** 0.5))
    every, all_ = F.array(*[F.lit(x) for x in bounds[step - 1 :: step]]).cast("array<bigint>"), F.array(*[F.lit(x) for x in bounds]).cast("array<bigint>")
    coarse = F.size(F.filter(every, lambda x: x < F.col(id_))) * step
    return F.when(F.col(id_).isNull(), 0).otherwise(coarse + F.size(F.filter(F.slice(all_, coarse + 1, F.lit(step)), lambda x: x < F.col(id_))))


def with_next(docs: DataFrame, id_: str, text: str, prepared: Callable[[DataFrame], DataFrame], carried: list[str]) -> DataFrame:
    """docs, prepared, with next_<name> of the text and of each carried column: the row after it by descending id, the first after the last."""
    given = partitions(docs.sparkSession)
    parts = max(given, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // RANGE_BYTES))
    shares = [k / parts for k in range(1, parts)]
    got = docs.agg(F.percentile_approx(id_, shares or [0.5], max(10_000, 20 * parts)).alias("b")).first()["b"]
    bounds = sorted(set(got or []))
    ranged = docs.withColumn("__range", _range(id_, bounds) if bounds else F.lit(0))
    # the first row of each range, by id alone: as many rows as there are ranges
    tops = {r["__range"]: r["top"] for r in ranged.groupBy("__range").agg(F.max(id_).alias("top")).collect()}
    order = sorted(tops, reverse=True)
    after = {order[i]: order[(i + 1) % len(order)] for i in range(len(order))}
    of = docs.sparkSession.createDataFrame([(tops[b], a) for a, b in after.items()], "__top long, __of int")
    heads = ranged.drop("__range").join(F.broadcast(of), F.col(id_).eqNullSafe(F.col("__top")))  # a row a range: bounded
    heads = heads.groupBy("__of").agg(F.min_by(F.struct(*docs.columns), F.coalesce(text, F.lit(""))).alias("row")).select("row.*", F.col("__of").alias("__range"))
    both = prepared(ranged).withColumn("__real", F.lit(True)).unionByName(prepared(heads).withColumn("__real", F.lit(False)))
    both = both.repartition(parts, "__range") if parts > given else both  # a task a range
    line = Window.partitionBy("__range").orderBy(F.desc("__real"), F.desc_nulls_last(id_), text)
    for name in (text, *carried):
        both = both.withColumn(f"next_{name}", F.lead(name).over(line))
    return both.where("__real").drop("__real", "__range")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", "text", lambda df: with_bins(df, "text", "own"), ["own"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "edited", "own", "next_own")
    rows = with_bins(rows, "edited", "changed")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), packed("own").alias("fingerprint"),
        packed("changed").alias("edited_fingerprint"), likeness("own", "changed").alias("near_edited"), likeness("own", "next_own").alias("near_next"),
    )
