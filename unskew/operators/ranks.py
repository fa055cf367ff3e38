"""Running sums and exact quantiles without a window over rows.

A partition may hold a third of all rows, or all of them. Quantiles of the ordering value, from mergeable sketches, cut it into
slices of about SLICE_ROWS rows; windows run within slices, and sums of the slices before a row's own, a number a slice, are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import checkpointed

SLICE_ROWS, MOST_SLICES = 100_000, 2000


def _met(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """left joined to right, whose keys are distinct, on keys that may be null."""
    named = right.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return left.join(named, same).drop(*[f"__key_{k}" for k in keys])


def sliced(rows: DataFrame, order: str, *partition: str, slice_rows: int | None = None) -> DataFrame:
    """rows, computed once, with __slice: the more, the larger the largest partition is."""
    rows = checkpointed(rows)
    most = rows.groupBy(*partition).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    slices = min(MOST_SLICES, -(-most // (slice_rows or SLICE_ROWS)))
    if slices <= 1:
        return rows.withColumn("__slice", F.lit(0))
    shares = [k / slices for k in range(1, slices)]
    bounds = rows.groupBy(*partition).agg(F.percentile_approx(order, shares, max(10_000, 20 * slices)).alias("__bounds"))
    # slices numbers a partition: partitions are models or classes
    met = _met(rows, F.broadcast(bounds), *partition) if partition else rows.crossJoin(F.broadcast(bounds))
    return met.withColumn("__slice", F.size(F.filter("__bounds", lambda b: b < F.col(order)))).drop("__bounds")


def prefix_sums(rows: DataFrame, sums: list[str], order: str, *partition: str, slice_rows: int | None = None) -> DataFrame:
    """rows with upto_<c> (sum of c over rows up to this one, by rising order), all_<c> (over the partition) and next (the order of
    the row after it, null for the last). Rows of a partition have different values of order."""
    cut = sliced(rows, order, *partition, slice_rows=slice_rows)
    each = cut.groupBy(*partition, "__slice").agg(*[F.sum(c).alias(c) for c in sums], F.min(order).alias("__first"))
    line, whole = Window.partitionBy(*partition).orderBy("__slice"), Window.partitionBy(*partition)  # over slices, not rows
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(*partition, "__slice", F.lead("__first").over(line).alias("__next"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") for c in sums], *[F.sum(c).over(whole).alias(f"all_{c}") for c in sums])
    own = Window.partitionBy(*partition, "__slice").orderBy(order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.select("*", F.lead(order).over(own).alias("__after"), *[F.sum(c).over(upto).alias(f"__own_{c}") for c in sums])
    met = _met(summed, each, *partition, "__slice")
    return met.select(*rows.columns, F.coalesce("__after", "__next").alias("next"), *[(F.col(f"__before_{c}") + F.col(f"__own_{c}")).alias(f"upto_{c}") for c in sums], *[f"all_{c}" for c in sums])


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], *partition: str, slice_rows: int | None = None) -> DataFrame:
    """partition, and by name the exact quantile (interpolated) of each share of the values that aren't null."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*partition, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    run = prefix_sums(counts, ["__n"], "__v", *partition, slice_rows=slice_rows)
    # the k-th value (from 0) is the one whose rows reach beyond k
    at = {n: F.lit(q) * (F.col("all___n") - 1) for n, q in shares.items()}
    holds = lambda k: (F.col("upto___n") > k) & (F.col("upto___n") - F.col("__n") <= k)
    picked = [a for n, k in at.items() for a in (F.max(F.when(holds(F.floor(k)), F.col("__v"))).alias(f"__low_{n}"), F.max(F.when(holds(F.ceil(k)), F.col("__v"))).alias(f"__high_{n}"), F.max(k - F.floor(k)).alias(f"__part_{n}"))]
    got = run.groupBy(*partition).agg(*picked)
    # equal ends stay as they are, whatever the part
    mixed = lambda n: F.when(F.col(f"__low_{n}") == F.col(f"__high_{n}"), F.col(f"__low_{n}")).otherwise((1 - F.col(f"__part_{n}")) * F.col(f"__low_{n}") + F.col(f"__part_{n}") * F.col(f"__high_{n}"))
    return got.select(*partition, *[mixed(n).alias(n) for n in shares])
