"""Scaling, splits and sampling as plans. Draws depend on seed and row id alone, so results don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import interpolate, uniform
from ..lineage import checkpointed
from .knn import neighbours

#: Into how many slices a class is cut to place its rows by hash, and by score.
SLICES, SCORE_SLICES = 1024, 64


def class_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def class_targets(rows: DataFrame, label: str = "label") -> DataFrame:
    """One row: mean (half to even), largest and smallest class."""
    return class_counts(rows, label).agg(F.bround(F.avg("n")).cast("long").alias("mean_target"), F.max("n").alias("max_target"), F.min("n").alias("min_target"))


def split_classes(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, n, role: the majority (ties: the smaller label) and the minorities by size."""
    place = F.row_number().over(Window.orderBy(F.desc("n"), label))  # over classes, not rows
    return class_counts(rows, label).withColumn("place", place).select(label, "n", F.when(F.col("place") == 1, "majority").otherwise("minority").alias("role"), "place")


def label_index(rows: DataFrame, label: str) -> DataFrame:
    """label, label_idx: from 0 in ascending order of the labels (numbers by value)."""
    return rows.select(label).distinct().withColumn("label_idx", F.row_number().over(Window.orderBy(label)) - 1)


def scale(rows: DataFrame, fit_on: Column, features: str = "features", keys: tuple[str, ...] = ()) -> DataFrame:
    """Standardises features by mean and population deviation of the rows where fit_on holds; constant ones are only shifted."""
    at = rows.where(fit_on).select(*keys, F.posexplode(features).alias("i", "x"))
    stats = at.groupBy(*keys, "i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = stats.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("__stats"))  # one struct a dimension
    joined = rows.join(F.broadcast(stats), list(keys)) if keys else rows.crossJoin(F.broadcast(stats))
    scaled = F.zip_with(features, "__stats", lambda x, t: (x - t["m"]) / F.when(t["s"] > 0, t["s"]).otherwise(1.0))
    return joined.withColumn(features, scaled).drop("__stats")


def with_place(rows: DataFrame, seed: int, *partition: str, id_col: str = "id", out: str = "place", slices: int = SLICES) -> DataFrame:
    """rows with their place (from 1) in each partition by hash.

    A partition may hold a third of all rows, so no window gathers it: the hash, which is even, cuts it into slices; rows
    are placed within their slice, and a count of the slices before it, of bounded size, is added.
    """
    cut = rows.withColumn("__u", uniform(seed, id_col)).withColumn("__slice", F.floor(F.col("__u") * slices).cast("int"))
    sizes = cut.groupBy(*partition, "__slice").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*partition).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select(*[F.col(c).alias(f"__key_{c}") for c in partition], F.col("__slice").alias("__cut"), before.alias("__before"))
    own = F.row_number().over(Window.partitionBy(*partition, "__slice").orderBy("__u", id_col))
    same = F.col("__slice") == F.col("__cut")
    for c in partition:
        same = same & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    placed = cut.withColumn("__own", own).join(F.broadcast(before), same)
    return placed.withColumn(out, F.col("__own") + F.col("__before")).select(*rows.columns, out)


def with_rank(rows: DataFrame, score: Column, *partition: str, id_col: str = "id", out: str = "place", slices: int = SCORE_SLICES) -> DataFrame:
    """rows with their place (from 1) in each partition by rising score, then id.

    A partition may hold a third of all rows, and many of them one score, so no window gathers it: quantiles of the score cut
    it into slices, and a slice of one score is cut by quantiles of the id; rows are placed within their slice, and a count of
    the slices before it is added. What is broadcast has slices squared numbers a partition at most.
    """
    rows = checkpointed(rows.withColumn("__score", score.cast("double")))
    shares = [k / slices for k in range(1, slices)]
    under = lambda bounds, x: F.size(F.filter(bounds, lambda b: b < F.col(x)))

    def met(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        named = right.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *[c for c in right.columns if c not in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
        return left.join(F.broadcast(named), same).drop(*[f"__key_{k}" for k in keys])

    cut = met(rows, rows.groupBy(*partition).agg(F.percentile_approx("__score", shares, 10_000).alias("__b")), *partition).withColumn("__slice", under("__b", "__score"))
    ends = cut.groupBy(*partition, "__slice").agg((F.min("__score") == F.max("__score")).alias("__one"), F.percentile_approx(id_col, shares, 10_000).alias("__ids"))
    cut = met(cut, ends, *partition, "__slice").withColumn("__part", F.when(F.col("__one"), under("__ids", id_col)).otherwise(0))
    sizes = cut.groupBy(*partition, "__slice", "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*partition).orderBy("__slice", "__part").rowsBetween(Window.unboundedPreceding, -1)  # over slices, not rows
    before = sizes.select(*partition, "__slice", "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*partition, "__slice", "__part").orderBy("__score", id_col))
    placed = met(cut.withColumn("__own", own), before, *partition, "__slice", "__part")
    return placed.withColumn(out, F.col("__own") + F.col("__before")).select(*[c for c in rows.columns if c not in (out, "__score")], out)


def stratified_folds(rows: DataFrame, n: int = 5, seed: int = 42, label: str = "label", id_col: str = "id") -> DataFrame:
    """rows with fold (from 1): each class is dealt evenly."""
    placed = with_place(rows, seed, label, id_col=id_col, out="__place")
    return placed.withColumn("fold", ((F.col("__place") - 1) % n + 1).cast("int")).drop("__place")


def stratified_holdout(rows: DataFrame, share: float = 0.3, seed: int = 42, label: str = "label", id_col: str = "id") -> DataFrame:
    """rows with split: ceil(share * n) test rows, apportioned to the classes by largest remainders (ties: the smaller label)."""
    counts = class_counts(rows, label).withColumn("total", F.sum("n").over(Window.partitionBy()))
    counts = counts.withColumn("want", F.col("n") * F.ceil(F.col("total") * share) / F.col("total")).withColumn("low", F.floor("want"))
    place = F.row_number().over(Window.orderBy(F.desc(F.col("want") - F.col("low")), label))
    spare = F.ceil(F.col("total") * share) - F.sum("low").over(Window.partitionBy())
    counts = counts.withColumn("test", F.col("low") + (place <= spare).cast("int")).select(label, "test")
    dealt = with_place(rows, seed, label, id_col=id_col, out="__r").join(F.broadcast(counts), label)
    return dealt.withColumn("split", F.when(F.col("__r") <= F.col("test"), "test").otherwise("train")).drop("__r", "test")


def imbalance_ratio(rows: DataFrame, ir: int, seed: int = 42, label: str = "label", id_col: str = "id") -> DataFrame:
    """The majority whole and of every other class max(1, majority // ir) rows without replacement, or all it has."""
    roles = split_classes(rows, label)
    most = roles.agg(F.max("n").alias("most"))
    want = roles.crossJoin(F.broadcast(most)).select(label, F.when(F.col("role") == "majority", F.col("n")).otherwise(F.greatest(F.lit(1), F.floor(F.col("most") / ir))).alias("want"))
    return with_place(rows, seed, label, id_col=id_col, out="__r").join(F.broadcast(want), label).where("__r <= want").drop("__r", "want")


def random_balance(rows: DataFrame, seed: int = 42, label: str = "label", id_col: str = "id") -> DataFrame:
    """As many rows of each class as the smallest has."""
    least = class_counts(rows, label).agg(F.min("n").alias("least"))
    return with_place(rows, seed, label, id_col=id_col, out="__r").crossJoin(F.broadcast(least)).where("__r <= least").drop("__r", "least")


def stratified_cap(rows: DataFrame, cap: int, seed: int = 42, label: str = "label", id_col: str = "id") -> DataFrame:
    """About cap rows: round(cap * n_c / n) of each class (half to even), one at least."""
    counts = class_counts(rows, label).withColumn("total", F.sum("n").over(Window.partitionBy()))
    want = counts.select(label, F.when(F.col("total") <= cap, F.col("n")).otherwise(F.greatest(F.lit(1), F.bround(F.lit(cap) * F.col("n") / F.col("total")))).alias("want"))
    return with_place(rows, seed, label, id_col=id_col, out="__r").join(F.broadcast(want), label).where("__r <= want").drop("__r", "want")


def weighted_without_replacement(rows: DataFrame, weight: Column, n: int, seed: int, *partition: str, id_col: str = "id") -> DataFrame:
    """n rows of each partition, drawn by weight: the largest log(u) / w (exponential races)."""
    key = F.ln(F.greatest(uniform(seed, id_col), F.lit(1e-12))) / F.greatest(weight, F.lit(1e-12))
    return with_rank(rows, -key, *partition, id_col=id_col, out="__r").where(F.col("__r") <= n).drop("__r")


def self_paced(rows: DataFrame, hardness: str, round_: int, rounds: int, bins: int = 20, seed: int = 42, label: str = "label", id_col: str = "id") -> DataFrame:
    """As many rows of each class as the smallest has, by hardness bins of weight 1 / (mean hardness + tan(pi i / 2(n - 1))).

    A bin gives at most what it holds; what others lack goes to the hardest weights first, a row a bin and turn.
    """
    import math

    alpha = math.tan(math.pi * min(round_, rounds - 1) / (2 * max(1, rounds - 1)))
    least = class_counts(rows, label).agg(F.min("n").alias("least"))
    each = Window.partitionBy(label)  # over bins, not rows
    ends = rows.groupBy(label).agg(F.min(hardness).alias("__low"), F.max(hardness).alias("__high"))
    low, high = F.col("__low"), F.col("__high")
    at = F.when(high > low, F.least(F.floor((F.col(hardness) - low) / (high - low) * bins), F.lit(bins - 1))).otherwise(0)
    binned = rows.join(F.broadcast(ends), label).withColumn("__bin", at).drop("__low", "__high")
    stats = binned.groupBy(label, "__bin").agg(F.avg(hardness).alias("h"), F.count("*").alias("have")).crossJoin(F.broadcast(least))
    stats = stats.withColumn("w", 1 / (F.col("h") + alpha + 1e-12))
    want = F.floor(F.col("least") * F.col("w") / F.sum("w").over(each))
    stats = stats.withColumn("take", F.least("have", want)).withColumn("lack", F.col("least") - F.sum("take").over(each))
    # leftovers: the bins that still have rows, in turns by weight; a bin's j-th spare row comes at turn j
    spare = stats.where("have > take").select(label, "__bin", "w", "lack", F.explode(F.sequence(F.lit(1), F.least(F.col("have") - F.col("take"), F.greatest("lack", F.lit(1))).cast("int"))).alias("turn"))
    more = spare.withColumn("p", F.row_number().over(Window.partitionBy(label).orderBy("turn", F.desc("w"), "__bin"))).where("p <= lack").groupBy(label, "__bin").agg(F.count("*").alias("more"))
    take = stats.join(more, [label, "__bin"], "left").select(label, "__bin", (F.col("take") + F.coalesce("more", F.lit(0))).alias("take"))
    dealt = with_place(binned, seed + round_, label, "__bin", id_col=id_col, out="__r")
    return dealt.join(F.broadcast(take), [label, "__bin"]).where("__r <= take").drop("__r", "__bin", "take")


def synthetic_slots(counts: DataFrame, label: str = "label") -> DataFrame:
    """label, slot: one row for each synthetic row that lifts a class to the largest."""
    want = counts.crossJoin(F.broadcast(counts.agg(F.max("n").alias("most")))).where("n < most")
    return want.select(label, "n", F.explode(F.sequence(F.lit(0), (F.col("most") - F.col("n") - 1).cast("int"))).alias("slot"))


def smote(rows: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """rows (id, label, features) with synthetic ones up to the largest class: a hashed seed row, one of its k nearest of
    the class, a hashed gap; classes of one row give copies. Synthetic ids are negative: a class has 2 ** 40 of its own."""
    rows = checkpointed(rows.select("id", "label", "features"))
    numbered = with_place(rows.select("id", "label", "features"), seed, "label").withColumn("place", (F.col("place") - 1).cast("int"))
    slots = synthetic_slots(class_counts(rows))
    drawn = slots.withColumn("place", F.least(F.floor(uniform(seed, "label", "slot", F.lit("seed")) * F.col("n")), F.col("n") - 1).cast("int"))
    drawn = drawn.join(numbered, ["label", "place"])
    near = checkpointed(neighbours(rows, k, which="same").select("id", "rank", "neighbour"))  # once: it is the dear part
    have = near.groupBy("id").agg(F.max("rank").alias("have"))
    drawn = drawn.join(have, "id", "left").withColumn("rank", (F.floor(uniform(seed, "label", "slot", F.lit("near")) * F.col("have")) + 1).cast("int"))
    drawn = drawn.join(near, ["id", "rank"], "left").join(rows.select(F.col("id").alias("neighbour"), F.col("features").alias("to")), "neighbour", "left")
    made = interpolate("features", F.coalesce("to", "features"), uniform(seed, "label", "slot", F.lit("gap")))
    number = -(F.col("label").cast("long") * (1 << 40) + F.col("slot") + 1)
    return rows.select("id", "label", "features").unionByName(drawn.select(number.alias("id"), "label", made.alias("features")))


def up_down(rows: DataFrame, k: int = 7, seed: int = 42) -> DataFrame:
    """Up-down sampling: minority rows are interpolated toward rows of low reception rate up to the majority's number;
    majority rows are dropped by 1 / rate over its largest value, but never a whole class."""
    from .knn import reception_rate

    rate = reception_rate(rows, k)
    role = split_classes(rows).select("label", "role")
    inverse = 1 / F.greatest("rate", F.lit(1e-6))
    marked = checkpointed(rows.join(rate.select("id", "rate"), "id").join(F.broadcast(role), "label"))
    # one row a class: its largest inverse rate, and the row of the least one, which stays
    most = marked.groupBy("label").agg(F.max(inverse).alias("most"), F.min_by("id", F.struct(inverse, "id")).alias("safest"))
    marked = marked.join(F.broadcast(most), "label").withColumn("p", F.when(F.col("role") == "majority", inverse / F.col("most")).otherwise(0.0))
    kept = marked.where((uniform(seed, "id") >= F.col("p")) | (F.col("id") == F.col("safest"))).select("id", "label", "features")
    return smote(kept, k, seed)
