"""Selections and weights that learners start from, as plans: budgets with class cover, weighted oversampling, target neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import interpolate, uniform
from ..lineage import checkpointed
from .knn import neighbours
from .sampling import with_rank


def budgeted(rows: DataFrame, p: str, most: int, label: str = "label", id_col: str = "id") -> DataFrame:
    """Rows of selection probability p >= .5 and the most probable of a class without any (ties: the smaller id); of over `most`
    the most probable of each class and then overall, classes first if they alone are more."""
    best = rows.groupBy(label).agg(F.max(F.col(p)).alias("__top"), F.min_by(id_col, F.struct(-F.col(p), F.col(id_col))).alias("__best"))  # a row a class
    marked = rows.join(F.broadcast(best), label).withColumn("__first", F.col(id_col) == F.col("__best"))
    wanted = marked.where((F.col(p) >= 0.5) | F.col("__first")).drop("__top", "__best")
    ranked = with_rank(wanted, -F.col("__first").cast("int") * 2 - F.col(p), id_col=id_col, out="__r")
    return ranked.where((F.col("__r") <= most) | F.col("__first")).select(*rows.columns)


def weighted_oversample(rows: DataFrame, weight: str, label, goal: int, k: int = 5, seed: int = 42) -> DataFrame:
    """id (negative), label, features: synthetic rows that lift a class to `goal` rows. A row breeds max(1, its share of the weights)
    times (half to even); if that is too few the rows of most weight breed once more, if too many those of least weight less
    often, once at least; each time toward a hashed one of its k nearest of the class by a hashed gap."""
    own = checkpointed(rows.where(F.col("label") == label).select("id", "label", "features", weight))
    n = own.count()
    if n <= 1 or goal <= n:
        return own.where("false").select("id", "label", "features")
    want = goal - n
    total = own.agg((F.sum(weight) + 1e-10).alias("__sum"))
    counted = own.crossJoin(F.broadcast(total)).withColumn("__n", F.greatest(F.lit(1), F.bround(F.col(weight) / F.col("__sum") * want)).cast("long")).drop("__sum")
    ranked = checkpointed(with_rank(counted, F.col(weight), out="__r"))
    off = want - ranked.agg(F.sum("__n")).first()[0]
    if off > 0:
        ranked = ranked.withColumn("__n", F.col("__n") + (F.col("__r") > n - off).cast("long"))
    elif off < 0:
        # what rows can give up comes from the least weights on, rank by rank; counts by rank are summed in slices of ranks
        spare = ranked.withColumn("__spare", F.col("__n") - 1).withColumn("__slice", F.floor(F.col("__r") / 1024))
        sizes = spare.groupBy("__slice").agg(F.sum("__spare").alias("__s"))
        before = sizes.select(F.col("__slice").alias("__cut"), F.coalesce(F.sum("__s").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # slices, not rows
        inner = F.coalesce(F.sum("__spare").over(Window.partitionBy("__slice").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        met = spare.withColumn("__inner", inner).join(before, F.col("__slice") == F.col("__cut"))
        gone = F.least(F.col("__spare"), F.greatest(F.lit(-off) - F.col("__before") - F.col("__inner"), F.lit(0)))
        ranked = met.withColumn("__n", F.col("__n") - gone)
    near = checkpointed(neighbours(own, k).select("id", "rank", "neighbour"))
    have = near.groupBy("id").agg(F.max("rank").alias("__have"))
    drawn = ranked.where("__n > 0").select("id", "label", "features", "__r", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__copy")).join(have, "id")
    drawn = drawn.withColumn("rank", (F.floor(uniform(seed, "id", "__copy", F.lit("near")) * F.col("__have")) + 1).cast("int")).join(near, ["id", "rank"])
    drawn = drawn.join(own.select(F.col("id").alias("neighbour"), F.col("features").alias("__to")), "neighbour")
    # a column of its own: within the last select, id would be the new one
    drawn = drawn.withColumn("__gap", uniform(seed, "id", "__copy", F.lit("gap")))
    made = interpolate("features", "__to", F.col("__gap"))
    return drawn.select((-(F.col("__r").cast("long") * (1 << 32) + F.col("__copy"))).alias("id"), "label", made.alias("features"))


def target_distribution(rows: DataFrame, k: int = 3) -> DataFrame:
    """id, neighbour, p: softmax of negative squared distances to the max(10, 3 k) nearest rows of the class."""
    near = neighbours(rows, max(10, 3 * k), which="same").withColumn("__d2", F.col("dist") * F.col("dist"))
    lists = near.groupBy("id").agg(F.collect_list(F.struct("neighbour", "__d2")).alias("l"))  # max(10, 3 k) at most
    low = F.array_min(F.transform("l", lambda e: e["__d2"]))
    each = F.transform("l", lambda e: F.struct(e["neighbour"].alias("neighbour"), F.exp(low - e["__d2"]).alias("e")))
    total = F.aggregate(each, F.lit(0.0), lambda s, e: s + e["e"])
    return lists.select("id", F.explode(F.transform(each, lambda e: F.struct(e["neighbour"].alias("neighbour"), (e["e"] / (total + 1e-12)).alias("p")))).alias("x")).select("id", "x.*")


def within_boundary(points: DataFrame, rows: DataFrame) -> DataFrame:
    """id, features: each point (id, label, seed, features) drawn back toward its seed to 0.95 of the way from the seed to the
    nearest row of another class."""
    asked = points.select("id", "label", F.col("seed").alias("features"))
    bound = neighbours(rows, 1, which="other", queries=asked).select("id", F.greatest(F.col("dist") * 0.95, F.lit(1e-12)).alias("__bound"))
    step = F.zip_with("features", "seed", lambda x, s: x - s)
    far = F.sqrt(F.aggregate(F.transform(step, lambda d: d * d), F.lit(0.0), lambda a, d: a + d))
    back = F.zip_with("seed", step, lambda s, d: s + d / far * F.col("__bound"))
    return points.join(bound, "id", "left").select("id", F.when(far > F.col("__bound"), back).otherwise(F.col("features")).alias("features"))
