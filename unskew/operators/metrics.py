"""Ten classification metrics as aggregates of predictions: keys, y int, yhat int, proba array<double> (one value a class).

Everything but the two ranking metrics follows from the confusion counts, which are pre-aggregated before any shuffle by
label. Keys may be any columns (dataset, fold, model); all metrics come out for each key at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import prefix_sums

RECALL_FLOOR = 1e-3


def confusion(pred: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, yhat, n."""
    return pred.groupBy(*keys, "y", "yhat").agg(F.count("*").alias("n"))


def row_normalised(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts pooled over all other keys, with each label's share; labels without support have none."""
    pooled = counts.groupBy(*keys, "y", "yhat").agg(F.sum("n").alias("n"))
    support = F.sum("n").over(Window.partitionBy(*keys, "y"))
    return pooled.select(*keys, "y", "yhat", "n", F.round(F.col("n") / support, 6).alias("share"))


def per_class(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, c, tp, actual, predicted: of each label that occurs as truth or prediction."""
    both = counts.select(*keys, F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("yhat").alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted")),
    )).alias("e")).select(*keys, "e.*")
    return both.groupBy(*keys, "c").agg(*(F.sum(x).alias(x) for x in ("tp", "actual", "predicted")))


def from_confusion(counts: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """Accuracy, macro precision, recall and F1 (over labels in truth or prediction), GMean, MCC, IBA, Kappa."""
    total = Window.partitionBy(*keys)
    c = per_class(counts, keys).withColumn("s", F.sum("actual").over(total))
    recall = F.when(F.col("actual") > 0, F.col("tp") / F.col("actual")).otherwise(0.0)
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    f1 = F.when(F.col("actual") + F.col("predicted") > 0, 2 * F.col("tp") / (F.col("actual") + F.col("predicted"))).otherwise(0.0)
    negatives = F.col("s") - F.col("actual")
    tnr = F.when(negatives > 0, (negatives - (F.col("predicted") - F.col("tp"))) / negatives).otherwise(0.0)
    iba = F.when(F.col("actual") > 0, (1 + 0.5 * (recall - tnr)) * recall).otherwise(0.0)
    a = c.groupBy(*keys).agg(
        F.sum("tp").cast("double").alias("c"), F.max("s").cast("double").alias("s"), F.avg(precision).alias("Precision"), F.avg(recall).alias("Recall"), F.avg(f1).alias("F1"),
        F.exp(F.avg(F.when(F.col("actual") > 0, F.ln(F.when(recall > 0, recall).otherwise(RECALL_FLOOR))))).alias("GMean"),
        (F.sum(iba) / classes).alias("IBA"), F.sum(F.col("actual") * F.col("predicted")).cast("double").alias("pt"),
        F.sum(F.col("actual") * F.col("actual")).cast("double").alias("tt"), F.sum(F.col("predicted") * F.col("predicted")).cast("double").alias("pp"),
    )
    under = (F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt"))
    by_chance = F.col("pt") / (F.col("s") * F.col("s"))
    return a.select(
        *keys, (F.col("c") / F.col("s")).alias("Accuracy"), "Precision", "Recall", "F1", "GMean",
        F.when(under > 0, (F.col("c") * F.col("s") - F.col("pt")) / F.sqrt(under)).otherwise(0.0).alias("MCC"), "IBA",
        F.when(by_chance < 1, (F.col("c") / F.col("s") - by_chance) / (1 - by_chance)).alias("Kappa"),
    )


def ranking(pred: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """keys, AUC (one against the rest, macro; of class 1 for two classes), AUPRC (average precision); both 0 if a class is missing.

    Scores are first aggregated by value, so that ties cost one row; running sums go by slices of the scores, so no task holds a model.
    """
    wanted = [1] if classes == 2 else list(range(classes))
    long = pred.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.get("proba", F.lit(c)).alias("score"), (F.col("y") == c).cast("long").alias("pos")) for c in wanted])).alias("e")).select(*keys, "e.*")
    by_score = long.groupBy(*keys, "k", F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("__down")).agg(F.sum("pos").alias("p"), F.count("*").alias("n"))
    w = prefix_sums(by_score, ["p", "n"], "__down", *keys, "k").withColumnRenamed("upto_p", "tp").withColumnRenamed("upto_n", "above")
    # negatives below this score, and half of those at it
    below = (F.col("all_n") - F.col("all_p")) - (F.col("above") - F.col("tp")) + (F.col("n") - F.col("p")) / 2
    each = w.groupBy(*keys, "k").agg(
        F.sum(F.col("p") * below).alias("u"), F.sum(F.col("p") * F.col("tp") / F.col("above")).alias("ap"), F.max("all_p").alias("all_p"), F.max("all_n").alias("all_n")
    )
    good = (F.col("all_p") > 0) & (F.col("all_p") < F.col("all_n"))
    auc = F.when(good, F.col("u") / (F.col("all_p") * (F.col("all_n") - F.col("all_p")))).otherwise(0.0)
    out = each.groupBy(*keys).agg(F.avg(auc).alias("AUC"), F.avg(F.when(good, F.col("ap") / F.col("all_p")).otherwise(0.0)).alias("AUPRC"), F.min(good).alias("whole"))
    return out.select(*keys, F.when(F.col("whole"), F.col("AUC")).otherwise(0.0).alias("AUC"), F.when(F.col("whole"), F.col("AUPRC")).otherwise(0.0).alias("AUPRC"))


def all_metrics(pred: DataFrame, keys: list[str], classes: int) -> DataFrame:
    return from_confusion(confusion(pred, keys), keys, classes).join(ranking(pred, keys, classes), keys)


def over_folds(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Mean and population deviation over folds, as <name>_mean and <name>_std."""
    return metrics.groupBy(*keys).agg(*[f(n).alias(f"{n}_{k}") for n in names for k, f in (("mean", F.avg), ("std", F.stddev_pop))])
