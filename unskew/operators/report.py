"""The report over result tables: normalised names, failed cells, coverage, means and average ranks, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import normal_name

METRICS = ("F1", "GMean", "AUC", "AUPRC", "Runtime")


def normalise_models(results: DataFrame, names: dict[str, str]) -> DataFrame:
    """Model renamed by the map; the old name stays in _orig_model."""
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
    renamed = F.coalesce(F.try_element_at(lookup, F.col("Model")), "Model") if names else F.col("Model")
    return results.withColumn("_orig_model", F.col("Model")).withColumn("Model", renamed)


def failed(metrics: tuple[str, ...] = METRICS, has_error: bool = True) -> Column:
    """Whether any metric is null or not a number, or the error text is more than blanks."""
    out = F.lit(False)
    for m in metrics:
        out = out | F.col(m).isNull() | F.isnan(m)
    return out | (F.trim(F.coalesce("Error", F.lit(""))) != "") if has_error else out


def with_group(results: DataFrame) -> DataFrame:
    """One row for each report it belongs to: Overall, its source, and for bearing sets its ratio."""
    ratio = F.regexp_extract("Dataset", r"^IR(\d+)_", 1)
    bearing = F.when(F.lower("Source") == "bearing", F.concat(F.lit("Bearing_IR"), F.when(ratio != "", ratio).otherwise("other")))
    return results.withColumn("Group", F.explode(F.array_compact(F.array(F.lit("Overall"), F.col("Source"), bearing))))


def average_rank(column: str, partition: Window, descending: bool) -> Column:
    """Ties share the mean of their places; null stays null."""
    x = F.col(column)
    order = Window.partitionBy(*partition, x.isNull()).orderBy(x.desc() if descending else x.asc())
    ties = F.count("*").over(Window.partitionBy(*partition, x))
    return F.when(x.isNotNull(), F.rank().over(order) + (ties - 1) / 2.0)


def rankings(results: DataFrame, metrics: tuple[str, ...] = METRICS, keys: tuple[str, ...] = ("Group",)) -> DataFrame:
    """keys, Model, n_datasets, the mean and rank of each metric, mean ranks without and with Runtime. Only models that
    cover all of the group's datasets without failure; Runtime ranks upwards, all else downwards."""
    marked = results.withColumn("__bad", failed(metrics, "Error" in results.columns))
    whole = marked.groupBy(*keys).agg(F.countDistinct("Dataset").alias("required"))
    each = marked.groupBy(*keys, "Model").agg(
        F.countDistinct(F.when(~F.col("__bad"), F.col("Dataset"))).alias("covered"), *[F.avg(F.when(~F.col("__bad"), F.col(m))).alias(m) for m in metrics]
    )
    done = each.join(F.broadcast(whole), list(keys)).where("covered = required")
    ranked = done.select(*keys, "Model", F.col("covered").alias("n_datasets"), *metrics, *[average_rank(m, keys, m != "Runtime").alias(f"{m}_rank") for m in metrics])
    scores = [m for m in metrics if m != "Runtime"]
    mean = lambda ms: sum((F.col(f"{m}_rank") for m in ms[1:]), F.col(f"{ms[0]}_rank")) / float(len(ms))
    return ranked.withColumn("Avg_Rank_excl_Runtime", mean(scores)).withColumn("Avg_Rank_incl_Runtime", mean(list(metrics)))


def ordered(ranked: DataFrame) -> DataFrame:
    """By mean rank, then name; models without a rank come last."""
    return ranked.orderBy(F.asc_nulls_last("Avg_Rank_excl_Runtime"), F.lower("Model"))


def with_excluded(ranked: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("Group",)) -> DataFrame:
    """ranked, and the models that miss datasets of a group by name alone."""
    names = [*keys, "Model"]
    left = results.select(*names).distinct().join(ranked.select(*names), names, "left_anti")
    return ranked.unionByName(left, allowMissingColumns=True)


def notes(results: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Item, Text: what was left out (by model, its missing datasets by source) and what was renamed."""
    lack = missing_by_source(results, metrics).groupBy("Model").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s: %d", "Source", "n"))), ", ").alias("Text"))  # a source each
    out = lack.select(F.concat(F.lit("Excluded "), "Model").alias("Item"), F.concat(F.lit("datasets without result: "), "Text").alias("Text"))
    if "_orig_model" in results.columns:
        out = out.unionByName(renamed(results).select(F.concat(F.lit("Renamed "), "_orig_model").alias("Item"), F.format_string("to %s, %d rows", "Model", "n").alias("Text")))
    return out


def missing_by_source(results: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Model, Source, n: datasets that a model failed or lacks, by each dataset's first source (by name)."""
    sources = results.groupBy("Dataset").agg(F.min("Source").alias("Source"))
    models = results.select("Model").distinct()
    good = results.where(~failed(metrics, "Error" in results.columns)).select("Model", "Dataset").distinct()
    lack = models.crossJoin(F.broadcast(sources)).join(good, ["Model", "Dataset"], "left_anti")  # the grid of models and datasets
    return lack.groupBy("Model", "Source").agg(F.count("*").alias("n"))


def failed_cells(results: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    return results.where(failed(metrics, "Error" in results.columns)).select("Model", "Dataset").distinct()


def paper_names(models: DataFrame, titles: DataFrame) -> DataFrame:
    """Model, Paper: the title (column Title; ties: the first by name) that is the model's name but for case, hyphens and
    underscores, or else the model's name."""
    short = titles.groupBy(normal_name("Title").alias("__name")).agg(F.min("Title").alias("Paper"))
    found = models.join(short, normal_name("Model") == F.col("__name"), "left")
    return found.select("Model", F.coalesce("Paper", "Model").alias("Paper"))


def last_results(results: DataFrame, run_order: str) -> DataFrame:
    """The last row of each model and dataset; a success beats errors whenever they ran."""
    bad = F.trim(F.coalesce("Error", F.lit(""))) != ""
    place = F.row_number().over(Window.partitionBy("Model", "Dataset").orderBy(bad, F.desc(run_order)))
    return results.withColumn("__r", place).where("__r = 1").drop("__r")


def open_cells(grid: DataFrame, results: DataFrame) -> DataFrame:
    """Cells of the grid (Model, Dataset) without a result that is free of errors."""
    done = results.where(F.trim(F.coalesce("Error", F.lit(""))) == "").select("Model", "Dataset")
    return grid.join(done, ["Model", "Dataset"], "left_anti")


def with_baselines(means: DataFrame, baselines: DataFrame) -> DataFrame:
    """means, and of the baselines those whose model isn't among them."""
    return means.unionByName(baselines.join(means.select("Model"), "Model", "left_anti"), allowMissingColumns=True)


def renamed(results: DataFrame) -> DataFrame:
    """Model, _orig_model, n of the rows whose model was renamed."""
    return results.where("_orig_model <> Model").groupBy("Model", "_orig_model").agg(F.count("*").alias("n"))
