"""Labelled tables from CSV files: catalog of datasets, reading, folds, and result files."""

from __future__ import annotations

import os
import re
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import sampling
from . import xlsx

CATALOG = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("source", T.StringType(), False), T.StructField("path", T.StringType(), False), T.StructField("ir", T.IntegerType())])


@dataclass(frozen=True)
class Dataset:
    """source: keel (five given folds), keel_complete, bearing, software_defect or heart (one file)."""

    name: str
    source: str
    path: str
    ir: int | None = None


def wanted(name, only) -> bool:
    """None means all, an empty collection none."""
    return only is None or name in only


def discover(root: str, names=None, irs=None, sources=None) -> list[Dataset]:
    """All datasets under root, sorted: KEEL/5fold/<name>/fold1_train.csv, KEEL/complete/<name>.csv,
    Bearing/IR<n>/<name>.csv, Software/<name>.csv, Heart/<name>.csv."""
    found = []

    def files(*parts):
        folder = os.path.join(root, *parts)
        return [(x, os.path.join(folder, x)) for x in sorted(os.listdir(folder))] if os.path.isdir(folder) else []

    for name, path in files("KEEL", "5fold"):
        if os.path.exists(os.path.join(path, "fold1_train.csv")):
            found.append(Dataset(name, "keel", path))
    for folder, source in (("KEEL/complete", "keel_complete"), ("Software", "software_defect"), ("Heart", "heart")):
        found += [Dataset(x[:-4], source, path) for x, path in files(*folder.split("/")) if x.endswith(".csv")]
    for sub, path in files("Bearing"):
        if m := re.fullmatch(r"IR(\d+)", sub):
            found += [Dataset(f"{sub}_{x[:-4]}", "bearing", os.path.join(path, x), int(m[1])) for x in sorted(os.listdir(path)) if x.endswith(".csv")]
    return [d for d in found if wanted(d.name, names) and wanted(d.source, sources) and (d.ir is None or wanted(d.ir, irs))]


def catalog(spark: SparkSession, datasets: list[Dataset]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(d).values()) for d in datasets], CATALOG)


def read_csv(spark: SparkSession, path: str, bearing: bool = False) -> DataFrame:
    """features array<double>, label: the last column (bearing: the column `label`, features are feat_* columns).

    Ids (numbered()) come from content, so that they don't depend on how the file is split. A cell that is no number makes
    the read fail when it is run, as a cast under ANSI rules.
    """
    raw = spark.read.csv(path, header=True, inferSchema=True)
    columns = [c for c in raw.columns if c.startswith("feat_")] if bearing else raw.columns[:-1]
    label = "label" if bearing else raw.columns[-1]
    return raw.select(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("features"), F.col(f"`{label}`").alias("label"))


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds id: a hash of the row's content and of its number among equal rows within keys."""
    from pyspark.sql import Window

    copy = F.row_number().over(Window.partitionBy(*keys, "label", "features").orderBy(F.lit(0)))
    return rows.withColumn("__copy", copy).withColumn("id", F.xxhash64(*keys, "label", "features", "__copy")).drop("__copy")


def load_folds(spark: SparkSession, data: Dataset, folds: int = 5, seed: int = 42) -> DataFrame:
    """dataset, fold (from 1), split, id, features, label, label_idx (over all folds)."""
    if data.source == "keel":
        parts = []
        for k in range(1, 6):
            for split in ("train", "test"):
                parts.append(read_csv(spark, os.path.join(data.path, f"fold{k}_{split}.csv")).select(F.lit(k).alias("fold"), F.lit(split).alias("split"), "features", "label"))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rows = numbered(rows, "fold", "split")
    else:
        whole = numbered(read_csv(spark, data.path, data.source == "bearing"))
        if data.source == "keel_complete":
            rows = sampling.stratified_holdout(whole, 0.3, seed).withColumn("fold", F.lit(1))
        else:
            dealt = sampling.stratified_folds(whole, folds, seed).withColumnRenamed("fold", "__own")
            rows = dealt.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).withColumn("split", F.when(F.col("fold") == F.col("__own"), "test").otherwise("train")).drop("__own")
    index = sampling.label_index(rows, "label")
    return rows.join(F.broadcast(index), "label").select(F.lit(data.name).alias("dataset"), "fold", "split", "id", "features", F.col("label").cast("string").alias("label"), "label_idx")


RESULT_COLUMNS = ("Model", "Dataset")


def _files(spark: SparkSession, path: str):
    """Path class and file system of a path."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind, kind(path).getFileSystem(spark._jsc.hadoopConfiguration())


def read_results(spark: SparkSession, path: str, required: tuple[str, ...] = RESULT_COLUMNS) -> DataFrame:
    """A result table (CSV, Parquet or a workbook's first sheet) that has the required columns. If a writer was lost while it put a new table in place
    of the old one, the old one is read."""
    kind, fs = _files(spark, path)
    if not fs.exists(kind(path)) and fs.exists(kind(f"{path}.old")):
        path = f"{path}.old"
    plain = path.rstrip("/").removesuffix(".old")
    if plain.endswith(".xlsx"):
        rows = xlsx.read(spark, path)
    else:
        rows = spark.read.parquet(path) if plain.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"result columns are missing: {', '.join(missing)}")
    return rows


def write_results(results: DataFrame, path: str) -> None:
    """Replaces the table at path once the new one is complete; the old one stays aside until then, so that there is one at any
    time. Columns that begin with _ stay out."""
    kind, fs = _files(results.sparkSession, path)
    new, old = kind(f"{path}.new"), kind(f"{path}.old")
    results.select([c for c in results.columns if not c.startswith("_")]).write.mode("overwrite").parquet(f"{path}.new")
    if fs.exists(kind(path)):
        fs.delete(old, True)
        fs.rename(kind(path), old)
    if not fs.rename(new, kind(path)):
        raise OSError(f"{path} could not be put in place; the former table is {path}.old")
    fs.delete(old, True)


def write_imbalanced(rows: DataFrame, ratios: list[int], path: str, seed: int = 42) -> DataFrame:
    """Writes one set for each ratio (partitioned by ir), and beside them as JSON the manifest that it returns: ir, label, n."""
    sets = None
    for ir in ratios:
        one = sampling.imbalance_ratio(rows, ir, seed).withColumn("ir", F.lit(ir))
        sets = one if sets is None else sets.unionByName(one)
    sets.write.mode("overwrite").partitionBy("ir").parquet(path)
    counts = rows.sparkSession.read.parquet(path).groupBy("ir", "label").agg(F.count("*").alias("n"))
    counts.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}_manifest")  # a row a ratio and class
    return counts


def confusion_json(counts: DataFrame) -> DataFrame:
    """value: one JSON text for each model and dataset with its confusion rows and their shares; write it with .text()."""
    from ..operators.metrics import row_normalised

    shares = row_normalised(counts, ["model", "dataset"])
    rows = shares.groupBy("model", "dataset").agg(F.array_sort(F.collect_list(F.struct("y", "yhat", "n", "share"))).alias("cells"))  # a cell for each pair of labels
    return rows.select(F.to_json(F.struct("model", "dataset", "cells")).alias("value"))
