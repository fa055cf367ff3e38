"""The benchmark grid: every model on every fold of every dataset, as one distributed job of cells.

Folds are rows of one table (dataset, fold, split, id, features, label_idx); a cell is a group of it for one model, which a
task trains and scores. A cell that fails gives its error instead of stopping the run. Scores come back as predictions,
so that all metrics are aggregates of one plan.
"""

from __future__ import annotations

import signal
import time
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import written
from ..operators import metrics as M
from ..operators.learners import LEARNERS, SMOKE

PREDICTION = "model string, dataset string, fold int, id long, y int, yhat int, proba array<double>, runtime double, error string"
NAMES = ["Accuracy", "Precision", "Recall", "F1", "GMean", "AUC", "AUPRC", "MCC", "IBA", "Kappa"]
MOST_ROWS = 50_000


@contextmanager
def limited(seconds: float):
    """Raises TimeoutError in the worker's main thread after so many seconds."""

    def stop(*_):
        raise TimeoutError(f"stopped after {seconds:g} seconds")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _cell(classes: int, seed: int, smoke: bool, params: dict, limit: float):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        model, dataset, fold = df["model"].iloc[0], df["dataset"].iloc[0], int(df["fold"].iloc[0])
        try:
            if len(df) > MOST_ROWS:
                raise ValueError(f"a fold of {len(df)} rows is beyond the bound of {MOST_ROWS}")
            df = df.sort_values(["split", "id"])
            train, test = df[df["split"] == "train"], df[df["split"] == "test"]
            x, y = np.stack(train["features"].to_numpy()).astype(float), train["label_idx"].to_numpy().astype(int)
            mean, dev = x.mean(0), x.std(0)
            dev[dev == 0] = 1.0
            z = (np.stack(test["features"].to_numpy()).astype(float) - mean) / dev
            began = time.perf_counter()
            settings = (SMOKE.get(model, {}) if smoke else {}) | params.get(model, {})
            with limited(limit):
                predict = LEARNERS[model]((x - mean) / dev, y, classes, seed + fold, **settings)
                took = time.perf_counter() - began
                p = predict(z)
            return pd.DataFrame({"model": model, "dataset": dataset, "fold": fold, "id": test["id"], "y": test["label_idx"], "yhat": p.argmax(1), "proba": list(p), "runtime": took, "error": None})
        except Exception as e:
            return pd.DataFrame({"model": [model], "dataset": [dataset], "fold": [fold], "id": [None], "y": [None], "yhat": [None], "proba": [None], "runtime": [None], "error": [f"{type(e).__name__}: {e}"]})

    return run


def predictions(folds: DataFrame, models: list[str], seed: int = 42, smoke: bool = False, params: dict | None = None, limit: float = 3600, cells: DataFrame | None = None) -> DataFrame:
    """model, dataset, fold, id, y, yhat, proba, runtime, error of every test row of every cell; limit: seconds for a fold.

    cells: (Model, Dataset) of those to run, if not all; all datasets of one call share the number of classes.
    """
    unknown = [m for m in models if m not in LEARNERS]
    if unknown:
        raise ValueError(f"no such model: {', '.join(unknown)}")
    found = folds.agg((F.max("label_idx") + 1).alias("classes"), F.count_distinct("dataset", "fold").alias("n")).first()
    classes = found["classes"]
    if cells is None:
        cells = folds.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    else:
        named = cells.where(F.col("Model").isin(models)).select(F.col("Model").alias("model"), F.col("Dataset").alias("dataset"))
        cells = folds.join(F.broadcast(named), "dataset")  # models times datasets
    # a cell is little data and much work: tasks by cells, which are not put together by size; four times as many, so that few share one
    keys = ["model", "dataset", "fold"]
    return cells.repartition(4 * max(1, found["n"] * len(models)), *keys).groupBy(*keys).applyInPandas(_cell(classes, seed, smoke, params or {}, limit), PREDICTION)


def results(pred: DataFrame, source: str | DataFrame) -> DataFrame:
    """Model, Dataset, Source (of all, or a table Dataset, Source), each metric's mean and deviation over folds, Runtime, Error: one row a cell.

    All datasets of one call share the number of classes; call it by dataset otherwise."""
    pred = written(pred)  # read more than once, and each reading would train every cell
    good = pred.where("error is null")
    classes = good.agg(F.max(F.size("proba"))).first()[0] or 2
    keys = ["model", "dataset", "fold"]
    each = M.all_metrics(good, keys, classes).join(good.groupBy(*keys).agg(F.max("runtime").alias("Runtime")), keys)
    means = M.over_folds(each, ["model", "dataset"], [*NAMES, "Runtime"])
    errors = pred.where("error is not null").groupBy("model", "dataset").agg(F.min("error").alias("Error"))
    cells = pred.select("model", "dataset").distinct().join(errors, ["model", "dataset"], "left").join(means, ["model", "dataset"], "left")
    cells = cells.withColumnsRenamed({"model": "Model", "dataset": "Dataset"})
    cells = cells.withColumn("Source", F.lit(source)) if isinstance(source, str) else cells.join(F.broadcast(source.select("Dataset", "Source")), "Dataset")
    # a cell with a failed fold counts as failed
    return cells.select("Model", "Dataset", "Source", *[F.when(F.col("Error").isNull(), F.col(f"{n}_{k}")).alias(f"{n}_{k}") for n in [*NAMES, "Runtime"] for k in ("mean", "std")], "Error")


def grid(catalog: DataFrame, models: list[str]) -> DataFrame:
    """Model, Dataset, Source of all cells."""
    return catalog.select(F.explode(F.array(*[F.lit(m) for m in models])).alias("Model"), F.col("name").alias("Dataset"), F.col("source").alias("Source"))
