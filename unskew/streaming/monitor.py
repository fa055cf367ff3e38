"""An extension: class balance over time of a labelled stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_balance(stream: DataFrame, ts: str = "ts", label: str = "label", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, label, n of each window; rows later than `late` are left out when stream is a stream."""
    # watermarks need timestamps with a zone
    marked = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if stream.isStreaming else stream
    return marked.groupBy(F.window(ts, window).alias("w"), F.col(label).alias("label")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "label", "n")


def imbalance(balance: DataFrame) -> DataFrame:
    """window_start, classes, ir: the largest over the smallest class of each closed window."""
    return balance.groupBy("window_start").agg(F.count("*").alias("classes"), (F.max("n") / F.min("n")).alias("ir"))
