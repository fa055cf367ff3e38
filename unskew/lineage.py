"""Results that are computed once: kept in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on one machine alone a temporary one will do."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("a cluster must name a folder that all its machines share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "unskew-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in that folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as Parquet, for tables that follow from one another in rounds: a checkpoint keeps the planner's estimate of its size, which
    joins multiply round by round, until planning takes longer than the rounds; files have the size that they have."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
