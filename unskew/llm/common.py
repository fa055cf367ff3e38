"""What the operators of this package share: reading, cutting lineage, hashing of rows into folds."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, so that a worker's memory doesn't grow with the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda pad: 0


def release() -> None:
    """Gives freed memory back to the system, for workers that stay between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("a cluster must name a folder that all its machines share in spark.checkpoint.dir")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "unskew-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written as compressed Parquet to the shared folder and read again: for what is too large for checkpoint(). The
    folder goes when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    jvm = df.sparkSession.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a key that a task may gather, whatever the input; how many keys of more rows may be broadcast.
FEW, MANY = 100_000, 50_000


def meet(rows: DataFrame, named: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined to named, whose keys are distinct and whose column n says how many of the `total` rows hold a key.

    A key of over FEW rows that over 1 in MANY rows hold isn't gathered in a task: there are MANY such keys at most, and
    they go to the rows by broadcast. All other keys meet by shuffle.
    """
    bar = max(FEW, total // MANY)
    if total <= bar:  # no key can have so many
        return rows.join(named.drop("n"), key)
    hot, cold = F.broadcast(named.where(F.col("n") > bar).drop("n")), named.where(F.col("n") <= bar).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def fold_of(value, modulus: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus
