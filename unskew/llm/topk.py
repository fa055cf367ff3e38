"""Exact top-k inner-product search with vector-approximation files.

Vectors are rounded to integers (floor(256 * x)). The approximation of a vector is one byte a dimension: its cell out of CELLS
between the dimension's least and largest value. The cells' middles give an estimate of each score, and half the cells'
widths a bound on its error, which is the same for all vectors of a query.

(1) Blocks of cells, not of vectors, meet blocks of queries by an equi-join on block numbers (cogroup); each pair of blocks
gives the vectors whose upper bound reaches its k-th lower bound. (2) By query, the k-th lower bound over all blocks drops
most of what is left. (3) Only the exact vectors of survivors are read, in the order of their bounds until the k-th
exact score is no less than the next bound.

Many vectors may be alike, which would all survive together; so of rows of equal vectors only those of the k + 1 least
ids, k rows an id at most, are candidates: others can't be among the k best of any query. No side is broadcast but the
dimensions' ranges and sizes, and no task sees more than one block of either.

Defined cases: vectors null, empty, or holding null or non-finite components neither ask nor answer; vectors of unlike
length don't meet; equal scores go to the smaller id; rows of one id all answer, but ask
once, by the least of their vectors, and never meet each other; an empty table gives no rows. Other columns are ignored. Scores are exact while |score| < 2**53.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SCALE, CELLS, VECTOR_BLOCK, QUERY_BLOCK, STEP = 256, 256, 16384, 1024, 128
BOUNDED = "query_id long, row long, lower double, upper double"


class Cells:
    """Cells of each dimension, and what they say about scores."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cells: int = CELLS):
        self.low, self.cells = low.astype(float), cells
        self.width = np.maximum((high - low) / cells, 1e-9)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return np.clip((vectors - self.low) / self.width, 0, self.cells - 1).astype(np.uint8)

    def middles(self, cell: np.ndarray) -> np.ndarray:
        return self.low + (cell + 0.5) * self.width

    def error(self, queries: np.ndarray) -> np.ndarray:
        """How far an estimate may be off, rounding (here, and of which cell a value falls into) included."""
        most = np.maximum(np.abs(self.low), np.abs(self.low + self.cells * self.width))
        return np.abs(queries) @ (0.5 * self.width + 1e-9 * most + 1e-9)


def _scan(cells: dict[int, Cells], k: int):
    """Of a block of queries and a block of cells what may be among the k best."""

    def scan(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "row": np.empty(0, np.int64), "lower": np.empty(0), "upper": np.empty(0)})]
        if len(queries) and len(rows):
            q_len, r_len = queries["v"].map(len).to_numpy(), rows["cells"].map(len).to_numpy()
            for dims in np.unique(q_len):
                q, r = queries[q_len == dims], rows[r_len == dims]
                if len(r):
                    asked, ids, row = np.stack(q["v"].to_numpy()).astype(float), r["id"].to_numpy(np.int64), r["row"].to_numpy(np.int64)
                    middle = cells[dims].middles(np.frombuffer(b"".join(r["cells"]), np.uint8).reshape(-1, dims))
                    for at in range(0, len(asked), STEP):
                        part = asked[at : at + STEP]
                        out.append(bounded(part, q["id"].to_numpy(np.int64)[at : at + STEP], middle, ids, row, cells[dims].error(part), k))
        return pd.concat(out)

    return scan


def bounded(asked, q_ids, middle, ids, row, error, k) -> pd.DataFrame:
    """For all queries the rows whose upper bound reaches the k-th lower bound."""
    scores = asked @ middle.T
    scores[q_ids[:, None] == ids[None, :]] = -np.inf
    last = scores.shape[1] - k
    bar = np.partition(scores, last, axis=1)[:, last] - 2 * error if last > 0 else np.full(len(asked), -np.inf)
    q, r = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
    return pd.DataFrame({"query_id": q_ids[q], "row": row[r], "lower": scores[q, r] - error[q], "upper": scores[q, r] + error[q]})


def _read(k: int):
    """Reads exact vectors in the order of upper bounds until the k-th score is certain."""

    def read(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["upper", "id"], ascending=[False, True])
        asked, ids, upper, v = np.array(df["asked"].iloc[0], float), df["id"].to_numpy(np.int64), df["upper"].to_numpy(), df["v"].to_numpy()
        found, scores, at = np.empty(0, np.int64), np.empty(0, np.int64), 0
        while at < len(ids) and not (len(scores) == k and upper[at] < scores[-1]):
            to = min(len(ids), at + max(4 * k, 16))
            scores = np.concatenate([scores, np.rint(np.stack(v[at:to]).astype(float) @ asked).astype(np.int64)])
            found, at = np.concatenate([found, ids[at:to]]), to
            best = np.lexsort((found, -scores))[:k]
            found, scores = found[best], scores[best]
        return pd.DataFrame({"query_id": df["query_id"].iloc[0], "rank": np.arange(1, len(found) + 1, dtype=np.int32), "vec_id": found, "score": scores})

    return read


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose id is divisible by `every`, the k best among all other rows."""
    x = F.col(vector_col)
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = vectors.where(F.col(id_col).isNotNull() & good).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v")
    )
    asked = whole.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    # equal rows: k of one id, k + 1 ids of one vector; a row's number names it
    alike = whole.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    alike = alike.withColumn("place", place).where(F.col("place") <= k + 1).select("id", "v", "copies", F.xxhash64("id", "v").alias("row"))
    alike = checkpointed(alike)
    # a row for each length of vectors: ranges of its dimensions
    ends = alike.select(F.size("v").alias("dims"), F.posexplode("v").alias("i", "c")).groupBy("dims", "i").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    ends = ends.groupBy("dims").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("ends")).collect()
    cells = {r["dims"]: Cells(np.array([e["low"] for e in r["ends"]], float), np.array([e["high"] for e in r["ends"]], float)) for r in ends}

    def approximate(dfs):
        for df in dfs:
            dims = df["v"].map(len).to_numpy()
            made = pd.Series([b""] * len(df), dtype=object)
            for n in np.unique(dims):
                at = np.flatnonzero(dims == n)
                made.iloc[at] = [c.tobytes() for c in cells[n].of(np.stack(df["v"].to_numpy()[at]).astype(float))]
            yield pd.DataFrame({"id": df["id"].to_numpy(), "row": df["row"].to_numpy(), "cells": made.to_numpy()})

    n, n_asked = alike.count(), asked.count()
    blocks, q_blocks = max(1, math.ceil(n / VECTOR_BLOCK)), max(1, math.ceil(n_asked / QUERY_BLOCK))
    every_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")).withColumn("vb", every_of(blocks))
    # no id or vector fills a block: a row is one of few that are alike
    right = alike.select("id", "v", "row").mapInPandas(approximate, "id long, row long, cells binary")
    right = right.withColumn("vb", F.pmod("row", F.lit(blocks)).cast("int")).withColumn("qb", every_of(q_blocks))
    met = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(_scan(cells, k), BOUNDED)
    met = checkpointed(met)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower")))
    bar = met.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.min("lower").alias("bar"), F.count("*").alias("found"))
    kept = met.join(bar, "query_id").where((F.col("upper") >= F.col("bar")) | (F.col("found") < k)).select("query_id", "row", "upper")
    read = kept.join(alike, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("query_id", "id", "v", "upper")
    read = read.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("asked")), "query_id")
    return read.groupBy("query_id").applyInPandas(_read(k), "query_id long, rank int, vec_id long, score long")
