"""Clusters of points as plans: density peaks by pointer jumping, and eps-graphs by blocks and hooking.

A row's way to its cluster's centre is a chain of parents. Each round of pointer jumping replaces parents by their parents, so that chains
of any length end after a logarithmic number of joins; a parent that very many rows share is one row of the joined side, and skewed
joins are split by AQE.

Links of an eps-graph are never listed: each pair of blocks gives a row's count of near rows, or the edges of a spanning forest of
its links, at most as many as it has rows. Components of what is left follow by hooking roots to smaller ones and jumping.

Rows: id (long), label, features (array<double>). An empty table gives no rows; equal points are near one another.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpointed
from . import sampling
from .knn import BLOCK, PAIRS, Rough, density_parent, exact, neighbours
from .ranks import quantiles

SMALL_EPS = 1e-6


def roots(parents: DataFrame, rounds: int = 64) -> DataFrame:
    """id, root of id, parent: where the chain of parents of each row ends. A row whose parent is null or itself is a root."""
    state = checkpointed(parents.select("id", F.coalesce("parent", "id").alias("root")))
    for _ in range(rounds):
        up = state.select(F.col("id").alias("root"), F.col("root").alias("__up"))
        moved = checkpointed(state.join(up, "root").select("id", F.col("__up").alias("root"), (F.col("__up") != F.col("root")).alias("__moved")))
        state = moved.drop("__moved")
        if moved.where("__moved").isEmpty():
            return state
    raise RuntimeError("parents go round in a circle")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, root: the least node that edges (a, b) reach, for each node of an edge."""
    edges = checkpointed(edges.where("a <> b").distinct())
    label = checkpointed(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")))
    for _ in range(rounds):
        of = lambda c, out: label.select(F.col("id").alias(c), F.col("root").alias(out))
        apart = edges.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y")
        hooks = checkpointed(apart.select(F.greatest("x", "y").alias("id"), F.least("x", "y").alias("parent")).groupBy("id").agg(F.min("parent").alias("parent")))
        if hooks.isEmpty():
            return label.select(F.col("id").alias("node"), "root")
        tops = label.select(F.col("root").alias("id")).distinct().join(hooks, "id", "left")
        new = roots(tops).select(F.col("id").alias("root"), F.col("root").alias("__top"))
        label = checkpointed(label.join(new, "root").select("id", F.col("__top").alias("root")))
    raise RuntimeError("components have not settled")


# -- density peaks -------------------------------------------------------------------------------------------------------


def peaks_reach(n: int) -> int:
    """How many neighbours density looks at in a table of n rows."""
    return min(max(15, math.isqrt(n)), n - 1)


def density_clusters(rows: DataFrame, k: int | None = None, near: DataFrame | None = None) -> DataFrame:
    """id, cluster (the id of its centre), rho, delta: centres are the rows of largest rho * delta, ceil(root of half the rows) many; others
    go where the chain of their nearest denser rows first meets one, or to the first centre if it meets none. The densest
    row's delta is the distance to the last of its k nearest. near: nearest_distances() of the rows and k, if it is known."""
    n = rows.count()
    if n <= 2:
        first = rows.agg(F.min("id").alias("cluster"))
        return rows.select("id").crossJoin(F.broadcast(first)).select("id", "cluster", F.lit(1.0).alias("rho"), F.lit(1.0).alias("delta"))  # one row
    k = peaks_reach(n) if k is None else k
    found = checkpointed(density_parent(rows, k, near))
    top = rows.join(found.where("parent IS NULL").select("id"), "id")
    far = neighbours(rows, k, queries=top).groupBy("id").agg(F.max("dist").alias("__far"))
    found = found.join(F.broadcast(far), "id", "left").select("id", "rho", "parent", F.coalesce("delta", "__far").alias("delta"))  # one row
    placed = checkpointed(sampling.with_rank(found, -F.col("rho") * F.col("delta"), out="place"))
    centres = math.ceil(math.sqrt(n / 2))
    chain = placed.select("id", F.when(F.col("place") > centres, F.col("parent")).alias("parent"))
    ends = roots(chain).join(placed.select(F.col("id").alias("root"), (F.col("place") <= centres).alias("centre")), "root")
    first = placed.where("place = 1").select(F.col("id").alias("__first"))  # one row
    named = ends.crossJoin(F.broadcast(first)).select("id", F.when(F.col("centre"), F.col("root")).otherwise(F.col("__first")).alias("cluster"))
    return named.join(placed.select("id", "rho", "delta"), "id")


# -- eps-graphs ----------------------------------------------------------------------------------------------------------


def _by_blocks(left: DataFrame, right: DataFrame, f, schema: str, block: int) -> DataFrame:
    """What f(ids, points, other ids, other points) gives for each pair of blocks of left and right (id, features)."""
    blocks = max(1, math.ceil(right.count() / block))
    part = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return f(a["id"].to_numpy(), np.stack(a["features"].to_numpy()).astype(float), b["id"].to_numpy(), np.stack(b["features"].to_numpy()).astype(float))

    a = left.select("id", "features").withColumn("i", part).withColumn("j", every)
    b = right.select("id", "features").withColumn("j", part).withColumn("i", every)
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(run, schema)


def _near(x: np.ndarray, z: np.ndarray, eps: float, step: int = 64):
    """(first row, distances) of a few rows of x at a time to all of z; those beyond eps are infinite. Distances are formed only of pairs
    that the product of the blocks can't rule out."""
    rough = Rough(x, 2.0)
    rough.read(z)
    for at in range(0, len(x), step):
        part = slice(at, min(at + step, len(x)))
        least = rough.least(part, np.full(part.stop - at, eps))
        d = np.full((part.stop - at, len(z)), np.inf)
        i, j = np.nonzero(rough.closeness(part) >= least[:, None])
        for a in range(0, len(i), PAIRS):
            here, there = i[a : a + PAIRS], j[a : a + PAIRS]
            gap = exact(x[at + here], z[there])
            d[here, there] = np.where(gap <= eps, gap, np.inf)
        yield at, d


def class_eps(rows: DataFrame, k: int = 5) -> float:
    """The median distance to the k-th nearest row (or the last one), of those that are above 0; 1e-6 at least, 1 for a single row."""
    kth = neighbours(rows, k).groupBy("id").agg(F.max("dist").alias("kth")).where("kth > 0")
    got = quantiles(kth, "kth", {"eps": 0.5}).first()["eps"]
    return max(got, SMALL_EPS) if got is not None else 1.0 if rows.count() <= 1 else SMALL_EPS


def eps_clusters(rows: DataFrame, eps: float, least: int, block: int = BLOCK) -> DataFrame:
    """id, core, cluster: a row is a core if `least` rows (itself included) are within eps; cores within eps of one another are one
    cluster, named by its least core; others within eps of a core go to the nearest one's cluster (ties: the smaller id), and the rest have none."""
    points = checkpointed(rows.select(F.col("id").cast("long").alias("id"), "features"))

    def count(ids, x, others, z):
        return pd.DataFrame({"id": ids, "n": np.concatenate([np.isfinite(d).sum(1) for _, d in _near(x, z, eps)])})

    counts = _by_blocks(points, points, count, "id long, n long", block).groupBy("id").agg(F.sum("n").alias("n"))
    marked = checkpointed(points.join(counts, "id").select("id", "features", (F.col("n") >= least).alias("core")))
    cores = marked.where("core").select("id", "features")

    def forest(ids, x, others, z):
        """Edges of a spanning forest of the pair's links."""
        names = np.unique(np.concatenate([ids, others]))
        up, edges = np.arange(len(names)), []
        a_at, b_at = np.searchsorted(names, ids), np.searchsorted(names, others)

        def top(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for at, d in _near(x, z, eps):
            for r in range(len(d)):
                mine = top(a_at[at + r])
                hits = np.flatnonzero(np.isfinite(d[r]))
                for j in hits[up[b_at[hits]] != mine]:
                    other = top(b_at[j])
                    if other != mine:
                        edges.append((names[mine], names[other]))
                        mine, up[max(mine, other)] = min(mine, other), min(mine, other)
        return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)

    joined = components(_by_blocks(cores, cores, forest, "a long, b long", block))
    named = checkpointed(cores.select("id").join(joined.select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster")))

    def nearest(ids, x, others, z):
        out = []
        order = np.argsort(others)
        for at, d in _near(x, z[order], eps):
            best = d.argmin(1)
            ok = np.flatnonzero(np.isfinite(d[np.arange(len(d)), best]))
            out.append(pd.DataFrame({"id": ids[at + ok], "near": others[order][best[ok]], "dist": d[ok, best[ok]]}))
        return pd.concat(out)

    edge = _by_blocks(marked.where("NOT core"), cores, nearest, "id long, near long, dist double", block)
    edge = edge.groupBy("id").agg(F.min_by("near", F.struct("dist", "near")).alias("near"))
    edge = edge.join(named.select(F.col("id").alias("near"), "cluster"), "near").select("id", "cluster")
    return marked.select("id", "core").join(named.unionByName(edge), "id", "left").select("id", "core", "cluster")
