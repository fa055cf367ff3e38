"""Generators of rows as plans: energy spheres, potential climbs and ellipsoids, on tables of any size.

What a generator needs of a row (its ordered neighbours, its class's covariance) comes out of joins and sums; each synthetic row is a
slot of its own, drawn by hash, so slots are independent and results don't depend on partitioning. NumPy works on a batch of slots and
their bounded neighbour lists inside tasks. Classes follow one another where a method says so; no task holds a class.

Rows: id (long), label (int), features (array<double>, finite, one length). Synthetic ids are negative: a class has 2 ** 40 of its own,
a pass (see class_by_class) 2 ** 50. A class of one row gives copies or points in its own sphere; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import uniform
from ..lineage import checkpointed
from . import sampling
from .forest import hashed, matrix
from .knn import neighbours

ENERGY, P_NORM, REACH = 0.25, 1.0, 50
GAMMA, STEP_SIZE, STEPS, NEAR = 0.05, 0.001, 500, 25
SEED_NEAR, VARIANCE_FLOOR = 5, 1e-3


def slot_ids(label: int) -> Column:
    return -(F.lit(label).cast("long") * (1 << 40) + F.col("slot") + 1)


def seeds_of(own: DataFrame, n: int, seed: int) -> DataFrame:
    """slot (0 .. n - 1) with the columns of a hashed row of own each, with replacement."""
    placed = sampling.with_place(own, seed, out="__place")
    size = own.agg(F.count("*").alias("__size"))
    slots = own.sparkSession.range(n).select(F.col("id").alias("slot")).crossJoin(F.broadcast(size)).where("__size > 0")
    slots = slots.select("slot", F.least(F.floor(uniform(seed, F.lit("pick"), "slot") * F.col("__size")) + 1, F.col("__size")).alias("__place"))
    return slots.join(placed, "__place").drop("__place")


def class_by_class(rows: DataFrame, step: Callable[[DataFrame, int, int, int], tuple[DataFrame, DataFrame]], seed: int = 42) -> DataFrame:
    """rows lifted class by class, largest first: the i-th class is lifted to the largest one's size against a hashed share of
    the classes before it (together about as many as the largest has). step(used, label, n, seed) gives (used, maybe moved, what is added)."""
    state = checkpointed(rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), "features"))
    sizes = sorted(((r["n"], r["label"]) for r in sampling.class_counts(state).collect()), reverse=True)  # a row a class
    for i, (n, label) in enumerate(sizes):
        if not i or n >= sizes[0][0]:
            continue
        earlier = [c for _, c in sizes[:i]]
        placed = sampling.with_place(state.where(F.col("label").isin(earlier)), seed + i, "label")
        used = checkpointed(placed.where(F.col("place") <= sizes[0][0] // i).drop("place").unionByName(state.where(F.col("label") == label)))
        moved, made = step(used, label, sizes[0][0] - n, seed + i)
        state = checkpointed(state.join(used.select("id"), "id", "left_anti").unionByName(moved).unionByName(made))
    return state


# -- energy spheres ------------------------------------------------------------------------------------------------------


def absorbed(found: DataFrame, energy: float) -> DataFrame:
    """Of ordered neighbour lists (id, rank, dist) with cost: the energy that a sphere around id spends until it holds the
    neighbour, as each step costs its length for every row inside and itself."""
    line = Window.partitionBy("id").orderBy("rank")
    step = F.col("rank") * (F.col("dist") - F.coalesce(F.lag("dist").over(line), F.lit(0.0)))
    return found.withColumn("cost", F.sum(step).over(line)).where(F.col("cost") < energy)


def spheres(rows: DataFrame, label: int, energy: float = ENERGY, p: float = P_NORM, reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """(id, radius of each row of a class; id, neighbour, dist, radius of what lies inside). A sphere grows among rows of other
    classes until its energy is spent; rows whose lists are all inside ask again with twice the reach, so no list is cut."""
    own, others = rows.where(F.col("label") == label), rows.where(F.col("label") != label)
    n, asked, inside = others.count(), own, None
    while True:
        got = checkpointed(absorbed(neighbours(others, reach, p, queries=asked), energy).select("id", "neighbour", "rank", "dist", "cost"))
        if reach < n:
            more = got.groupBy("id").agg(F.max("rank").alias("__last")).where(F.col("__last") >= reach).select("id")
            asked = checkpointed(asked.join(more, "id", "left_semi"))
            got = got.join(more, "id", "left_anti")
        inside = got if inside is None else inside.unionAll(got)
        if reach >= n or asked.isEmpty():
            break
        reach *= 2
    last = inside.groupBy("id").agg(F.max("rank").alias("m"), F.max("dist").alias("far"), F.max("cost").alias("spent"))
    m, far, left = F.coalesce("m", F.lit(0)), F.coalesce("far", F.lit(0.0)), F.lit(energy) - F.coalesce("spent", F.lit(0.0))
    # a sphere with all others inside spends the rest on them alone
    radius = far + left / F.when((m == n) & (m > 0), m).otherwise(m + 1)
    radii = checkpointed(own.select("id").join(last, "id", "left").select("id", radius.alias("radius")))
    return radii, inside.select("id", "neighbour", "dist").join(radii, "id")


def pushed(rows: DataFrame, inside: DataFrame, p: float = P_NORM, seed: int = 42) -> DataFrame:
    """rows, each moved by the sum of its pushes to the surfaces of the spheres that hold it. A row at a sphere's very centre is pushed
    in a hashed direction."""
    x, c = rows.select(F.col("id").alias("neighbour"), F.col("features").alias("x")), rows.select("id", F.col("features").alias("c"))
    side = lambda i: F.when(uniform(seed, F.lit("side"), "id", "neighbour", i) < 0.5, -1.0).otherwise(1.0)
    away = F.transform("x", lambda v, i: side(i) * (1e-6 + 1e-6 * uniform(seed, F.lit("jitter"), "id", "neighbour", i)))
    met = inside.join(c, "id").join(x, "neighbour")
    met = met.select("neighbour", "dist", "radius", F.when(F.col("dist") < 1e-20, away).otherwise(F.zip_with("x", "c", lambda v, w: v - w)).alias("gap"))

    def summed(ids: list[np.ndarray], pushes: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """One vector a row."""
        at, push = np.concatenate(ids), np.concatenate(pushes)
        order = np.argsort(at, kind="stable")
        names, first = np.unique(at[order], return_index=True)
        return [names], [np.add.reduceat(push[order], first)]

    def run(batches):
        ids, pushes = [], []
        for b in batches:
            if not len(b):
                continue
            gap, dist = matrix(b["gap"]), b["dist"].to_numpy()
            # the jittered distance of rows at a centre needs its norm; all others have theirs
            d = np.where(dist < 1e-20, (np.abs(gap) ** p).sum(1) ** (1 / p), dist)
            ids.append(b["neighbour"].to_numpy())
            pushes.append(((b["radius"].to_numpy() - d) / d)[:, None] * gap)
            if len(ids) > 8:  # what is held is about a vector a row
                ids, pushes = summed(ids, pushes)
        if ids:
            ids, pushes = summed(ids, pushes)
            for at in range(0, len(ids[0]), 10_000):
                part = pushes[0][at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(ids[0][at : at + 10_000]), pa.array(list(part), pa.list_(pa.float64()))], ["id", "move"])

    moves = met.repartition("neighbour").mapInArrow(run, "id long, move array<double>")  # all pushes of a row meet in one task
    met = rows.join(moves, "id", "left")
    return met.select("id", "label", F.when(F.col("move").isNull(), F.col("features")).otherwise(F.zip_with("features", "move", lambda a, b: a + b)).alias("features"))


def in_spheres(own: DataFrame, radii: DataFrame, label: int, n: int, p: float = P_NORM, seed: int = 42) -> DataFrame:
    """id, label, features: about n points in the spheres of a class, the more the smaller a sphere is (round(n / r over the sum of 1 / r),
    half to even), each along a hashed direction."""
    inverse = radii.select("id", (1 / F.greatest("radius", F.lit(1e-12))).alias("v"), "radius")
    total = inverse.agg(F.greatest(F.sum("v"), F.lit(1e-12)).alias("__total"))
    wanted = inverse.crossJoin(F.broadcast(total)).select("id", "radius", F.bround(F.col("v") / F.col("__total") * n).cast("long").alias("n")).where("n > 0")
    slots = wanted.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).join(own.select("id", "features"), "id")
    draw = lambda what, *more: uniform(seed, F.lit(what), "id", "k", *more)
    slots = slots.withColumn("way", F.transform("features", lambda x, i: 2 * draw("way", i) - 1))
    norm = F.pow(F.aggregate("way", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x), F.lit(p))), 1 / p)
    slots = slots.withColumn("norm", norm)
    made = F.zip_with("features", "way", lambda x, w: x + w / F.greatest("norm", F.lit(1e-20)) * draw("reach") * F.col("radius"))
    # slots in a row: those of earlier rows first, counted by rows, not by slots
    slots = slots.select("id", "k", made.alias("features"))
    slots = sampling.with_place(slots.withColumn("pair", F.xxhash64("id", "k")), seed, id_col="pair", out="slot")
    return slots.select(slot_ids(label).alias("id"), F.lit(label).alias("label"), "features")


def energy_resample(rows: DataFrame, energy: float = ENERGY, p: float = P_NORM, seed: int = 42) -> DataFrame:
    """Cleaning and lifting by energy spheres, class by class."""

    def step(used: DataFrame, label: int, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
        radii, inside = spheres(used, label, energy, p)
        return pushed(used, inside, p, seed), in_spheres(used.where(F.col("label") == label), radii, label, n, p, seed)

    return class_by_class(rows, step, seed)


# -- potential climbs ----------------------------------------------------------------------------------------------------


def _rbf(d: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-((d / gamma) ** 2)) if gamma else np.zeros_like(d)


def climb(points: np.ndarray, near: np.ndarray, sign: np.ndarray, keys: np.ndarray, gamma: float, size: float, steps: int) -> np.ndarray:
    """Points (slots x d) after `steps` tries each. near: slots x k x d; sign: 1 for others, -1 for the own class, 0 for none. A try
    moves one coordinate by size, and stays if the potential's absolute value falls; then all directions but the way back are
    open again, in an order hashed from the slot's key and how often it moved."""
    n, d = points.shape
    at, moved, dist = points.copy(), np.zeros(n, np.int64), np.abs(near - points[:, None, :]).sum(2)
    total = lambda gap: (sign * _rbf(gap, gamma)).sum(1)
    now = np.abs(total(dist))
    order = lambda rows: np.argsort(hashed(hashed(keys[rows] * 1_000_003 + moved[rows], 7)[:, None] + np.arange(2 * d, dtype=np.uint64)[None, :], 11), 1)
    ways, left, back = order(np.arange(n)), np.full(n, 2 * d), np.full(n, -1)
    rows = np.arange(n)
    for _ in range(steps):
        left = left - 1
        alive = left >= 0
        if not alive.any():
            break
        way = ways[rows, np.maximum(left, 0)]
        barred = alive & (way == back)  # the way back isn't among the open ones: take the next instead
        left = np.where(barred, left - 1, left)
        alive &= left >= 0
        way = ways[rows, np.maximum(left, 0)]
        dim, by = way // 2, np.where(way % 2, size, -size)
        x, z = near[rows, :, dim], at[rows, dim][:, None]
        gap = dist - np.abs(x - z) + np.abs(x - z - by[:, None])
        then = np.abs(total(gap))
        better = np.flatnonzero(alive & (then < now))
        at[better, dim[better]] += by[better]
        dist[better], now[better] = gap[better], then[better]
        moved[better] += 1
        if len(better):
            ways[better], left[better], back[better] = order(better), 2 * d, way[better] ^ 1
    return at


def climbed(used: DataFrame, label: int, n: int, gamma: float = GAMMA, size: float = STEP_SIZE, steps: int = STEPS, k: int = NEAR, seed: int = 42) -> DataFrame:
    """id, label, features: n points of a class, each a climb from a hashed row among its k nearest rows and itself."""
    own = used.where(F.col("label") == label)
    # only rows that are asked for ask
    drawn = checkpointed(seeds_of(own, n, seed).select("slot", "id", "features"))
    asked = drawn.select("id").distinct().join(own, "id")
    found = neighbours(used, k, queries=asked).select("id", "neighbour", (F.col("neighbour_label") != label).alias("other"), "rank")
    x = used.select(F.col("id").alias("neighbour"), F.col("features").alias("x"))
    # k neighbours and vectors a list
    lists = found.join(x, "neighbour").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "x"))).alias("near"))
    spare = [list(r["features"]) for r in used.where(F.col("label") != label).orderBy("id").limit(1).collect()]  # where no other row is near
    joined = drawn.join(lists, "id", "left")

    def run(batches):
        for b in batches:
            for start in range(0, len(b), 256):
                part = b.slice(start, 256)
                points, keys = matrix(part["features"]), part["slot"].to_numpy()
                d = points.shape[1]
                near, sign = np.zeros((len(part), k + 2, d)), np.zeros((len(part), k + 2))
                near[:, 0], sign[:, 0] = points, -1.0  # the row itself
                lists = part["near"]
                lens = np.diff(lists.offsets.to_numpy())
                if lens.sum():
                    flat = lists.flatten()
                    r = np.repeat(np.arange(len(part)), lens)
                    c = np.arange(len(r)) - np.repeat(np.cumsum(lens) - lens, lens) + 1
                    near[r, c] = matrix(flat.field("x"))
                    sign[r, c] = np.where(flat.field("other").to_numpy(zero_copy_only=False), 1.0, -1.0)
                if spare:
                    alone = ~(sign > 0).any(1)
                    near[alone, -1], sign[alone, -1] = spare[0], 1.0
                made = climb(points, near, sign, keys + label * (1 << 40), gamma, size, steps)
                yield pa.RecordBatch.from_arrays([part["slot"], pa.array(list(made), pa.list_(pa.float64()))], ["slot", "features"])

    # an even number of slots a task, as climbs are what costs
    dealt = joined.select("slot", "features", F.coalesce("near", F.array().cast("array<struct<rank:int,other:boolean,x:array<double>>>")).alias("near"))
    made = dealt.repartition(int(used.sparkSession.conf.get("spark.sql.shuffle.partitions")), "slot").mapInArrow(run, "slot long, features array<double>")
    return made.select(slot_ids(label).alias("id"), F.lit(label).alias("label"), "features")


def potential_resample(rows: DataFrame, gamma: float = GAMMA, size: float = STEP_SIZE, steps: int = STEPS, k: int = NEAR, seed: int = 42) -> DataFrame:
    """Lifting by climbs of the mutual class potential, class by class."""
    return class_by_class(rows, lambda used, label, n, s: (used, climbed(used, label, n, gamma, size, steps, k, s)), seed)


# -- ellipsoids ----------------------------------------------------------------------------------------------------------


def trusted_seeds(rows: DataFrame, label: int, k: int = SEED_NEAR, share: float = 0.5) -> DataFrame:
    """id, features, weight of a class's rows with at least max(1, k * share) rows of the class among their k nearest (weight: how many);
    of all its rows where none has (weight: one at least)."""
    own = rows.where(F.col("label") == label)
    same = neighbours(rows, k, queries=own).groupBy("id").agg(F.sum((F.col("neighbour_label") == label).cast("int")).alias("same"))
    known = checkpointed(own.select("id", "features").join(same, "id", "left").withColumn("same", F.coalesce("same", F.lit(0))))
    good = known.where(F.col("same") >= max(1, int(k * share)))
    if good.isEmpty():
        return known.select("id", "features", F.greatest("same", F.lit(1)).alias("weight"))
    return good.select("id", "features", F.col("same").alias("weight"))


def axes(seeds: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes, variances along them) of rows, from sums of products a task; the driver solves d x d numbers."""

    def run(batches):
        n, s, ss = 0, 0.0, 0.0
        for b in batches:
            x = matrix(b["features"])
            if len(x):
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([ss.ravel().tolist()], pa.list_(pa.float64()))], ["n", "s", "ss"])

    # shifted by one row, so that a far mean costs no digits
    origin = np.array(seeds.orderBy("id").first()["features"])
    shifted = seeds.select(F.zip_with("features", F.array(*[F.lit(float(v)) for v in origin]), lambda a, b: a - b).alias("features"))
    parts = shifted.mapInArrow(run, "n long, s array<double>, ss array<double>")
    add = lambda c: parts.select(F.posexplode(c).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    n = parts.agg(F.sum("n")).first()[0]
    s, ss = np.array([r["v"] for r in add("s")]), np.array([r["v"] for r in add("ss")])  # d and d * d numbers
    mean = s / n
    cov = ss.reshape(len(s), len(s)) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    return origin + mean, vectors[:, ::-1], np.maximum(values[::-1], 0.0)


def on_ellipsoids(seeds: DataFrame, label: int, n: int, floor: float = VARIANCE_FLOOR, seed: int = 42) -> DataFrame:
    """id, label, features: n points, each from a row drawn by weight: alpha is its squared distance in units of variance along
    the principal axes; coordinates are even up to the root of alpha times the variance, the last one up to what they leave of alpha."""
    mean, vectors, variances = axes(seeds)
    rank = min(seeds.count(), len(mean))
    vectors, variances = vectors[:, :rank], np.maximum(variances[:rank], floor)
    copies = seeds.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("weight")))).withColumn("pair", F.xxhash64("id", "copy"))  # weights are k at most
    placed = sampling.with_place(copies.select("id", "features", "pair"), seed, id_col="pair", out="__place")
    size = copies.agg(F.count("*").alias("__size"))
    slots = seeds.sparkSession.range(n).select(F.col("id").alias("slot")).crossJoin(F.broadcast(size))
    slots = slots.select("slot", F.least(F.floor(uniform(seed, F.lit("pick"), "slot") * F.col("__size")) + 1, F.col("__size")).alias("__place"))
    drawn = slots.join(placed, "__place").select("slot", "features")

    def run(batches):
        for b in batches:
            x, slot = matrix(b["features"]), b["slot"].to_numpy()
            t = (x - mean) @ vectors if len(x) else np.zeros((0, rank))
            alpha = (t * t / variances).sum(1, keepdims=True)
            u = (hashed(hashed(slot + label * (1 << 40), seed)[:, None] + np.arange(rank, dtype=np.uint64)[None, :], 3) >> np.uint64(11)) / float(1 << 53)
            spread = np.maximum(alpha * variances, floor)
            made = (2 * u - 1) * np.sqrt(spread)
            used = (made[:, :-1] ** 2 / spread[:, :-1]).sum(1)
            last = np.sqrt(np.maximum((1 - used) * alpha[:, 0] * variances[-1], 0)) * (used <= 1)
            made[:, -1] = (2 * u[:, -1] - 1) * last
            yield pa.RecordBatch.from_arrays([b["slot"], pa.array(list(made @ vectors.T + mean), pa.list_(pa.float64()))], ["slot", "features"])

    made = drawn.mapInArrow(run, "slot long, features array<double>")
    return made.select(slot_ids(label).alias("id"), F.lit(label).alias("label"), "features")


def ellipsoid_resample(rows: DataFrame, k: int = SEED_NEAR, seed: int = 42) -> DataFrame:
    """Every class lifted to the largest one's size along its own principal axes; a class of one row by copies."""
    rows = checkpointed(rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), "features"))
    sizes = {r["label"]: r["n"] for r in sampling.class_counts(rows).collect()}  # a row a class
    out = rows
    for label, n in sorted(sizes.items()):
        need = max(sizes.values()) - n
        if need and n == 1:
            out = out.unionByName(seeds_of(rows.where(F.col("label") == label), need, seed).select(slot_ids(label).alias("id"), "label", "features"))
        elif need:
            out = out.unionByName(checkpointed(on_ellipsoids(checkpointed(trusted_seeds(rows, label, k)), label, need, seed=seed + label)))
    return out
