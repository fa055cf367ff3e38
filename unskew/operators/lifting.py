"""Resampling methods as plans, on tables of any size: the kernels of resamplers.py by searches, joins and a slot a synthetic row.

What a method needs of a row (neighbours, safety, trust, group) is a table by id; what is drawn is drawn by hash, so results don't
depend on partitioning. Where a kernel's draw goes by weights of few values, classes of weights are drawn first and rows evenly within
them. The driver holds a row a class or class of weights.

Rows: id (long), label (int), features (array<double>, finite, one length). Synthetic ids are negative: a class has 2 ** 40 of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import interpolate, uniform
from ..lineage import checkpointed, written
from . import neighbourhood, sampling
from .clusters import class_eps, density_clusters, eps_clusters, peaks_reach
from .forest import matrix
from .generators import axes, seeds_of, slot_ids
from .knn import FIRST, cross_class_distance, keyed, merged, nearest_distances, neighbours, safe_level
from .ranks import quantiles

INLAND, BORDER, TRAPPED = range(3)
ROW = ["id", "label", "features"]


def by_size(rows: DataFrame) -> list[tuple[int, int]]:
    """(class, rows), largest first; ties: the smaller class."""
    return sorted(((r["label"], r["n"]) for r in sampling.class_counts(rows).collect()), key=lambda v: (-v[1], v[0]))  # a row a class


def of(rows: DataFrame, label: int) -> DataFrame:
    return rows.where(F.col("label") == label)


def named(rows: DataFrame, label: int) -> DataFrame:
    """id, label, features of slots."""
    return rows.select(slot_ids(label).alias("id"), F.lit(label).alias("label"), "features")


def copies(own: DataFrame, label: int, need: int, seed: int) -> DataFrame:
    return named(seeds_of(own, need, seed), label)


def lists(found: DataFrame, x: DataFrame, out: str, *more: str) -> DataFrame:
    """id, out: each row's neighbours (k at most) by rank with their vectors (x), and further columns of found."""
    to = x.select(F.col("id").alias("neighbour"), F.col("features").alias("x"))
    return found.join(to, "neighbour").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "x", *more))).alias(out))


def picked(column: str, u: Column) -> Column:
    """One of a list, or null of an empty one."""
    return F.get(column, F.floor(u * F.size(column)).cast("int"))


def weighted_pick(column: str, weight: str, u: Column) -> Column:
    """One of a short list by the weights in it."""
    upto = F.transform(column, lambda e, i: F.aggregate(F.slice(column, F.lit(1), i + 1), F.lit(0.0), lambda s, x: s + x[weight]))
    return F.get(column, F.least(F.size(F.filter(upto, lambda w: w <= u * F.element_at(upto, -1))), F.size(column) - 1))


def weighted_seeds(own: DataFrame, level: str, weights: dict[int, float], first: int, n: int, seed: int) -> DataFrame:
    """slot (first .. first + n - 1) with the columns of a row of own each, drawn by the weight of its level, with replacement."""
    held = {r[level]: r["n"] for r in own.groupBy(level).agg(F.count("*").alias("n")).collect()}  # a row a level
    levels = sorted(held)
    upto = np.cumsum([weights[v] * held[v] for v in levels])
    slots = own.sparkSession.range(first, first + n).select(F.col("id").alias("slot"))
    at = F.array(*[F.lit(float(v)) for v in upto[:-1] / upto[-1]]) if len(levels) > 1 else F.array().cast("array<double>")
    slots = slots.withColumn("__u", uniform(seed, F.lit("level"), "slot")).withColumn("__at", F.size(F.filter(at, lambda w: w <= F.col("__u"))))
    slots = slots.withColumn(level, F.get(F.array(*[F.lit(v) for v in levels]), F.col("__at")))
    size = F.get(F.array(*[F.lit(held[v]) for v in levels]), F.col("__at"))
    slots = slots.withColumn("__place", F.least(F.floor(uniform(seed, F.lit("pick"), "slot") * size) + 1, size)).drop("__u", "__at")
    return slots.join(sampling.with_place(own, seed, level, out="__place"), [level, "__place"]).drop("__place")


def with_row(slots: DataFrame, rows: DataFrame, what: str, seed: int, out: str) -> DataFrame:
    """slots with the vector of a hashed row of rows."""
    placed = sampling.with_place(rows.select("id", F.col("features").alias(out)), seed, out="__place").drop("id")
    n = rows.count()
    return slots.withColumn("__place", F.least(F.floor(uniform(seed, F.lit(what), "slot") * n) + 1, F.lit(n))).join(placed, "__place").drop("__place")


def normals(seed: int, *keys: str) -> Column:
    """A normal draw a dimension, by Box and Muller from hashes."""
    return F.transform("features", lambda x, i: F.sqrt(-2 * F.ln(F.greatest(uniform(seed, F.lit("r"), *keys, i), F.lit(1e-12)))) * F.cos(2 * math.pi * uniform(seed, F.lit("a"), *keys, i)))


def moved(way: str | Column, by: Column) -> Column:
    return F.zip_with("features", way, lambda x, w: x + w * by)


# -- hybrid sampling by safety ---------------------------------------------------------------------------------------------


def sh_resample(rows: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """To the mean class size: larger classes lose rows by lot, unsafe ones first; smaller ones gain points in balls around rows drawn by
    safety that reach as far as the k-th row of another class."""
    rows = checkpointed(keyed(rows))
    sizes = by_size(rows)
    goal = round(sum(n for _, n in sizes) / len(sizes)) if sizes else 0
    safe = checkpointed(safe_level(rows, k))
    out = rows.join(neighbourhood.roulette_delete(rows, safe, goal, seed).select("id"), "id", "left_semi")
    for label, n in sizes:
        if n >= goal:
            continue
        # shares of up to k neighbours: a number of levels that doesn't grow with the rows
        levels = math.lcm(*range(1, k + 1))
        own = of(rows, label).join(safe.select("id", F.round(F.col("safe") * levels).cast("int").alias("level")), "id")
        drawn = weighted_seeds(own, "level", {v: v / levels + 1e-6 for v in range(levels + 1)}, 0, goal - n, seed + label)
        drawn = drawn.join(cross_class_distance(rows, label, k), "id").withColumn("way", normals(seed + label, "slot"))
        norm = F.greatest(F.sqrt(F.aggregate("way", F.lit(0.0), lambda s, w: s + w * w)), F.lit(1e-12))
        reach = F.coalesce("dist", F.lit(1.0)) * F.pow(uniform(seed + label, F.lit("reach"), "slot"), 1 / F.size("features"))
        out = out.unionByName(named(drawn.withColumn("by", reach / norm).withColumn("features", moved("way", F.col("by"))), label))
    return out


# -- clean candidate regions -----------------------------------------------------------------------------------------------


def orem_resample(rows: DataFrame, stop: int = 5, seed: int = 42) -> DataFrame:
    """Every class to the largest one's size, from the smallest up, each among all rows and points before it."""
    state = checkpointed(keyed(rows))
    sizes = by_size(state)
    for label, n in sorted(sizes[1:], key=lambda v: (v[1], v[0])):
        if n < sizes[0][1]:
            made = neighbourhood.orem_generate(state, label, sizes[0][1] - n, stop, seed=seed + label)
            state = checkpointed(state.unionByName(made.select((F.col("id") - (label << 40)).alias("id"), "label", "features")))
    return state


# -- directions by purity --------------------------------------------------------------------------------------------------


def smom_resample(rows: DataFrame, k: int = 5, trapped: float = 0.2, least: int = 3, seed: int = 42) -> DataFrame:
    """Seeds in turn; the direction to a neighbour is drawn by how pure the midpoint is, less where seed or neighbour lie in a cluster of
    low safety."""
    rows = checkpointed(keyed(rows))
    sizes, safe, out = by_size(rows), checkpointed(safe_level(rows, k).select("id", "safe")), rows
    for label, n in sizes[1:]:
        own, need = of(rows, label), sizes[0][1] - n
        if need and n == 1:
            out = out.unionByName(copies(own, label, need, seed))
        if not need or n == 1:
            continue
        group = eps_clusters(own, class_eps(own, k), least).select("id", F.coalesce("cluster", -1 - F.col("id")).alias("group")).join(safe, "id")
        mean = group.groupBy("group").agg((F.avg("safe") < 0.5).alias("bad"))
        bad = checkpointed(group.join(mean, "group").select("id", "bad"))
        ways = neighbourhood.midpoint_weights(rows, label, k).join(bad, "id").withColumnRenamed("bad", "low")
        ways = ways.join(bad.withColumnRenamed("id", "neighbour"), "neighbour")
        weight = F.col("pure") * F.when(F.col("low"), math.sqrt(trapped)).otherwise(1.0) * F.when(F.col("bad"), trapped).otherwise(1.0) + 1e-9
        ways = lists(ways.select("id", "neighbour", F.lit(0).alias("rank"), weight.alias("w")), own, "ways", "w")
        seeds = sampling.with_place(own, seed + label, out="__place").withColumn("__place", F.col("__place") - 1)
        slots = own.sparkSession.range(need).select(F.col("id").alias("slot"), (F.col("id") % n).alias("__place"))
        drawn = slots.join(seeds, "__place").join(ways, "id").withColumn("u", uniform(seed, F.lit("way"), F.lit(label), "slot"))
        drawn = drawn.withColumn("to", weighted_pick("ways", "w", F.col("u"))["x"])
        out = out.unionByName(named(drawn.withColumn("features", interpolate("features", "to", uniform(seed, F.lit("gap"), F.lit(label), "slot"))), label))
    return out


# -- borders on both sides -------------------------------------------------------------------------------------------------


def eb_resample(rows: DataFrame, k: int = 5, spread: int = 2, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """Against the largest class, border rows of both sides breed: majority ones drawn 0.3 toward the minority's, minority ones 0.5."""
    rows = checkpointed(keyed(rows))
    sizes, out = by_size(rows), rows
    big = sizes[0][0] if sizes else 0

    def mates(asked: DataFrame, pool: DataFrame, name: str, apart: bool = True) -> DataFrame:
        """asked with the list of its k nearest of the pool; apart: without equal points, if there are others."""
        found = lists(neighbours(pool, k, queries=asked), pool, "l", "dist")
        if apart:
            other = F.filter("l", lambda e: e["dist"] > 0)
            found = found.withColumn("l", F.when(F.size(other) > 0, other).otherwise(F.col("l")))
        return asked.join(found.withColumnRenamed("l", name), "id", "left")

    def bred(drawn: DataFrame, label: int, c: int, share: float, *keys: str) -> DataFrame:
        u = lambda what: uniform(seed, F.lit(what), F.lit(c), F.lit(label), *keys)
        to = drawn.withColumn("m", F.coalesce(picked("mate", u("mate"))["x"], F.col("features"))).withColumn("t", picked("toward", u("toward"))["x"])
        to = to.withColumn("m", interpolate("m", "features", u("gap")))
        return to.withColumn("features", F.zip_with("m", "t", lambda a, b: (1 - share) * a + share * b))

    for c, n in sizes[1:]:
        border = checkpointed(neighbourhood.border_rows(rows, c, big, k, spread))
        low, high = (checkpointed(of(rows, v).join(border.select("id"), "id", "left_semi")) for v in (c, big))
        lows, highs = low.count(), high.count()
        if lows and highs:
            drawn = bred(mates(mates(high, of(rows, big), "mate"), low, "toward", False), big, c, 0.3, "id")
            placed = sampling.with_place(drawn.select(*ROW), seed)
            out = out.unionByName(placed.select((-(F.lit((1 << 55) + (c << 40)) + F.col("place"))).alias("id"), "label", "features"))
        each = max(0, -(-math.ceil(ratio * (sizes[0][1] + highs) - n) // lows)) if lows else 0
        if each and (highs or lows > 1):
            asked = mates(mates(low, of(rows, c), "mate"), high if highs else of(rows, big), "toward", False)
            placed = sampling.with_place(asked, seed).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
            out = out.unionByName(named(bred(placed, c, c, 0.5, "id", "copy").withColumn("slot", (F.col("place") - 1) * each + F.col("copy")), c))
    return out


# -- local and global views ------------------------------------------------------------------------------------------------


def quotas(weights: DataFrame, need: int) -> DataFrame:
    """id, copy: each row (id, weight) as often as its share of need by largest remainders, with slot, a number of its own."""
    quota = checkpointed(neighbourhood.largest_remainder(weights, need).where("quota > 0"))
    each = quota.select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))).alias("copy"))
    return sampling.with_place(each.withColumn("pair", F.xxhash64("id", "copy")), 0, id_col="pair", out="slot").drop("pair")


def glos_resample(rows: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Rows far from their class against others are hard and get most of the new points. Rows among their own breed from the class's
    Gaussian, border rows by interpolation, lone rows by a small step."""
    rows = checkpointed(keyed(rows))
    sizes, out = by_size(rows), rows
    found = checkpointed(neighbours(rows, k, queries=rows.where(F.col("label") != sizes[0][0]))) if sizes else None
    for label, n in sizes[1:]:
        own, need = of(rows, label), sizes[0][1] - n
        if not need:
            continue
        edges = of(found, label)
        scores = neighbourhood.did(edges).join(edges.groupBy("id").agg(F.sum((F.col("neighbour_label") == label).cast("int")).alias("same"), F.count("*").alias("of")), "id")
        mean = scores.agg(F.avg("did").alias("mean"))
        scores = checkpointed(scores.crossJoin(F.broadcast(mean)).select("id", (F.when(F.col("hard"), F.col("mean") - F.col("did")).otherwise(0.0) + 1e-12).alias("weight"), "same", "of"))
        kin = checkpointed(neighbours(own, k))
        step = quantiles(kin.where("rank = 1"), "dist", {"q": 0.5}).first()["q"] if n > 1 else 1.0
        center, vectors, variances = axes(own)
        spread = np.sqrt(variances * (n / (n - 1) if n > 1 else 0.0) + 1e-3)

        def gaussian(batches, center=center, turn=(vectors * spread).T):
            for b in batches:
                z = matrix(b["z"])
                made = z @ turn + center if len(z) else z
                yield pa.RecordBatch.from_arrays([b["slot"], pa.array(list(made), pa.list_(pa.float64()))], ["slot", "draw"])

        drawn = quotas(scores.select("id", "weight"), need).join(own, "id").join(scores.select("id", "same", "of"), "id").join(lists(kin, own, "kin"), "id", "left")
        drawn = checkpointed(drawn.withColumn("z", normals(seed + label, "slot")))
        gap = uniform(seed + label, F.lit("gap"), "slot")
        among = drawn.where(F.col("same") == F.col("of"))
        among = among.join(among.select("slot", "z").mapInArrow(gaussian, "slot long, draw array<double>"), "slot").withColumn("features", interpolate("features", "draw", gap))
        rest = drawn.where(F.col("same") != F.col("of"))
        to = picked("kin", uniform(seed + label, F.lit("kin"), "slot"))["x"]
        alone = (F.col("same") == 0) | F.col("kin").isNull()
        rest = rest.withColumn("to", to).withColumn("features", F.when(alone, moved("z", F.lit(float(step)))).otherwise(interpolate("features", "to", gap)))
        out = out.unionByName(named(among, label)).unionByName(named(rest, label))
    return out


# -- quality control -------------------------------------------------------------------------------------------------------


def qc_resample(rows: DataFrame, k: int = 5, eta: float = 0.5, least: float = 0.3, clear: float = 0.05, seed: int = 42) -> DataFrame:
    """Trusted rows breed several candidates; the purest and clearest is kept if it is good enough, else the most trusted neighbour is
    copied."""
    rows = checkpointed(keyed(rows))
    sizes, out = by_size(rows), rows
    for label, n in sizes[1:]:
        own, rest, need = of(rows, label), rows.where(F.col("label") != label), sizes[0][1] - n
        if need and n == 1:
            out = out.unionByName(copies(own, label, need, seed))
        if not need or n == 1:
            continue
        kin, others = neighbourhood.own_and_others(rows, label, k)
        tau = quantiles(kin.where("rank = 1"), "dist", {"q": 0.5}).first()["q"]
        near = written(merged(kin, others, k))
        trust = written(neighbourhood.trust(rows, label, k, near))
        support = near.agg(F.sum("same") / F.sum("of")).first()[0]
        tries = 1 if 1 - support < 0.33 else 3 if 1 - support < 0.66 else 5
        known = kin.join(trust.withColumnRenamed("id", "neighbour"), "neighbour")
        ways = written(lists(known, own, "ways", "trust"))
        slots = written(quotas(trust.select("id", (F.col("trust") + 1e-12).alias("weight")), need))
        drawn = slots.join(own, "id").join(ways, "id").withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
        drawn = drawn.withColumn("way", picked("ways", uniform(seed + label, F.lit("way"), "slot", "try")))
        tried = drawn.withColumn("features", interpolate("features", "way.x", uniform(seed + label, F.lit("gap"), "slot", "try")))
        tried = written(tried.select((-1 - (F.col("slot") * tries + F.col("try"))).alias("id"), F.lit(label).alias("label"), "features", "slot", "try", F.col("id").alias("from"), F.col("way.neighbour").alias("neighbour")))
        # purity only of the midpoints of ways that are drawn
        pairs = written(tried.select(F.col("from").alias("id"), "neighbour").distinct())
        pure = neighbourhood.midpoint_weights(rows, label, k, pairs).select(F.col("id").alias("from"), "neighbour", F.col("pure").alias("mid"))
        found = merged(neighbours(own, k, queries=tried), neighbours(rest, k, queries=tried), k).select("id", (F.col("same") / F.col("of")).alias("own"), "far")
        scored = tried.join(found, "id").where((F.col("own") >= least) & (F.col("far") >= clear * tau)).join(pure, ["from", "neighbour"])
        score = eta * F.col("own") + (1 - eta) * F.col("mid") + 0.25 * F.least(F.lit(1.0), F.col("far") / max(tau, 1e-12))
        best = scored.groupBy("slot").agg(F.max_by("features", F.struct(score, -F.col("try"))).alias("best"))
        # the most trusted neighbour; ties: the nearest
        safest = F.aggregate("ways", F.get("ways", F.lit(0)), lambda a, e: F.when(e["trust"] > a["trust"], e).otherwise(a))
        kept = slots.join(ways, "id").select("slot", safest["x"].alias("spare")).join(best, "slot", "left")
        out = out.unionByName(named(kept.withColumn("features", F.coalesce("best", "spare")), label))
    return out


# -- similarity of classes -------------------------------------------------------------------------------------------------


def similarities(mixed: dict[tuple[int, int], int]) -> dict[tuple[int, int], float]:
    """How often classes stand among each other's neighbours (counts by pair of classes), made symmetric; 1 for a class itself."""
    classes = {c for pair in mixed for c in pair}
    total = {a: sum(mixed.get((a, b), 0) for b in classes) for a in classes}
    share = lambda a, b: mixed.get((a, b), 0) / total[a] if total[a] else 0.0
    return {(a, b): 1.0 if a == b else (share(a, b) + share(b, a)) / 2 for a in classes for b in classes}


def with_copies(held: DataFrame, added: DataFrame, label: int, turn: int, k: int) -> DataFrame:
    """held (id, label, m: how often the row is there, near: its k nearest in order) after copies of rows of a class (id, more) have come.
    A copy stands in every list in which its row does, after what is as near, and first in its row's own."""
    seen = held.select("id", F.explode("near").alias("e")).where((F.col("e.kind") == label) & (F.col("e.site") != F.col("id"))).groupBy("id", F.col("e.site").alias("site")).agg(F.min("e.dist").alias("dist"))
    seen = seen.join(added.withColumnRenamed("id", "site"), "site").unionByName(added.select("id", F.col("id").alias("site"), F.lit(0.0).alias("dist"), "more"))
    new = seen.groupBy("id").agg(F.collect_list(F.struct("site", "dist", "more")).alias("new"))  # k + 1 sites at most
    come = lambda e: F.struct(e["dist"], F.lit(turn).alias("turn"), e["site"], F.lit(label).alias("kind"))
    come_all = F.flatten(F.transform("new", lambda e: F.array_repeat(come(e), F.least(e["more"], F.lit(k)).cast("int"))))
    own = F.aggregate("new", F.lit(0).cast("long"), lambda s, e: s + F.when(e["site"] == F.col("id"), e["more"]).otherwise(F.lit(0)))
    near = F.when(F.col("new").isNull(), F.col("near")).otherwise(F.slice(F.array_sort(F.concat("near", come_all)), 1, k))
    return held.join(new, "id", "left").select("id", "label", (F.col("m") + F.coalesce(own, F.lit(0))).alias("m"), near.alias("near"))


def soup_resample(rows: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """To the mean class size: larger classes lose their least safe rows, smaller ones copy their safest; safety is the mean similarity of
    a row's class to its neighbours', taken anew after each class and round of copies.

    A row whose neighbours are all of its class has the largest safety, 1, and copies never take it away. Once there are such rows, each copy
    is of one of them, so a round draws as many as there are; before that a round is one copy. Copies change only lists in which
    their row stands, so that vectors are searched once. The driver holds a row a class and mix of neighbours."""
    state = written(keyed(rows))
    sizes = by_size(state)
    goal = round(sum(n for _, n in sizes) / len(sizes)) if sizes else 0
    for label, n in sizes:
        if n > goal:
            scores = neighbourhood.safety(neighbours(state, k)).where(F.col("label") == label).select("id", F.round("safety", 9).alias("safety"))
            # rows without any neighbour are safe
            scores = of(state, label).select("id").join(scores, "id", "left").withColumn("safety", F.coalesce("safety", F.lit(1.0)))
            gone = sampling.with_rank(scores, -F.col("safety"), out="place").where(F.col("place") > goal)
            state = written(state.join(gone.select("id"), "id", "left_anti"))
    small = [(label, n) for label, n in reversed(sizes) if n < goal]
    if not small:
        return state
    entry = F.struct("dist", F.lit(0).alias("turn"), F.col("neighbour").alias("site"), F.col("neighbour_label").alias("kind"))
    near = neighbours(state, k).groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("near"))
    held = state.select("id", "label", F.lit(1).cast("long").alias("m")).join(near, "id", "left")
    held = written(held.withColumn("near", F.coalesce("near", F.array().cast(near.schema["near"].dataType))))
    kinds, turn, out = F.array_sort(F.transform("near", lambda e: e["kind"])), 0, state
    for label, n in small:
        while n < goal:
            mixes = [(r["label"], r["kinds"], r["m"]) for r in held.groupBy("label", kinds.alias("kinds")).agg(F.sum("m").alias("m")).collect()]  # a row a class and mix
            mixed = {}
            for a, among, m in mixes:
                for b in among:
                    mixed[a, b] = mixed.get((a, b), 0) + m
            alike = similarities(mixed)
            safe = [(round(sum(alike[a, b] for b in among) / len(among), 9) if among else 1.0, among, m) for a, among, m in mixes if a == label]
            top = max(s for s, _, _ in safe)
            best = [among for s, among, _ in safe if s == top]
            there = sum(m for s, _, m in safe if s == top)
            like = F.lit(False)
            for among in best:
                like = like | (kinds == F.array(*[F.lit(b) for b in among]).cast("array<int>"))
            members = held.where((F.col("label") == label) & like).select("id", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("copy")).select("id")
            take, turn = min(goal - n, there) if top == 1.0 else 1, turn + 1
            drawn = seeds_of(members, take, seed + turn).groupBy("id").agg(F.count("*").alias("more"))
            held, n = written(with_copies(held, written(drawn), label, turn, k)), n + take
        made = of(held, label).where("m > 1").select("id", F.explode(F.sequence(F.lit(2).cast("long"), "m")).alias("copy")).withColumn("pair", F.xxhash64("id", "copy"))
        made = sampling.with_place(made, seed, id_col="pair", out="slot").select("id", (F.col("slot") - 1).alias("slot"))
        out = out.unionByName(named(made.join(of(state, label).select("id", "features"), "id"), label))
    return out


# -- groups of rows within their class -------------------------------------------------------------------------------------


def kin_of(pool: DataFrame, k: int = 5) -> DataFrame:
    """id, same, kin, cluster: of each row of a class the distance to the nearest other one (1 if there is none), the k nearest as (rank, dist,
    neighbour), and its density cluster, from one search."""
    n = pool.count()
    reach = peaks_reach(n)
    near = checkpointed(nearest_distances(pool, max(reach, k), max(FIRST, k)))
    kin = F.slice(F.transform("nears", lambda e, i: F.struct((i + 1).alias("rank"), F.get("dists", i).alias("dist"), e.alias("neighbour"))), 1, k)
    found = near.select("id", F.coalesce(F.get("dists", F.lit(0)), F.lit(1.0)).alias("same"), kin.alias("kin"))
    peaks = density_clusters(pool, near=near.withColumn("dists", F.slice("dists", 1, max(reach, 1)))).select("id", "cluster")
    return written(found.join(peaks, "id"))


def groups(kin: DataFrame, pool: DataFrame, rest: DataFrame, k: int = 5) -> DataFrame:
    """id, group, other: inland, border or trapped for each row of a class (pool, and its kin_of()) against the rest, by purity of its neighbourhood, its
    margin and its cluster's mean margin; and how near the rest is."""
    own = kin.select("id", F.explode("kin").alias("e")).select("id", "e.*")
    found = merged(own, neighbours(rest, k, queries=pool), k).select("id", (F.col("same") / F.col("of")).alias("pure"), F.col("far").alias("other"))
    known = written(kin.select("id", "same", "cluster").join(found, "id", "left").withColumn("margin", F.col("other") - F.col("same")))
    known = known.join(known.groupBy("cluster").agg(F.avg("margin").alias("mean")), "cluster")
    inland = F.col("other").isNull() | ((F.col("pure") >= 0.75) & (F.col("margin") > 0) & (F.col("mean") >= 0))
    trapped = (F.col("pure") <= 0.25) | (F.col("margin") <= 0) | ((F.col("mean") < 0) & (F.col("pure") < 0.5))
    return written(known.select("id", F.when(inland, INLAND).when(trapped, TRAPPED).otherwise(BORDER).alias("group"), "other"))


def apart(a: str, b: str) -> Column:
    """The distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, z: (x - z) * (x - z)), F.lit(0.0), lambda s, d: s + d))


def bounded(seed_x: str, x: str, other: str) -> Column:
    """x, drawn back toward its seed to 0.95 of the way to the nearest of the rest."""
    far = apart(x, seed_x)
    bound = F.greatest(F.col(other) * 0.95, F.lit(1e-12))
    return F.when(far > bound, F.zip_with(seed_x, x, lambda s, p: s + (p - s) / far * bound)).otherwise(F.col(x))


def nearer(asked: DataFrame, pool: DataFrame, rest: DataFrame, margin: float) -> DataFrame:
    """The rows of asked that are nearer to the pool than to the rest by the margin. reach: how far a row's seed, one of the pool, is; other:
    how far the rest is from the seed. The rest is farther from the row than other - reach, which often says enough before a search."""
    sure = lambda near: F.col("other") - F.col("reach") > margin * F.col(near) * (1 + 1e-9) + 1e-9 * F.col("other")
    unsure = asked.where(~sure("reach"))
    unsure = written(unsure.join(neighbours(pool, 1, queries=unsure).select("id", F.col("dist").alias("near")), "id"))
    left = unsure.where(~sure("near"))
    far = neighbours(rest, 1, queries=left).select("id", F.col("dist").alias("far"))
    kept = asked.where(sure("reach")).unionByName(unsure.where(sure("near")).drop("near"))
    return kept.unionByName(left.join(far, "id").where(F.col("far") > margin * F.col("near")).drop("near", "far"))


def nromm_resample(rows: DataFrame, k: int = 5, margin: float = 1.05, ratio: int = 20, seed: int = 42) -> DataFrame:
    """Each class against the inland rows of the larger ones: its rows breed by group, points are kept within the seed's boundary and count
    if they are nearer to their class than to the rest by the margin; `ratio` tries a point at most, then plain steps.

    The method at last lets inland rows go to which others are nearer than their own. There are none: by the definition of groups() (and the
    kernel's, and the reference's) an inland row's margin, the distance to others less that to its own, is above 0. So no search is made for
    them."""
    state = written(keyed(rows))
    sizes, kin = by_size(state), {}
    for pos, (label, n) in enumerate(sizes[1:], 1):
        need, pool = sizes[0][1] - n, written(of(state, label))
        if not need:
            continue
        if n == 1:
            state = written(state.unionByName(copies(pool, label, need, seed)))
            continue
        rest = None
        for larger, _ in sizes[:pos]:
            held = of(state, larger)
            kin[larger] = kin_of(held, k) if larger not in kin else kin[larger]  # a class is whole when smaller ones come
            inland = held.join(groups(kin[larger], held, pool, k).where(F.col("group") == INLAND).select("id"), "id", "left_semi")
            part = held if inland.isEmpty() else inland
            rest = part if rest is None else rest.unionByName(part)
        rest = written(rest)
        mine = kin_of(pool, k)
        marked = written(pool.join(groups(mine, pool, rest, k).select("id", "group", "other"), "id"))
        marked = written(marked.join(lists(mine.select("id", F.explode("kin").alias("e")).select("id", "e.*"), pool, "kin"), "id"))
        free, inland = marked.where(F.col("group") != TRAPPED), marked.where(F.col("group") == INLAND)
        free, no_inland = marked if free.isEmpty() else free, inland.isEmpty()
        weights, made, missing, tried, s = {INLAND: 0.5, BORDER: 1.0, TRAPPED: 1.5}, None, need, 0, seed + label
        u = lambda what: uniform(s, F.lit(what), "slot")  # noqa: B023, E731
        while missing and tried < need * ratio + 50:
            # as many as are missing, then as many as the tries so far say; if few count tries double, so that rounds are few
            rate = (need - missing) / tried if tried else 1.0
            m = min(need * ratio + 50 - tried, max(64, math.ceil(1.1 * missing / rate) if rate > 0.25 else max(2 * missing, tried)))
            drawn = weighted_seeds(marked, "group", weights, tried, m, s)
            drawn = with_row(with_row(drawn, free, "from", s, "a"), free, "free", s, "b")
            drawn = drawn.withColumn("c", F.col("b")) if no_inland else with_row(drawn, inland, "inland", s, "c")
            drawn = drawn.withColumn("start", F.when(F.col("group") == TRAPPED, interpolate("features", "a", 0.5 + 0.5 * u("way"))).otherwise(F.col("features")))
            drawn = drawn.withColumn("z", interpolate("start", F.when(F.col("group") == BORDER, F.col("b")).otherwise(F.col("c")), u("z")))
            drawn = drawn.withColumn("to", picked("kin", u("kin"))["x"]).withColumn("step", interpolate("features", "to", u("step")))
            drawn = drawn.withColumn("z", F.zip_with("z", "step", lambda a, b: (a + b) / 2))
            drawn = drawn.withColumn("z", bounded("features", "z", "other"))
            asked = written(drawn.select((-1 - F.col("slot")).alias("id"), F.lit(label).alias("label"), F.col("z").alias("features"), "slot", "other", apart("z", "features").alias("reach")))
            good = nearer(asked, pool, rest, margin).select("id", "slot", "features")
            good = written(sampling.with_place(good, s).where(F.col("place") <= missing).select("slot", "features"))
            tried, missing, made = tried + m, missing - good.count(), good if made is None else made.unionByName(good)
        if missing:
            drawn = weighted_seeds(marked, "group", weights, tried, missing, s).withColumn("to", picked("kin", u("kin"))["x"])
            drawn = drawn.withColumn("z", interpolate("features", "to", u("step")))
            drawn = drawn.select("slot", bounded("features", "z", "other").alias("features"))
            made = drawn if made is None else made.unionByName(drawn)
        state = written(state.unionByName(named(made, label)))
    return state
