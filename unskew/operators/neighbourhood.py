"""Statistics of neighbourhoods and classes that resampling models start from, as plans over neighbour edges.

Edges come from knn.neighbours(); rows are (id, label, features).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import interpolate, min_max, squared_distance, uniform
from ..lineage import checkpointed
from .knn import merged, neighbours
from .ranks import prefix_sums, quantiles


def region_types(edges: DataFrame, k: int = 5) -> DataFrame:
    """label, safe, border, rare, outlier rows by how many of the k neighbours share the class (>= 4/5, >= 2/5, > 0, none)."""
    same = edges.groupBy("id", "label").agg(F.avg((F.col("neighbour_label") == F.col("label")).cast("double")).alias("s"))
    n = lambda c: F.sum(c.cast("long"))
    return same.groupBy("label").agg(
        n(F.col("s") >= 0.8).alias("safe"), n((F.col("s") < 0.8) & (F.col("s") >= 0.4)).alias("border"), n((F.col("s") < 0.4) & (F.col("s") > 0)).alias("rare"), n(F.col("s") == 0).alias("outlier")
    )


def class_similarity(edges: DataFrame) -> DataFrame:
    """a, b, similarity: how often classes stand among each other's neighbours, made symmetric; 1 for a class itself."""
    mix = edges.groupBy(F.col("label").alias("a"), F.col("neighbour_label").alias("b")).agg(F.count("*").alias("n"))
    share = mix.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("a")))
    classes = share.select("a").distinct()
    grid = classes.crossJoin(classes.withColumnRenamed("a", "b"))  # classes, not rows
    there = grid.join(share.select("a", "b", "p"), ["a", "b"], "left").join(share.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("p").alias("q")), ["a", "b"], "left")
    mean = (F.coalesce("p", F.lit(0.0)) + F.coalesce("q", F.lit(0.0))) / 2
    return there.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(mean).alias("similarity"))


def safety(edges: DataFrame) -> DataFrame:
    """id, label, safety: the mean similarity of a row's class to its neighbours' classes."""
    edges = checkpointed(edges)  # read twice
    sim = class_similarity(edges)
    met = edges.join(F.broadcast(sim), (F.col("label") == F.col("a")) & (F.col("neighbour_label") == F.col("b")))  # classes squared
    return met.groupBy("id", "label").agg(F.avg("similarity").alias("safety"))


def drop_least_safe(rows: DataFrame, scores: DataFrame, goal: Column | int) -> DataFrame:
    """Of classes over the goal the rows of most safety (ties: the smaller id); smaller classes whole."""
    from .sampling import with_rank

    ranked = with_rank(rows.join(scores.select("id", "safety"), "id"), -F.col("safety"), "label", out="__r")
    return ranked.where(F.col("__r") <= goal).drop("__r", "safety")


def repeat_safest(rows: DataFrame, scores: DataFrame, goal: int) -> DataFrame:
    """label, id, copies of classes under the goal: rows in the order of safety are copied in turns until it is reached."""
    from .sampling import class_counts, with_rank

    ranked = with_rank(rows.select("id", "label").join(scores.select("id", "safety"), "id"), -F.col("safety"), "label", out="r")
    ranked = ranked.join(F.broadcast(class_counts(rows)), "label").withColumn("r", F.col("r") - 1)
    need = F.greatest(F.lit(goal) - F.col("n"), F.lit(0))
    copies = F.floor(need / F.col("n")) + (F.col("r") < need % F.col("n")).cast("long")
    return ranked.select("label", "id", copies.cast("long").alias("copies")).where("copies > 0")


def roulette_delete(rows: DataFrame, safe: DataFrame, goal: int, seed: int = 42) -> DataFrame:
    """Of classes over the goal, rows are drawn away without replacement by weight 1 - safe; label, id of what stays."""
    key = F.ln(F.greatest(uniform(seed, "id"), F.lit(1e-12))) / (1 - F.col("safe") + 1e-6)
    from .sampling import with_rank

    # the races' losers stay
    ranked = with_rank(rows.select("id", "label").join(safe.select("id", "safe"), "id"), key, "label", out="__r")
    return ranked.where(F.col("__r") <= goal).select("id", "label")


def did(edges: DataFrame) -> DataFrame:
    """id, label, did, hard: mean distance to other neighbours over mean distance to same ones; hard if under its class's mean."""
    same = F.col("neighbour_label") == F.col("label")
    each = edges.groupBy("id", "label").agg(F.avg(F.when(same, F.col("dist"))).alias("s"), F.avg(F.when(~same, F.col("dist"))).alias("o"))
    each = each.withColumn("did", F.coalesce("o", F.lit(0.0)) / F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(1e-12)))
    each = checkpointed(each)
    mean = each.groupBy("label").agg(F.avg("did").alias("__mean"))  # a row a class
    return each.join(F.broadcast(mean), "label").select("id", "label", "did", (F.col("did") < F.col("__mean")).alias("hard"))


def largest_remainder(weights: DataFrame, total: int, key: str = "id", weight: str = "weight", *partition: str) -> DataFrame:
    """key, quota: total shared out by weight within each partition; ties of remainders go to the smaller key."""
    from .sampling import with_rank

    sums = weights.groupBy(*partition).agg(F.sum(weight).alias("__sum"))
    met = lambda df, more: df.join(F.broadcast(more), list(partition)) if partition else df.crossJoin(F.broadcast(more))
    shared = met(weights, sums).withColumn("__share", F.col(weight) / F.col("__sum") * total).withColumn("__low", F.floor("__share"))
    placed = checkpointed(with_rank(shared, F.col("__low") - F.col("__share"), *partition, id_col=key, out="__place"))
    left = placed.groupBy(*partition).agg((F.lit(total) - F.sum("__low")).alias("__left"))
    return met(placed, left).select(*partition, key, (F.col("__low") + (F.col("__place") <= F.col("__left")).cast("long")).alias("quota"))


def density_clipped(scores: DataFrame, value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """value scaled to [0, 1] between two percentiles, clipped."""
    bounds = quantiles(scores, value, {"__lo": low, "__hi": high})
    x = F.least(F.greatest(F.col(value), F.col("__lo")), F.col("__hi"))
    return scores.crossJoin(F.broadcast(bounds)).withColumn("scaled", min_max(x, F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def centroids(rows: DataFrame) -> DataFrame:
    """label, centre: the mean of each class, dimension by dimension."""
    long = rows.select("label", F.posexplode("features").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))


def _to_centres(rows: DataFrame) -> DataFrame:
    """id, label, distances: squared distances to all class centres, in the order of labels."""
    listed = centroids(rows).groupBy().agg(F.array_sort(F.collect_list(F.struct("label", "centre"))).alias("cs"))
    return rows.crossJoin(F.broadcast(listed)).select("id", "label", F.transform("cs", lambda c: squared_distance("features", c["centre"])).alias("d2"))


def nearest_centroid(rows: DataFrame) -> DataFrame:
    """id, y, yhat, proba: a softmax over negative squared distances to class centres; labels are 0 to C - 1."""
    low = _to_centres(rows).withColumn("e", F.transform("d2", lambda d: F.exp(F.array_min("d2") - d)))
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    scored = low.select("id", F.col("label").alias("y"), F.transform("e", lambda x: x / total).alias("proba"), (F.array_position("d2", F.array_min("d2")) - 1).cast("int").alias("yhat"))
    return scored.select("id", "y", "yhat", "proba")


def membership_entropy(rows: DataFrame) -> DataFrame:
    """id, label, entropy of fuzzy memberships by inverse squared distance to class centres, overlap: over mean + deviation."""
    u = _to_centres(rows).withColumn("w", F.transform("d2", lambda d: 1 / F.greatest(d, F.lit(1e-24))))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    u = u.withColumn("u", F.transform("w", lambda x: x / total))
    u = u.withColumn("entropy", -F.aggregate("u", F.lit(0.0), lambda s, x: s + x * F.ln(F.greatest(x, F.lit(1e-12)))))
    bar = u.agg((F.avg("entropy") + F.stddev_pop("entropy")).alias("bar"))
    return u.crossJoin(F.broadcast(bar)).select("id", "label", "entropy", (F.col("entropy") > F.col("bar")).alias("overlap"))


def midpoint_weights(rows: DataFrame, label: int, k: int = 5, pairs: DataFrame | None = None) -> DataFrame:
    """id, neighbour, pure: of each pair of a class's rows that are near, the share of the class among the k nearest of the midpoint. pairs: id,
    neighbour of those that are asked for (default: all)."""
    own = rows.where(F.col("label") == label)
    pairs = neighbours(own, k).select("id", "neighbour") if pairs is None else pairs
    a, b = own.select("id", F.col("features").alias("x")), own.select(F.col("id").alias("neighbour"), F.col("features").alias("z"))
    mids = pairs.join(a, "id").join(b, "neighbour").select("id", "neighbour", interpolate("x", "z", F.lit(0.5)).alias("features"))
    # midpoints ask with negative ids of their own, so that no row is left out as itself
    asked = mids.withColumn("pair", -1 - F.xxhash64("id", "neighbour").bitwiseAND(F.lit((1 << 62) - 1)))
    near = neighbours(rows, k, queries=asked.select(F.col("pair").alias("id"), F.lit(label).alias("label"), "features"))
    pure = near.groupBy(F.col("id").alias("pair")).agg(F.avg((F.col("neighbour_label") == label).cast("double")).alias("pure"))
    return asked.join(pure, "pair").select("id", "neighbour", "pure")


def own_and_others(rows: DataFrame, label: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The k nearest of a class's rows among their class, and among the others."""
    own = rows.where(F.col("label") == label)
    return checkpointed(neighbours(own, k)), checkpointed(neighbours(rows.where(F.col("label") != label), k, queries=own))


def trust(rows: DataFrame, label: int, k: int = 5, near: DataFrame | None = None) -> DataFrame:
    """id, trust of a class's rows: 0.4 of support, 0.3 of density and 0.3 of isolation from others, the latter two to [0, 1]. near: merged()
    of own_and_others(), if it is known."""
    near = merged(*own_and_others(rows, label, k), k) if near is None else near
    joined = near.where("far IS NOT NULL AND mean IS NOT NULL").select("id", (F.col("same") / F.col("of")).alias("support"), (1 / F.greatest("mean", F.lit(1e-12))).alias("density"), F.col("far").alias("isolation"))
    b = joined.agg(*[f(c).alias(f"{n}_{c}") for c in ("density", "isolation") for n, f in (("lo", F.min), ("hi", F.max))])
    part = lambda c: min_max(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    return joined.crossJoin(F.broadcast(b)).select("id", (0.4 * F.col("support") + 0.3 * part("density") + 0.3 * part("isolation")).alias("trust"))


def border_rows(rows: DataFrame, label: int, against: int, k: int = 5, spread: int = 2) -> DataFrame:
    """id, label of both classes' rows with at least k / spread (rounded up) but not all k neighbours of the other class."""
    both = rows.where(F.col("label").isin(label, against))
    other = neighbours(both, k).groupBy("id", "label").agg(F.sum((F.col("neighbour_label") != F.col("label")).cast("long")).alias("o"))
    return other.where((F.col("o") >= -(-k // spread)) & (F.col("o") < k)).select("id", "label")


def class_covariance(rows: DataFrame) -> DataFrame:
    """label, i, j, cov: sample covariances of each class for j <= i, from one sum of products a task and class.

    Tasks give sums of centred products (64 dimensions: 2,080 numbers a class), which meet by class and cell.
    """
    import numpy as np
    import pandas as pd

    means = centroids(rows)

    def products(dfs):
        sums: dict = {}
        for df in dfs:
            for label, part in df.groupby("label"):
                x = np.stack(part["features"].to_numpy()) - np.stack(part["centre"].to_numpy())
                got = x.T @ x
                n, held = sums.get(label, (0, 0.0))
                sums[label] = n + len(x), held + got
        for label, (n, held) in sums.items():
            i, j = np.tril_indices(len(held))
            yield pd.DataFrame({"label": label, "i": i, "j": j, "n": n, "s": held[i, j]})

    kind = dict(rows.dtypes)["label"]
    centred = rows.select("label", "features").join(F.broadcast(means), "label")  # a centre a class
    summed = centred.mapInPandas(products, f"label {kind}, i int, j int, n long, s double").groupBy("label", "i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return summed.select("label", "i", "j", F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)).alias("cov"))


def between_class_scatter(rows: DataFrame) -> DataFrame:
    """i, j, scatter for j <= i: the sum over classes of n_c (mean_c - mean)(mean_c - mean)^T, from means alone."""
    long = rows.select("label", F.posexplode("features").alias("i", "x"))
    means = long.groupBy("label", "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"))  # classes times dimensions
    whole = means.groupBy("i").agg((F.sum("s") / F.sum("n")).alias("mean"))
    apart = means.join(F.broadcast(whole), "i").select("label", "i", "n", (F.col("s") / F.col("n") - F.col("mean")).alias("d"))
    other = apart.select("label", F.col("i").alias("j"), F.col("d").alias("e"))
    return apart.join(other, "label").where("j <= i").groupBy("i", "j").agg(F.sum(F.col("n") * F.col("d") * F.col("e")).alias("scatter"))


def best_split(rows: DataFrame, value: str, label: str, classes: int) -> DataFrame:
    """threshold, gini: the cut of one feature with the least weighted Gini impurity, from cumulative counts by value.

    Values are counted first, and counts run up by slices of the values."""
    counts = [F.sum((F.col(label) == c).cast("long")).alias(f"c{c}") for c in range(classes)]
    by_value = rows.groupBy(F.col(value).alias("v")).agg(*counts)
    run = prefix_sums(by_value, [f"c{c}" for c in range(classes)], "v")
    w = run.select("v", "next", *[F.col(f"upto_c{c}").alias(f"l{c}") for c in range(classes)], *[F.col(f"all_c{c}").alias(f"t{c}") for c in range(classes)])
    left = [F.col(f"l{c}").cast("double") for c in range(classes)]
    right = [F.col(f"t{c}") - F.col(f"l{c}") for c in range(classes)]

    def impurity(parts):
        n = sum(parts[1:], parts[0])
        return n - sum((p * p for p in parts[1:]), parts[0] * parts[0]) / n

    total = sum((F.col(f"t{c}") for c in range(1, classes)), F.col("t0"))
    cut = w.where("next is not null").select(((F.col("v") + F.col("next")) / 2).alias("threshold"), ((impurity(left) + impurity(right)) / total).alias("gini"))
    return cut.orderBy("gini", "threshold").limit(1)


def balanced_sets(rows: DataFrame, seed: int = 42) -> DataFrame:
    """set, id, label: for each class a set in which no class has more rows than it (larger ones cut by hash)."""
    from .sampling import class_counts, with_place

    goals = class_counts(rows).select(F.col("label").alias("set"), F.col("n").alias("goal"))
    return with_place(rows.select("id", "label"), seed, "label").crossJoin(F.broadcast(goals)).where("place <= goal").select("set", "id", "label")


def sphere_oversample(rows: DataFrame, label: int, n: int, k: int = 5, seed: int = 42) -> DataFrame:
    """id (negative), label, features: n points, each even in the ball around a seed row that reaches to its k-th row of other
    classes (without such rows, as far as the median distance to the nearest row of the class, 1 for a single row); directions are
    normal draws by Box and Muller from hashes."""
    from .knn import cross_class_distance, median_distance
    from .sampling import with_place

    own = with_place(rows.where(F.col("label") == label), seed, "label")
    size = own.agg(F.count("*").alias("__size"))
    radius = cross_class_distance(rows, label, k)
    alone = rows.where(F.col("label") != label).isEmpty()
    spare = ([r["median_dist"] for r in median_distance(own).collect()] if alone else None) or [1.0]  # a class
    slots = rows.sparkSession.range(n).crossJoin(F.broadcast(size)).select(F.col("id").alias("slot"), (F.floor(uniform(seed, F.lit("seed"), "id") * F.col("__size")) + 1).alias("place"))
    drawn = slots.join(own, "place").join(radius, "id")
    normal = F.transform("features", lambda x, i: F.sqrt(-2 * F.ln(F.greatest(uniform(seed, F.lit("r"), F.col("slot"), i), F.lit(1e-12)))) * F.cos(2 * F.pi() * uniform(seed, F.lit("a"), F.col("slot"), i)))
    drawn = drawn.withColumn("way", normal).withColumn("norm", F.sqrt(F.aggregate("way", F.lit(0.0), lambda s, x: s + x * x)))
    reach = F.coalesce("dist", F.lit(spare[0])) * F.pow(uniform(seed, F.lit("reach"), "slot"), 1.0 / F.size("features"))
    made = F.zip_with("features", "way", lambda x, w: x + w / F.col("norm") * reach)
    return drawn.select((-1 - F.col("slot")).alias("id"), "label", made.alias("features"))


def orem_generate(rows: DataFrame, label: int, n: int, stop: int = 5, reach: int = 50, seed: int = 42) -> DataFrame:
    """id (negative), label, features: n points of a class, its rows as seeds in turns, each toward a hashed row of its clean
    region, dimension by dimension; at most half the way toward other classes."""
    from ..functions.vectors import interpolate_each
    from .knn import candidate_region, clean_directions
    from .sampling import with_place

    own = with_place(rows.where(F.col("label") == label), seed, "label")
    region = clean_directions(candidate_region(rows, stop, reach, own), rows)
    ways = region.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "neighbour_label"))).alias("ways"))
    size = own.agg(F.count("*").alias("__size"))
    slots = rows.sparkSession.range(n).crossJoin(F.broadcast(size)).select(F.col("id").alias("slot"), (F.col("id") % F.col("__size") + 1).alias("place"))
    drawn = slots.join(own, "place").join(ways, "id", "left")
    pick = F.get("ways", F.floor(uniform(seed, F.lit("way"), "slot") * F.size("ways")).cast("int"))
    drawn = drawn.withColumn("w", F.when(F.size("ways") > 0, pick))
    drawn = drawn.join(rows.select(F.col("id").alias("__to"), F.col("features").alias("to")), F.col("w.neighbour") == F.col("__to"), "left")
    drawn = drawn.withColumn("gaps", F.transform("features", lambda x, i: uniform(seed, F.lit("gap"), F.col("slot"), i)))
    made = interpolate_each("features", F.coalesce("to", "features"), "gaps", F.coalesce(F.col("w.neighbour_label") != F.col("label"), F.lit(False)))
    return drawn.select((-1 - F.col("slot")).alias("id"), "label", made.alias("features"))
