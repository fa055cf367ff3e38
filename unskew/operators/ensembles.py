"""Heads and ensembles that take a whole table: base learners are distributed trees, what goes on between them is a plan.

The self-paced ensemble cuts features into bins once and keeps a byte a feature and the sum of its members' probabilities of each row;
a round draws its sample by hardness bins, grows a forest on it (forest.py) and adds that forest's probabilities, each once, and
checkpoints them: its cost does not depend on the rounds before. Boosting keeps weights and votes as columns over pyspark.ml's stumps.
State is checkpointed every round, so that a lost executor costs a round at most and plans stay short. To the driver come models
(bounded by their trees and depth) and sums.

Rows: id, label (0 .. classes - 1), features (array<double>, finite). An empty table raises ValueError.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import argmax, hardness, softmax, uniform
from ..lineage import checkpointed
from . import forest, sampling
from .knn import inverse_density

TREES, DEPTH, BINS, ROUNDS, EVERY = 30, 12, 64, 30, 5


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__x", array_to_vector("features"))


def _classes(rows: DataFrame) -> int:
    most = rows.agg(F.max("label")).first()[0]
    if most is None:
        raise ValueError("no rows to fit on")
    return int(most) + 1


def fit_stump(rows: DataFrame, weight: str, seed: int = 42, depth: int = 1):
    head = DecisionTreeClassifier(featuresCol="__x", labelCol="label", maxDepth=depth, maxBins=BINS, weightCol=weight, seed=seed, minInstancesPerNode=1)
    return head.fit(_vectors(rows))


def with_proba(rows: DataFrame, model, classes: int, out: str = "proba") -> DataFrame:
    """rows with the model's probabilities, 0 for classes it never saw."""
    scored = model.transform(_vectors(rows)).withColumn(out, vector_to_array("probability"))
    padded = F.when(F.size(out) < classes, F.concat(out, F.array_repeat(F.lit(0.0), F.lit(classes) - F.size(out)))).otherwise(F.col(out))
    return scored.withColumn(out, padded).select(*[c for c in rows.columns if c != out], out)


# -- self-paced ensemble -----------------------------------------------------------------------------------------------


def hardness_bins(rows: DataFrame, h: str, round_: int, rounds: int, target: int, bins: int = 20) -> DataFrame:
    """label, bin, have, take: how many rows of each class's hardness bin (bins of [0, 1]) a round takes. A bin weighs 1 / (mean
    hardness + tan(pi i / 2 (n - 1))) and gives what it holds at most; what lacks goes to the heaviest bins, a row a bin and turn; a class of at
    most `target` rows gives all."""
    alpha = math.tan(math.pi * round_ / (2 * max(1, rounds - 1)))
    each = Window.partitionBy("label")  # over bins, not rows
    at = F.least(F.floor(F.col(h) * bins), F.lit(bins - 1)).cast("int")
    stats = rows.groupBy("label", at.alias("bin")).agg(F.avg(h).alias("h"), F.count("*").alias("have"))
    stats = stats.withColumn("w", 1 / (F.col("h") + alpha)).withColumn("w", F.col("w") / (F.sum("w").over(each) + 1e-12)).withColumn("n", F.sum("have").over(each))
    stats = stats.withColumn("first", F.least("have", F.floor(F.col("w") * target)))
    stats = stats.withColumn("lack", F.least(F.lit(target), F.col("n")) - F.sum("first").over(each)).withColumn("spare", F.col("have") - F.col("first"))
    # turn t gives a row to each bin that has more than t spare rows, heaviest first: whole turns by their sums, the last one by rank
    # the bins of a class in the order in which they run out of spare rows
    out = Window.partitionBy("label").orderBy("spare", "bin")
    stats = stats.withColumn("left", F.count("*").over(each) - F.row_number().over(out) + 1)
    rise = F.col("spare") - F.coalesce(F.lag("spare").over(out), F.lit(0))
    stats = stats.withColumn("until", F.sum(rise * F.col("left")).over(out.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rise", rise)
    # rows given before this bin's spare level is reached, and the whole turns that `lack` pays for
    before = F.col("until") - F.col("rise") * F.col("left")
    turns = F.when(F.col("until") <= F.col("lack"), F.col("rise")).when(before < F.col("lack"), F.floor((F.col("lack") - before) / F.col("left"))).otherwise(0)
    stats = stats.withColumn("turns", F.sum(turns).over(each)).withColumn("given", F.least("spare", "turns"))
    stats = stats.withColumn("rest", F.col("lack") - F.sum("given").over(each))
    more = F.row_number().over(Window.partitionBy("label").orderBy((F.col("spare") > F.col("given")).desc(), F.desc("w"), "bin")) <= F.col("rest")
    take = F.when(F.col("n") <= target, F.col("have")).otherwise(F.col("first") + F.col("given") + (more & (F.col("spare") > F.col("given"))).cast("long"))
    return stats.select("label", "bin", "have", take.alias("take"))


def paced_sample(rows: DataFrame, h: str, round_: int, rounds: int, target: int, bins: int = 20, seed: int = 42) -> DataFrame:
    """The rows of a round's sample: of each hardness bin what hardness_bins() gives it, by hash."""
    binned = rows.withColumn("bin", F.least(F.floor(F.col(h) * bins), F.lit(bins - 1)).cast("int"))
    take = hardness_bins(rows, h, round_, rounds, target, bins).select("label", "bin", "take")  # bins times classes rows
    dealt = sampling.with_place(binned, seed + round_, "label", "bin", out="__r")
    return dealt.join(F.broadcast(take), ["label", "bin"]).where("__r <= take").select(*rows.columns)


def sample_with_replacement(rows: DataFrame, wanted: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """rows drawn with replacement: of each group (keys) as many as wanted (keys, n) says, each draw one even hash; with draw
    (from 0). Groups without rows give none."""
    placed = sampling.with_place(rows, seed, *keys, out="__place")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__have"))
    slots = wanted.join(sizes, keys).where("n > 0").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)))
    slots = slots.withColumn("__place", F.least(F.floor(uniform(seed, *keys, "draw") * F.col("__have")) + 1, F.col("__have")))
    return slots.select(*keys, "draw", "__place").join(placed, [*keys, "__place"]).select(*rows.columns, "draw")


def _leaves(models: list[forest.Trees], votes: list[float], bins: np.ndarray) -> np.ndarray:
    """The sum of the forests' mean class shares, each times its vote."""
    out = np.zeros((len(bins), models[0].classes))
    for m, v in zip(models, votes, strict=True):
        shares, roots = m.shares(), np.arange(m.roots)
        for start in range(0, len(bins), step := max(1, forest.CELLS // m.roots)):
            part = slice(start, start + step)
            out[part] += v * shares[m.nodes(bins[part], roots)].mean(1)
    return out


@dataclass
class Ensemble:
    """Forests over one set of cuts."""

    models: list[forest.Trees]
    votes: list[float]
    classes: int

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with proba, the (weighted) mean of the forests' probabilities, in one pass."""
        sent = rows.sparkSession.sparkContext.broadcast((self.models, [v / sum(self.votes) for v in self.votes]))
        kept = [f for f in rows.schema.fields if f.name != "proba"]

        def run(batches):
            models, votes = sent.value
            for b in batches:
                bins = models[0].bins(forest.matrix(b["features"])) if len(b) else np.zeros((0, 0), np.uint8)
                yield pa.RecordBatch.from_arrays([*b.columns, forest.lists(_leaves(models, votes, bins))], [*b.schema.names, "proba"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
        return rows.select(*[f.name for f in kept]).mapInArrow(run, f"{schema}, proba array<double>")


def _added(state: DataFrame, model: forest.Trees) -> DataFrame:
    """state, its totals with a further forest's probabilities, computed once."""
    sent = state.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            if len(b):
                total = forest.matrix(b["total"]) + _leaves([sent.value], [1.0], forest.packed(b["bins"]))
                yield pa.RecordBatch.from_arrays([b[c] for c in ("id", "label", "fold", "bins")] + [forest.lists(total)], ["id", "label", "fold", "bins", "total"])

    out = checkpointed(state.mapInArrow(run, "id long, label int, fold int, bins binary, total array<double>"))
    sent.unpersist()
    return out


def fit_self_paced(rows: DataFrame, rounds: int = ROUNDS, trees: int = TREES, bins: int = 20, kind: str = "absolute", seed: int = 42, depth: int = DEPTH) -> Ensemble:
    """Forests on balanced samples that move from easy rows to evenly hard ones."""
    sizes = sampling.class_counts(rows).collect()  # a row a class
    if not sizes:
        raise ValueError("no rows to fit on")
    classes, target, n = max(r["label"] for r in sizes) + 1, min(r["n"] for r in sizes), sum(r["n"] for r in sizes)
    cuts = forest.cut_points(rows, BINS)
    ready = forest.prepared(rows.select("id", "label", "features"), cuts, forest.few_tasks(rows.sparkSession, n))
    models, state = [], ready.withColumn("total", F.array_repeat(F.lit(0.0), classes))
    tasks = forest.few_tasks(rows.sparkSession, target * len(sizes))
    for i in range(rounds):
        if i:
            h = hardness(F.get("total", F.col("label")) / float(i), kind)
            if kind == "entropy":  # over its largest value
                h = h / (state.agg(F.max(h)).first()[0] + 1e-12)
            known = state.select("id", "label", "fold", "bins", F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0)).alias("h"))
            sample = paced_sample(known, "h", i, rounds, target, bins, seed)
        else:
            sample = sampling.random_balance(ready, seed)
        sample = checkpointed(forest.spread(sample.select("id", "label", "fold", "bins"), tasks))
        models.append(forest.grow_gini(sample, cuts, classes, tasks, trees, depth, seed + i))
        if i + 1 < rounds:
            state = _added(state, models[-1])
    return Ensemble(models, [1.0] * rounds, classes)


# -- boosting with adaptive margins --------------------------------------------------------------------------------------


def margin_state(rows: DataFrame, k: int = 5) -> DataFrame:
    """id, label, features, gamma (class size over the smallest), density (inverse, within the class), w (even), votes (zeros)."""
    rows = checkpointed(rows.select("id", "label", "features"))
    classes, n = _classes(rows), rows.count()
    sizes = sampling.class_counts(rows)
    gamma = sizes.crossJoin(F.broadcast(sizes.agg(F.min("n").alias("__least")))).select("label", (F.col("n") / F.col("__least")).alias("gamma"))
    out = rows.join(F.broadcast(gamma), "label").join(inverse_density(rows, k).select("id", "density"), "id")  # gamma: a row a class
    return checkpointed(out.select("id", "label", "features", "gamma", "density", F.lit(1.0 / n).alias("w"), F.array_repeat(F.lit(0.0), classes).alias("votes")))


def _voted(votes: str, said: str, vote: float) -> Column:
    return F.transform(votes, lambda x, i: x + F.when(i == F.col(said), F.lit(vote)).otherwise(0.0))


def margin_round(state: DataFrame, said: Column) -> tuple[DataFrame, float]:
    """(state after a round whose learner said `said`, the learner's vote): votes grow by the log odds of its weight right against wrong,
    and weights shrink with the margin of the softmax of votes, the more the larger and the sparser a row's class is."""
    state = state.withColumn("__said", said)
    hit = F.col("__said") == F.col("label")
    got = state.agg(F.sum(F.when(hit, F.col("w"))).alias("right"), F.sum(F.when(~hit, F.col("w"))).alias("wrong")).first()
    beta = math.log(max(got["right"] or 0.0, 1e-10) / max(got["wrong"] or 0.0, 1e-10))
    state = state.withColumn("votes", _voted("votes", "__said", beta))
    p = softmax("votes")
    own = F.get(p, F.col("label"))
    other = F.array_max(F.transform(p, lambda x, i: F.when(i != F.col("label"), x).otherwise(F.lit(float("-inf")))))
    w = F.exp(-F.col("gamma") * F.col("density") * (own - other + 1.0)) * F.col("w") * F.exp(-F.lit(beta) * hit.cast("double"))
    state = checkpointed(state.withColumn("w", w).drop("__said"))
    total = state.agg(F.sum("w")).first()[0]
    return state.withColumn("w", F.col("w") / F.lit(total)), beta


@dataclass
class Boosted:
    models: list
    votes: list[float]
    classes: int

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with proba: the softmax of the learners' votes."""
        state = rows.withColumn("__votes", F.array_repeat(F.lit(0.0), self.classes))
        for i, (m, v) in enumerate(zip(self.models, self.votes, strict=True)):
            state = with_proba(state, m, self.classes, "__p")
            state = state.withColumn("__said", argmax("__p")).withColumn("__votes", _voted("__votes", "__said", v)).drop("__p", "__said")
            state = checkpointed(state) if i % EVERY == EVERY - 1 else state
        return state.withColumn("proba", softmax("__votes")).drop("__votes")


def fit_margin_boost(rows: DataFrame, rounds: int = 50, k: int = 5, seed: int = 42) -> tuple[Boosted, DataFrame]:
    """(the ensemble, the last state): stumps boosted by adaptive margins. It ends early once a stump is wrong on no weight."""
    state, models, votes = margin_state(rows, k), [], []
    classes = _classes(state)
    for _ in range(rounds):
        model = fit_stump(state, "w", seed)
        state, beta = margin_round(with_proba(state, model, classes, "__p"), argmax("__p"))
        state = state.drop("__p")
        models.append(model)
        votes.append(beta)
    return Boosted(models, votes, classes), state
