"""Random-layer machines by Gram sums, and an ensemble of them chosen by local competence.

A machine's hidden layer is random and fixed, H = sigmoid(X W + b), so that its output weights solve (H'H + reg I) beta = H'Y.
H'H and H'Y are sums over rows: tasks add up their blocks and pass them on by rows of the matrix, which are added in two steps
(first among about the root of all tasks), STRIP rows of the matrix at a time. A task holds one such matrix, and one solve of
hidden x hidden numbers is left to the driver, whatever the number of rows.

The ensemble has a machine for each class, on a table in which every class has that class's number of rows: larger classes are cut by
hash, smaller ones filled between near rows. A row's machines vote by how well each does on the nearest rows of a part that
none was fitted on.

Rows: id (long), label (0 .. classes - 1), features (array<double>, finite). An empty table raises ValueError.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import interpolate, uniform
from ..lineage import checkpointed
from . import sampling
from .forest import matrix
from .knn import neighbours

#: STEP: rows whose hidden layer a task holds at once, whatever the batch.
HIDDEN, REG, STRIP, STEP = 2000, 0.01, 64, 512


@dataclass
class Machine:
    w: np.ndarray
    b: np.ndarray
    classes: int
    beta: np.ndarray | None = None

    def hidden(self, x: np.ndarray) -> np.ndarray:
        h = x @ self.w
        h += self.b
        np.exp(np.negative(np.clip(h, -40, 40, out=h), out=h), out=h)
        h += 1
        return np.divide(1, h, out=h)

    def proba(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.hidden(x[at : at + STEP]) @ self.beta for at in range(0, max(len(x), 1), STEP)])
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def random_layer(dims: int, classes: int, hidden: int = HIDDEN, seed: int = 42) -> Machine:
    rng = np.random.default_rng(seed)
    return Machine(rng.normal(size=(dims, hidden)), rng.normal(size=hidden), classes)


def added(parts: DataFrame, n: int) -> DataFrame:
    """key, part (0), sums (doubles as bytes): strips of one key and part added up, one key at a time."""

    def run(batches):
        at, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["key", "part", "sums"])
        for b in batches:
            for key, part, blob in zip(b["key"].to_pylist(), b["part"].to_pylist(), b["sums"], strict=True):
                got = np.frombuffer(blob.as_py())
                if (key, part) == at:
                    total += got
                else:
                    if at is not None:
                        yield out()
                    at, total = (key, part), got.copy()
        if at is not None:
            yield out()

    return parts.repartition(n, "key", "part").sortWithinPartitions("key", "part").mapInArrow(run, "key int, part int, sums binary")


def gram(rows: DataFrame, machine: Machine) -> tuple[np.ndarray, np.ndarray]:
    """(H'H, H'Y) over all rows."""
    sent = rows.sparkSession.sparkContext.broadcast(machine)
    hidden, classes = machine.w.shape[1], machine.classes
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, int(tasks**0.5))

    def run(batches):
        from pyspark import TaskContext

        held, m = np.zeros((hidden, hidden + classes)), sent.value
        for b in batches:
            x, y = matrix(b["features"]), b["label"].to_numpy()
            for start in range(0, len(x), STEP):
                h = m.hidden(x[start : start + STEP])
                # by strips, so that the product takes no second matrix
                for at in range(0, hidden, 8 * STRIP):
                    held[at : at + 8 * STRIP, :hidden] += h[:, at : at + 8 * STRIP].T @ h
                for c in range(classes):
                    held[:, hidden + c] += h[y[start : start + STEP] == c].sum(0)
        part = TaskContext.get().partitionId() % groups
        for key, start in enumerate(range(0, hidden, STRIP)):
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([part], pa.int32()), pa.array([held[start : start + STRIP].tobytes()], pa.binary())], ["key", "part", "sums"])

    parts = rows.select("label", "features").mapInArrow(run, "key int, part int, sums binary")
    once = added(added(parts, tasks), max(1, min(tasks, -(-hidden // STRIP))))
    whole = np.zeros((hidden, hidden + classes))
    for r in once.collect():  # the matrix
        start = r["key"] * STRIP
        whole[start : start + STRIP] = np.frombuffer(r["sums"]).reshape(-1, hidden + classes)
    return whole[:, :hidden], whole[:, hidden:]


def fit_machine(rows: DataFrame, classes: int, hidden: int = HIDDEN, reg: float = REG, seed: int = 42) -> Machine:
    first = rows.select(F.size("features").alias("d")).first()
    if first is None:
        raise ValueError("no rows to fit on")
    machine = random_layer(first["d"], classes, hidden, seed)
    a, b = gram(rows, machine)
    machine.beta = np.linalg.solve(a + reg * np.eye(hidden), b)
    return machine


def with_probas(rows: DataFrame, machines: list[Machine], out: str = "probas") -> DataFrame:
    """rows with each machine's class vector, one after the other."""
    sent = rows.sparkSession.sparkContext.broadcast(machines)
    kept = [f for f in rows.schema.fields if f.name != out]

    def run(batches):
        for b in batches:
            x = matrix(b["features"])
            p = np.hstack([m.proba(x) for m in sent.value]) if len(x) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(p), pa.list_(pa.float64()))], [*b.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.select(*[f.name for f in kept]).mapInArrow(run, f"{schema}, {out} array<double>")


def even_set(rows: DataFrame, near: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """id, label, features with `target` rows a class: larger classes are cut by hash; smaller ones get rows between a hashed
    row and one of its nearest of the class, copies where a class has one row. near: id, rank, neighbour within classes."""
    placed = checkpointed(sampling.with_place(rows.select("id", "label", "features"), seed, "label"))
    counts = sampling.class_counts(rows).where(F.col("n") < target)
    slots = counts.select("label", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(target) - F.col("n") - 1)).alias("slot"))
    drawn = slots.withColumn("place", F.least(F.floor(uniform(seed, "label", "slot", F.lit("seed")) * F.col("n")) + 1, F.col("n")))
    drawn = drawn.join(placed, ["label", "place"])
    have = near.groupBy("id").agg(F.max("rank").alias("have"))
    drawn = drawn.join(have, "id", "left").withColumn("rank", (F.floor(uniform(seed, "label", "slot", F.lit("near")) * F.col("have")) + 1).cast("int"))
    drawn = drawn.join(near.select("id", "rank", "neighbour"), ["id", "rank"], "left")
    drawn = drawn.join(rows.select(F.col("id").alias("neighbour"), F.col("features").alias("to")), "neighbour", "left")
    made = interpolate("features", F.coalesce("to", "features"), uniform(seed, "label", "slot", F.lit("gap")))
    number = -(F.col("label").cast("long") * (1 << 40) + F.col("slot") + 1)
    return placed.where(F.col("place") <= target).select("id", "label", "features").unionByName(drawn.select(number.alias("id"), "label", made.alias("features")))


@dataclass
class Council:
    machines: list[Machine]
    checked: DataFrame  # id (negative), label, features, right: whether each machine names the row's class
    k: int
    classes: int

    def predict(self, rows: DataFrame) -> DataFrame:
        """id, proba: the machines' vectors weighted by inverse distance to those of the k nearest checked rows that they get right,
        over machines at least as right there as their mean."""
        rows = rows.select(F.col("id").cast("long").alias("id"), F.lit(0).alias("label"), "features")
        near = neighbours(self.checked, self.k, queries=rows).join(self.checked.select(F.col("id").alias("neighbour"), "right"), "neighbour")
        hits = near.select("id", "dist", F.posexplode("right").alias("m", "hit"))
        by = hits.groupBy("id", "m").agg(F.avg(F.col("hit").cast("double")).alias("acc"), F.sum(F.when(F.col("hit"), 1 / F.greatest("dist", F.lit(1e-12))).otherwise(0.0)).alias("alpha"))
        by = by.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("m", "acc", "alpha"))).alias("ms"))  # a struct a machine
        mean = F.aggregate("ms", F.lit(0.0), lambda s, x: s + x["acc"]) / F.size("ms")
        by = by.withColumn("mean", mean).withColumn("alpha", F.transform("ms", lambda x: F.when(x["acc"] >= F.col("mean") - 1e-12, x["alpha"]).otherwise(0.0)))
        total = F.aggregate("alpha", F.lit(0.0), lambda s, x: s + x)
        by = by.select("id", F.when(total > 0, F.col("alpha")).otherwise(F.transform("alpha", lambda x: F.lit(1.0))).alias("alpha"))
        told = with_probas(rows, self.machines).join(by, "id", "left")
        n = len(self.machines)
        weight = lambda m: F.coalesce(F.get("alpha", F.lit(m)), F.lit(1.0))
        summed = F.array(*[sum((weight(m) * F.get("probas", F.lit(m * self.classes + c)) for m in range(1, n)), weight(0) * F.get("probas", F.lit(c))) for c in range(self.classes)])
        told = told.select("id", summed.alias("s")).withColumn("t", F.aggregate("s", F.lit(0.0), lambda s, x: s + x))
        return told.select("id", F.transform("s", lambda x: x / F.col("t")).alias("proba"))


def fit_council(rows: DataFrame, hidden: int = HIDDEN, reg: float = REG, k_fill: int = 5, k: int = 5, share: float = 0.2, seed: int = 42) -> Council:
    """A machine for each class, and the part of the rows that they are checked on."""
    cut = checkpointed(sampling.stratified_holdout(rows.select("id", "label", "features"), share, seed))
    fitted = cut.where("split = 'train'").drop("split")
    sizes = {r["label"]: r["n"] for r in sampling.class_counts(fitted).collect()}  # a row a class
    if not sizes:
        raise ValueError("no rows to fit on")
    classes = int(rows.agg(F.max("label")).first()[0]) + 1
    near = checkpointed(neighbours(fitted, k_fill, which="same").select("id", "rank", "neighbour"))
    machines = [fit_machine(even_set(fitted, near, sizes[c], seed + c), classes, hidden, reg, seed + c) for c in sorted(sizes)]
    # numbers of their own, so that a row asked about may be one of them
    checked = with_probas(cut.where("split = 'test'").select((-1 - F.col("id")).alias("id"), "label", "features"), machines)
    of = lambda m: F.slice("probas", m * classes + 1, classes)
    right = F.array(*[(F.array_position(of(m), F.array_max(of(m))) - 1) == F.col("label") for m in range(len(machines))])
    checked = checkpointed(checked.select("id", "label", "features", right.alias("right")))
    return Council(machines, checked, k, classes)
