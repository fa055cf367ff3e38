"""Exact k-nearest-neighbour joins by tasks that stream, and the neighbourhood statistics that follow from them.

Queries (id, label, features array<double>) are dealt to a bounded number of tasks by hash; each task holds its queries with their
k best so far and reads the candidates batch by batch. A matrix product in single precision leaves out what can't be among the k
(with a margin for its rounding), and exact distances of the rest choose. So what is shuffled is the rows times the number of tasks,
which doesn't grow up to TASKS * MOST_QUERIES rows (TASKS, or the cluster's cores if they are more, MOST_TASKS at most); a task holds MOST_QUERIES queries and MOST_BEST places at most. Few queries are
met by several splits of the candidates, and a rank window over k rows a split and query gives the result. The work grows with
queries times candidates. Self is told by id, so duplicates of a point remain neighbours. Ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import checkpointed
from .ranks import quantiles

BLOCK = 4096
#: Tasks of one search (on many cores), queries that are worth a task, queries and places of neighbours that a task may hold.
TASKS, MOST_TASKS, QUERIES, MOST_QUERIES, MOST_BEST = 12, 32, 128, 1 << 16, 1 << 23
#: Queries and candidates of one product (it stays in a core's cache), pairs of which exact distances are formed, and tile cells of other norms at once.
STEP, WIDE, PAIRS, TILE = 256, 2048, 1 << 15, 1 << 17
#: Distances that are formed in a core's cache.
FORMED = 1 << 10
#: Candidates for each place of a list that are read at once, if batches are smaller; neighbours of nearest_distances() that have ids.
MERGED, FIRST = 64, 16
#: Longer lists are kept without order, but for the last place, until they are read.
LONG = 32
SCHEMA = "id long, label int, neighbour long, neighbour_label int, dist double, rank int"


def _candidates(q: np.ndarray, x: np.ndarray, able: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that may be among the k nearest, from the product of the blocks."""
    norms = (x * x).sum(1)
    own = (q * q).sum(1)
    d2 = np.where(able, own[:, None] + norms[None, :] - 2 * q @ x.T, np.inf)
    if x.shape[0] > k:
        slack = 1e-12 * (x.shape[1] + 8) * (own + norms.max())  # beyond what rounding can do
        able = able & (d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k] + 2 * slack[:, None])
    return np.nonzero(able)


def first_copies(labels: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first n rows of each vector and label, in order."""
    keys = np.ascontiguousarray(np.column_stack([x + 0.0, labels]))
    keys = keys.view(np.dtype((np.void, keys.itemsize * keys.shape[1]))).ravel()
    order = np.argsort(keys, kind="stable")
    starts = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]])
    place = np.arange(len(order)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
    return np.sort(order[place < n])


def true_at(hits: np.ndarray) -> np.ndarray:
    """np.flatnonzero() of few hits, by eight at a time."""
    flat = hits.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    at = (words[:, None] * 8 + np.arange(8)).ravel()
    return np.append(at[flat[at]], whole + np.flatnonzero(flat[whole:]))


def exact(a: np.ndarray, b: np.ndarray, p: float = 2.0) -> np.ndarray:
    """Distances row by row, formed from differences, so that equal points have distance zero exactly."""
    return np.sqrt(((a - b) ** 2).sum(1)) if p == 2 else (np.abs(a - b) ** p).sum(1) ** (1 / p)


class Rough:
    """Rough distances of queries to a batch of candidates as closeness, the larger the closer, and bounds on it that no rounding passes.

    For p = 2 it is the inner product less half the candidate's square, from one product, in single precision unless the numbers are
    too large for it; for other norms it is less the sum over dimensions. For p 1 and 2 rows are shifted to the queries' mean first,
    so that far data cost no digits."""

    def __init__(self, q: np.ndarray, p: float):
        self.p, self.shift = p, q.mean(0) if p in (1, 2) else np.zeros(q.shape[1])
        self.q = q - self.shift
        self.size = self.sizes(self.q)

    def sizes(self, x: np.ndarray) -> np.ndarray:
        return (x * x).sum(1) if self.p == 2 else np.abs(x).sum(1)

    def read(self, x: np.ndarray) -> None:
        x = x - self.shift
        top = max(np.abs(x).max(initial=0), np.abs(self.q).max(initial=0))
        self.kind = np.float32 if top < 1e15 and self.p in (1, 2) else np.float64
        self.slack = 2 * float(np.finfo(self.kind).eps) * (x.shape[1] + 8)
        size = self.sizes(x)
        self.most = size.max(initial=0)
        self.lift = ((self.slack - 0.5 if self.p == 2 else self.slack) * size).astype(self.kind)
        self.x = np.ascontiguousarray(x.T, dtype=self.kind)
        if self.p == 2:
            self.x = np.concatenate([self.x, self.lift[None]])
            self.blocks = [np.ascontiguousarray(self.x[:, at : at + WIDE]) for at in range(0, len(x), WIDE)]

    def closeness(self, part: np.ndarray, block: int | None = None) -> np.ndarray:
        """Of some queries to the batch, or to a block of WIDE candidates of it."""
        q = self.q[part].astype(self.kind)
        if self.p == 2:
            return np.concatenate([q, np.ones((len(q), 1), self.kind)], 1) @ (self.x if block is None else self.blocks[block])
        among = slice(None) if block is None else slice(block * WIDE, (block + 1) * WIDE)
        every, lift = self.x[:, among], self.lift[among]
        out, n = np.empty((len(q), every.shape[1]), self.kind), max(1, TILE // len(q))
        for at in range(0, every.shape[1], n):
            x = every[:, at : at + n]
            total, gap = np.zeros((len(q), x.shape[1]), self.kind), np.empty((len(q), x.shape[1]), self.kind)
            for i in range(len(x)):
                np.abs(np.subtract(q[:, i, None], x[i], out=gap), out=gap)
                total += gap if self.p == 1 else gap**self.p
            out[:, at : at + n] = lift[at : at + n] - total
        return out

    def least(self, part: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The least closeness of candidates within far of each query."""
        if self.p == 2:
            return ((0.5 - self.slack) * self.size[part] - far * far * (0.5 + 1e-6) - 1e-30).astype(self.kind)
        return (-(far**self.p) * (1 + 1e-6) - self.slack * self.size[part] - 1e-30).astype(self.kind)

    def under(self, part: np.ndarray, closest: np.ndarray) -> np.ndarray:
        """The least closeness of candidates that may be as near as ones of the given closeness."""
        return (closest - 4 * self.slack * (self.size[part] + self.most) - 1e-6 * np.abs(closest) - 1e-30).astype(self.kind)


class Nearest:
    """The k best of the candidates read so far, for each query."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, k: int, p: float = 2.0, which: str = "any", height: np.ndarray | None = None):
        self.ids, self.labels, self.q, self.k, self.p, self.which, self.height = ids, labels, q, k, p, which, height
        self.rough = Rough(q, p)
        self.dist, self.near = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        self.kind = np.zeros((len(q), k), np.int32)

    def able(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of a query and a candidate of the batch whether it counts."""
        ids, labels, height = self.batch
        if self.which == "higher":  # ties: the smaller id
            return (height[j] > self.height[i]) | ((height[j] == self.height[i]) & (ids[j] < self.ids[i]))
        ok = ids[j] != self.ids[i]
        return ok if self.which == "any" else ok & ((labels[j] == self.labels[i]) == (self.which == "same"))

    def read(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, height: np.ndarray | None = None) -> None:
        if self.which != "higher" and len(ids) > self.k + 1:
            # ties go to the smaller id, so that of equal rows only the first k count, or k + 1 where the query is one of them
            order = np.argsort(ids, kind="stable")
            kept = order[first_copies(labels[order], x[order], self.k + 1)]
            if len(kept) < len(ids):
                ids, labels, x = ids[kept], labels[kept], x[kept]
        self.batch = ids, labels, height
        self.rough.read(x)
        every = np.arange(len(ids))[None, :]
        # none is nearer than k rows at distance 0 of smaller ids
        open_ = np.flatnonzero((self.dist[:, -1] > 0) | (self.near[:, -1] > ids.min(initial=np.iinfo(np.int64).max)))
        for at in range(0, len(open_), STEP):
            part = open_[at : at + STEP]
            far = self.dist[part, -1]
            least = self.rough.least(part, far)
            new = np.flatnonzero(np.isinf(far))
            if len(new) and len(ids) > self.k:  # less than k so far: the k closest of the batch bound what counts
                kth = np.partition(np.where(self.able(part[new][:, None], every), self.rough.closeness(part[new]), -np.inf), len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                least[new] = np.where(np.isneginf(kth), -np.inf, self.rough.under(part[new], kth))
            found = []
            for block, start in enumerate(range(0, len(ids), WIDE)):
                hits = self.rough.closeness(part, block) >= least[:, None]
                if self.which != "any":
                    hits &= self.able(part[:, None], every[:, start : start + WIDE])
                i, j = np.divmod(true_at(hits), hits.shape[1])
                found.append((i, j + start))
            i, j = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
            order = np.argsort(i.astype(np.uint16), kind="stable")
            i, j = i[order], j[order]
            for a in range(0, len(i), PAIRS):
                self.take(part[i[a : a + PAIRS]], j[a : a + PAIRS], x)

    def take(self, i: np.ndarray, j: np.ndarray, x: np.ndarray) -> None:
        ids, labels, _ = self.batch
        ok = self.able(i, j)
        i, j = i[ok], j[ok]
        d = np.concatenate([exact(x[j[a : a + FORMED]], self.q[i[a : a + FORMED]], self.p) for a in range(0, len(i), FORMED)]) if len(i) else np.zeros(0)
        ok = d <= self.dist[i, -1]
        i, j, d = i[ok], j[ok], d[ok]
        if not len(i):
            return
        if self.k > LONG:
            return self.put(i, d, ids[j], labels[j])
        rows, at = np.unique(i, return_inverse=True)
        place = np.concatenate([np.repeat(np.arange(len(rows)), self.k), at])
        dist, near = np.concatenate([self.dist[rows].ravel(), d]), np.concatenate([self.near[rows].ravel(), ids[j]])
        kind = np.concatenate([self.kind[rows].ravel(), labels[j]])
        order = np.lexsort((near, dist, place))
        order = order[(np.searchsorted(place[order], np.arange(len(rows)))[:, None] + np.arange(self.k)).ravel()]
        for kept, new in ((self.dist, dist), (self.near, near), (self.kind, kind)):
            kept[rows] = new[order].reshape(-1, self.k)

    def put(self, i: np.ndarray, d: np.ndarray, near: np.ndarray, kind: np.ndarray) -> None:
        """The k best of long lists and pairs (in the order of queries), with the last of them in the last place; ties as by full order."""
        rows, first, of, n = np.unique(i, return_index=True, return_inverse=True, return_counts=True)
        place = self.k + np.arange(len(i)) - first[of]
        every = []
        for kept, new, none in ((self.dist, d, np.inf), (self.near, near, np.iinfo(np.int64).max), (self.kind, kind, 0)):
            both = np.full((len(rows), self.k + n.max()), none, kept.dtype)
            both[:, : self.k] = kept[rows]
            both[of, place] = new
            every.append(both)
        best = np.argpartition(every[0], self.k - 1, axis=1)[:, : self.k]
        last = np.take_along_axis(every[0], best[:, -1:], 1)
        tied = np.flatnonzero(np.isfinite(last[:, 0]) & ((last[:, 0] == 0) | ((every[0] <= last).sum(1) > self.k)))
        if len(tied):
            best[tied] = np.lexsort((every[1][tied], every[0][tied]))[:, : self.k]
        for kept, both in zip((self.dist, self.near, self.kind), every, strict=True):
            kept[rows] = np.take_along_axis(both, best, 1)

    def settle(self) -> None:
        """Long lists in order."""
        for start in range(0, len(self.q) if self.k > LONG else 0, step := max(1, PAIRS // self.k)):
            part = slice(start, start + step)
            order = np.lexsort((self.near[part], self.dist[part]))
            for kept in (self.dist, self.near, self.kind):
                kept[part] = np.take_along_axis(kept[part], order, 1)

    def found(self) -> pa.RecordBatch:
        self.settle()
        i, rank = np.nonzero(np.isfinite(self.dist))
        columns = [self.ids[i], self.labels[i], self.near[i, rank], self.kind[i, rank], self.dist[i, rank], (rank + 1).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in SCHEMA.split(", ")])


def matrix(column: pa.Array) -> np.ndarray:
    """A list column, of one length, as an array."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def streamed(start, emit):
    """For mapInArrow over tasks of queries and then candidates (see dealt): emit(what start() made of the queries and all candidates read)."""

    def run(batches):
        held, state, task, waiting = [], None, None, []

        def read():
            nonlocal waiting
            if waiting:
                all_ = waiting[0] if len(waiting) == 1 else pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                state.read(all_["id"].to_numpy(), all_["label"].to_numpy(), matrix(all_["features"]), *[all_[c].to_numpy() for c in all_.schema.names[5:]])
                waiting = []

        def made():
            if state is not None:
                read()
                yield from emit(state)

        for b in batches:
            tasks, kinds = b["task"].to_numpy(), b["kind"].to_numpy()
            cuts = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(kinds) != 0)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(b)], strict=True):
                if a == z:
                    continue
                if tasks[a] != task:
                    yield from made()
                    held, state, task = [], None, tasks[a]
                part = b.slice(a, z - a)
                if not kinds[a]:
                    held.append(part)
                elif held:
                    if state is None:
                        state = start(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    waiting.append(part)
                    if sum(len(w) for w in waiting) >= MERGED * state.k:  # long lists are merged with many candidates at once
                        read()
        yield from made()

    return run


def dealt(asked: DataFrame, rows: DataFrame, queries: int, n: int, k: int = 1, block: int = QUERIES, splits: int | None = None) -> tuple[DataFrame, int]:
    """task, kind (0 for queries, 1 for candidates), id, label, features and further columns, one partition a task with its queries
    first, and how many splits of the candidates each query meets."""
    # every task reads all candidates, so there are no more than run at once, and as many for small tables as for large ones
    tasks = max(TASKS, min(rows.sparkSession.sparkContext.defaultParallelism, MOST_TASKS))
    groups = max(min(tasks, math.ceil(queries / block)), math.ceil(queries / MOST_QUERIES), math.ceil(queries * k / MOST_BEST), 1)
    splits = splits or max(1, min(tasks // groups, math.ceil(n / (16 * block))))
    part = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    more = asked.columns[3:]
    columns = ["id", F.col("label").cast("int").alias("label"), "features", *more]
    left = asked.withColumn("__s", every(splits)).select((part(groups) + groups * F.col("__s")).alias("task"), F.lit(0).alias("kind"), *columns)
    right = rows.withColumn("__g", every(groups)).select((F.col("__g") + groups * part(splits)).alias("task"), F.lit(1).alias("kind"), *columns)
    met = left.unionByName(right).repartitionById(groups * splits, F.col("task")).sortWithinPartitions("task", "kind", "id")
    return met, splits


def keyed(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), F.col("features").cast("array<double>").alias("features"), *more)


def neighbours(rows: DataFrame, k: int, p: float = 2.0, which: str = "any", queries: DataFrame | None = None, block: int = QUERIES) -> DataFrame:
    """id, label, neighbour, neighbour_label, dist, rank (from 1): the k nearest of the rows, or fewer if there are fewer.

    which: any, same or other class. queries: other rows to ask for (default: the rows themselves). block: queries that are worth a task.
    """
    rows = keyed(rows)
    n = rows.count()
    asked, m = (rows, n) if queries is None else (keyed(queries), queries.count())
    k = min(k, max(n, 1))
    met, splits = dealt(asked, rows, m, n, k, block)
    start = lambda b: Nearest(b["id"].to_numpy(), b["label"].to_numpy(), matrix(b["features"]), k, p, which)
    found = met.mapInArrow(streamed(start, lambda s: [s.found()]), SCHEMA)
    if splits == 1:
        return found
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def safe_level(rows: DataFrame, k: int = 5) -> DataFrame:
    """id, label, safe: the share of the k nearest with the own label; 1 without neighbours."""
    same = neighbours(rows, k).groupBy("id").agg(F.avg((F.col("neighbour_label") == F.col("label")).cast("double")).alias("safe"))
    return rows.select("id", "label").join(same, "id", "left").select("id", "label", F.coalesce("safe", F.lit(1.0)).alias("safe"))


def cross_class_distance(rows: DataFrame, label: int, k: int = 5) -> DataFrame:
    """id, dist: of each row of a class the distance to its k-th nearest row of other classes; null if there is none."""
    own = rows.where(F.col("label") == label)
    far = neighbours(rows.where(F.col("label") != label), k, queries=own).groupBy("id").agg(F.max("dist").alias("dist"))
    return own.select("id").join(far, "id", "left")


def median_distance(rows: DataFrame) -> DataFrame:
    """label, median_dist: the median distance to the nearest row of the own class; 1 for classes of one row."""
    near = quantiles(neighbours(rows, 1, which="same"), "dist", {"median_dist": 0.5}, "label")
    return rows.select("label").distinct().join(near, "label", "left").select("label", F.coalesce("median_dist", F.lit(1.0)).alias("median_dist"))


def consecutive_cut(found: DataFrame, stop: int = 5) -> DataFrame:
    """Of ordered neighbour lists what comes before `stop` neighbours of other classes in a row (their own first ones included)."""
    line = Window.partitionBy("id").orderBy("rank")
    same = F.col("neighbour_label") == F.col("label")
    island = F.sum(same.cast("int")).over(line)
    found = found.withColumn("__island", island)
    run = F.sum((~same).cast("int")).over(Window.partitionBy("id", "__island").orderBy("rank"))
    found = found.withColumn("__run", run)
    over = F.max((F.col("__run") >= stop).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("__over", F.coalesce(over, F.lit(0))).where("__over = 0").drop("__island", "__run", "__over")


def candidate_region(rows: DataFrame, stop: int = 5, reach: int = 50, queries: DataFrame | None = None) -> DataFrame:
    """consecutive_cut() of whole ordered neighbour lists: rows whose list has not been cut within `reach` neighbours ask again
    with a doubled reach, until it has or all rows are read."""
    n, asked, whole = rows.count(), rows if queries is None else queries, None
    while True:
        got = checkpointed(consecutive_cut(neighbours(rows, reach, queries=asked), stop))
        if reach < n:
            # a list that ends short of reach was cut; one cut at reach itself asks again and ends the same
            open_ = got.groupBy("id").agg(F.max("rank").alias("__last")).where(F.col("__last") >= reach).select("id")
            asked = checkpointed(asked.join(open_, "id", "left_semi"))
            got = got.join(open_, "id", "left_anti")
        whole = got if whole is None else whole.unionAll(got)
        if reach >= n or asked.isEmpty():
            return whole
        reach *= 2


def clean_directions(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Neighbours to whose midpoint no earlier neighbour of another class lies closer than half the distance."""
    v = rows.select(F.col("id").alias("__v"), F.col("features").alias("__x"))
    full = found.join(v, F.col("neighbour") == F.col("__v")).drop("__v")
    own = rows.select("id", F.col("features").alias("__own"))
    full = full.join(own, "id")
    lists = full.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "neighbour_label", "dist", F.col("__x").alias("x"), "label", F.col("__own").alias("own")))).alias("l"))

    def blocked(e: Column, earlier: Column) -> Column:
        mid2 = F.aggregate(F.zip_with(F.zip_with(e["own"], e["x"], lambda p, q: (p + q) / 2), earlier["x"], lambda m, z: (m - z) * (m - z)), F.lit(0.0), lambda s, x: s + x)
        return (earlier["rank"] < e["rank"]) & (earlier["neighbour_label"] != e["label"]) & (mid2 < e["dist"] * e["dist"] / 4)

    kept = F.filter("l", lambda e: ~F.exists("l", lambda z: blocked(e, z)))
    return lists.select("id", F.explode(kept).alias("e")).select("id", "e.label", "e.neighbour", "e.neighbour_label", "e.dist", "e.rank")


def inverse_density(rows: DataFrame, k: int = 5) -> DataFrame:
    """id, label, density: mean 1 / distance to same-class rows among the k nearest (1 if none), over its class mean, turned
    by exp(-x) and again over its class mean."""
    near = neighbours(rows, k).where("neighbour_label = label").groupBy("id").agg(F.avg(1 / F.greatest("dist", F.lit(1e-10))).alias("r"))
    out = checkpointed(rows.select("id", "label").join(near, "id", "left").withColumn("r", F.coalesce("r", F.lit(1.0))))

    def over_mean(df: DataFrame, column: str) -> DataFrame:
        return df.join(F.broadcast(df.groupBy("label").agg(F.avg(column).alias("__mean"))), "label")  # a row a class

    out = over_mean(out, "r").select("id", "label", F.exp(-F.col("r") / F.col("__mean")).alias("e"))
    return over_mean(out, "e").select("id", "label", (F.col("e") / F.col("__mean")).alias("density"))


def reception_rate(rows: DataFrame, k: int = 7) -> DataFrame:
    """id, label, rate: summed distance to same-class neighbours over summed distance to all k."""
    found = neighbours(rows, k)
    same = F.when(F.col("neighbour_label") == F.col("label"), F.col("dist")).otherwise(0.0)
    out = found.groupBy("id", "label").agg(F.sum(same).alias("s"), F.sum("dist").alias("t"))
    return out.select("id", "label", F.when(F.col("t") > 0, F.col("s") / F.col("t")).otherwise(0.0).alias("rate"))


def nearest_distances(rows: DataFrame, k: int, first: int = 0) -> DataFrame:
    """id, dists, and with first nears: the distances to each row's k nearest rows in order, as one list, and the ids of the first of them."""

    def lists(state: Nearest):
        state.settle()
        out = [pa.array(state.ids)]
        for values, n in ((state.dist, state.k), (state.near, first))[: 2 if first else 1]:
            held = np.isfinite(state.dist[:, :n])
            ends = np.concatenate([[0], np.cumsum(held.sum(1))]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values[:, :n][held])))
        yield pa.RecordBatch.from_arrays(out, ["id", "dists", "nears"][: len(out)])

    rows = keyed(rows)
    n = rows.count()
    k = min(k, max(n - 1, 1))
    met, _ = dealt(rows, rows, n, n, k, splits=1)
    return met.mapInArrow(streamed(lambda b: Nearest(b["id"].to_numpy(), b["label"].to_numpy(), matrix(b["features"]), k), lists), "id long, dists array<double>" + (", nears array<long>" if first else ""))


def nearest_higher(rows: DataFrame, height: str, queries: DataFrame | None = None) -> DataFrame:
    """id, parent, delta: the nearest row of more height (ties of height: to the smaller id); rows without one are left out. queries: ids of
    the rows to ask for (default: all)."""
    rows = keyed(rows, F.col(height).cast("double").alias("height"))
    asked = rows if queries is None else checkpointed(rows.join(queries.select("id"), "id", "left_semi"))
    n = rows.count()
    met, splits = dealt(asked, rows, n if queries is None else asked.count(), n, splits=1 if queries is None else None)

    def start(b):
        return Nearest(b["id"].to_numpy(), b["label"].to_numpy(), matrix(b["features"]), 1, which="higher", height=b["height"].to_numpy())

    found = met.mapInArrow(streamed(start, lambda s: [s.found()]), SCHEMA).select("id", F.col("neighbour").alias("parent"), F.col("dist").alias("delta"))
    if splits == 1:
        return found
    return found.groupBy("id").agg(F.min(F.struct("delta", "parent")).alias("m")).select("id", "m.parent", "m.delta")


def merged(own: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """id, same, of, far, mean: from lists of the k nearest rows among the own class and among the others (neighbours()) how many of the k
    nearest of all are own, and how many these are; the distance to the first of the others, and the mean distance to the own list."""
    both = own.select("id", "dist", "neighbour", F.lit(1).alias("own")).unionByName(others.select("id", "dist", "neighbour", F.lit(0).alias("own")))
    first = F.slice(F.array_sort(F.collect_list(F.struct("dist", "neighbour", "own"))), 1, k)
    mine = F.col("own") == 1
    got = both.groupBy("id").agg(first.alias("l"), F.min(F.when(~mine, F.col("dist"))).alias("far"), F.avg(F.when(mine, F.col("dist"))).alias("mean"))
    return got.select("id", F.size(F.filter("l", lambda e: e["own"] == 1)).alias("same"), F.size("l").alias("of"), "far", "mean")


def density_parent(rows: DataFrame, k: int | None = None, near: DataFrame | None = None) -> DataFrame:
    """id, rho, parent, delta: the nearest row of higher density; density is a Gaussian sum over the k nearest rows (default: 15,
    or the root of the number of rows if that is more) with the median k-th distance as its width. Distances stay in one list a
    row. A parent is the first denser one of the FIRST neighbours; rows that have none there search among denser rows alone; only the densest
    row has none. Ties of density go to the smaller id. near: nearest_distances() of the rows and k with ids of the first, if it is known."""
    rows = keyed(rows)
    k = max(15, math.isqrt(rows.count())) if k is None else k
    found = checkpointed(nearest_distances(rows, k, FIRST)) if near is None else near
    width = quantiles(found.where(F.size("dists") > 0).select(F.element_at("dists", -1).alias("kth")), "kth", {"dc": 0.5})
    gauss = F.aggregate("dists", F.lit(0.0), lambda s, d: s + F.exp(-F.pow(d / F.greatest("dc", F.lit(1e-12)), 2)))
    rho = checkpointed(found.crossJoin(F.broadcast(width)).where(F.size("dists") > 0).select("id", gauss.alias("rho")))
    to = rho.select(F.col("id").alias("parent"), F.col("rho").alias("up"))
    close = found.select("id", F.posexplode("nears").alias("place", "parent"), "dists").select("id", "place", "parent", F.get("dists", F.col("place")).alias("delta"))
    close = close.join(to, "parent").join(rho, "id").where((F.col("up") > F.col("rho")) | ((F.col("up") == F.col("rho")) & (F.col("parent") < F.col("id"))))
    close = checkpointed(close.groupBy("id").agg(F.min(F.struct("place", "parent", "delta")).alias("m")).select("id", "m.parent", "m.delta"))
    best = close.unionByName(nearest_higher(rows.join(rho, "id"), "rho", rho.join(close.select("id"), "id", "left_anti")))
    return rho.join(best, "id", "left").select("id", "rho", "parent", "delta")
