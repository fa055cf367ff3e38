"""SimHash near-duplicate groups by bit-sliced comparison.

A fingerprint has bit j set if over half of the text's shingle hashes have it. Fingerprints link at RADIUS or fewer
differing bits, and documents of equal fingerprints belong together.

Candidates: the 64 bits are cut into `parts` runs. Two fingerprints within RADIUS agree on at least parts - RADIUS runs,
so for every choice of so many runs, fingerprints that agree on them form a bucket, and no link is missed. The number of
parts follows from the number of distinct fingerprints, so that a bucket of unrelated ones stays small at any size.
Buckets over TILE rows are cut into tiles and every pair of tiles of a bucket becomes a task of its own.

Comparison: a block's fingerprints are stored as 64 vertical bit planes, 64 fingerprints to a machine word. A query's
bits are XORed plane by plane and added into carry-save counters (as many bits as the radius has and a sticky overflow,
starting such that overflow means "beyond the radius"); once every lane of a block has overflowed the block is abandoned. Each block gives
a spanning forest of its links, never all pairs, so that a group of n copies costs n rows.

Groups: alternating large-star and small-star steps over the forest's edges, with checkpoints, until nothing changes. A node
of many edges, a fingerprint of many copies and a group of many fingerprints aren't gathered (common.meet).

Defined cases: a null or blank text has fingerprint zero, linked like any other; texts of fewer than `width` words are
one shingle; repeated rows and ids are rows of their own; null ids get a group but never name it (a group of null ids
alone has a null component); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, meet, partitions

WIDTH, RADIUS, SEED = 4, 4, 42
BUCKET, TILE, LANES, CHUNK = 2048, 8192, 512, 1 << 18
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Of the XXH64 hashes of all word shingles, repeats included, the bits set in over half."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    size = min(width, len(words))
    plain = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, hashed = ends - lengths, xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(words) - size + 1
    for at in range(0, n, CHUNK):  # so many hashes at once
        cut = zip(starts[at : min(n, at + CHUNK)].tolist(), ends[at + size - 1 :].tolist(), strict=False)
        h = np.array([hashed(plain[a:b], SEED) for a, b in cut], dtype="<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            ones[8 * byte : 8 * byte + 8] += np.bincount(h[:, byte], minlength=256) @ _BITS
    return int(sum(1 << j for j in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id, fp (as a signed long) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x, width) for x in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """64 x words: bit planes of fingerprints, lanes beyond the last one zero."""
    lanes = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    lanes[: len(fps)] = fps
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little").view(np.uint64)


#: Words of lanes still open, as a share, at which the rest go on one by one.
SPARSE = 0.25


def within(queries: np.ndarray, block: np.ndarray, radius: int = RADIUS, closed: np.ndarray | None = None, open_: list[int] | None = None) -> np.ndarray | None:
    """queries x words: lanes of the block's planes within the radius of each query; None if all were abandoned. A word (64 lanes
    against a query) is abandoned once all its lanes exceed the radius. closed: lanes that don't matter, queries x words; open_ gathers how many
    words are open at each check."""
    bits = max(1, radius.bit_length())
    start = (1 << bits) - 1 - radius  # counters of so many bits overflow at radius + 1 differences
    shape = (len(queries), block.shape[1])
    counters = [np.full(shape, _ALL if start >> i & 1 else 0, np.uint64) for i in range(bits)]
    over = np.zeros(shape, np.uint64) if closed is None else closed.copy()
    flip = np.where(queries[None, :] >> np.arange(64, dtype=np.uint64)[:, None] & np.uint64(1), _ALL, np.uint64(0))
    live = None
    for j in range(64):
        d = block[j][None, :] ^ flip[j][:, None] if live is None else block[j][live[1]] ^ flip[j][live[0]]
        for c in counters:
            carry = c & d
            c ^= d
            d = carry
        over |= d
        if j % 8 == 7 and j > 8:
            left = np.nonzero(over != _ALL)
            if open_ is not None:
                open_.append(len(left[0]))
            if not len(left[0]):
                return None
            if live is None and len(left[0]) <= SPARSE * over.size or live is not None and len(left[0]) < len(over):
                counters, over = [c[left] for c in counters], over[left]
                live = left if live is None else (live[0][left], live[1][left])
    if live is None:
        return ~over
    out = np.zeros(shape, np.uint64)
    out[live] = ~over
    return out


def _passed(asked: int, first: int, lanes: np.ndarray, words: int) -> np.ndarray:
    """Of `asked` rows from position `first`, the lanes at or before each row, and those beyond the last one: they don't matter."""
    bits = np.ones((asked, words * 64), bool)
    bits[:, : len(lanes)] = lanes[None, :] <= first + np.arange(asked)[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def forest(fps: np.ndarray, radius: int = RADIUS, split: int | None = None, group: np.ndarray | None = None) -> np.ndarray:
    """Edges (positions) of a spanning forest of the links between fps; with split, only of those across that position, with
    group, only of those within a group."""
    rows, cols = (np.arange(len(fps)), np.arange(len(fps))) if split is None else (np.arange(split), np.arange(split, len(fps)))
    label, edges = np.arange(len(fps)), []
    for at in range(0, len(cols), LANES * 8):
        lanes = cols[at : at + LANES * 8]
        block = planes(fps[lanes])
        for q in range(0, len(rows), LANES):
            asked = rows[q : q + LANES]
            if split is None and asked[0] > lanes[-1]:
                continue
            hit = within(fps[asked], block, radius, _passed(len(asked), int(asked[0]), lanes, block.shape[1]) if split is None else None)
            if hit is None:
                continue
            some = np.flatnonzero(hit.any(1))
            bits = np.unpackbits(hit[some].view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little")[:, : len(lanes)]
            a, b = np.nonzero(bits)
            a, b = asked[some[a]], lanes[b]
            if group is not None:
                same = group[a] == group[b]
                a, b = a[same], b[same]
            edges.append(_spanning(label, *((a[a < b], b[a < b]) if split is None else (a, b))))
    return np.concatenate(edges) if edges else np.empty((0, 2), np.int64)


def _spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Those of the links (a, b) that join labels, as edges between the labels' smallest members; label is updated."""
    kept = []
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return np.concatenate(kept) if kept else np.empty((0, 2), np.int64)
        x, y = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
        a, b = a[apart], b[apart]
        # each label hooks onto the least label that it meets
        to = np.arange(len(label))
        np.minimum.at(to, y, x)
        hooked = np.flatnonzero(to != np.arange(len(to)))
        kept.append(np.column_stack([to[hooked], hooked]))
        while (to[to] != to).any():
            to = to[to]
        label[:] = to[label]


def runs_and_choice(n: int, radius: int = RADIUS, bucket: int = BUCKET) -> tuple[list[tuple[int, int]], int]:
    """The runs (first bit, bits) and how many of them make a bucket's key, for n distinct fingerprints."""
    parts = next(p for p in range(radius + 1, 64) if p - radius == 8 or n >> (64 * (p - radius) // p) <= bucket)
    edges = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], parts - radius


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """a, b: fingerprints (column fp of distinct, n rows) joined by a spanning forest of all links."""
    spark = distinct.sparkSession
    runs, choose = runs_and_choice(n, radius)
    tables = []
    for t, picked in enumerate(combinations(runs, choose)):
        mask = sum(((1 << size) - 1) << first for first, size in picked)
        mask -= (mask >> 63) << 64
        tables.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    assert len(tables) == comb(len(runs), choose)
    keyed = distinct.select("fp", F.explode(F.array(*tables)).alias("k")).select("fp", "k.t", "k.key")
    # buckets beyond a tile are rare: unrelated fingerprints don't fill one
    large = keyed.groupBy("t", "key").count().where(F.col("count") > TILE).select("t", "key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    keyed = keyed.join(large, ["t", "key"], "left")
    tile = F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))).cast("int")
    keyed = keyed.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
    keyed = keyed.select("fp", "t", "key", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))

    def edges(fps: np.ndarray, tiles: np.ndarray, i: int, j: int) -> np.ndarray:
        if i == j:
            return forest(fps, radius)
        order = np.argsort(tiles, kind="stable")
        fps[:] = fps[order]
        return forest(fps, radius, int((tiles == i).sum()))

    def run(dfs):
        """Whole buckets gather up to LANES rows, as links across buckets are links too; larger ones stand alone."""
        held: list[np.ndarray] = []
        rest = None

        def out(fps, found):
            return pd.DataFrame({"a": fps[found[:, 0]].view(np.int64), "b": fps[found[:, 1]].view(np.int64)})

        def small():
            fps = np.unique(np.concatenate(held))
            held.clear()
            return out(fps, forest(fps, radius))

        def whole(df):
            size = 0
            cuts = np.flatnonzero(np.any(df[["t", "key", "i", "j"]].to_numpy()[1:] != df[["t", "key", "i", "j"]].to_numpy()[:-1], axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(df)], strict=True):
                if b - a == 1:
                    continue
                fps = df["fp"].to_numpy(np.int64)[a:b].view(np.uint64).copy()
                if b - a > LANES:
                    i, j = int(df["i"].iloc[a]), int(df["j"].iloc[a])
                    found = edges(fps, df["tile"].to_numpy()[a:b], i, j)
                    yield out(fps, found)
                    continue
                if size + b - a > LANES:
                    yield small()
                    size = 0
                held.append(fps)
                size += b - a
            if held:
                yield small()

        for df in dfs:
            df = df if rest is None else pd.concat([rest, df])
            last = df.iloc[-1]
            same = (df["t"] == last["t"]) & (df["key"] == last["key"]) & (df["i"] == last["i"]) & (df["j"] == last["j"])
            rest = df[same]
            if not same.all():
                yield from whole(df[~same])
        if rest is not None:
            yield from whole(rest)

    dealt = keyed.repartition(partitions(spark), "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "fp")
    return dealt.mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the least node that edges (a, b) reach, for each node of an edge, by large-star and small-star steps."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = checkpointed(edges)
    state, total = None, edges.count()
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = meet(both.where("v > u"), least, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = meet(large, least, "u", 2 * total).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = checkpointed(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, total = now, now[0]
    else:
        raise RuntimeError("components have not settled")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = checkpointed(fingerprints(docs, id_col, text_col, width))
    classes = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    distinct, total = classes.agg(F.count("*"), F.sum("n")).first()
    found = components(links(classes.select("fp"), distinct, radius))
    named = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    # the least id of each group, by way of classes, not documents
    group = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = meet(named.select("fp", "root", F.col("n").alias("copies")), group, "root", distinct).select("fp", "component_id", F.col("copies").alias("n"))
    return meet(rows, named, "fp", total or 0).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
