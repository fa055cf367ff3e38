"""One document of each group of near copies: links are pairs whose sets of shingles have a Jaccard similarity of SIMILAR or more.

Candidates come from the bit-sliced comparison of simhash.py at a wide radius. At a similarity of 0.8 the angle of two sets
is at most acos(8/9), so 15 % of the bits of two fingerprints differ: ten of 64 on average. RADIUS lies five deviations above
(24), unrelated fingerprints (32 on average) mostly beyond it. No cut of 64 bits into runs finds so many differences short
of comparing all pairs, so fingerprints are compared within buckets: BANDS keys, each of ROWS least hashes of the set.
A pair of similarity s shares no bucket with probability (1 - s^ROWS)^BANDS, 5e-6 at 0.8 and 3e-14 at 0.9. Buckets of over
LARGE sets aren't compared but taken as candidates whole, by way of their least set, so that no bucket is gathered.

Confirmation: within a candidate group all pairs count, whether they share a bucket or not, by counting common shingles
through an inverted index. A group over TILE texts or WORDS shingles is cut into tiles. First every tile meets the group's
first text; what is similar to it is linked. Then every tile of texts that aren't meets every tile of the group, each pair
a task of its own, so that a large group of copies of one text costs as many comparisons as it has texts. Each task gives a
spanning forest of its links.

Defined cases: texts of equal shingle sets belong together, blank and null ones too; texts of fewer than WIDTH words are
one shingle; repeated ids are rows of their own when groups are formed. Shingles, sets and texts are told apart by 64-bit
hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, meet, partitions, stored
from .simhash import LANES, _BITS, _spanning, components, forest

WIDTH, SIMILAR, SEED = 5, 0.8, 42
ROWS, BANDS, CHUNK = 6, 40, 4096
TILE, WORDS, LARGE = 2048, 1 << 21, 8192
_FACTORS, _TERMS = (np.random.default_rng(SEED + i).integers(0, 1 << 64, ROWS * BANDS, np.uint64) for i in range(2))
_FACTORS |= np.uint64(1)


def radius(similar: float = SIMILAR) -> int:
    """Five deviations above the differing bits that sets of so much similarity have on average, and in most cases fewer."""
    p = math.acos(2 * similar / (1 + similar)) / math.pi
    return math.ceil(64 * p + 5 * math.sqrt(64 * p * (1 - p)))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct XXH64 hashes of the text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    size, hashed = min(width, len(words)), xxhash.xxh64_intdigest
    found = {hashed(b" ".join(words[i : i + size]), SEED) for i in range(len(words) - size + 1)} if words else ()
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed number."""
    if not len(hashes):
        return 0
    by = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def band_keys(hashes: np.ndarray) -> list[int]:
    """BANDS signed keys; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(ROWS * BANDS, ~np.uint64(0))
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, (_FACTORS[:, None] * hashes[None, at : at + CHUNK] + _TERMS[:, None]).min(1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (the text's hash), node (the shingle set's), size, fp, keys of every row."""
    bounded_batches(docs.sparkSession)
    kind = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            sets = [shingles(x) for x in b.column(2).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_fingerprint(s) for s in sets], pa.int64()),
                pa.array([band_keys(s) for s in sets], kind.field("keys").type),
            ], schema=kind)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, th long, node long, size long, fp long, keys array<long>")


def confirmed(sets: list[np.ndarray], split: int | None = None, similar: float = SIMILAR) -> np.ndarray:
    """Edges (positions) of a spanning forest of the pairs of sets that are similar; with split, only of those across that position."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, word = np.unique(np.concatenate(sets), return_inverse=True) if len(owner) else (None, owner)
    order = np.argsort(word, kind="stable")
    listed, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(word))]).astype(np.int64)
    ends, label, edges = np.cumsum(sizes), np.arange(len(sets)), []
    for i in range(len(sets) if split is None else split):
        others = label[i + 1 :] if split is None else label[split:]
        if (others == label[i]).all():  # joined already
            continue
        own = word[ends[i] - sizes[i] : ends[i]]
        common = np.zeros(len(sets), np.int64)
        for at in range(0, len(own), CHUNK):  # the lists of so many shingles at once
            a, n = first[own[at : at + CHUNK]], np.diff(first)[own[at : at + CHUNK]]
            common += np.bincount(listed[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        near = np.flatnonzero((common > 0) & (common >= similar * (sizes + sizes[i] - common)))
        near = near[near > i] if split is None else near[near >= split]
        if len(near):
            edges.append(_spanning(label, np.full(len(near), i), near))
    return np.concatenate(edges) if edges else np.empty((0, 2), np.int64)


def candidates(classes: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """a, b: nodes of classes (node, fp, keys) joined by a forest of what lies within the radius in a common bucket."""
    keyed = classes.select("node", "fp", F.explode("keys").alias("key"))
    total = classes.agg(F.sum(F.size("keys"))).first()[0] or 0
    least = checkpointed(keyed.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1"))
    met = stored(meet(keyed, least.withColumn("rows", F.col("n")), "key", total))
    large = met.where((F.col("rows") > LARGE) & (F.col("node") != F.col("b"))).select(F.col("node").alias("a"), "b")
    wide = radius(similar)

    def run(dfs):
        """Whole buckets gather up to LANES rows at least; pairs of one bucket count."""
        held, rest, size = [], None, 0

        def out():
            df = pd.concat(held)
            held.clear()
            node, group = df["node"].to_numpy(np.int64), np.cumsum(np.concatenate([[0], np.diff(df["key"].to_numpy(np.int64)) != 0]))
            e = forest(df["fp"].to_numpy(np.int64).view(np.uint64), wide, group=group)
            return pd.DataFrame({"a": node[e[:, 0]], "b": node[e[:, 1]]})

        for df in dfs:
            df = df if rest is None else pd.concat([rest, df])
            key = df["key"].to_numpy(np.int64)
            cuts = np.flatnonzero(np.diff(key)) + 1  # the last bucket may go on
            at = 0
            while len(cuts) and at < cuts[-1]:
                i = np.searchsorted(cuts, at + LANES - size)
                to = int(cuts[min(i, len(cuts) - 1)])
                held.append(df.iloc[at:to])
                size, at = size + to - at, to
                if size >= LANES:
                    yield out()
                    size = 0
            rest = df.iloc[at:]
        if rest is not None:
            held.append(rest)
        if held:
            yield out()

    dealt = met.where(F.col("rows") <= LARGE).select("key", "node", "fp").repartition(partitions(classes.sparkSession), "key").sortWithinPartitions("key", "node")
    return dealt.mapInPandas(run, "a long, b long").unionAll(large).distinct()


def links(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: nodes of classes (node, th, size, fp, keys) joined by a spanning forest of all links; texts: th, text."""
    found = components(candidates(classes))
    found = found.unionAll(found.select(F.col("root").alias("node"), "root").distinct())  # components() doesn't list roots
    members = checkpointed(classes.select("node", "th", "size").join(found, "node"))
    tiles = F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / WORDS)).cast("int")
    groups = members.groupBy("root").agg(tiles.alias("tiles"), F.count("*").alias("n"))
    members = meet(members, groups, "root", members.count()).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    told = stored(texts.join(members.select("th", "root", "node", "tile", "tiles"), "th").select("root", "node", "tile", "tiles", "text"))

    def edges(df: pd.DataFrame, split: int | None = None) -> pd.DataFrame:
        e, node = confirmed([shingles(x) for x in df["text"]], split), df["node"].to_numpy(np.int64)
        return pd.DataFrame({"a": node[e[:, 0]], "b": node[e[:, 1]]})

    def small(df: pd.DataFrame) -> pd.DataFrame:
        return edges(df.sort_values("node"))

    def star(df: pd.DataFrame) -> pd.DataFrame:
        """The group's first text, a row of its own in each tile, against the tile."""
        return edges(df.sort_values(["first", "node"], ascending=[False, True]), 1)

    def pair(df: pd.DataFrame) -> pd.DataFrame:
        i, j, new = df["i"].iloc[0], df["j"].iloc[0], df["new"].iloc[0]
        df = df.sort_values(["side", "node"])
        return edges(df, None if new and i == j else int((df["side"] == 0).sum()))

    kind = "a long, b long"
    plain = told.where("tiles = 1").select("root", "node", "text").groupBy("root").applyInPandas(small, kind)
    large = told.where("tiles > 1")
    if large.isEmpty():
        return plain
    firsts = large.where("node = root").select("root", "node", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "text", F.lit(1).alias("first"))
    rows = large.where("node <> root").select("root", "node", "tile", "text", F.lit(0).alias("first")).unionByName(firsts)
    near = checkpointed(rows.groupBy("root", "tile").applyInPandas(star, kind))
    # what isn't like the first text meets all of its group
    new = checkpointed(large.where("node <> root").select("root", "node", "tile", "tiles").join(near.select(F.col("b").alias("node")), "node", "left_anti"))
    left = new.groupBy("root").agg(F.ceil(F.count("*") / TILE).cast("int").alias("new_tiles"), F.count("*").alias("n"))
    sizes = large.groupBy("root").agg(F.count("*").alias("n"))
    left = left.drop("n").join(sizes, "root")
    rows = meet(large, left, "root", large.count()).join(new.select("node", F.lit(True).alias("is_new")), "node", "left")
    # tiles of few new texts may be as long as the others, so they are cut as finely as those
    cut = F.pmod(F.xxhash64("node", F.lit(1)), "new_tiles").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fresh = rows.where("is_new").withColumn("cut", cut)
    within = fresh.withColumn("other", every("new_tiles")).select("root", F.lit(True).alias("new"), F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), (F.col("cut") > F.col("other")).cast("int").alias("side"), "node", "text")
    across = fresh.withColumn("other", every("tiles")).select("root", F.lit(False).alias("new"), F.col("cut").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "node", "text")
    old = rows.where("is_new is null").withColumn("other", every("new_tiles")).select("root", F.lit(False).alias("new"), F.col("other").alias("i"), F.col("tile").alias("j"), F.lit(1).alias("side"), "node", "text")
    rest = within.unionByName(across).unionByName(old).groupBy("root", "new", "i", "j").applyInPandas(pair, kind)
    return plain.unionAll(near).unionAll(rest).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, one of each group: the least id, of its texts in the group the one of least hash.

    Rows alike in id and text are one; of them the row of least hash stays. Rows of null ids can't be named; all of them stay.
    """
    first = F.min(F.struct(F.col("id").isNull(), "id", "th"))
    classes = stored(signatures(docs, id_col, text_col).groupBy("node").agg(first.alias("first"), F.min("th").alias("th"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    texts = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).dropDuplicates(["th"])
    found = components(links(classes, texts))
    named = classes.join(found, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("__id"), F.col("first.th").alias("__th")).where("__id is not null")
    orderable = [F.col(c) for c, t in docs.dtypes if "map<" not in t]
    named_rows = docs.where(F.col(id_col).isNotNull()).select(F.struct(*docs.columns).alias("__row"), F.xxhash64(*orderable).alias("__h"), F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__th"))
    one = named_rows.groupBy("__id", "__th").agg(F.min_by("__row", "__h").alias("__row"))
    return one.join(kept, ["__id", "__th"], "left_semi").select("__row.*").unionAll(docs.where(F.col(id_col).isNull()))
