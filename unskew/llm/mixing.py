"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions alone.

Every source gets a target of words: the budget (a share of all words) is dealt by the sources' weights, no source above
`most` times its own size, and what such sources leave is dealt again among the others until none is above. A source's
documents are repeated whole as often as its target holds its size, and the rest is the budget of one more copy.

Which documents get that copy is a matter of hashes. A document's hash of BITS bits is even and depends on its id and text
alone. Words are summed by source and bucket (the hash's first STEP bits), with sums before the shuffle; running sums over a
source's buckets, never over its documents, give the one bucket in which the budget ends. Only documents of these
boundary buckets are read again, cut by the next STEP bits, and so on until each boundary bucket holds one hash. The
budget's threshold is that hash: a map over all rows takes what lies below it, nothing is sorted. Thresholds are nested:
of two budgets, the larger one takes all that the smaller takes.

Documents at the threshold itself are cut, so that a source's words meet its target: each gives an equal share of its words,
to the nearest word.

Tables of a row a source, or of at most 2 ** STEP buckets a source, are never collected; the driver sees sums alone. Sources of
many rows are joined by `meet`.

Defined cases: a null text has no words; a null source is a source of its own, the last; sources of no words have a target
of 0, and a table without words takes nothing; rows of one id are told apart by their text, and wholly equal rows share
what they take evenly; a null id counts as the empty text; an empty table gives no rows; other columns are ignored. Sums are exact
below 2**53 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, meet, stored

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BITS, STEP = 60, 12


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, key (the source, never null), size, h of every row."""
    doc_id, source, text = F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))
    named = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    return docs.select(
        doc_id.alias("doc_id"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.conv(F.substring(named, 1, BITS // 4), 16, 10).cast("long").alias("h"),
    )


def named_source(key: str = "key") -> Column:
    return F.when(F.col(key) != "", F.expr(f"substring({key}, 2)"))


def weighted(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """sizes (a row a source) with weight: the weights repeat over the sources by code point, null last."""
    placed = checkpointed(sizes.orderBy(named_source().asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    # each partition of a sorted table is a run of sources; the rows before a run make their numbers gapless
    run = F.shiftrightunsigned("at", 33)
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # over partitions, not rows
    before = placed.groupBy(run.alias("run")).agg(F.count("*").alias("rows")).select("run", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rows = placed.withColumn("run", run).join(F.broadcast(before), "run")  # a row a partition
    return rows.select(*sizes.columns, F.get(listed, (place % len(weights)).cast("int")).alias("weight"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (key, source_size, n: a row a source) with target: the budget by weight, at most `most` sizes of each source."""
    rows = checkpointed(weighted(sizes, weights).withColumn("cap", F.col("source_size") * F.lit(float(most))))
    budget = float(share) * (rows.agg(F.sum("source_size")).first()[0] or 0)
    free, fair, left = F.lit(True), F.lit(0.0), None
    while True:  # what a weight of 1 gets only rises from turn to turn, so sources once above their bound stay so
        got = rows.agg(F.sum(F.when(~free, F.col("cap"))).alias("held"), F.sum(F.when(free, F.col("weight"))).alias("weights"), F.count(F.when(free, 1)).alias("left")).first()
        if got["left"] in (0, left):
            break
        left = got["left"]
        fair = F.col("weight") * F.lit(budget - (got["held"] or 0.0)) / F.lit(got["weights"])
        free = fair <= F.col("cap")
    return rows.withColumn("target", F.when(free, fair).otherwise(F.col("cap"))).drop("weight", "cap")


def thresholds(rows: DataFrame, goals: DataFrame, total: int) -> DataFrame:
    """key, threshold, rest, words: of each source with a budget (goals: key, budget > 0) the hash at which it ends, what is
    left of it there, and how many words documents of that hash hold. rows: key, size, h."""
    rest, left = goals.select("key", F.col("budget").alias("rest")), rows
    for level in range(1, BITS // STEP + 1):
        bucket = F.shiftright("h", BITS - level * STEP)
        sums = left.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("h").alias("threshold"), F.max("h").alias("last"))
        upto = F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # 2 ** STEP rows at most
        met = sums.withColumn("upto", upto).join(rest, "key").where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        edge = checkpointed(met.select("key", "bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"), "words", "threshold", "last", "n"))
        if edge.where("threshold < last").limit(1).count() == 0:
            break
        inside = meet(left, edge.select("key", F.col("bucket").alias("edge"), "n"), "key", total)
        left = stored(inside.where(bucket == F.col("edge")).select("key", "size", "h"))
        rest, total = edge.select("key", "rest"), left.count()
    return edge.select("key", "threshold", "rest", "words")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every row: how many of its words, repeats counted, the mix takes."""
    rows = stored(measured(docs, id_col, text_col, source_col))
    sizes = rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goals = targets(sizes, weights, share, most).withColumn("goal", F.floor(F.col("target") + 0.5))
    goals = goals.withColumn("copies", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(0))
    goals = checkpointed(goals.withColumn("budget", F.col("goal") - F.col("copies") * F.col("source_size")))
    total = rows.count()
    ends = thresholds(rows, goals.where("budget > 0"), total)
    named = checkpointed(goals.join(ends, "key", "left").select("key", "source_size", "target", "copies", "threshold", "rest", "words", "n"))
    joined = meet(rows, named, "key", total)
    extra = F.when(F.col("h") < F.col("threshold"), F.col("size")).when(F.col("h") == F.col("threshold"), F.expr("least(size, (2 * size * rest + words) div (2 * words))")).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + extra).cast("long").alias("taken"), named_source().alias("source"))
