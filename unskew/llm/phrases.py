"""Phrase collocation mining with generalised suffix automata per shard.

A shard is a run of a task's texts, SHARD_BYTES at most. Its words are coded by one dictionary, and its pieces (texts cut at
PIECE_ENDS) go into one suffix automaton (`Automaton`): states are the classes of substrings that end at the same places,
each with the number of those places (endpos), its longest substring's length and its suffix link. Depth is bounded, so
the automaton is built level by level: the suffix links of a suffix automaton form the tree of the reversed text, and a
level of that tree is the one above with one word more to the left. All substrings of a state share its count, so a shard
gives its phrases and counts by walking states, never occurrences.

Counts are summed over shards. As each part of a phrase is at least as frequent as the phrase, only phrases whose parts are
frequent can be. The first pass counts words. The second one counts pairs of frequent words by buckets of their hash, which are
packed, so that rare pairs cost a few bytes and no row, and the third triples of such pairs. The last counts phrases all of whose
pairs and triples lie in buckets that are frequent as a whole. Frequent words and buckets reach the shards as bit tables of
MOST_BITS at most, whatever their number: a wrong bit costs rows, never a result, as sums of the phrases themselves decide.

Over all shards, a candidate's suffix link drops its first word, and its prefix its last. A phrase within a longer one is
within a phrase of one word more that is at least as frequent, so subsumption looks along these two edges alone. Parts of
cuts meet their counts by joins in which a part that very many candidates share is broadcast (`common.meet`). The best of each
language are taken by slices of its candidates first, so no window holds a language.

Defined cases: a null text is empty, a null language is `und`; texts without words count nothing; a text over SHARD_BYTES is cut at the
end of a piece, or else after a word, where the cut repeats the words that phrases across it need without
counting them again; rows of one id all count; an empty table gives no rows; other columns are ignored. Products are decimals of 38
digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import packed, unpacked
from .common import bounded_batches, meet, partitions, release, stored

#: Words of a phrase at most, its least count, percent of its count that a longer one absorbs, phrases of a language reported.
LONGEST, LEAST, ABSORBED, BEST = 4, 30, 80, 2000
SCALE = 2_000_000
SHARD_BYTES, BATCH, SLICE_ROWS = 6 << 20, 1 << 16, 100_000
#: Bucket counts that a task keeps before it passes them on.
HELD = 2_000_000
#: Bits for each frequent phrase, and of a table at most.
BITS_EACH, MOST_BITS = 16, 1 << 28
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
COUNTED = "lang string, phrase string, count long"
_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("count", pa.int64())])
_FOLDED = bytes(32 if b in BLANKS else 10 if b in PIECE_ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def parts_of(text: bytes, most: int, repeat: int):
    """(part, words repeated from the part before) of a folded text: cut at piece ends, else after words, `most` bytes where it can."""
    new = skip = 0
    while len(text) - new > most:
        cut = text.rfind(b"\n", new + 1, new + most)
        if cut < 0:
            cut = text.rfind(b" ", new + 1, new + most)
        if cut < 0:  # one word
            cut = min((i for i in (text.find(b" ", new + most), text.find(b"\n", new + most)) if i >= 0), default=-1)
        if cut < 0:
            break
        yield text[:cut], skip
        again = text[:cut].rsplit(None, repeat)[-repeat:] if repeat and text[cut] == 32 else []
        text, new, skip = b" ".join(again) + text[cut:], len(b" ".join(again)), len(again)
    yield text, skip


class Words:
    """The words of a shard's folded texts in order: dictionary, codes, whether a word follows another one in its piece, its
    text's language, and whether phrases that end there count."""

    def __init__(self, texts: list[bytes], langs: list[int], skipped: list[int]):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        blank = (data == 32) | (data == 10)
        starts = np.flatnonzero(~blank & np.concatenate([np.ones(min(1, len(data)), bool), blank[:-1]]))
        ends = np.flatnonzero(~blank & np.concatenate([blank[1:], np.ones(min(1, len(data)), bool)])) + 1
        piece = np.searchsorted(np.flatnonzero(data == 10), starts)
        self.joined = np.concatenate([np.zeros(min(1, len(starts)), bool), piece[1:] == piece[:-1]])
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~blank])]).dictionary_encode()
        self.dictionary, self.codes = words.dictionary, words.indices.to_numpy()
        text_of = np.searchsorted(np.cumsum([0] + [len(t) + 1 for t in texts]), starts, side="right") - 1
        self.lang = np.asarray(langs, np.int64)[text_of]
        first = np.searchsorted(text_of, np.arange(len(texts)))
        self.fresh = np.ones(len(starts), bool)
        for at, n in zip(first.tolist(), skipped, strict=True):
            self.fresh[at : at + n] = False


class Automaton:
    """Suffix automaton of runs of words, for substrings of at most `depth` words.

    codes: the words; joined: whether a word follows the one before it in a run; fresh: whether substrings that end there count.
    Of each state: length (of its longest substring), shortest, link (the state of its longest suffix that ends at more places, -1
    for none), count (endpos), end (one of those places).
    """

    def __init__(self, codes: np.ndarray, joined: np.ndarray, fresh: np.ndarray, depth: int):
        all_places = np.arange(len(codes))
        reach = all_places - np.maximum.accumulate(np.where(joined, 0, all_places)) if len(codes) else all_places  # words to the left in the run
        counts, ends, parents, nodes = [], [], [], np.zeros(len(codes), np.int64)
        span = int(codes.max()) + 1 if len(codes) else 1
        for d in range(depth):
            places = np.flatnonzero(reach >= d)
            if not len(places):
                break
            _, first, at = np.unique(nodes[places] * span + codes[places - d], return_index=True, return_inverse=True)
            parents.append(nodes[places[first]])
            counts.append(np.bincount(at, fresh[places], len(first)).astype(np.int64))
            ends.append(places[first])
            nodes[places] = at
        sizes = [len(c) for c in counts]
        base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        # a node whose one extension to the left ends at the same places is of its state
        owner = np.arange(base[-1])
        for d in range(len(sizes) - 1, 0, -1):
            same = np.flatnonzero(counts[d] == counts[d - 1][parents[d]])
            owner[base[d - 1] + parents[d][same]] = owner[base[d] + same]
        kept = owner == np.arange(base[-1])
        number, length = np.cumsum(kept) - 1, np.repeat(np.arange(1, len(sizes) + 1), sizes)
        shortest, link = length.copy(), np.full(base[-1], -1, np.int64)
        for d in range(1, len(sizes)):
            up, own = owner[base[d - 1] + parents[d]], owner[base[d] : base[d + 1]]
            head = own != up  # the shortest of its state, whose parent is of the linked one
            link[own[head]], shortest[own[head]] = number[up[head]], d + 1
        if sizes:
            own = owner[: sizes[0]]
            link[own], shortest[own] = -1, 1
        self.length, self.shortest, self.link = length[kept], shortest[kept], link[kept]
        self.count = np.concatenate([*counts, np.zeros(0, np.int64)])[kept]
        self.end = np.concatenate([*ends, np.zeros(0, np.int64)])[kept]

    def states_of(self, n: int) -> np.ndarray:
        """The states that hold a substring of n words that counts; each holds one of a length at most."""
        return np.flatnonzero((self.shortest <= n) & (n <= self.length) & (self.count > 0))


def _mixed(words: list[np.ndarray], lang: np.ndarray, bits: int) -> np.ndarray:
    """Places in a table of 2 ** bits bits of phrases given by their words' and languages' hashes."""
    h = lang.copy()
    for w in words:
        h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)


def _hashes(strings: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in strings.to_pylist()], np.uint64)


class Frequent:
    """A bit table of phrases of n words (n: 1, 2 or 3): those that are frequent are in it, and few others."""

    def __init__(self, n: int, bits: int, parts: DataFrame):
        """parts: part, set (the bits of a part, 2 ** 15 bits or more each)."""
        self.n, self.bits = n, bits
        table = np.zeros(1 << (bits - 3), np.uint8)  # MOST_BITS / 8 bytes at most
        for r in parts.collect():
            table[r["part"] * len(r["set"]) : (r["part"] + 1) * len(r["set"])] = np.frombuffer(r["set"], np.uint8)
        self.table = parts.sparkSession.sparkContext.broadcast(table)

    def has(self, words: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
        at = _mixed(words, lang, self.bits)
        return (self.table.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _bits(wanted: int) -> int:
    return min(MOST_BITS, max(1 << 15, wanted)).bit_length() - 1


def frequent_words(words: DataFrame) -> Frequent:
    """Of lang, phrase (a word)."""
    bits = _bits(words.count() * BITS_EACH)

    def places(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_mixed([_hashes(b["phrase"])], _hashes(b["lang"]), bits))], ["at"])

    at = words.select("lang", "phrase").mapInArrow(places, "at long")
    return Frequent(1, bits, at.groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias("set")))


class Shard:
    """Words of a shard with the names of its languages, their hashes, and the runs that may hold frequent phrases."""

    def __init__(self, texts: list[bytes], langs: list[int], skipped: list[int], names: list[str], frequent: Frequent | None):
        words = Words(texts, langs, skipped)
        self.dictionary, self.names = words.dictionary, pa.array(names, pa.string())
        self.codes, self.lang, self.fresh, self.joined = words.codes, words.lang, words.fresh, words.joined
        if frequent is not None and len(self.codes):
            self.hash, self.lang_hash = _hashes(self.dictionary)[self.codes], _hashes(self.names)[self.lang]
            follows = self.joined.copy()
            if frequent.n == 1:
                good = frequent.has([self.hash], self.lang_hash)
                follows &= good & np.concatenate([[False], good[:-1]])
            else:
                at = np.flatnonzero(follows)
                follows[at] = frequent.has([self.hash[at - 1], self.hash[at]], self.lang_hash[at])
            kept = np.flatnonzero(follows | np.concatenate([follows[1:], [False]]))
            self.codes, self.lang, self.fresh, self.joined = self.codes[kept], self.lang[kept], self.fresh[kept], follows[kept]
            self.hash, self.lang_hash = self.hash[kept], self.lang_hash[kept]


def shards(batches, repeat: int, frequent: Frequent | None) -> Iterator[Shard]:
    """The texts of a task's batches (lang, text as bytes) by shards."""
    texts, langs, skipped, held, names = [], [], [], 0, {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            for part, skip in parts_of(text.translate(_FOLDED), SHARD_BYTES, repeat):
                texts.append(part)
                langs.append(names.setdefault(lang, len(names)))
                skipped.append(skip)
                held += len(part) + 1
                if held >= SHARD_BYTES:
                    yield Shard(texts, langs, skipped, list(names), frequent)
                    texts, langs, skipped, held, names = [], [], [], 0, {}
                    release()
    if texts:
        yield Shard(texts, langs, skipped, list(names), frequent)
    release()


def run_ends(shard: Shard, n: int) -> np.ndarray:
    """The places at which a run's n-th or later word stands."""
    ends = shard.joined.copy()
    for i in range(1, n - 1):
        ends[i:] &= shard.joined[:-i]
        ends[:i] = False
    return np.flatnonzero(ends)


def shard_counts(shard: Shard, least: int, depth: int, triples: Frequent | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, phrase, count) of one shard, for phrases of `least` to `depth` words, whose triples are all frequent; with
    single words, a row a language without a phrase that counts all its words."""
    if not len(shard.codes):
        return
    codes = shard.codes.astype(np.int64)
    automaton = Automaton(codes * len(shard.names) + shard.lang, shard.joined, shard.fresh, depth)
    if least == 1:
        n = np.bincount(shard.lang, shard.fresh, len(shard.names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([shard.names, pa.nulls(len(n), pa.string()), pa.array(n)], schema=_ARROW)
    good = np.ones(len(codes), bool)
    if triples is not None:
        at = run_ends(shard, 3)
        good[at] = triples.has([shard.hash[at - 2], shard.hash[at - 1], shard.hash[at]], shard.lang_hash[at])
    for n in range(least, depth + 1):
        every = automaton.states_of(n)
        for i in range(n - 2):
            every = every[good[automaton.end[every] - i]]
        for start in range(0, len(every), BATCH):
            states = every[start : start + BATCH]
            end = automaton.end[states]
            told = [shard.dictionary.take(pa.array(codes[end - i])) for i in range(n - 1, -1, -1)]
            phrases = pc.binary_join_element_wise(*told, " ") if n > 1 else told[0]
            yield pa.RecordBatch.from_arrays([shard.names.take(pa.array(shard.lang[end])), phrases, pa.array(automaton.count[states])], schema=_ARROW)


def counted(docs: DataFrame, least: int, depth: int, frequent: Frequent | None = None, triples: Frequent | None = None) -> DataFrame:
    """lang, phrase, f over all of docs (lang, text as bytes), for phrases of `least` to `depth` words."""

    def run(batches):
        for shard in shards(batches, depth - 1, frequent):
            yield from shard_counts(shard, least, depth, triples)

    return docs.mapInArrow(run, COUNTED).groupBy("lang", "phrase").agg(F.sum("count").alias("f"))


def _added(ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(ids), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def frequent_runs(docs: DataFrame, shorter: Frequent, least: int) -> Frequent:
    """The buckets of phrases a word longer than `shorter` ones, whose parts are among those, that `least` or more fall into, from
    packed counts: each part of the buckets is summed by one task, a part at a time."""
    spark, n = docs.sparkSession, shorter.n + 1
    bits = _bits((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 4)
    part_bits = min(bits - 15, max(0, (partitions(spark) - 1).bit_length()))
    low = bits - part_bits

    def packs(ids: np.ndarray, counts: np.ndarray):
        ends = np.searchsorted(ids, np.arange(1, (1 << part_bits) + 1) << low)
        starts = np.concatenate([[0], ends[:-1]])
        parts = np.flatnonzero(ends > starts)
        blobs = [packed(ids=ids[starts[p] : ends[p]] & ((1 << low) - 1), n=counts[starts[p] : ends[p]]) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def run(batches):
        ids, counts, held = [], [], 0
        for shard in shards(batches, n - 1, shorter):
            at = run_ends(shard, n)
            at = at[shard.fresh[at]]
            if len(at):
                found, times = np.unique(_mixed([shard.hash[at - i] for i in range(n - 1, -1, -1)], shard.lang_hash[at], bits), return_counts=True)
                ids, counts, held = [*ids, found], [*counts, times], held + len(found)
            if held >= HELD:
                ids, counts = ([x] for x in _added(ids, counts))
                held = len(ids[0])
                if held >= HELD // 2:
                    yield from packs(ids[0], counts[0])
                    ids, counts, held = [], [], 0
        if held:
            yield from packs(*_added(ids, counts))

    def add(batches):
        part, sums = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())], ["part", "set"])
        for b in batches:
            for p, blob in zip(b["part"].to_pylist(), b["blob"].to_pylist(), strict=True):
                if p != part:
                    if part is not None:
                        yield done()
                    part, sums = p, np.zeros(1 << low, np.int64 if low < 20 else np.int32)
                got = unpacked(blob)
                at = got["ids"].astype(np.int64)
                sums[at] = np.minimum(sums[at] + got["n"].astype(np.int64), least)  # more than `least` tells nothing
        if part is not None:
            yield done()

    blobs = docs.mapInArrow(run, "part int, blob binary").repartition(1 << part_bits, "part").sortWithinPartitions("part")
    return Frequent(n, bits, blobs.mapInArrow(add, "part int, set binary"))


def unabsorbed(candidates: DataFrame, share: int = ABSORBED) -> DataFrame:
    """candidates (lang, phrase, f) without those within a longer one of at least `share` percent of their count."""
    link, prefix = F.expr("substring(phrase, locate(' ', phrase) + 1)"), F.expr("substring_index(phrase, ' ', size(split(phrase, ' ')) - 1)")
    longer = candidates.where(F.size(F.split("phrase", " ")) > 2).select("lang", F.explode(F.array(link, prefix)).alias("phrase"), "f")
    over = longer.groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    much = F.col("over").cast("decimal(19,0)") * F.lit(100).cast("decimal(3,0)") >= F.col("f").cast("decimal(19,0)") * F.lit(share).cast("decimal(3,0)")
    return candidates.join(over, ["lang", "phrase"], "left").where(~F.coalesce(much, F.lit(False))).drop("over")


def scored(candidates: DataFrame, known: DataFrame, longest: int) -> DataFrame:
    """lang, phrase, a, l, r, score: each candidate by its lowest cut. known: lang, phrase, f of every part of a candidate."""
    words = F.split("phrase", " ")
    size = F.size(words)
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    side = lambda start, n, of: F.struct(F.lit(of).alias("side"), F.array_join(F.slice("words", start, n), " ").alias("part"))
    asks = cuts.withColumn("half", F.explode(F.array(side(F.lit(1), F.col("k"), 0), side(F.col("k") + 1, F.size("words") - F.col("k"), 1))))
    asks = stored(asks.select("lang", "phrase", "a", "k", "half.side", F.struct("lang", "half.part").alias("key")))
    uses = asks.groupBy("key").agg(F.count("*").alias("n"))
    named = uses.join(known.select(F.struct("lang", F.col("phrase").alias("part")).alias("key"), "f"), "key")
    told = meet(asks, named, "key", asks.count())
    at = lambda k, s: F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f")))
    every = range(1, longest)
    wide = told.groupBy("lang", "phrase", "a").agg(*[at(k, s).alias(f"f{k}{s}") for k in every for s in (0, 1)])
    score = lambda k: F.expr(f"(CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div CAST(f{k}0 + f{k}1 AS DECIMAL(20,0))")
    cut = lambda k: F.when(F.col(f"f{k}0").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"f{k}0").alias("l"), F.col(f"f{k}1").alias("r")))
    wide = wide.withColumn("cut", F.array_min(F.array(*[cut(k) for k in every])))
    return wide.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def best_of(rows: DataFrame, best: int) -> DataFrame:
    """rows with rank, the first `best` of each language; by slices of about SLICE_ROWS rows first, so that no window holds a language."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    while (total := rows.count()) > SLICE_ROWS:
        slice_ = F.pmod(F.xxhash64("phrase"), F.lit(-(-total // SLICE_ROWS)))
        fewer = stored(rows.withColumn("slice", slice_).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= best).drop("rank", "slice"))
        if fewer.count() == total:
            break
        rows = fewer
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, absorbed: int = ABSORBED, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best collocations of each language."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    enough = F.col("f") >= least
    first = stored(counted(rows, 1, 1).where(enough | F.col("phrase").isNull()))
    totals, words = first.where("phrase IS NULL").select("lang", F.col("f").alias("n")), first.where("phrase IS NOT NULL")
    pairs = frequent_runs(rows, frequent_words(words), least)
    candidates = stored(counted(rows, 2, longest, pairs, frequent_runs(rows, pairs, least) if longest > 2 else None).where(enough))
    found = stored(scored(unabsorbed(candidates, absorbed), words.unionByName(candidates), longest))
    return best_of(found, best).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
