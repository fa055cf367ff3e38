"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, strips accents, joins compatibility forms, maps look-alike letters, digits and symbols inside words
to one letter each, drops invisible characters and turns all else into single blanks. i, l and 1 are one letter.
Lexicon entries are whole words or beginnings of words, with a weight: the log of how much likelier a toxic training row
uses the entry, word for word, than a clean one. A hit inside an exception phrase doesn't count; of several entries that begin at one
word the heaviest counts. The summed weight, alone and over the square root of the length in words, goes through a
logistic curve fitted on training rows.

The fit reads a bounded sample of labelled rows: about FIT_ROWS, those of least hash, with either label, each text once. Lexicon
and exceptions are bounded (LEXICON, EXCEPTIONS), so the model can be broadcast; scoring is one map over whole texts.

Defined cases: null and empty texts score as texts without a hit; labels null or for unknown ids are ignored, of
contrary labels for one id the toxic one counts; with no toxic training row every score is 0; repeated rows are scored
row by row; other columns are ignored (keep_clean() keeps them).
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, fold

FOLDS, HELD, THRESHOLD = 4, 2, 0.3
FIT_ROWS, CANDIDATES, LEXICON, EXCEPTIONS = 10_000, 50_000, 2000, 2000
PREFIXES, LEAST_WEIGHT, LEAST_GAIN = (4, 5, 6, 7), 1.5, 20.0
#: Letters that look like a Latin one, then digits and symbols read as letters within a word.
ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point of the basic plane what it folds to (0: nothing); which ones fold to a letter only within a word."""
    to, inner = np.full(1 << 16, 32, np.uint32), np.zeros(1 << 16, bool)
    for c in range(1 << 16):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind in ("Mn", "Me", "Cf", "Cs"):
            to[c] = 0
        elif kind[0] in "LN":
            base = [x for x in unicodedata.normalize("NFKD", ch).lower() if unicodedata.category(x)[0] in "LN"]
            x = base[0] if base else ch
            x = DIGITS.get(ALIKE.get(x, x), ALIKE.get(x, x))
            to[c] = ord("i" if x == "l" else x)
        elif ch in SYMBOLS:
            to[c], inner[c] = ord(SYMBOLS[ch]), True
    return to, inner


def folded(text: str | None) -> str:
    """The words of a text, folded, each between blanks."""
    if not text:
        return " "
    to, inner = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if (points >> 16).any():
        points = np.frombuffer(unicodedata.normalize("NFKC", text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.where(points >> 16, 32, to[np.minimum(points, 0xFFFF)])
    odd = np.flatnonzero(inner[np.minimum(points, 0xFFFF)])
    if len(odd):  # a symbol is a letter only with a letter or such a symbol on its left and a letter on its right
        word = (out != 32) & (out != 0)
        solid = word & ~inner[np.minimum(points, 0xFFFF)]
        left, right = np.concatenate([[False], word[:-1]]), np.concatenate([solid[1:], [False]])
        bad = odd[~(left[odd] & right[odd])]
        out = out.copy()
        out[bad] = 32
    out = np.concatenate([[32], out[out != 0], [32]]).astype(np.uint32)
    out = out[np.concatenate([[True], (out[1:] != 32) | (out[:-1] != 32)])]
    return out.tobytes().decode("utf-32-le", "surrogatepass")


def fold_entry(entry: str) -> str:
    """A lexicon entry or phrase, as matched: whole words, or with a final * the beginning of a word."""
    return folded(entry.rstrip("*")).rstrip() if entry.endswith("*") else folded(entry)


class Lexicon:
    """entries: folded pattern (begins with a blank) to weight. exceptions: folded phrases."""

    def __init__(self, entries: dict[str, float], exceptions: set[str] = frozenset(), curve=(-5.0, 0.5, 2.0, 1.5)):
        self.entries, self.exceptions, self.curve, self._machine = entries, set(exceptions), curve, None

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for x in {*self.entries, *self.exceptions}:
                self._machine.add_word(x, (len(x), self.entries.get(x), x in self.exceptions))
            self._machine.make_automaton()
        return self._machine

    def hits(self, text: str) -> list[tuple[int, float]]:
        """(where in the folded text, weight) of each word that an entry hits, outside exceptions."""
        if not self.entries:
            return []
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight, excepted) in self.machine().iter(text):
            start = end - size + 1
            if excepted:
                spared.append((start, end))
            if weight is not None and weight > best.get(start, 0.0):
                best[start] = weight
        if spared and best:
            spared.sort()
            starts = np.array([s for s, _ in spared])
            reach = np.maximum.accumulate([e for _, e in spared])
            best = {k: v for k, v in best.items() if (i := np.searchsorted(starts, k, "right") - 1) < 0 or reach[i] <= k}
        return sorted(best.items())

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Of the summed weight: its log, and its share by the root of the length and by the length."""
        plain = folded(text)
        total, words = sum(w for _, w in self.hits(plain)), max(1, plain.count(" ") - 1)
        return math.log1p(total), total / math.sqrt(words), math.log1p(100 * total / words)

    def score(self, text: str | None) -> float:
        if not self.entries:
            return 0.0
        z = self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _tokens(plain: str) -> Counter:
    """Entries that a folded text could support, and how often: its words, and beginnings of longer words."""
    n = Counter()
    for w, k in Counter(plain.split()).items():
        n[f" {w} "] += k
        for size in PREFIXES:
            if len(w) > size:
                n[f" {w[:size]}"] += k
    return n


def _tally(texts, wanted=None) -> pd.DataFrame:
    docs, times = Counter(), Counter()
    for x in texts:
        n = _tokens(folded(x))
        if wanted is not None:
            n = {t: k for t, k in n.items() if t in wanted}
        docs.update(n.keys())
        times.update(n)
    return pd.DataFrame({"token": list(docs), "docs": list(docs.values()), "times": [times[t] for t in docs]}).astype({"token": str, "docs": "int64", "times": "int64"})


def _gain(a: int, of_a: int, b: int, of_b: int) -> float:
    """Log-likelihood ratio (G squared) of an entry's document counts in both classes."""
    share = (a + b) / (of_a + of_b)
    cells = ((a, of_a * share), (of_a - a, of_a * (1 - share)), (b, of_b * share), (of_b - b, of_b * (1 - share)))
    return sum(2 * got * math.log(got / expected) for got, expected in cells if got)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col, FOLDS) != HELD))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col).cast("int") == 1).cast("int")).alias("toxic"))
    # about fit_rows of least hash with either label: a bar on the hash, which is spread evenly, follows from their number
    h = F.xxhash64("id")
    known = checkpointed(known)
    bars = {r["toxic"]: -(1 << 63) + (1 << 64) * fit_rows // r["count"] for r in known.groupBy("toxic").count().collect() if r["count"] > fit_rows}
    low = F.lit(True)
    for label, bar in bars.items():
        low &= (F.col("toxic") != label) | (h <= bar)
    picked = F.broadcast(known.where(low))  # bounded by the bars
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.join(picked, "id").dropDuplicates(["toxic", "text"]).select("toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon learned from labelled rows whose fold isn't the held-out one. exceptions: further phrases that never count."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = checkpointed(_sample(docs, labels, id_col, text_col, label_col, fit_rows))  # at most twice fit_rows
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic:
        return Lexicon({})
    least = max(3, round(0.01 * n_toxic))
    words = {r["toxic"]: max(1, r["n"]) for r in rows.groupBy("toxic").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).collect()}
    schema = "token string, docs long, times long"
    both = (F.sum("docs").alias("docs"), F.sum("times").alias("times"))
    counts = rows.where("toxic = 1").mapInPandas(lambda dfs: (_tally(df["text"]) for df in dfs), schema).groupBy("token").agg(*both)
    toxic = {r["token"]: (r["docs"], r["times"]) for r in counts.where(F.col("docs") >= least).orderBy(F.desc("docs"), "token").limit(CANDIDATES).collect()}
    wanted = spark.sparkContext.broadcast(frozenset(toxic))
    counts = rows.where("toxic = 0").mapInPandas(lambda dfs: (_tally(df["text"], wanted.value) for df in dfs), schema).groupBy("token").agg(*both)
    clean = {r["token"]: (r["docs"], r["times"]) for r in counts.collect()}  # at most CANDIDATES
    none = (0, 0)
    weight = {t: math.log((n + 0.5) / words[1]) - math.log((clean.get(t, none)[1] + 0.5) / words.get(0, 1)) for t, (_, n) in toxic.items()}
    gain = {t: _gain(d, n_toxic, clean.get(t, none)[0], n_clean) for t, (d, _) in toxic.items()}
    entries: dict[str, float] = {}
    stems: set[str] = set()
    for t in sorted(toxic, key=lambda t: (-gain[t], -len(t), t)):
        stem = t.rstrip()
        if weight[t] < LEAST_WEIGHT or gain[t] < LEAST_GAIN or len(entries) >= LEXICON or stem in stems:
            continue
        if not any(stem[:n] in entries for n in range(2, len(stem) + 1)):
            entries[t] = weight[t]
            stems |= {stem[:n] for n in range(2, len(stem) + 1)}
    lexicon = Lexicon(entries, {fold_entry(x) for x in exceptions})
    shared = spark.sparkContext.broadcast(lexicon)

    def contexts(batches):
        for df in batches:
            n: dict[str, list[int]] = {}
            for x, toxic in zip(df["text"], df["toxic"], strict=True):
                plain, seen = folded(x), set()
                for at, _ in shared.value.hits(plain):
                    end = plain.index(" ", at + 1)
                    seen.add(plain[at : end + 1])
                    before, after = plain.rfind(" ", 0, at) if at else -1, plain.find(" ", end + 1)
                    seen |= {plain[before : end + 1]} if before >= 0 else set()
                    seen |= {plain[at : after + 1]} if after >= 0 else set()
                for p in seen:
                    n.setdefault(p, [0, 0])[int(toxic)] += 1
            yield pd.DataFrame({"phrase": list(n), "clean": [c for c, _ in n.values()], "toxic": [t for _, t in n.values()]}).astype({"phrase": str, "clean": "int64", "toxic": "int64"})

    seen = rows.mapInPandas(contexts, "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    kind = seen.where("c >= 2 and t = 0").orderBy(F.desc("c"), "phrase").limit(EXCEPTIONS).collect()
    lexicon = Lexicon(entries, lexicon.exceptions | {r["phrase"] for r in kind})
    final = spark.sparkContext.broadcast(lexicon)

    def features(batches):
        for df in batches:
            x = [final.value.features(t) for t in df["text"]]
            yield pd.DataFrame({"x": x, "toxic": df["toxic"].astype("int32")})

    got = rows.mapInPandas(features, "x array<double>, toxic int").collect()  # at most twice fit_rows
    lexicon.curve = _logistic(np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton's method; the ridge keeps weights finite where the labels can be told apart without error."""
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1)) * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep / 10, x.T @ (p - y) + keep @ w / 10)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for b in batches:
            s = np.array([shared.value.score(x) for x in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype("int32"))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, FOLDS) == HELD).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score under the threshold."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([shared.value.score(x) < threshold for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
