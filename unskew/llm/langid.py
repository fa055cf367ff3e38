"""Language identification by rank-order profiles (out-of-place distance of the most frequent n-grams).

A text's letters, lower-cased, form words bounded by one blank; its n-grams are the runs of one to three such characters
within a word and its blanks. The PROFILE most frequent ones, in order (ties by code), make the text's profile; a
language's profile is made alike from all training texts of the language. A profile's distance to a language is the sum
over its n-grams of the difference in rank, or PROFILE for an n-gram that the language's profile lacks.

The fit reads a bounded sample: for each language about FIT_ROWS labelled training
documents, those of least hash. Prediction is
one map over whole texts without a shuffle; what it broadcasts is PROFILE n-grams a language.

Defined cases: a null text or one without letters is `und` with score 0; ties of distance go to the alphabetically first
language; with nothing to learn from every document is `und`; repeated rows and ids are predicted row by row; other
columns are ignored (keep_known() keeps them). Texts are read whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fold

PROFILE, FIT_ROWS, FOLDS = 400, 3000, 5
_PIECE = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    """Of each code point of the basic plane, itself if a letter, else a blank."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(1 << 16)], dtype=np.uint32)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's n-grams; long texts are counted by pieces, so that memory stays bounded."""
    codes, counts, at = [], [], 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text):  # cut at a blank, so that no n-gram is lost, unless one word is as long as the piece
            end = max(text.rfind(" ", at, end), text.rfind("\n", at, end)) + 1 or end
            end = end if end > at else at + _PIECE
        points = np.frombuffer(f" {text[at:end]} ".lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = end
        low = points < 1 << 16
        chars = _letters()[np.where(low, points, 32)].astype(np.int64)
        if not low.all():
            some, where = np.unique(points[~low], return_inverse=True)
            chars[~low] = np.array([c if chr(c).isalpha() else 32 for c in some.tolist()])[where]
        chars = chars[np.concatenate([[True], (chars[1:] != 32) | (chars[:-1] != 32)])]
        letter = chars != 32
        two, three = chars[:-1] << 21 | chars[1:], chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:]
        grams = np.concatenate([chars[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]])
        code, count = np.unique(grams, return_counts=True)
        codes.append(code)
        counts.append(count)
    if len(codes) < 2:
        return (codes[0], counts[0]) if codes else (np.empty(0, np.int64), np.empty(0, np.int64))
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, in order."""
    return codes[np.lexsort((codes, -counts))[:size]]


def _count(batches):
    for df in batches:
        for lang, texts in df.groupby("lang")["text"]:
            grams = [ngrams(x) for x in texts]
            codes, at = np.unique(np.concatenate([c for c, _ in grams]), return_inverse=True)
            yield pd.DataFrame({"lang": lang, "gram": codes, "n": np.bincount(at, np.concatenate([n for _, n in grams]), len(codes)).astype(np.int64)})


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's profile, from rows whose fold isn't 0."""
    bounded_batches(docs.sparkSession)
    rows = docs.where((fold(id_col, FOLDS) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # about fit_rows of least hash in each language: a bar on the hash, which is spread evenly, follows from their number
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h"))
    bars = {r["lang"]: -(1 << 63) + (1 << 64) * fit_rows // r["count"] for r in rows.groupBy("lang").count().collect() if r["count"] > fit_rows}
    low = F.lit(True)
    for lang, bar in bars.items():
        low &= (F.col("lang") != lang) | (F.col("h") <= bar)
    counts = rows.where(low).select("lang", "text").mapInPandas(_count, "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = total.withColumn("r", F.row_number().over(top)).where(F.col("r") <= profile)
    out: dict[str, list] = {}
    for r in kept.orderBy("lang", "r").collect():  # PROFILE rows a language
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


class Model:
    """Profiles of all languages side by side, for one lookup of a text's n-grams."""

    def __init__(self, profiles: dict[str, np.ndarray], profile: int = PROFILE):
        self.langs, self.profile = sorted(profiles), profile
        self.codes = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.int64)]))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, dtype=np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        mine = ranked(*ngrams(text), self.profile) if self.langs and text else ()
        if not len(mine):  # no letter
            return "und", 0.0
        at = np.searchsorted(self.codes, mine)
        at[(at >= len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != mine)] = len(self.codes)
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.profile, np.abs(ranks - np.arange(len(mine))[:, None])).sum(0)
        best = int(away.argmin())
        # 1 for no distance, 0 for nothing in common
        return self.langs[best], float(1 - away[best] / (self.profile * len(mine)))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score of every row."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Model(profiles))

    def run(batches):
        for b in batches:
            got = [model.value.predict(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, FOLDS) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The rows, with all their columns, whose language is recognised: not `und`, and a score over `least`."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Model(profiles))
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            got = [model.value.predict(x) for x in b.column(at).to_pylist()]
            yield b.filter(pa.array([lang != "und" and score > least for lang, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
