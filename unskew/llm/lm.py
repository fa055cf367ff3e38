"""Language-model scores by deleted interpolation of word unigrams and bigrams.

p(w | h) = a * c(h, w) / c(h) + b * c(w) / N + z / (V + 1), where the mixture weights a, b, z belong to the bucket of the
context's frequency (its number of bits). They are learned by expectation-maximisation on counts that are held out: the
training documents of fold DELETED are predicted from the counts of the others. Afterwards all training documents count.
The token before the first and after the last word is the end token. A context that was never seen has no a.

Data flow. Words are 64-bit hashes. (1) Each task counts its words; counts meet by hash in as many parts as there are
shuffle partitions, or more, so that a part holds what PART_BYTES of text bring. Tasks also report pairs that are frequent in them. (2) Two tables of bounded size are broadcast: up to
HOT of the most frequent words with their exact counts, and up to SHARE of the reported pairs of such words. (3) Each task
turns its documents into word pairs. Of a table pair only the number travels, and its occurrences wait beside their
document, so that no pair is too frequent for a part. The other pairs are routed: by the pair if both words are hot, by
the rare word if one is, else by the context; each part sees all occurrences of its pairs, and its own word counts supply
what the table lacks. (4) Pairs of two rare words go on to the second word's part. (5) What was found for each pair, and
which documents hold it, is written to the shared folder; the mixture weights follow from a histogram of it of
bounded size; one more pass sums up each document.

All steps move columns packed into binary values, one for each task and part, so that Spark sees few rows. The tables only
save travel: every pair and word is counted exactly, nothing is sampled, cut or dropped, and no task holds more than a
part or a flush of FLUSH tokens. Documents are told by task and place, so their rows must come in a repeatable order, as from
files; pass others through common.stored() first.

Defined cases: a null or blank text is the end token alone; without training documents the base score is 0 and so is the
score; without a deleted fold the weights are fixed; ids may be null or repeated, each row is scored by itself; an empty
table gives no rows; other columns are ignored. Two words of one hash would count as one (odds below 1e-6 for a million
words).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import packed, unpacked
from .common import bounded_batches, fold, partitions, release, stored

FOLDS, HELD, DELETED = 10, 0, 1
#: Hot words, and the least share (one in) of a pair in the table, at most; tokens and distinct words of a flush.
HOT, SHARE, FLUSH, TYPES = 1 << 16, 400_000, 800_000, 400_000
BUCKETS, CHUNK, PART_BYTES = 40, 250_000, 32 << 20
ADD = 0.1
FIXED = (0.5, 0.4, 0.1)
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
ROUTED = "part int, kind int, origin long, payload binary"
FOUND = "kind int, key long, weight double, payload binary"
INFO, PAIRS, HISTOGRAM, ONWARD, COUNTED, WAITING = range(6)
_U64 = np.empty(0, np.uint64)
_I64 = np.empty(0, np.int64)


@dataclass
class Size:
    hot: int = HOT
    share: int = SHARE
    flush: int = FLUSH
    types: int = TYPES


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _slots(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands among sorted keys; -1 if nowhere."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return (key % np.uint64(parts)).astype(np.int64)


def _cuts(sorted_: np.ndarray):
    """(from, to) of each run of equal values."""
    ends = np.flatnonzero(np.concatenate([sorted_[1:] != sorted_[:-1], [True]])) + 1 if len(sorted_) else _I64
    return zip([0, *ends[:-1]], ends, strict=False)


def _frame(kind: int, key, payload, weight=0.0) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, "key": key, "weight": weight, "payload": payload})


def _arrow(rows: list[tuple], names: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(names)], [n for n, _ in names])


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    part = fold(id_col, FOLDS)
    kind = F.when(part == HELD, 0).when(part == DELETED, 1).otherwise(2)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), kind.cast("int").alias("fold"), F.col(text_col).alias("text"))


@dataclass
class _Flush:
    """Documents gathered until they are enough: distinct words and one flat line of word numbers, end tokens (0) between."""

    size: Size
    number: dict = field(default_factory=lambda: {b"": 0})
    flat: list = field(default_factory=lambda: [0])
    sizes: list = field(default_factory=list)
    folds: list = field(default_factory=list)
    ids: list = field(default_factory=list)

    def add(self, doc_id, fold_, text) -> None:
        words, number = words_of(text), self.number
        self.flat.extend([number.setdefault(w, len(number)) for w in words])
        self.flat.append(0)
        self.sizes.append(len(words) + 1)
        self.folds.append(fold_)
        self.ids.append(doc_id)

    def full(self) -> bool:
        return len(self.flat) > self.size.flush or len(self.number) > self.size.types

    def arrays(self):
        """Hash of each word number; previous and own number, document and fold of each token."""
        flat = np.array(self.flat, np.int32)
        doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.number), np.uint64, len(self.number))
        return hashes, flat[:-1], flat[1:], doc, np.array(self.folds, np.int8)[doc]


def _flushes(batches, size: Size):
    held = _Flush(size)
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            held.add(*row)
            if held.full():
                yield held
                held = _Flush(size)
                release()
    if held.sizes:
        yield held
    del held
    release()


def _count_words(parts: int, size: Size):
    def run(batches):
        for held in _flushes(batches, size):
            hashes, before, own, _, fold_ = held.arrays()
            n = len(hashes)
            all_, deleted = np.bincount(own, minlength=n), np.bincount(own[fold_ == DELETED], minlength=n)
            pair, times = np.unique(before.astype(np.int64) * n + own, return_counts=True)
            often = times * size.share > len(own)
            rows = []
            first, second, times = hashes[pair[often] // n], hashes[pair[often] % n], times[often]
            order = np.lexsort((second, first, _part(first, parts)))
            for a, b in _cuts(_part(first[order], parts)):  # reports of pairs go to parts of negative number
                one = order[a:b]
                rows.append((-1 - int(_part(first[one[:1]], parts)[0]), packed(a=first[one], b=second[one], n=times[one])))
            part = _part(hashes, parts)
            order = np.lexsort((hashes, part))
            order = order[all_[order] > 0]
            for a, b in _cuts(part[order]):
                one = order[a:b]
                rows.append((int(part[one[0]]), packed(word=hashes[one], all=all_[one], deleted=deleted[one])))
            yield _arrow(rows, [("part", pa.int32()), ("payload", pa.binary())])

    return run


def _merge(top: int):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        got = [unpacked(x) for x in df["payload"]]
        if df["part"].iloc[0] < 0:
            a, b = (np.concatenate([x[k].astype(np.uint64) for x in got]) for k in "ab")
            n = np.concatenate([x["n"] for x in got])
            order = np.lexsort((b, a))
            a, b, n = a[order], b[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else _I64
            pairs = packed(a=a[first], b=b[first], n=np.add.reduceat(n, first) if len(first) else n)
            return pd.DataFrame({"part": [int(df["part"].iloc[0])], "types": [0], "tokens": [0], "deleted": [0], "payload": [pairs], "hot": [None]})
        word, at = np.unique(np.concatenate([x["word"].astype(np.uint64) for x in got]), return_inverse=True)
        all_, deleted = (np.bincount(at, np.concatenate([x[n] for x in got]), len(word)).astype(np.int64) for n in ("all", "deleted"))
        del got, at
        release()
        hot = np.lexsort((word, -all_))[:top]
        return pd.DataFrame({
            "part": [int(df["part"].iloc[0])], "types": [len(word)], "tokens": [int(all_.sum())], "deleted": [int(deleted.sum())],
            "payload": [packed(word=word, all=all_, deleted=deleted)], "hot": [packed(word=word[hot], all=all_[hot], deleted=deleted[hot])],
        })

    return run


@dataclass
class _Table:
    """What is broadcast: hot words (sorted hashes) with counts, table pairs (sorted, of slots), totals."""

    word: np.ndarray
    all: np.ndarray
    deleted: np.ndarray
    pair: np.ndarray
    tokens: int
    types: int
    deleted_tokens: int
    parts: int
    size: Size

    @property
    def rare(self) -> int:
        """The code of the first word that isn't hot."""
        return len(self.word)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ADD) / (self.tokens + ADD * (self.types + 1)))


def _route(table):
    def run(batches):
        t: _Table = table.value
        task, k = TaskContext.get().partitionId(), 0
        for k, held in enumerate(_flushes(batches, t.size)):
            origin, n = task << 24 | k, len(held.sizes)
            hashes, before, own, doc, fold_ = held.arrays()
            code = _slots(t.word, hashes)
            hot = code >= 0
            code[~hot] = t.rare + np.arange(int((~hot).sum()))
            rare_words = hashes[~hot]
            base = np.where(hot, t.base(t.all[np.where(hot, code, 0)]) if t.rare else 0.0, 0.0)
            named = np.array([i is not None for i in held.ids], bool)
            info = packed(
                ids=np.array([i or 0 for i in held.ids], np.int64), named=named, fold=np.array(held.folds), n=np.array(held.sizes),
                base=np.bincount(doc, base[own], n), known=np.bincount(doc[hot[own]], minlength=n),
            )
            rows = [(origin % t.parts, INFO, origin, info)]
            x, y = code[before], code[own]
            both = hot[before] & hot[own]
            slot = np.full(len(x), -1)
            slot[both] = _slots(t.pair, x[both] << 32 | y[both])
            at = np.flatnonzero(slot >= 0)
            if len(at):
                rows.append((origin % t.parts, WAITING, origin, _waiting(slot[at], doc[at], n)))
                who, where = np.unique(slot[at], return_inverse=True)
                all_, deleted = np.bincount(where, fold_[at] > 0, len(who)), np.bincount(where, fold_[at] == DELETED, len(who))
                order = np.argsort(who % t.parts, kind="stable")
                for a, b in _cuts(who[order] % t.parts):
                    one = order[a:b]
                    rows.append((int(who[one[0]] % t.parts), COUNTED, origin, packed(pair=who[one], all=all_[one].astype(np.int64), deleted=deleted[one].astype(np.int64))))
            rest = np.flatnonzero(slot < 0)
            x, y, both = x[rest], y[rest], both[rest]
            hx, hy = hashes[before[rest]], hashes[own[rest]]
            part = _part(np.where(both, _mix(hx, hy), np.where(hot[before[rest]], hy, hx)), t.parts)
            order = np.argsort(part << 44 | x << 22 | y) if code.max() < 1 << 22 else np.lexsort((y, x, part))
            x, y, part, held_by = x[order], y[order], part[order], (doc[rest].astype(np.int64) << 2 | fold_[rest])[order]
            for a, b in _cuts(part):
                p, q = x[a:b], y[a:b]
                words = np.unique(np.concatenate([p[p >= t.rare], q[q >= t.rare]]))
                p, q = (np.where(v >= t.rare, t.rare + np.searchsorted(words, v), v) for v in (p, q))
                rows.append((int(part[a]), PAIRS, origin, packed(x=p, y=q, word=rare_words[words - t.rare], doc=held_by[a:b])))
            for i in range(0, len(rows), 256):
                yield _arrow(rows[i : i + 256], [("part", pa.int32()), ("kind", pa.int32()), ("origin", pa.int64()), ("payload", pa.binary())])

    return run


def _waiting(pair: np.ndarray, doc: np.ndarray, docs: int) -> bytes:
    key, n = np.unique(pair * docs + doc, return_counts=True)
    return packed(pair=key // docs, doc=key % docs, n=n)


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(np.floor(np.log2(np.maximum(c, 1))) + 1, BUCKETS - 1), 0).astype(np.int64)


def _code(share: np.ndarray) -> np.ndarray:
    """0 for a share of none, else 1 to 127 for half octaves up to 1."""
    return np.where(share > 0, np.clip(127 + np.floor(2 * np.log2(np.maximum(share, 1e-30))), 1, 127), 0).astype(np.int64)


def _histogram(t: _Table, held, c_hw, c_h, c_w) -> pd.DataFrame:
    """Of pairs with `held` deleted occurrences, with the counts of the other training documents."""
    some = held > 0
    held, c_hw, c_h, c_w = held[some], c_hw[some], c_h[some], c_w[some]
    code = _bucket(c_h) << 16 | _code(c_hw / np.maximum(c_h, 1)) << 8 | _code(c_w / max(1, t.tokens - t.deleted_tokens))
    code, at = np.unique(code, return_inverse=True)
    return _frame(HISTOGRAM, code, None, np.bincount(at, held, len(code)))


def _resolved(t: _Table, x, y, c_hw, c_h, c_w, n, doc, origin) -> pd.DataFrame:
    """Rows of pairs (codes x, y; counts; n occurrences each) with the document and origin of each occurrence."""
    ends, out, start, a = np.cumsum(n), [], 0, 0
    while start < len(n):
        stop = max(int(np.searchsorted(ends, a + CHUNK, "right")), start + 1)
        b = int(ends[stop - 1])
        names, at = np.unique(origin[a:b], return_inverse=True)
        p, q = x[start:stop], y[start:stop]
        rare_x, rare_y = p >= t.rare, q >= t.rare
        out.append(packed(
            x=np.minimum(p, t.rare), y=np.minimum(q, t.rare), c_hw=c_hw[start:stop], c_h=c_h[start:stop][rare_x], c_w=c_w[start:stop][rare_y],
            n=n[start:stop], doc=doc[a:b], origin=at, names=names,
        ))
        start, a = stop, b
    return _frame(PAIRS, 0, out)


def _known(t: _Table, words: np.ndarray, own: pd.DataFrame):
    """All and deleted counts by code: of hot words, then of `words` as this part knows them."""
    all_, deleted = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    if len(own):
        mine = unpacked(own["payload"].iloc[0])
        slot = _slots(mine["word"].astype(np.uint64), words)
        all_[slot >= 0], deleted[slot >= 0] = mine["all"][slot[slot >= 0]], mine["deleted"][slot[slot >= 0]]
    return np.concatenate([t.all, all_]), np.concatenate([t.deleted, deleted])


def _meet(table):
    def run(key, routed: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        t: _Table = table.value
        kind = routed["kind"].to_numpy()
        aside = routed[(kind == INFO) | (kind == WAITING)]
        out = [_frame(HISTOGRAM, _I64, None), pd.DataFrame({"kind": aside["kind"], "key": aside["origin"], "weight": 0.0, "payload": aside["payload"]})]
        if (kind == COUNTED).any():
            got = [unpacked(x) for x in routed.loc[kind == COUNTED, "payload"]]
            pair, at = np.unique(np.concatenate([x["pair"] for x in got]), return_inverse=True)
            c_hw, e_hw = (np.bincount(at, np.concatenate([x[k] for x in got]), len(pair)).astype(np.int64) for k in ("all", "deleted"))
            h, w = t.pair[pair] >> 32, t.pair[pair] & 0xFFFFFFFF
            out += [_frame(COUNTED, 0, [packed(pair=pair, c_hw=c_hw)]), _histogram(t, e_hw, c_hw - e_hw, t.all[h] - t.deleted[h], t.all[w] - t.deleted[w])]
        blobs = routed[kind == PAIRS]
        if len(blobs):
            got = [unpacked(x) for x in blobs["payload"]]
            words = np.unique(np.concatenate([x["word"].astype(np.uint64) for x in got]))
            pair, doc, origin = [], [], []
            for x, name in zip(got, blobs["origin"], strict=True):
                to = np.concatenate([np.arange(t.rare), t.rare + np.searchsorted(words, x["word"].astype(np.uint64))])
                pair.append(to[x["x"]] << 32 | to[x["y"]])
                doc.append(x["doc"].astype(np.int32))
                origin.append(np.full(len(x["doc"]), name))
            del got
            pair, doc, origin = map(np.concatenate, (pair, doc, origin))
            order = np.argsort(pair, kind="stable")
            pair, doc, origin = pair[order], doc[order], origin[order]
            del order
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            n = np.diff([*first, len(pair)])
            c_hw, e_hw = np.add.reduceat(doc & 3 > 0, first, dtype=np.int64), np.add.reduceat(doc & 3 == DELETED, first, dtype=np.int64)
            doc >>= 2
            x, y = pair[first] >> 32, pair[first] & 0xFFFFFFFF
            all_, deleted = _known(t, words, counts)
            c_h, e_h, c_w, e_w = all_[x], deleted[x], all_[y], deleted[y]
            # a rare second word after a rare first one belongs to another part, or by chance to this one
            here = (x < t.rare) | (y < t.rare)
            here[~here] = _part(words[y[~here] - t.rare], t.parts) == key[0]
            out.append(_histogram(t, np.where(here, e_hw, 0), c_hw - e_hw, c_h - e_h, c_w - e_w))
            those = np.repeat(here, n)
            out.append(_resolved(t, x[here], y[here], c_hw[here], c_h[here], c_w[here], n[here], doc[those], origin[those]))
            away = np.flatnonzero(~here)
            if len(away):
                to = _part(words[y[away] - t.rare], t.parts)
                for a, b in _cuts(np.sort(to)):
                    one = away[np.argsort(to, kind="stable")[a:b]]
                    at = np.repeat(first[one] - (np.cumsum(n[one]) - n[one]), n[one]) + np.arange(n[one].sum())
                    names, of = np.unique(origin[at], return_inverse=True)
                    blob = packed(word=words[y[one] - t.rare], n=n[one], c_hw=c_hw[one], e_hw=e_hw[one], c_h=c_h[one], e_h=e_h[one], doc=doc[at], origin=of, names=names)
                    out.append(_frame(ONWARD, int(_part(words[y[one[:1]] - t.rare], t.parts)[0]), [blob]))
        made = pd.concat(out)
        del out, aside, blobs
        release()
        return made

    return run


def _meet_onward(table):
    def run(key, onward: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        t: _Table = table.value
        if not len(onward):
            return _frame(PAIRS, _I64, None)
        got = [unpacked(x) for x in onward["payload"]]
        x = {k: np.concatenate([g[k] for g in got]) for k in ("n", "c_hw", "e_hw", "c_h", "e_h", "doc")}
        origin = np.concatenate([g["names"][g["origin"]] for g in got])
        words, y = np.unique(np.concatenate([g["word"].astype(np.uint64) for g in got]), return_inverse=True)
        all_, deleted = _known(t, words, counts)
        y = y + t.rare
        return pd.concat([
            _histogram(t, x["e_hw"], x["c_hw"] - x["e_hw"], x["c_h"] - x["e_h"], all_[y] - deleted[y]),
            _resolved(t, np.full(len(y), t.rare), y, x["c_hw"], x["c_h"], all_[y], x["n"], x["doc"], origin),
        ])

    return run


def mixture(codes: np.ndarray, held: np.ndarray, types: int, rounds: int = 200) -> np.ndarray:
    """BUCKETS x 3 weights of pair, word and uniform share, by expectation-maximisation over the histogram."""
    share = lambda c: np.where(c > 0, 2.0 ** ((c - 126.5) / 2), 0.0)
    bucket, seen = codes >> 16, np.stack([share(codes >> 8 & 255), share(codes & 255), np.full(len(codes), 1 / (types + 1))])
    out = np.tile(np.array(FIXED), (BUCKETS, 1))
    overall = None
    for b in [None, *range(BUCKETS)]:  # buckets that hold nothing out take the weights over all
        some = np.full(len(codes), True) if b is None else bucket == b
        w = np.array(FIXED) if overall is None else overall
        if b == 0:
            w = np.array([0.0, w[1], w[2]]) / (w[1] + w[2])
        if held[some].sum() > 0:
            x, n = seen[:, some], held[some]
            for _ in range(rounds):
                part = w[:, None] * x
                new = (part / part.sum(0) * n).sum(1) + 1e-6 * np.array([b != 0, True, True])
                new /= new.sum()
                if np.abs(new - w).max() < 1e-9:
                    break
                w = new
        if b is None:
            overall = w
        else:
            out[b] = w
    return out


def _log_p(t: _Table, weights: np.ndarray, c_hw, c_h, c_w) -> np.ndarray:
    w = weights[_bucket(c_h)]
    return np.log10(w[:, 0] * c_hw / np.maximum(c_h, 1) + w[:, 1] * c_w / max(1, t.tokens) + w[:, 2] / (t.types + 1))


def _sum_up(table, model):
    def sums(doc, score, rare_doc=_I64, rare_count=_I64) -> bytes:
        who, at = np.unique(doc, return_inverse=True)
        order = np.argsort(rare_doc, kind="stable")
        return packed(doc=who, score=np.bincount(at, score, len(who)), rare_doc=rare_doc[order], rare_count=rare_count[order])

    def run(dfs):
        t: _Table = table.value
        weights, pair_counts = model.value
        for df in dfs:
            rows = []
            for r in df.itertuples():
                if r.kind == INFO:
                    rows.append((int(r.key), INFO, r.payload))
                    continue
                x = unpacked(r.payload)
                if r.kind == WAITING:
                    h, w = t.pair[x["pair"]] >> 32, t.pair[x["pair"]] & 0xFFFFFFFF
                    rows.append((int(r.key), PAIRS, sums(x["doc"], _log_p(t, weights, pair_counts[x["pair"]], t.all[h], t.all[w]) * x["n"])))
                    continue
                rare_x, rare_y = x["x"] == t.rare, x["y"] == t.rare
                c_h, c_w = np.zeros(len(rare_x), np.int64), np.zeros(len(rare_x), np.int64)
                c_h[~rare_x], c_w[~rare_y] = t.all[x["x"][~rare_x]], t.all[x["y"][~rare_y]]
                c_h[rare_x], c_w[rare_y] = x["c_h"], x["c_w"]
                score, rare, count = (np.repeat(v, x["n"]) for v in (_log_p(t, weights, x["c_hw"], c_h, c_w), rare_y, c_w))
                order = np.argsort(x["origin"], kind="stable")
                for a, b in _cuts(x["origin"][order]):
                    one = order[a:b]
                    few = one[rare[one]]
                    rows.append((int(x["names"][x["origin"][one[0]]]), PAIRS, sums(x["doc"][one], score[one], x["doc"][few], count[few])))
            yield pd.DataFrame(rows, columns=["origin", "kind", "payload"]).astype({"origin": "int64", "kind": "int32"})
            rows.clear()
        release()

    return run


def _finish(table):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        t: _Table = table.value
        kind = df["kind"].to_numpy()
        info = unpacked(df.loc[kind == INFO, "payload"].iloc[0])
        base, known, score = info["base"].copy(), info["known"].copy(), np.zeros(len(info["n"]))
        for blob in df.loc[kind == PAIRS, "payload"]:
            x = unpacked(blob)
            score[x["doc"]] += x["score"]
            base += np.bincount(x["rare_doc"], t.base(x["rare_count"]), len(base))
            known += np.bincount(x["rare_doc"], x["rare_count"] > 0, len(base)).astype(np.int64)
        if not t.tokens:
            score[:], base[:] = 0.0, 0.0
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(info["ids"].copy(), info["named"] == 0), "held_out": info["fold"] == 0, "n_tokens": info["n"], "n_known": known,
            "train_tokens": t.tokens, "base_score": base, "score": score,
        })

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: Size | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark, size = docs.sparkSession, size or Size()
    bounded_batches(spark)
    rows = _documents(docs, id_col, text_col)
    bytes_ = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), -(-bytes_ // PART_BYTES))
    # a task a part, where there are more parts than shuffle partitions
    dealt = lambda df, key="part": df.repartition(parts, key) if parts > partitions(spark) else df
    counted = rows.where("fold > 0").mapInArrow(_count_words(parts, size), "part int, payload binary")
    counts = dealt(counted).groupBy("part").applyInPandas(_merge(max(1, size.hot // parts)), "part int, types long, tokens long, deleted long, payload binary, hot binary")
    counts = stored(counts)
    reported, counts = counts.where("part < 0").select("payload"), counts.where("part >= 0")
    totals = counts.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v"), F.sum("deleted").alias("e")).first()
    hot = [unpacked(r["hot"]) for r in counts.select("hot").collect()]  # size.hot words at most
    word = np.concatenate([_U64, *(x["word"].astype(np.uint64) for x in hot)])
    order = np.argsort(word)
    all_, deleted = (np.concatenate([_I64, *(x[k] for x in hot)])[order] for k in ("all", "deleted"))
    tokens = totals["n"] or 0
    pair = _table_pairs(reported, tokens, word[order], size)
    table = spark.sparkContext.broadcast(_Table(word[order], all_, deleted, pair, tokens, totals["v"] or 0, totals["e"] or 0, parts, size))
    known = counts.select("part", "payload")
    found = stored(dealt(rows.mapInArrow(_route(table), ROUTED)).groupBy("part").cogroup(dealt(known).groupBy("part")).applyInPandas(_meet(table), FOUND))
    onward = found.where(F.col("kind") == ONWARD).select(F.col("key").cast("int").alias("part"), "payload")
    onward = stored(dealt(onward).groupBy("part").cogroup(dealt(known).groupBy("part")).applyInPandas(_meet_onward(table), FOUND))
    both = found.unionByName(onward)
    histogram = both.where(F.col("kind") == HISTOGRAM).groupBy("key").agg(F.sum("weight").alias("n")).collect()  # BUCKETS * 2**14 rows at most
    weights = mixture(np.array([r["key"] for r in histogram], np.int64), np.array([r["n"] for r in histogram], float), table.value.types)
    pair_counts = np.zeros(len(pair), np.int64)
    for r in found.where(F.col("kind") == COUNTED).select("payload").collect():  # size.share pairs at most
        x = unpacked(r["payload"])
        pair_counts[x["pair"]] = x["c_hw"]
    model = spark.sparkContext.broadcast((weights, pair_counts))
    sums = both.where(F.col("kind").isin(INFO, PAIRS, WAITING)).mapInPandas(_sum_up(table, model), "origin long, kind int, payload binary")
    return dealt(sums, "origin").groupBy("origin").applyInPandas(_finish(table), RESULT)


def _table_pairs(reported: DataFrame, tokens: int, hot: np.ndarray, size: Size) -> np.ndarray:
    """Of the reported pairs of hot words those with a share over 1 / size.share of all tokens, sorted: size.share at most."""
    words = reported.sparkSession.sparkContext.broadcast(hot)

    def run(dfs):
        for df in dfs:
            out = []
            for x in map(unpacked, df["payload"]):
                a, b = (_slots(words.value, x[k].astype(np.uint64)) for k in "ab")
                kept = (a >= 0) & (b >= 0) & (x["n"] * size.share > tokens)
                out.append(packed(pair=np.sort(a[kept] << 32 | b[kept])))
            yield pd.DataFrame({"payload": out})

    got = [unpacked(r["payload"])["pair"] for r in reported.mapInPandas(run, "payload binary").collect()]
    return np.sort(np.concatenate([_I64, *got]))
