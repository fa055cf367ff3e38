"""Encoding and decoding with a SentencePiece vocabulary: unigram Viterbi over a double-array trie of pieces with log scores.

A text gets one leading blank, blanks become the marker U+2581, and the encoding is the sequence of pieces of highest
summed log probability that spells it; a character may also be spelled by its byte pieces, each at BYTE_PENALTY below the
least score of all pieces. Of equal sums the one whose last piece is longer wins, and so on backwards. Decoding joins pieces
and bytes, turns markers into blanks and drops the leading one; it gives the text back exactly unless the text itself holds
the marker.

Log scores: a vocabulary made by merges holds ranks, not probabilities. fit() learns the pieces' unigram log probabilities
from the documents by expectation-maximisation: parts of texts are counted over all documents, then each of ROUNDS jobs
sums, over all distinct parts and all their spellings (forward and backward over the trie), how often each piece is
expected, with PRIOR added. For the fit alone, parts are cut after FIT_CHARS. Codec(path) without scores takes the file's numbers.

The trie runs over UTF-8 bytes. No piece has a marker after another character, so a text is cut before every run of markers;
parts beyond LONG bytes are cut on where no piece reaches across. Each distinct part is solved once; all new parts of a slice
move through the trie together, position by position, in arrays. What is remembered is bounded in bytes, and parts that stay
long are not remembered. Rows are worked by themselves in one map without a shuffle; the vocabulary, a few hundred kB,
is read from a path that is a parameter.

Defined cases: a null text encodes like the empty one, to no ids; ids and repeated rows are worked row by row; an empty
table gives no rows (and a fit of equal scores); other columns are ignored; ids that stand for no text (control pieces) decode to nothing.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

#: Rows of a slice, bytes that are remembered, parts that are solved at once, bytes from which a part is long.
SLICE, CACHE, PART, LONG = 250, 64 << 20, 8192, 256
MARK, BYTE_PENALTY, LIFT = "▁", 10.0, 3.0
#: Of the fit: rounds, what is added to each piece's count, characters of a part, distinct parts counted before they are passed on, parts at once.
ROUNDS, PRIOR, FIT_CHARS, FLUSH, FIT_PARTS = 4, 0.1, 24, 400_000, 20_000
_PART = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>$")


class DoubleArray:
    """Keys (bytes) to numbers: the child of state s by byte c is base[s] + c + 1 if check there is s."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        value: list[int] = [-1]
        for number, key in enumerate(keys):
            node = 0
            for c in key:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = nxt
            value[node] = number
        # states are placed breadth first; the children of one go to the lowest free places that their bytes allow
        size = 3 * len(children) + 1200
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        place, lowest, queue = {0: 0}, 300, [0]  # no base below zero
        for node in queue:
            at, kids = place[node], children[node]
            self.value[at] = value[node]
            if not kids:
                continue
            codes = np.sort(np.fromiter(kids, np.int64, len(kids))) + 1
            while not free[lowest]:
                lowest += 1
            start = self._fit(free, lowest, codes)
            self.base[at] = start
            for c, child in kids.items():
                spot = start + c + 1
                free[spot], self.check[spot], place[child] = False, at, spot
                queue.append(child)
        # every state's 256 children lie within the arrays
        last = int(np.flatnonzero(~free)[-1]) + 600
        self.base, self.check, self.value = self.base[:last], self.check[:last], self.value[:last]

    @staticmethod
    def _fit(free: np.ndarray, first: int, codes: np.ndarray, window: int = 512) -> int:
        """The least base, from places at or after `first` for the least code on, whose places are all free."""
        while True:
            spots = first + np.flatnonzero(free[first : first + window])
            spots = spots[spots + 300 < len(free)]
            fits = free[spots[:, None] + (codes - codes[0])].all(1)
            if fits.any():
                return int(spots[fits.argmax()] - codes[0])
            first += window
            if first >= len(free):
                raise ValueError("no room left in the double array")

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        to = self.base[state] + byte + 1
        return np.where(self.check[to] == state, to, -1)

    def get(self, key: bytes) -> int:
        state = 0
        for c in key:
            to = int(self.base[state]) + c + 1
            if self.check[to] != state:
                return -1
            state = to
        return int(self.value[state])


class Codec:
    def __init__(self, path: str, scores: np.ndarray | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(self.size)]
        self.text = [b"" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else p.encode() for i, p in enumerate(pieces)]
        self.byte = np.full(256, -1, np.int64)
        for i, p in enumerate(pieces):
            if model.is_byte(i):
                b = int(_BYTE.match(p)[1], 16)
                self.byte[b], self.text[i] = i, bytes([b])
        if (self.byte < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        plain = [i for i in range(self.size) if self.text[i] and not model.is_byte(i)]
        if any(MARK in pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece has a marker after another character")
        self.given = np.array([model.get_score(i) for i in range(self.size)])
        self.ids = np.array(plain, np.int64)
        self.trie = DoubleArray([self.text[i] for i in plain])
        self.bytes = np.array([len(t) for t in self.text])
        self.longest = max(len(self.text[i]) for i in plain)
        #: Bytes of the character that a byte leads.
        self.width = np.array([1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)])
        self.known: dict[str, int] = {}
        self.rescore(scores)

    def rescore(self, scores: np.ndarray | None) -> None:
        """Takes other scores (None: the file's); the trie stays."""
        self.score = self.given if scores is None else np.asarray(scores, float)
        self.penalty = float(self.score[self.ids].min()) - BYTE_PENALTY
        self.__dict__.pop("_lists", None)
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.held = 0
        self.starts, self.sizes, self.sums, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)

    def _lines(self, parts: list[bytes]):
        """Parts by falling length: their places, lengths, bytes in one line, and where each begins there."""
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        lengths = np.array([len(parts[i]) for i in order], np.int64)
        return order, lengths, np.frombuffer(b"".join(parts[i] for i in order), np.uint8), np.cumsum(lengths) - lengths

    def _steps(self, lengths: np.ndarray, flat: np.ndarray, offset: np.ndarray):
        """(from, to, which parts, pieces or None for a character in bytes), by rising from and to, of all spellings of all parts."""
        for at in range(int(lengths[0]) if len(lengths) else 0):
            m = int(np.searchsorted(-lengths, -at, "left"))  # parts longer than `at`
            lead = flat[offset[:m] + at]
            who = np.flatnonzero((lead & 0xC0) != 0x80)
            if not len(who):
                continue
            state, alive, depth, chars = np.zeros(len(who), np.int64), who, 0, self.width[lead[who]]
            while len(alive) and depth < self.longest:
                inside = at + depth < lengths[alive]
                alive, state = alive[inside], state[inside]
                state = self.trie.step(state, flat[offset[alive] + at + depth].astype(np.int64))
                alive, state = alive[state >= 0], state[state >= 0]
                depth += 1
                number = self.trie.value[state]
                hit = number >= 0
                if hit.any():
                    yield at, at + depth, alive[hit], self.ids[number[hit]]
            for size in range(1, 5):
                w = who[chars == size]
                w = w[at + size <= lengths[w]]
                if len(w):
                    yield at, at + size, w, None

    def solve(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the best spellings of all parts in one line, how many each has, and its summed score."""
        order, lengths, flat, offset = self._lines(parts)
        n, width = len(parts), int(lengths[0]) if len(parts) else 0
        best = np.full((width + 1, n), -np.inf)
        back, piece = np.zeros((width + 1, n), np.int16), np.zeros((width + 1, n), np.int32)
        best[0] = 0.0
        for at, to, w, found in self._steps(lengths, flat, offset):
            new = best[at][w] + (self.score[found] if found is not None else (to - at) * self.penalty)
            better = new > best[to][w]
            w = w[better]
            best[to][w] = new[better]
            if found is None:
                back[to][w] = at - to
            else:
                back[to][w], piece[to][w] = to - at, found[better]
        # all parts walk back together; a character in bytes stands as -1 - (where it begins) until the end
        left, steps = lengths.copy(), []
        while left.any():
            at, live = np.flatnonzero(left), left[left > 0]
            depth = back[live, at]
            steps.append((at, np.where(depth > 0, piece[live, at], -1 - (live + depth))))
            left[at] = live - np.abs(depth)
        row = np.concatenate([r for r, _ in steps]) if steps else np.empty(0, np.int64)
        got = np.concatenate([x for _, x in steps]) if steps else np.empty(0, np.int64)
        turn = np.concatenate([np.full(len(r), -k) for k, (r, _) in enumerate(steps)]) if steps else row
        turned = np.lexsort((turn, row))
        row, got = row[turned], got[turned]
        if (got < 0).any():
            lead = flat[offset[row] + np.maximum(-1 - got, 0)]
            times = np.where(got >= 0, 1, self.width[lead])
            row, first = np.repeat(row, times), np.repeat(np.maximum(-1 - got, 0), times)
            step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            got = np.where(np.repeat(got >= 0, times), np.repeat(got, times), self.byte[flat[np.minimum(offset[row] + first + step, len(flat) - 1)]])
        sizes = np.bincount(row, minlength=n)
        sums = best[lengths, np.arange(n)]
        # from the order of lengths to the given one
        given = np.empty(n, np.int64)
        given[order] = np.arange(n)
        starts = (np.cumsum(sizes) - sizes)[given]
        out = got[np.repeat(starts - (np.cumsum(sizes[given]) - sizes[given]), sizes[given]) + np.arange(len(got))]
        return out, sizes[given], sums[given]

    def expected(self, parts: list[bytes], times: np.ndarray) -> tuple[np.ndarray, float]:
        """How often each piece is expected in the spellings of parts that occur so many times, and the parts' log probability.

        Probabilities are multiplied by e^LIFT a byte, which cancels out; parts whose sums are next to nothing all the same
        are summed in logarithms.
        """
        order, lengths, flat, offset = self._lines(parts)
        n, width, times = len(parts), int(lengths[0]) if len(parts) else 0, np.asarray(times, float)[order]
        steps = list(self._steps(lengths, flat, offset))
        chance = np.exp(self.score + LIFT * self.bytes)
        of_bytes = np.exp(np.arange(5) * (self.penalty + LIFT))
        ahead, behind = np.zeros((width + 1, n)), np.zeros((width + 1, n))
        ahead[0], behind[lengths, np.arange(n)] = 1.0, 1.0
        p = [chance[found] if found is not None else of_bytes[to - at] for at, to, _, found in steps]
        for (at, to, w, _), q in zip(steps, p, strict=True):
            ahead[to][w] += ahead[at][w] * q
        for (at, to, w, _), q in zip(reversed(steps), reversed(p), strict=True):
            behind[at][w] += behind[to][w] * q
        whole, out = behind[0], np.zeros(self.size)
        fine = whole > 1e-200
        share = np.where(fine, times / np.where(fine, whole, 1.0), 0.0)
        spelled = [(found, ahead[at][w] * q * behind[to][w] * share[w]) for (at, to, w, found), q in zip(steps, p, strict=True) if found is not None]
        if spelled:
            out = np.bincount(np.concatenate([x for x, _ in spelled]), np.concatenate([x for _, x in spelled]), self.size)
        total = float(((np.log(whole[fine]) - LIFT * lengths[fine]) * times[fine]).sum())
        if fine.all():
            return out, total
        rest, more = self._expected_logs([parts[order[i]] for i in np.flatnonzero(~fine)], times[~fine])
        return out + rest, total + more

    def _expected_logs(self, parts: list[bytes], times: np.ndarray) -> tuple[np.ndarray, float]:
        order, lengths, flat, offset = self._lines(parts)
        n, width, times = len(parts), int(lengths[0]), np.asarray(times, float)[order]
        ahead, behind = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf)
        ahead[0], behind[lengths, np.arange(n)] = 0.0, 0.0
        steps = list(self._steps(lengths, flat, offset))
        cost = lambda at, to, found: self.score[found] if found is not None else (to - at) * self.penalty
        for at, to, w, found in steps:
            ahead[to][w] = np.logaddexp(ahead[to][w], ahead[at][w] + cost(at, to, found))
        for at, to, w, found in reversed(steps):
            behind[at][w] = np.logaddexp(behind[at][w], behind[to][w] + cost(at, to, found))
        whole, out = behind[0], np.zeros(self.size)
        for at, to, w, found in steps:
            if found is not None:
                np.add.at(out, found, np.exp(ahead[at][w] + self.score[found] + behind[to][w] - whole[w]) * times[w])
        return out, float((whole * times).sum())

    def segments(self, part: str) -> list[str]:
        """The part cut wherever no piece reaches across, which leaves its best spelling as it is."""
        raw = np.frombuffer(part.encode("utf-8", "surrogatepass"), np.uint8)
        n = len(raw)
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        reach = starts + self.width[raw[starts]]
        for at in range(0, len(starts), 1 << 18):
            live = np.arange(at, min(len(starts), at + (1 << 18)))
            state, depth = np.zeros(len(live), np.int64), 0
            while len(live) and depth < self.longest:
                inside = starts[live] + depth < n
                live, state = live[inside], state[inside]
                state = self.trie.step(state, raw[starts[live] + depth].astype(np.int64))
                live, state = live[state >= 0], state[state >= 0]
                depth += 1
                hit = live[self.trie.value[state] >= 0]
                reach[hit] = np.maximum(reach[hit], starts[hit] + depth)
        cut = np.flatnonzero(np.maximum.accumulate(reach)[:-1] <= starts[1:]) + 1  # in characters
        edges = [0, *cut.tolist(), len(part)]
        return [part[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def _learn(self, parts: list[str]) -> None:
        # parts of like length go together, so that the arrays stay full
        parts.sort(key=len)
        for at in range(0, len(parts), PART):
            some = parts[at : at + PART]
            ids, sizes, sums = self.solve([x.encode("utf-8", "surrogatepass") for x in some])
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.sizes, self.sums, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.sums, sums]), np.concatenate([self.pool, ids.astype(np.int32)])
            self.held += sum(map(len, some)) + 150 * len(some) + 4 * len(ids)

    def _long(self, part: bytes) -> tuple[np.ndarray, float]:
        """One part by itself, byte by byte: for what stays longer than LONG."""
        n = len(part)
        best, back = array("d", [-np.inf]) * (n + 1), array("i", [0]) * (n + 1)
        best[0] = 0.0
        base, check, value, score = self._plain()
        penalty, width, longest = self.penalty, self.width.tolist(), self.longest
        for at in range(n):
            here = best[at]
            if here == -np.inf:
                continue
            state = 0
            for to in range(at + 1, min(at + longest, n) + 1):
                nxt = base[state] + part[to - 1] + 1
                if check[nxt] != state:
                    break
                state = nxt
                if value[state] >= 0 and here + score[value[state]] > best[to]:
                    best[to], back[to] = here + score[value[state]], to - at
            size = width[part[at]]
            if at + size <= n and here + size * penalty > best[at + size]:
                best[at + size], back[at + size] = here + size * penalty, -size
        ids, end = array("i"), n
        while end:
            step = back[end]
            if step > 0:
                ids.append(int(self.ids[self.trie.get(part[end - step : end])]))
            else:
                ids.extend(self.byte[b] for b in reversed(part[end + step : end]))
            end -= abs(step)
        return np.array(ids, np.int32)[::-1], best[n]

    def _plain(self):
        """The trie and scores as lists, made when the first long part is met."""
        if not hasattr(self, "_lists"):
            self._lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.score[self.ids].tolist()
        return self._lists

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, float]]:
        """(ids, score) of each text."""
        parts = [_PART.findall(MARK + x.replace(" ", MARK)) if x else [] for x in texts]
        for line in parts:
            if line and max(map(len, line)) > LONG // 4:
                line[:] = [y for x in line for y in (self.segments(x) if len(x) > LONG // 4 else (x,))]
        if self.held > CACHE:
            self._forget()
        short = lambda x: len(x) <= LONG // 4
        new = list(set().union(*parts).difference(self.known))
        if new:
            self._learn([x for x in new if short(x)])
        out = []
        for line in parts:
            if not line or max(map(len, line)) <= LONG // 4:
                out.append(self._found(line))
                continue
            runs, total, at = [], 0.0, 0
            for k, x in enumerate([*line, None]):
                if x is not None and short(x):
                    continue
                where, sums = self._found(line[at:k])
                runs.append(where)
                total += sums
                if x is not None:
                    ids, sum_ = self._long(x.encode("utf-8", "surrogatepass"))
                    runs.append(ids)
                    total += sum_
                at = k + 1
            out.append((np.concatenate(runs), total))
        return out

    def _found(self, line: list[str]) -> tuple[np.ndarray, float]:
        at = np.fromiter(map(self.known.__getitem__, line), np.int64, len(line))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        where = np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(line) else 0)
        return self.pool[where], float(self.sums[at].sum())

    def decode(self, ids) -> str:
        text = b"".join([self.text[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


_CODECS: dict = {}


def _codec(path: str, scores: np.ndarray | None = None) -> Codec:
    """One for each worker and vocabulary, kept from task to task; other scores are put into it."""
    key = zlib.crc32(b"" if scores is None else scores.tobytes())
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = key, Codec(path, scores)
    held, codec = _CODECS[path]
    if held != key:
        codec.rescore(scores)
        _CODECS[path] = key, codec
    return codec


def _pieces_of(text: str) -> list[str]:
    """Parts of a text, cut after FIT_CHARS."""
    parts = _PART.findall(MARK + text.replace(" ", MARK))
    if max(map(len, parts)) <= FIT_CHARS:
        return parts
    return [y for x in parts for y in ((x,) if len(x) <= FIT_CHARS else [x[i : i + FIT_CHARS] for i in range(0, len(x), FIT_CHARS)])]


def counted_parts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """part, n: all distinct parts of all texts."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        held = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["part", "n"])

        for b in batches:
            for x in b.column(0).to_pylist():
                held.update(_pieces_of(x))
                if len(held) > FLUSH:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.where(F.length(text_col) > 0).select(text_col).mapInArrow(run, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, path: str, text_col: str = "text", rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the vocabulary's pieces, learned from all documents; of byte and control pieces the least of all."""
    codec = _codec(path)
    plain = np.zeros(codec.size, bool)
    plain[codec.ids] = True
    score = np.full(codec.size, -np.log(len(codec.ids)))
    counted = stored(counted_parts(docs, text_col))
    for _ in range(rounds):
        shared = counted.sparkSession.sparkContext.broadcast(score)  # a number a piece

        def run(batches, shared=shared):
            codec, out, parts, times = _codec(path, shared.value), None, [], []
            for b in chain(batches, [None]):
                if b is not None:
                    parts += [x.encode("utf-8", "surrogatepass") for x in b.column(0).to_pylist()]
                    times.append(b.column(1).to_numpy())
                if parts and (b is None or len(parts) >= FIT_PARTS):
                    got, _ = codec.expected(parts, np.concatenate(times))
                    out, parts, times = got if out is None else out + got, [], []
            if out is not None:
                which = np.flatnonzero(out)
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(out[which], pa.float64())], ["piece", "n"])

        found = counted.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row a piece at most
        n = np.full(codec.size, PRIOR)
        n[[r["piece"] for r in found]] += [r["n"] for r in found]
        # sums of doubles differ with their order in the last digits
        score = np.round(np.log(n / n[plain].sum()), 6)
        score[~plain] = score[plain].min()
        shared.unpersist()
    return score


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", scores: np.ndarray | None = None) -> DataFrame:
    """doc_id, ids, score of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches):
        codec = _codec(path, shared.value)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                got = codec.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in got], pa.list_(pa.int32())), pa.array([s for _, s in got], pa.float64())], ["doc_id", "ids", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, score double")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of ids."""
    bounded_batches(encoded.sparkSession)

    def run(batches):
        codec = _codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", scores: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), score, decoded_chars, exact (decodes to the text) of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches):
        codec = _codec(path, shared.value)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                texts = part.column(1).to_pylist()
                got = codec.encode(texts)
                back = [codec.decode(x.tolist()) for x, _ in got]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(x) for x, _ in got], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x, _ in got], pa.int64()),
                    pa.array([s for _, s in got], pa.float64()), pa.array([len(x) for x in back], pa.int64()), pa.array([x == (t or "") for x, t in zip(back, texts, strict=True)], pa.bool_()),
                ], ["doc_id", "n_ids", "ids_crc32", "score", "decoded_chars", "exact"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, score double, decoded_chars long, exact boolean")
