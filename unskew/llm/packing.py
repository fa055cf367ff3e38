"""Cost-balanced packing of tokenised documents into sequences.

A document's ids (and a closing id) are cut into runs of at most CAPACITY; full runs are sequences of their own. The
others are dealt out by hash, and each partition packs them in windows of WINDOW tokens: a window's sequences are opened
all at once, and pieces go, the longest first, to the sequence of least estimated cost (linear in tokens plus quadratic
in each piece's length, for attention) of all that have room for it; if none has, the piece is cut to fill the cheapest. What doesn't fill whole sequences is carried to the next window; at the end of a partition it fills sequences
whose lengths are powers of two, which need no padding. So no sequence is padded at all.

Only ids travel (two bytes each if the vocabulary allows), in one shuffle; a task holds one window. A partition's result
is consistent by itself, so a lost task can be run again.

Tokenising goes by words: no pattern of the tokenizer crosses white space, so ids of distinct words are looked up once. What
is remembered is bounded in bytes, words beyond LONG characters aren't, and words are tokenised CHUNK bytes at a time.
A text with control characters that Python, but not the tokenizer, takes for white space is tokenised whole.

Defined cases: a null or blank text has the closing id alone; ids may be null or repeated, every row is packed by
itself; equal rows go to as many tasks as hold them; ties go to the earlier sequence; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions

CAPACITY, END = 4096, 2
LINEAR, QUADRATIC = 1.0, 1 / 6144
WINDOW, SLICE = 1 << 22, 250
#: Bytes that are remembered, characters from which a word isn't, characters of words tokenised at once.
CACHE, LONG, CHUNK = 64 << 20, 128, 1 << 18
RUNS = "doc_id long, start long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ODD = re.compile("[\x1c-\x1f]")
#: What goes through the tokenizer itself: zero bytes, specials, U+0130 (lower case of two letters) and all from U+0250 on.
_SLOW = re.compile("[\0\x1c-\x1f\u0130\u0250-\U0010ffff]|<\\|")
#: Fixed value: the normalizer under which words below U+0250 need only lower case.
NORMALIZER = '{"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\\\s+"}, "content": " "}, {"type": "Lowercase"}]}'


class Words:
    """Ids of texts by way of their distinct words; what it remembers is bounded.

    A word of letters below U+0250, digits and symbols is cut by the tokenizer's own pattern, and the merges of the
    tokenizer's file are applied by tiktoken (a zero byte stands for the end of a word); that gives the same ids faster.
    All other words, and those that might hold a special token, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = None
        with open(path) as f:
            spec = json.load(f)
        if spec["model"].get("type", "BPE") == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>" and json.dumps(spec["normalizer"]) == NORMALIZER:
            split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.cut = regex.compile(split).findall
            self._merges(spec)
        self.clear()

    def _merges(self, spec: dict) -> None:
        import tiktoken

        # byte-level BPE writes bytes as printable characters: themselves where printable, the others from U+0100 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        special = {x["content"] for x in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"]
        ranks = {}
        for token, i in vocabulary.items():
            if token not in special:
                ends = token.endswith("</w>")
                ranks[bytes(byte[c] for c in (token[:-4] if ends else token)) + b"\0" * ends] = i
        spare = max([*vocabulary.values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        ranks[b"\0"] = spare
        self.last = np.zeros(spare + 1, bool)
        self.last[[i for x, i in ranks.items() if x.endswith(b"\0")]] = True
        self.pieces = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _keep(self, words: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, flat.astype(np.uint32)])
        self.held += sum(map(len, words)) + 150 * len(words) + 4 * len(flat)

    def _learn(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in another order, how many ids each has, and all ids in one line."""
        if self.pieces is None:
            plain, rest = [], words
        elif _SLOW.search("\n".join(words)):
            plain, rest = [], []
            for w in words:
                (rest if _SLOW.search(w) else plain).append(w)
        else:
            plain, rest = words, []
        order, sizes, flat = [], [], []
        for some in _chunks(plain):
            parts, counts = [], []
            for w in some:
                w = w.lower()
                if w.isalpha():
                    parts.append(w)
                    counts.append(1)
                else:
                    cut = self.cut(w)
                    parts += cut
                    counts.append(len(cut))
            ids = np.array(self.pieces.encode_ordinary("\0".join(parts) + "\0"), np.uint32)
            bounds = np.concatenate([[0], np.flatnonzero(self.last[ids]) + 1])[np.concatenate([[0], np.cumsum(counts)])]
            order += some
            sizes.append(np.diff(bounds))
            flat.append(ids)
        for some in _chunks(rest):
            got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(some, add_special_tokens=False)]
            order += some
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            flat.append(np.concatenate(got))
        return order, np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, np.uint32), *flat])

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        lists = [[] if not x else [x] if _ODD.search(x) else x.split() for x in texts]
        distinct = set().union(*lists)
        if self.held > CACHE:
            self.clear()
        new = [w for w in distinct.difference(self.known) if len(w) <= LONG]
        if new:
            self._keep(*self._learn(new))
        once: dict[str, np.ndarray] = {}  # long words, for this slice
        for w in distinct:
            if len(w) > LONG:
                once[w] = self._learn([w])[2]
        out = []
        for line in lists:
            if not once or not any(len(w) > LONG for w in line):
                out.append(self._found(line))
                continue
            runs, at = [], 0
            for k, w in enumerate([*line, None]):
                if w is None or len(w) > LONG:
                    runs += [self._found(line[at:k])] if w is None else [self._found(line[at:k]), once[w]]
                    at = k + 1
            out.append(np.concatenate(runs))
        return out

    def _found(self, line: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.known.__getitem__, line), np.int64, len(line))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _chunks(words: list[str], most: int = CHUNK):
    """The words in runs of at most so many characters, or of one word."""
    held, size = [], 0
    for w in words:
        if held and size + len(w) > most:
            yield held
            held, size = [], 0
        held.append(w)
        size += len(w)
    if held:
        yield held


@lru_cache(1)
def _words(path: str) -> Words:
    """One for each worker, kept from task to task."""
    return Words(path)


def runs(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, start, doc_tokens, ids: each document's ids, closed by `end`, in runs of at most `capacity`."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        words = _words(path)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                doc, start, size, ids = [], [], [], []
                for i, x in zip(part.column(0).to_pylist(), words.ids(part.column(1).to_pylist()), strict=True):
                    x = np.append(x, np.uint32(end)).astype("<u4")
                    for a in range(0, len(x), capacity):
                        doc.append(i)
                        start.append(a)
                        size.append(len(x))
                        ids.append(_packed(x[a : a + capacity]))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "doc_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, RUNS)


def _packed(ids: np.ndarray) -> bytes:
    """Two bytes an id after a byte 2 if they suffice, else four after a byte 4."""
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if blob[0] == 2 else "<u4", offset=1).astype("<u4")


def balance(sizes: list[int], capacities: list[int]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """((piece, its first id, ids, sequence), ...) and what found no room (piece, first id, ids), for pieces of given sizes."""
    room, cost = np.array(capacities, np.int64), np.zeros(len(capacities))
    placed, rest = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at, left = 0, sizes[i]
        while left:
            able = room >= left
            if not able.any():
                able = room > 0
                if not able.any():
                    break
            s = int(np.where(able, cost, np.inf).argmin())
            put = min(left, int(room[s]))
            placed.append((i, at, put, s))
            room[s] -= put
            cost[s] += LINEAR * put + QUADRATIC * put * put
            at, left = at + put, left - put
        if left:
            rest.append((i, at, left))
    return placed, rest


def pack(found: DataFrame, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pieces of runs: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids (4 bytes each)."""
    schema = PIECES + ", ids binary" * with_ids

    def run(dfs):
        first = TaskContext.get().partitionId() << 40
        opened = 0
        held: list[tuple] = []  # doc_id, start, doc_tokens, ids
        tokens = 0

        def out(rows):
            names = [x.split()[0] for x in schema.split(", ")]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            return pd.DataFrame(dict(zip(names, cols, strict=False))).astype({"doc_id": "Int64"})

        def settle(last: bool):
            nonlocal held, tokens, opened
            sizes = [len(x[3]) for x in held]
            total = sum(sizes)
            placed, rest = balance(sizes, [capacity] * (total // capacity))
            base = opened
            opened += total // capacity
            keep = [(held[i][0], held[i][1] + at, held[i][2], held[i][3][at : at + n]) for i, at, n in rest]
            rows, offsets = [], {}
            for i, at, n, s in placed:
                rows.append(_piece(held[i], at, n, first + base + s, offsets))
            held, tokens = keep, total % capacity
            if last and held:
                powers = [1 << k for k in range(tokens.bit_length() - 1, -1, -1) if tokens >> k & 1]
                placed, _ = balance([len(x[3]) for x in held], powers)
                for i, at, n, s in placed:
                    rows.append(_piece(held[i], at, n, first + opened + s, offsets))
                opened += len(powers)
                held, tokens = [], 0
            return out(rows)

        for df in dfs:
            whole = []
            for doc_id, start, size, blob in zip(df["doc_id"], df["start"], df["doc_tokens"], df["ids"], strict=True):
                ids = _unpacked(blob)
                one = (None if pd.isna(doc_id) else int(doc_id), int(start), int(size), ids)
                if len(ids) == capacity:
                    whole.append(_piece(one, 0, capacity, first + opened, {}))
                    opened += 1
                else:
                    held.append(one)
                    tokens += len(ids)
                    if tokens >= WINDOW:
                        yield settle(False)
            yield out(whole)
        yield settle(True)

    # equal rows of several input partitions go apart
    dealt = found.withColumn("h", F.xxhash64("doc_id", "start", "ids", F.spark_partition_id()))
    dealt = dealt.repartition(partitions(found.sparkSession), "h").sortWithinPartitions("h", "doc_id").drop("h")
    return dealt.mapInPandas(run, schema)


def _piece(one: tuple, at: int, n: int, sequence: int, offsets: dict[int, int]) -> tuple:
    doc_id, start, size, ids = one
    offset = offsets.get(sequence, 0)
    offsets[sequence] = offset + n
    blob = ids[at : at + n].tobytes()
    return doc_id, start + at, n, zlib.crc32(blob), size, sequence, offset, blob


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    return pack(runs(docs, path, id_col, text_col, capacity), capacity, with_ids)
