"""Learned log scores of pieces, and parts beyond all bounds."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from unskew.llm import pieces
from unskew.llm import queries as Q

P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def learned(spark, sf):
    return pieces.fit(spark.read.parquet(f"{sf}/documents.parquet"), PATH)


def spellings(codec, raw):
    """All of them: (pieces or None for a character in bytes, log probability)."""
    value = {codec.text[i]: i for i in codec.ids}
    if not raw:
        return [((), 0.0)]
    out = []
    for n in range(1, min(len(raw), codec.longest) + 1):
        if raw[:n] in value:
            out += [((value[raw[:n]], *p), codec.score[value[raw[:n]]] + s) for p, s in spellings(codec, raw[n:])]
    n = int(codec.width[raw[0]])
    return out + [((None, *p), n * codec.penalty + s) for p, s in spellings(codec, raw[n:])]


def test_expected_counts_match_all_spellings(learned):
    codec = pieces.Codec(PATH, learned)
    words, times = ["▁the", "▁cat", "▁aé", "x", "▁there"], np.array([3, 1, 2, 5, 1])
    want, total = np.zeros(codec.size), 0.0
    for w, n in zip(words, times, strict=True):
        found = spellings(codec, w.encode())
        whole = math.log(sum(math.exp(s) for _, s in found))
        total += n * whole
        for p, s in found:
            for i in p:
                if i is not None:
                    want[i] += n * math.exp(s - whole)
    got, log_p = codec.expected([w.encode() for w in words], times)
    assert np.allclose(got, want) and math.isclose(log_p, total)


def test_sums_of_unlikely_parts_go_through_logarithms(learned):
    codec = pieces.Codec(PATH, learned)
    parts, times = ["🙂" * 24, "▁the", "的" * 24], np.array([2, 3, 1])
    got, log_p = codec.expected([x.encode() for x in parts], times)
    want, total = codec._expected_logs([x.encode() for x in parts], times)
    assert np.allclose(got, want) and math.isclose(log_p, total) and log_p < -1000


def test_query_matches_brute_force(spark, sf, learned):
    """Scores are the best over all spellings, by words, of learned log probabilities that sum to one."""
    codec = pieces.Codec(PATH, learned)
    assert math.isclose(np.exp(learned[codec.ids]).sum(), 1, rel_tol=1e-3) and (learned < 0).all()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in Q.op10_sentencepiece(spark, sf).collect()}
    value, known = {codec.text[i]: codec.score[i] for i in codec.ids}, {}

    def best(part):
        if part not in known:
            b = part.encode()
            at = [0.0] + [-math.inf] * len(b)
            for i in range(len(b)):
                if at[i] > -math.inf:
                    for j in range(i + 1, min(len(b), i + codec.longest) + 1):
                        if b[i:j] in value:
                            at[j] = max(at[j], at[i] + value[b[i:j]])
                    size = int(codec.width[b[i]])
                    at[i + size] = max(at[i + size], at[i] + size * codec.penalty)
            known[part] = at[-1]
        return known[part]

    assert got.keys() == texts.keys() and all(r["exact"] for r in got.values())
    for i, t in texts.items():
        if len(t) < 3000:
            assert math.isclose(got[i]["score"], sum(map(best, pieces._PART.findall(pieces.MARK + t.replace(" ", pieces.MARK)))) if t else 0, rel_tol=1e-9)


def test_each_round_makes_the_texts_likelier(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pieces.counted_parts(docs).collect()
    parts, times = [r["part"].encode() for r in rows], np.array([r["n"] for r in rows])
    told = [pieces.Codec(PATH, pieces.fit(docs, PATH, rounds=n)).expected(parts, times)[1] for n in (0, 1, 3)]
    assert told[0] < told[1] < told[2]


def test_learned_scores_spell_held_out_texts_better_than_ranks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows = docs.collect()
    codec = pieces.Codec(PATH, pieces.fit(spark.createDataFrame([(r["text"],) for r in rows if not held(r["doc_id"])], "text string"), PATH))
    ranks = pieces.Codec(PATH)
    texts = [r["text"] for r in rows if held(r["doc_id"]) and r["text"]]
    log_p = lambda ids: sum(codec.penalty if i in codec.byte else codec.score[i] for i in ids.tolist())
    learned, plain = sum(s for _, s in codec.encode(texts)), sum(log_p(ids) for ids, _ in ranks.encode(texts))
    assert learned > plain


def test_counts_of_parts(spark):
    texts = ["a b  b", None, "", "b" * 100, "a b  b"]
    got = {r["part"]: r["n"] for r in pieces.counted_parts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    want = Counter({"▁a": 2, "▁b": 2, "▁▁b": 2})
    whole = "▁" + "b" * 100
    want.update(whole[i : i + pieces.FIT_CHARS] for i in range(0, 101, pieces.FIT_CHARS))
    assert got == dict(want)


def test_long_parts_are_cut_where_no_piece_crosses(learned):
    codec, rng = pieces.Codec(PATH, learned), random.Random(4)
    for alphabet in ("的一是不了人我", "abcdefg", "aé的🙂z", "▁"):
        text = "".join(rng.choice(alphabet) for _ in range(900))
        got, score = codec.encode([text])[0]
        ids, want = codec._long((pieces.MARK + text).encode())
        assert codec.decode(got.tolist()) == (text if "▁" not in text else " " * 900) and math.isclose(score, want, rel_tol=1e-12) and len(got) == len(ids)
        assert "".join(codec.segments(text)) == text


def test_memory_of_unspaced_texts(learned):
    import resource

    codec, rng = pieces.Codec(PATH, learned), random.Random(6)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for _ in range(4):
        codec.encode(["".join(rng.choices("的一是不了人我在有他这中大来上", k=20_000)) for _ in range(30)])
        codec.encode(["".join(rng.choices("abcdefghijklmno", k=20_000)) for _ in range(5)])
    assert codec.held <= pieces.CACHE + (64 << 20)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10


def test_fit_of_nothing(spark):
    got = pieces.fit(spark.createDataFrame([], "text string"), PATH)
    assert np.isfinite(got).all() and len(set(got.tolist())) == 1
