"""Phrases against plain counting and their SQL; the automaton against all substrings."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from unskew.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, score string, count int"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, "y", 2) for i, (t, lang) in enumerate(rows)], SCHEMA)


def plain(rows, longest=4, least=30, absorbed=80, best=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    f = {p: c for p, c in f.items() if c >= least}
    dropped = {(lang, p[i : i + k]) for (lang, p), c in f.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * c >= absorbed * f[lang, p[i : i + k]]}
    found = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and (lang, p) not in dropped:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, r, p.decode(), -a, le, ri, n[lang], -s) for lang, rows in found.items() for r, (s, a, p, le, ri) in enumerate(sorted(rows)[:best], 1)]


def check(spark, rows, **k):
    got = sorted(tuple(r) for r in phrases.mine(frame(spark, rows), **k).collect())
    assert got == sorted(plain(rows, **k))
    return got


VOCABULARY = ["a", "b", "New", "york", "é", "x y", "\x1fz", "THE", "the", "of"]


def texts(seed, n, ends=(" ", "  ", "\t", ". ", "\n", ",", "!? ", "\x0b")):
    rng = np.random.default_rng(seed)
    made = ["".join(VOCABULARY[int(rng.zipf(1.4)) % 10] + ends[int(rng.zipf(1.8)) % len(ends)] for _ in range(rng.integers(1, 60))) for _ in range(n)]
    return [(t, ["en", "de", None, "und"][int(rng.integers(4))]) for t in made]


def test_matches_plain_counting(spark):
    got = check(spark, texts(1, 400), least=5)
    assert {len(r[2].split(" ")) for r in got} == {2, 3, 4} and {r[0] for r in got} == {"en", "de", "und"}


@pytest.mark.parametrize("k", [{"longest": 2, "least": 3}, {"longest": 5, "least": 4, "absorbed": 50}, {"best": 7, "least": 2}, {"least": 10_000}])
def test_settings(spark, k):
    check(spark, texts(2, 150), **k)


def test_odd_rows(spark):
    rows = [(None, "en"), ("", "en"), (" \t . \n", None), ("one", "en"), ("in the end " * 6000, "en"), ("same words here. " * 40, None), ("same words here. " * 40, None), ("w" * 100_000, "en"), ("no end " * 31, "en")]
    got = check(spark, rows)
    assert any(r[2] == "same words here" and r[3] == 80 for r in got)


def test_long_texts_are_cut_exactly(spark, monkeypatch):
    rows = texts(3, 40) + [(" ".join(f"{w} k{i % 7}" for i, w in enumerate(VOCABULARY * 40)), "en"), ("m" * 300 + " n " * 90 + "m" * 200, "en"), ("q" * 150 + ".r s t u. " * 40, "en")]
    want = sorted(plain(rows, least=3))
    for most in (20, 64, 257):
        for text, _ in rows:
            parts = list(phrases.parts_of((text or "").encode().translate(phrases._FOLDED), most, 3))
            assert sum(len(p.split()) - skip for p, skip in parts) == len((text or "").encode().translate(phrases._FOLDED).split())
    monkeypatch.setattr(phrases, "SHARD_BYTES", 64)
    counts = Counter()
    for text, lang in rows:  # the same cuts, counted without Spark
        for part, skip in phrases.parts_of((text or "").encode().translate(phrases._FOLDED), 64, 3):
            for batch in phrases.shard_counts(phrases.Shard([part], [0], [skip], [lang or "und"], None), 1, 4):
                counts.update({(r["lang"], r["phrase"]): r["count"] for r in batch.to_pylist() if r["phrase"]})
    for lang, _, p, a, *_ in want:
        assert counts[lang, p] == a


def test_empty_table(spark):
    assert phrases.mine(frame(spark, []).limit(0)).collect() == []


def everything(spark, n):
    made = phrases.Frequent.__new__(phrases.Frequent)
    made.n, made.bits, made.table = n, 15, spark.sparkContext.broadcast(np.full(4096, 255, np.uint8))
    return made


def test_full_bit_tables_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_ROWS", 20)
    rows = texts(4, 120)
    word, lang = phrases._hashes(pa.array(["a"])), phrases._hashes(pa.array(["en"]))
    assert phrases.frequent_words(spark.createDataFrame([("en", "a")], "lang string, phrase string")).has([word], lang).all()
    monkeypatch.setattr(phrases, "frequent_words", lambda words: everything(spark, 1))
    check(spark, rows, least=3, best=15)
    monkeypatch.setattr(phrases, "frequent_runs", lambda docs, shorter, least: everything(spark, shorter.n + 1))
    check(spark, rows, least=3, best=15)


def test_tasks_pass_counts_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 400)
    monkeypatch.setattr(phrases, "HELD", 30)
    monkeypatch.setattr(phrases, "BATCH", 7)
    check(spark, texts(5, 200), least=4)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.booleans()), max_size=40), st.integers(1, 5))
def test_automaton(run, depth):
    codes, joined = np.array([c for c, _ in run], np.int64), np.array([j and i > 0 for i, (_, j) in enumerate(run)], bool)
    a = phrases.Automaton(codes, joined, np.ones(len(run), bool), depth)
    ends = defaultdict(list)
    for i in range(len(run)):
        for n in range(1, depth + 1):
            if i - n + 1 < 0 or n > 1 and not joined[i - n + 2 : i + 1].all():
                break
            ends[tuple(codes[i - n + 1 : i + 1].tolist())].append(i)
    got = {}
    for n in range(1, depth + 1):
        for s in a.states_of(n).tolist():
            got[tuple(codes[a.end[s] - n + 1 : a.end[s] + 1].tolist())] = s
    assert {p: len(e) for p, e in ends.items()} == {p: int(a.count[s]) for p, s in got.items()}
    assert len(a.count) == len({tuple(e) for e in ends.values()})  # a state is a class of equal ends
    for p, s in got.items():
        assert a.end[s] in ends[p]
        longest = max((q for q in ends if ends[q] == ends[p]), key=len)
        assert a.length[s] == len(longest)
        shorter = [longest[i:] for i in range(len(longest)) if ends[longest[i:]] != ends[p]]
        assert a.link[s] == (got[shorter[0]] if shorter else -1)


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    df = entry.queries()["op11_phrases"](spark, sf)
    cur = con.execute(entry.oracle_sql()["op11_phrases"])
    at = [[c[0] for c in cur.description].index(c) for c in df.columns]
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(tuple(r[i] for i in at) for r in cur.fetchall())
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == sorted(plain([(r["text"], r["lang"]) for r in docs]))
