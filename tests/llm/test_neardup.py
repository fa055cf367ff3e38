"""Near-dedup of the pipeline against exact Jaccard similarity of all pairs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from unskew.llm import neardup

from test_truth import roots


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def linked(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def test_keep_one_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    sets = [plain_set(texts[i]) for i in ids]
    root = roots(len(ids), [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if linked(sets[a], sets[b])])
    got = neardup.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({ids[r] for r in root})


def test_confirmed_across_tiles(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(200)]
    made = []
    for i in range(60):  # each some words away from the one before it
        base = list(base)
        base[int(rng.integers(200))] = f"x{i}"
        made.append((i, " ".join(base)))
    sets = [plain_set(t) for _, t in made]
    root = roots(60, [(a, b) for a, b in itertools.combinations(range(60), 2) if linked(sets[a], sets[b])])
    hashed = [neardup.shingles(t) for _, t in made]
    assert roots(60, neardup.confirmed(hashed).tolist()) == root
    within = [neardup.confirmed(hashed[:25]).tolist(), [[a + 25, b + 25] for a, b in neardup.confirmed(hashed[25:]).tolist()], neardup.confirmed(hashed, 25).tolist()]
    assert roots(60, sum(within, [])) == root
    monkeypatch.setattr(neardup, "TILE", 9)
    kept = neardup.keep_one(spark.createDataFrame(made, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_one_id_with_two_texts(spark, parts):
    a, b = "one two three four five six seven", "other words that stand for themselves alone here"
    made = [(3, a, "x"), (5, a, "y"), (5, b, "z"), (5, b, "w"), (None, a, "n")]
    got = neardup.keep_one(spark.createDataFrame(made, "doc_id long, text string, first string").repartition(parts)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, a), (3, a), (5, b)]
    assert len({r["first"] for r in got if r["doc_id"] == 5} & {"z", "w"}) == 1


def test_wide_comparison_finds_all_similar_sets():
    """Bits of pairs of exactly the least similarity, of all sizes: next to none lies beyond the radius."""
    rng, far, n, other = np.random.default_rng(3), 0, 0, 0
    apart = lambda x, y: ((neardup.set_fingerprint(x) ^ neardup.set_fingerprint(y)) & (1 << 64) - 1).bit_count()
    for size in (4, 8, 16, 64, 200):
        for _ in range(400):
            h = rng.integers(0, 1 << 64, 2 * size, dtype=np.uint64)
            a, b = h[:size], np.concatenate([h[: size - size // 9], h[size : size + size // 9]]) if size >= 9 else h[: size + size // 4]
            assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
            far += apart(a, b) > neardup.radius()
            other += apart(a, h[size:]) > neardup.radius()
            n += 1
    assert far <= 1 and other > 0.8 * n


def test_candidates_are_the_pairs_of_a_bucket_within_the_radius(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40)
    made = [(int(b ^ sum(1 << int(j) for j in rng.choice(63, rng.integers(0, 30), replace=False))), [int(k) for k in rng.integers(0, 30, 3)]) for b in base for _ in range(8)]
    df = spark.createDataFrame([(i, fp, keys) for i, (fp, keys) in enumerate(made)], "node long, fp long, keys array<long>")
    want = [(i, j) for i, j in itertools.combinations(range(len(made)), 2) if set(made[i][1]) & set(made[j][1]) and (made[i][0] ^ made[j][0]).bit_count() <= neardup.radius()]
    found = [(r["a"], r["b"]) for r in neardup.candidates(df).collect()]
    assert roots(len(made), found) == roots(len(made), want) and len(set(roots(len(made), want))) > 1


@pytest.mark.parametrize("rows", [30, 400])
def test_many_rows_of_a_key_meet(spark, rows, monkeypatch):
    from unskew.llm import common

    monkeypatch.setattr(common, "FEW", rows)
    left = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(3000)], "x long, k long")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", F.col("k") * 2)
    got = common.meet(left, right, "k", 3000).collect()
    assert sorted((r["x"], r["v"]) for r in got) == [(i, 2 * (7 if i % 3 else i)) for i in range(3000)]


def test_two_families_in_one_large_group(spark, monkeypatch):
    """Texts like the first one, texts unlike it but like each other, and a bridge between."""
    monkeypatch.setattr(neardup, "TILE", 9)
    words = [f"w{i}" for i in range(100)]
    made = [(i, " ".join([*words[: 99 - i % 3], f"a{i}"])) for i in range(30)]
    for cut in range(3, 60, 3):
        made.append((100 + cut, " ".join([*[f"z{i}" for i in range(cut)], *words[cut:]])))
    sets = [plain_set(t) for _, t in made]
    root = roots(len(made), [(a, b) for a, b in itertools.combinations(range(len(made)), 2) if linked(sets[a], sets[b])])
    kept = neardup.keep_one(spark.createDataFrame(made, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({made[r][0] for r in root})
