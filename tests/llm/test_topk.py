"""Bounds of cells, and many rows alike."""

import numpy as np

from unskew.llm import topk


def plain(rows, k, every):
    out = {}
    for q in sorted({i for i, _ in rows if i % every == 0}):
        own = min(v for i, v in rows if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in rows if i != q and len(v) == len(own))[:k]
        out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(scored)}
    return out


def search(spark, rows, k, every):
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, k, every).collect()}


def test_scores_lie_within_their_bounds():
    rng = np.random.default_rng(0)
    for scale in (1, 300, 10**6):
        v, q = rng.integers(-scale, scale + 1, (500, 12)), rng.integers(-scale, scale + 1, (20, 12)).astype(float)
        cells = topk.Cells(v.min(0), v.max(0))
        assert (np.abs(q @ cells.middles(cells.of(v)).T - q @ v.T) <= cells.error(q)[:, None]).all()


def test_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 37)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-40, 41, 5).tolist()) for i in range(150)] + [(i, rng.integers(-3, 4, 2).tolist()) for i in range(150, 190)]
    assert search(spark, rows, 4, 7) == plain(rows, 4, 7)


def test_many_rows_alike(spark):
    """Equal vectors under many ids, equal rows of one id, and constant dimensions."""
    rows = [(i, [5, 1, 2]) for i in range(300)] + [(301, [5, 1, 2])] * 40 + [(302, [9, 1, 2])] * 3 + [(303, [1, 1, 2]), (303, [2, 1, 2]), (350, [0, 1, 0])]
    got = search(spark, rows, 5, 50)
    assert got == plain(rows, 5, 50)


def test_few_survive_the_scan():
    rng = np.random.default_rng(2)
    v, q = rng.normal(0, 256, (8000, 64)).round(), rng.normal(0, 256, (50, 64)).round()
    cells = topk.Cells(v.min(0), v.max(0))
    left = topk.bounded(q, np.arange(-50, 0), cells.middles(cells.of(v)), np.arange(8000), np.arange(8000), cells.error(q), 5)
    assert len(left) < 50 * 40
