"""Searches that stream candidates past tasks: exact on odd data, and bounded in what they shuffle."""

import numpy as np
import pytest

from unskew.operators import knn


def brute(ids, labels, x, k, p, which):
    out = []
    for i in range(len(ids)):
        able = [j for j in range(len(ids)) if ids[j] != ids[i] and (which == "any" or (labels[j] == labels[i]) == (which == "same"))]
        d = (np.abs(x - x[i]) ** p).sum(1) ** (1 / p) if p != 2 else np.sqrt(((x - x[i]) ** 2).sum(1))
        out += [(ids[i], ids[j], r) for r, j in enumerate(sorted(able, key=lambda j: (d[j], ids[j]))[:k], 1)]
    return out


@pytest.mark.parametrize("kind", ["plain", "far", "wide", "huge", "equal"])
@pytest.mark.parametrize("p,which", [(2.0, "any"), (2.0, "same"), (1.0, "other"), (3.0, "any")])
def test_search_of_batches_is_exact(kind, p, which):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    x = {"plain": x, "far": x + 1e6, "wide": x * np.where(np.arange(300) % 50 == 0, 1e7, 1)[:, None], "huge": x * 1e18, "equal": np.round(x[np.arange(300) % 7], 1)}[kind]
    ids, labels = rng.permutation(300), (np.arange(300) % 9 == 0).astype(np.int32)
    state = knn.Nearest(ids, labels, x, 4, p, which)
    for a in range(0, 300, 70):
        state.read(ids[a : a + 70], labels[a : a + 70], x[a : a + 70])
    got = state.found()
    assert sorted(zip(got["id"].to_pylist(), got["neighbour"].to_pylist(), got["rank"].to_pylist())) == sorted(brute(ids, labels, x, 4, p, which))


def test_rows_met_grow_with_the_rows(spark):
    rows = knn.keyed(spark.range(4000).selectExpr("id", "0 AS label", "array(cast(id as double)) AS features"))
    few, many = (knn.dealt(rows.where(f"id < {n}"), rows.where(f"id < {n}"), n, n, 5, 8)[0] for n in (1000, 4000))
    assert few.count() == 1000 * (knn.TASKS + 1) and many.count() == 4000 * (knn.TASKS + 1)
    assert many.rdd.getNumPartitions() == knn.TASKS
    assert knn.dealt(rows, rows, 600_000, 600_000, 5)[0].rdd.getNumPartitions() == knn.TASKS


def test_density_keeps_lists_of_distances_not_rows_of_pairs(spark):
    rows = spark.range(400).selectExpr("id", "0 AS label", "array(cast(id * id as double), cast(id % 7 as double)) AS features")
    got = knn.nearest_distances(rows, 20)
    assert got.columns == ["id", "dists"] and got.count() == 400 and got.selectExpr("min(size(dists)) AS n").first()["n"] == 20


def test_eps_graphs_form_distances_of_near_pairs_alone(monkeypatch):
    from unskew.operators import clusters

    x = np.random.default_rng(2).normal(size=(500, 8))
    formed = []
    monkeypatch.setattr(clusters, "exact", lambda a, b: formed.append(len(a)) or knn.exact(a, b))
    got = np.concatenate([d for _, d in clusters._near(x, x, 1.0)])
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.array_equal(np.isfinite(got), want <= 1.0) and np.allclose(got[want <= 1.0], want[want <= 1.0])
    assert sum(formed) < 1.1 * (want <= 1.0).sum()


@pytest.mark.parametrize("which", ["any", "same", "other"])
def test_equal_rows_cost_no_pairs(which, monkeypatch):
    rng = np.random.default_rng(6)
    x, labels, ids = rng.integers(0, 2, (1200, 2)).astype(float), rng.integers(0, 3, 1200).astype(np.int32), rng.permutation(1200)
    x[0] = 7.0, 7.0
    formed, plain = [], knn.exact
    monkeypatch.setattr(knn, "exact", lambda a, b, p=2.0: formed.append(len(a)) or plain(a, b, p))
    state = knn.Nearest(ids, labels, x, 5, 2.0, which)
    order = np.argsort(ids)
    for at in range(0, 1200, 300):
        part = order[at : at + 300]
        state.read(ids[part], labels[part], x[part])
    for i in range(1200):
        able = (ids != ids[i]) if which == "any" else (ids != ids[i]) & ((labels == labels[i]) == (which == "same"))
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = sorted(zip(d[able], ids[able], strict=True))[:5]
        assert list(zip(*((c[i][np.isfinite(state.dist[i])]) for c in (state.dist, state.near)), strict=True)) == want
    # all pairs at the least distance were about 360,000, a quarter of all
    assert sum(formed) < 1200 * 60


def test_small_tables_meet_as_many_tasks_as_large_ones(spark):
    rows = knn.keyed(spark.range(6000).selectExpr("id", "0 AS label", "array(cast(id as double)) AS features"))
    few, many = (knn.dealt(rows.where(f"id < {n}"), rows.where(f"id < {n}"), n, n)[0].where("kind = 1").count() / n for n in (1600, 6000))
    assert few == many == knn.TASKS


@pytest.mark.parametrize("grid", [False, True])
def test_long_lists_are_those_of_a_full_order(grid, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (900, 5)).astype(float) if grid else rng.normal(size=(900, 5))  # with ties at the last place, or none
    ids, labels = rng.permutation(900), rng.integers(0, 3, 900).astype(np.int32)
    state, full = knn.Nearest(ids[:80], labels[:80], x[:80], 40), []
    monkeypatch.setattr(knn.np, "lexsort", lambda keys, sort=np.lexsort: full.append(np.size(keys[0])) or sort(keys))
    for a in range(0, 900, 300):
        state.read(ids[a : a + 300], labels[a : a + 300], x[a : a + 300])
    ordered = sum(full)
    got = state.found().to_pandas()
    assert grid or ordered == 0  # candidates are sorted only for ties
    for q in range(80):
        d = np.where(ids == ids[q], np.inf, np.sqrt(((x - x[q]) ** 2).sum(1)))
        want = np.lexsort((ids, d))[:40]
        mine = got[got["id"] == ids[q]].sort_values("rank")
        assert mine["neighbour"].tolist() == ids[want].tolist() and np.allclose(mine["dist"], d[want]) and mine["neighbour_label"].tolist() == labels[want].tolist()
