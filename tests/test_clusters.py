"""Clusters against plain versions: chains of parents, components, density peaks and eps-graphs."""

import math

import numpy as np
import pytest

from unskew.operators import clusters as C
from unskew.operators import knn


def table(spark, n=120, seed=0, parts=3):
    rng = np.random.default_rng(seed)
    x = np.round(np.concatenate([rng.normal(c, 0.4, (n // 3, 2)) for c in ((0, 0), (4, 0), (0, 4))]), 2)
    return x, spark.createDataFrame([(i, 0, x[i].tolist()) for i in range(len(x))], "id long, label int, features array<double>").repartition(parts)


def test_roots_of_long_chains(spark):
    made = [(i, i - 1 if i % 100 else None) for i in range(300)] + [(500, 500), (501, 500)]
    got = {r["id"]: r["root"] for r in C.roots(spark.createDataFrame(made, "id long, parent long")).collect()}
    assert got == {i: i // 100 * 100 for i in range(300)} | {500: 500, 501: 500}
    with pytest.raises(RuntimeError):
        C.roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent long"), 5)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(i + 200, 100) for i in range(40)] + [(7, 7), (900, 901), (901, 900)]
    got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100} | {i + 200: 100 for i in range(40)} | {900: 900, 901: 900}
    assert C.components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_eps(x, eps, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = (d <= eps).sum(1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    changed = True
    while changed:
        changed = False
        for i in np.flatnonzero(core):
            low = label[(d[i] <= eps) & core].min()
            if low < label[i]:
                label[i], changed = low, True
    for i in np.flatnonzero(~core):
        near = np.flatnonzero(core & (d[i] <= eps))
        if len(near):
            label[i] = label[min(near, key=lambda j: (d[i, j], j))]
    return core, label


@pytest.mark.parametrize("block,eps,least", [(4096, 0.3, 4), (17, 0.3, 4), (40, 0.15, 3), (30, 9.0, 5), (50, 0.01, 2)])
def test_eps_clusters_match_plain_version(spark, block, eps, least):
    x, rows = table(spark)
    core, label = plain_eps(x, eps, least)
    got = {r["id"]: r for r in C.eps_clusters(rows, eps, least, block).collect()}
    assert len(got) == len(x)
    for i in range(len(x)):
        assert got[i]["core"] == core[i] and got[i]["cluster"] == (None if label[i] < 0 else label[i])


def test_class_eps(spark):
    x, rows = table(spark)
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 1)[:, 5]
    assert math.isclose(C.class_eps(rows), float(np.median(d[d > 0])))
    assert C.class_eps(rows.where("id = 1")) == 1.0 and C.class_eps(rows.limit(0)) == 1.0


def test_density_clusters_match_plain_version(spark):
    x, rows = table(spark, 150, 3)
    n, k = 150, 15
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = [[j for j in np.lexsort((np.arange(n), d[i])) if j != i][:k] for i in range(n)]
    dc = np.median([d[i, near[i][-1]] for i in range(n)])
    rho = np.array([np.exp(-((d[i, near[i]] / dc) ** 2)).sum() for i in range(n)])
    order = np.lexsort((np.arange(n), -rho))
    parent, delta = np.full(n, -1), np.zeros(n)
    delta[order[0]] = d[order[0], near[order[0]][-1]]
    for r in range(1, n):
        i = order[r]
        parent[i] = min(order[:r], key=lambda j: (d[i, j], j))
        delta[i] = d[i, parent[i]]
    centres = np.lexsort((np.arange(n), -rho * delta))[: math.ceil(math.sqrt(n / 2))].tolist()

    def cluster(i):
        while i >= 0 and i not in centres:
            i = parent[i]
        return i if i >= 0 else centres[0]

    got = {r["id"]: r for r in C.density_clusters(rows).collect()}
    assert all(got[i]["cluster"] == cluster(i) and math.isclose(got[i]["delta"], delta[i], rel_tol=1e-9) for i in range(n))


def test_small_tables(spark):
    _, rows = table(spark)
    assert C.density_clusters(rows.limit(0)).collect() == [] and C.eps_clusters(rows.limit(0), 1.0, 2).collect() == []
    assert [tuple(r) for r in C.density_clusters(rows.where("id = 5")).collect()] == [(5, 5, 1.0, 1.0)]
    assert [tuple(r) for r in C.eps_clusters(rows.where("id = 5"), 1.0, 2).collect()] == [(5, False, None)]


def test_only_rows_without_a_denser_neighbour_search_for_one(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.round(np.concatenate([rng.normal(c, 1, (150, 3)) for c in (0, 6)]), 2)
    rows = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, label int, features array<double>")
    asked, search = [], knn.nearest_higher
    monkeypatch.setattr(knn, "nearest_higher", lambda rows, height, queries=None: asked.append(queries.count()) or search(rows, height, queries))
    got = {r["id"]: r for r in knn.density_parent(rows, 20).collect()}
    assert 0 < asked[0] < 60  # of 300
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i, r in got.items():
        up = [j for j in got if (got[j]["rho"], -j) > (r["rho"], -i)]
        best = min(up, key=lambda j: (d[i, j], j), default=None)
        assert r["parent"] == best and (best is None or abs(r["delta"] - d[i, best]) < 1e-9)
