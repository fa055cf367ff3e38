"""Operators over whole neighbour lists against brute force."""

import numpy as np
import pytest

from unskew.operators import knn
from unskew.plans import queries as Q


@pytest.fixture(scope="module")
def all_points(spark):
    rows = sorted(Q.points(spark, "/root/testdata/sf0.01").collect())
    x = np.array([r["features"] for r in rows])
    d = np.stack([np.sqrt(((x - a) ** 2).sum(1)) for a in x])
    return np.array([r["id"] for r in rows]), np.array([r["label"] for r in rows]), d


def test_candidate_region_is_not_cut_at_reach(spark, all_points):
    ids, labels, d = all_points
    want = set()
    for i in range(len(ids)):
        run = 0
        for rank, j in enumerate((j for j in np.lexsort((ids, d[i])) if j != i), 1):
            want.add((ids[i], ids[j], rank))
            run = run + 1 if labels[j] != labels[i] else 0
            if run == 5:
                break
    got = Q.candidate_region_whole(spark, "/root/testdata/sf0.01").collect()
    assert max(r["rank"] for r in got) > 50
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_orem_generate_does_not_depend_on_reach(spark):
    from unskew.operators import neighbourhood

    rows = Q.points(spark, "/root/testdata/sf0.001").limit(80)
    few, all_ = (neighbourhood.orem_generate(rows, 0, 20, reach=n).orderBy("id").collect() for n in (40, 200))
    assert few == all_


def test_density_parent_of_all_rows(spark, all_points):
    ids, _, d = all_points
    got = {r["id"]: r for r in knn.density_parent(Q.points(spark, "/root/testdata/sf0.01")).collect()}
    k = max(15, int(len(ids) ** 0.5))
    near = np.sort(d + np.diag(np.full(len(ids), np.inf)), axis=1)[:, :k]
    rho = np.exp(-((near / np.median(near[:, -1])) ** 2)).sum(1)
    assert np.allclose([got[i]["rho"] for i in ids], rho)
    rho = np.array([got[i]["rho"] for i in ids])
    for i in range(len(ids)):
        up = np.flatnonzero((rho > rho[i]) | ((rho == rho[i]) & (ids < ids[i])))
        best = up[np.lexsort((ids[up], d[i][up]))][:1]
        assert got[ids[i]]["parent"] == (ids[best[0]] if len(best) else None)
    assert sum(r["parent"] is None for r in got.values()) == 1
