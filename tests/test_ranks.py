"""Running sums and quantiles by slices against NumPy, whatever the size of a slice."""

import re

import numpy as np
import pytest

from unskew.operators import metrics, neighbourhood, ranks
from unskew.plans import queries as Q


@pytest.mark.parametrize("slice_rows", [1, 7, 1000])
def test_prefix_sums(spark, slice_rows):
    rng = np.random.default_rng(1)
    made = [(g, float(v), int(rng.integers(5)), int(rng.integers(9))) for g in ("a", None, "c") for v in rng.choice(1000, {"a": 200, None: 30, "c": 1}[g], replace=False)]
    rows = spark.createDataFrame(made, "g string, v double, a long, b long")
    got = {(r["g"], r["v"]): r for r in ranks.prefix_sums(rows, ["a", "b"], "v", "g", slice_rows=slice_rows).collect()}
    assert len(got) == len(made)
    for g in ("a", None, "c"):
        mine = sorted(r for r in made if r[0] == g) if g else sorted(r[1:] for r in made if r[0] is None)
        mine = [r[-3:] for r in mine]
        for i, (v, _, _) in enumerate(mine):
            r = got[g, v]
            assert r["upto_a"] == sum(m[1] for m in mine[: i + 1]) and r["upto_b"] == sum(m[2] for m in mine[: i + 1])
            assert r["all_a"] == sum(m[1] for m in mine) and r["next"] == (mine[i + 1][0] if i + 1 < len(mine) else None)


@pytest.mark.parametrize("slice_rows", [1, 5, 1000])
def test_quantiles(spark, slice_rows):
    rng = np.random.default_rng(2)
    made = [(int(k), float(np.round(v, 1))) for k in range(3) for v in rng.normal(size=(1, 40, 101)[k])] + [(0, None)]
    rows = spark.createDataFrame(made, "k int, v double")
    got = {r["k"]: r for r in ranks.quantiles(rows, "v", {"lo": 0.05, "mid": 0.5, "hi": 0.95}, "k", slice_rows=slice_rows).collect()}
    for k in range(3):
        v = [x for y, x in made if y == k and x is not None]
        assert np.allclose([got[k]["lo"], got[k]["mid"], got[k]["hi"]], np.quantile(v, [0.05, 0.5, 0.95]))
    assert ranks.quantiles(rows.where("k > 5"), "v", {"q": 0.5}).first()["q"] is None


def test_ranks_of_metrics_and_cuts_go_by_slices(spark, sf, monkeypatch):
    one = sorted(map(tuple, metrics.ranking(Q.predictions(spark, sf), ["model"], 3).collect()))
    cut = neighbourhood.best_split(Q.read(spark, sf, "lineitem").selectExpr("l_extendedprice AS v", "CAST(l_quantity > 25 AS INT) AS y"), "v", "y", 2).collect()
    monkeypatch.setattr(ranks, "SLICE_ROWS", 11)
    two = sorted(map(tuple, metrics.ranking(Q.predictions(spark, sf), ["model"], 3).collect()))
    assert np.allclose(np.array(one, float), np.array(two, float), rtol=1e-12)
    assert cut == neighbourhood.best_split(Q.read(spark, sf, "lineitem").selectExpr("l_extendedprice AS v", "CAST(l_quantity > 25 AS INT) AS y"), "v", "y", 2).collect()


@pytest.mark.parametrize("name", ["ranking_metrics", "best_split", "density_clip", "median_distance", "density_parent"])
def test_no_keyless_window_percentile_or_cross_join_over_rows(spark, sf, name):
    text = Q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in text and "CartesianProduct" not in text
    for keys in re.findall(r"Window \[(.*?)\], \[(.*?)\]", text):
        assert "__slice" in keys[1] or "__before" in keys[0] or "__first" in keys[0] or "nb" in keys[1] or "id#" in keys[1] or "sum(" in keys[0], keys
