"""Resampling methods as plans: whole classes, points where they belong, no bound on rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from unskew.lineage import written
from unskew.operators import lifting as L
from unskew.operators import neighbourhood
from unskew.operators.knn import merged, neighbours
from unskew.operators.resamplers import near, run_kernel, with_copy
from unskew.plans.learning import QUERIES


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = np.round(np.concatenate([rng.normal(c, 0.5, (n, 2)) for c, n in ((0, 30), (1.5, 12), (4, 6))]), 3)
    y = np.repeat([0, 1, 2], [30, 12, 6])
    return x, y, spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(48)], "id long, label int, features array<double>").repartition(3)


LIFTS = {"orem_m": L.orem_resample, "smom": L.smom_resample, "glos": L.glos_resample, "qc_smote": L.qc_resample}


@pytest.mark.parametrize("method", sorted(LIFTS))
def test_classes_are_filled_beside_the_originals(table, method):
    x, y, rows = table
    got = LIFTS[method](rows).collect()
    assert sorted(r["label"] for r in got) == [0] * 30 + [1] * 30 + [2] * 30 and len({r["id"] for r in got}) == 90
    assert {r["id"]: tuple(r["features"]) for r in got if r["id"] >= 0} == {i: tuple(x[i]) for i in range(48)}
    if method in ("smom", "qc_smote"):  # between rows of the class
        for c in (1, 2):
            made = np.array([r["features"] for r in got if r["id"] < 0 and r["label"] == c])
            assert (made >= x[y == c].min(0) - 1e-9).all() and (made <= x[y == c].max(0) + 1e-9).all()


def test_hybrid_goes_to_the_mean(table):
    got = L.sh_resample(table[2]).collect()
    assert sorted(r["label"] for r in got) == [0] * 16 + [1] * 16 + [2] * 16 and sum(r["id"] >= 0 for r in got) == 16 + 12 + 6


def test_borders_breed_as_many_points_as_in_the_kernel(spark):
    rng = np.random.default_rng(4)
    x, y = np.round(rng.normal(size=(60, 2)), 3), np.repeat([0, 1, 2], [32, 18, 10])
    rows = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(60)], "id long, label int, features array<double>")
    got = L.eb_resample(rows).collect()
    want = run_kernel("EB-SMOTE", x, y, 3)[1]
    assert len(want) > 90 and np.bincount([r["label"] for r in got]).tolist() == np.bincount(want).tolist()
    assert {r["id"] for r in got if r["id"] >= 0} == set(range(60)) and len({r["id"] for r in got}) == len(got)


def test_queries_have_no_bound_on_rows():
    for name in ("eb_smote", "glos", "orem_m", "qc_smote", "shsampler", "smom"):
        assert QUERIES[f"resample_{name}"].__module__ == "unskew.plans.learning"


def test_soup_goes_to_the_mean_by_copies(table):
    x, y, rows = table
    got = L.soup_resample(rows).collect()
    assert sorted(r["label"] for r in got) == [0] * 16 + [1] * 16 + [2] * 16 and len({r["id"] for r in got}) == 48
    assert sum(r["id"] >= 0 for r in got) == 16 + 12 + 6
    for c in (1, 2):
        assert {tuple(r["features"]) for r in got if r["label"] == c} <= {tuple(v) for v in x[y == c]}


def test_lists_after_copies_are_those_of_the_kernel(spark):
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(size=(40, 2)), 2), np.repeat([0, 1], [30, 10])
    (at, away), own = near(x, 3), np.arange(40)
    held = [(i, int(y[i]), 1, [(float(d), 0, int(j), int(y[j])) for d, j in zip(away[i], at[i], strict=True)]) for i in range(40)]
    held = spark.createDataFrame(held, "id long, label int, m long, near array<struct<dist: double, turn: int, site: long, kind: int>>")
    for turn, copied in ((1, [31]), (2, [31, 35]), (3, [35, 35, 39])):
        added = spark.createDataFrame([(i, copied.count(i)) for i in sorted(set(copied))], "id long, more long")
        held = L.with_copies(held, added, 1, turn, 3)
        for b in copied:
            x, at, away = with_copy(x, at, away, b)
            own = np.append(own, own[b])
    got = {r["id"]: r for r in held.collect()}
    assert {i: r["m"] for i, r in got.items()} == dict(enumerate(np.bincount(own).tolist()))
    for i in range(40):
        assert [(e["dist"], e["site"]) for e in got[i]["near"]] == [(d, own[j]) for d, j in zip(away[i], at[i], strict=True)]


def test_soup_has_no_bound_on_rows():
    assert QUERIES["resample_soup"].__module__ == "unskew.plans.learning"


def test_nromm_has_no_bound_on_rows():
    assert QUERIES["resample_nromm"].__module__ == "unskew.plans.learning"


def test_tables_of_rounds_keep_the_size_that_they_have(spark):
    state = spark.range(50).selectExpr("id", "id AS x")
    for _ in range(4):
        state = written(state.join(state.select("id", F.col("x").alias("y")), "id").select("id", (F.col("y") + 1).alias("x")))
    assert sorted(r["x"] for r in state.collect()) == list(range(4, 54))
    assert int(str(state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1_000_000


def test_lists_of_own_and_others_say_what_one_search_of_all_says(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(60, 2)), 1)  # with equal points and distances
    rows = spark.createDataFrame([(int(i), int(i % 3 == 0), v.tolist()) for i, v in enumerate(x)], "id long, label int, features array<double>")
    own, rest = rows.where("label = 1"), rows.where("label = 0")
    want = {}
    for r in neighbours(rows, 5, queries=own).collect():
        want.setdefault(r["id"], []).append(r["neighbour_label"])
    got = merged(neighbours(own, 5), neighbours(rest, 5, queries=own), 5).collect()
    far = {r["id"]: r["dist"] for r in neighbours(rest, 1, queries=own).collect()}
    assert {r["id"]: (r["same"], r["of"]) for r in got} == {i: (sum(v), len(v)) for i, v in want.items()}
    assert {r["id"]: r["far"] for r in got} == far


def test_quality_control_asks_for_each_thing_once(table, monkeypatch):
    asked, pairs = [], []
    for module in (L, neighbourhood):
        found = module.neighbours
        monkeypatch.setattr(module, "neighbours", lambda rows, k, queries=None, found=found, **more: asked.append(1) or found(rows, k, queries=queries, **more))
    weights = neighbourhood.midpoint_weights
    monkeypatch.setattr(neighbourhood, "midpoint_weights", lambda rows, label, k, of: pairs.append(of.count()) or weights(rows, label, k, of))
    rows = table[2].where("id < 42")  # 30 and 12 rows: 18 are made
    got = L.qc_resample(rows, 5)
    assert got.where("label = 1").count() == 30
    # own class, others, midpoints of drawn ways (of 60), candidates among both
    assert len(asked) == 5 and pairs[0] <= 18 * 5 and pairs[0] < 60


def test_nromm_searches_no_class_twice_and_makes_the_points_that_are_missing(table, monkeypatch):
    searched, grouped = [], []
    kin, groups = L.kin_of, L.groups
    monkeypatch.setattr(L, "kin_of", lambda pool, k: searched.append((pool.first()["label"], pool.count())) or kin(pool, k))
    monkeypatch.setattr(L, "groups", lambda kin, pool, rest, k: grouped.append(1) or groups(kin, pool, rest, k))
    got = L.nromm_resample(table[2]).collect()
    assert sorted(r["label"] for r in got) == [0] * 30 + [1] * 30 + [2] * 30 and len({r["id"] for r in got}) == 90
    assert {r["id"] for r in got if r["id"] >= 0} == set(range(48))
    # the largest class once, the second before and after it grew, the third once; nothing at the end
    assert searched == [(0, 30), (1, 12), (1, 30), (2, 6)] and len(grouped) == 5


def test_points_are_kept_by_the_margin_with_few_searches(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pool, rest = rng.normal(0, 1, (40, 3)), rng.normal(0.8, 1, (80, 3))
    frame = lambda x, label, first: spark.createDataFrame([(first + i, label, v.tolist()) for i, v in enumerate(x)], "id long, label int, features array<double>")
    away = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)).min(1)
    seed = rng.integers(0, 40, 200)
    x = pool[seed] + rng.normal(0, 0.4, (200, 3))
    made = [(-1 - i, 1, v.tolist(), i, float(o), float(r)) for i, (v, o, r) in enumerate(zip(x, away(pool[seed], rest), np.sqrt(((x - pool[seed]) ** 2).sum(1)), strict=True))]
    asked = spark.createDataFrame(made, "id long, label int, features array<double>, slot long, other double, reach double")
    queries, search = [], L.neighbours
    monkeypatch.setattr(L, "neighbours", lambda rows, k, queries=None, n=queries: n.append(queries.count()) or search(rows, k, queries=queries))
    got = {r["slot"] for r in L.nearer(asked, frame(pool, 1, 0), frame(rest, 0, 100), 1.05).collect()}
    assert got == set(np.flatnonzero(away(x, rest) > 1.05 * away(x, pool)).tolist()) and 20 < len(got) < 200
    assert queries[1] < queries[0] < 200


def test_no_inland_row_is_nearer_to_others(table):
    for label in range(3):
        pool, rest = table[2].where(F.col("label") == label), table[2].where(F.col("label") != label)
        same = {r["id"]: r["dist"] for r in neighbours(pool, 1).collect()}
        marks = L.groups(L.kin_of(pool), pool, rest).collect()
        assert len(marks) == pool.count() and not [r for r in marks if r["group"] == L.INLAND and r["other"] < same[r["id"]]]
