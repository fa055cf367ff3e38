"""What plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from unskew.operators import report, sampling
from unskew.plans import queries as Q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["knn_join", "safe_level", "smote", "orem_generate", "sphere_oversample", "midpoint_weights", "stratified_folds", "imbalance_ratio", "random_balance"])
def test_no_join_of_all_pairs_of_rows(spark, sf, name):
    text = plan(Q.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    # a nested loop may only meet one row of totals, or a row for each class
    assert all("Build" in line for line in text.split("\n") if "BroadcastNestedLoopJoin" in line)


def test_scans_read_only_what_is_used(spark, sf):
    text = plan(Q.report_rankings(spark, sf))
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert read and all("l_shipdate" not in r and "l_extendedprice" not in r for r in read)
    text = plan(Q.read(spark, sf, "lineitem").where("l_quantity > 40").groupBy("l_returnflag").agg(F.count("*")))
    assert "GreaterThan(l_quantity,40.0)" in text


def test_places_need_no_window_of_a_whole_class(spark, sf):
    rows = Q.read(spark, sf, "orders")
    text = plan(sampling.stratified_folds(rows, 5, 42, "o_orderpriority", "o_orderkey"))
    windows = re.findall(r"Window \[row_number\(\).*?\], \[(.*?)\]", text)
    assert windows and all("__slice" in w for w in windows)


def test_results_do_not_depend_on_partitions(spark, sf):
    rows = Q.read(spark, sf, "orders")
    one = sampling.imbalance_ratio(rows.coalesce(1), 10, 1, "o_orderpriority", "o_orderkey")
    many = sampling.imbalance_ratio(rows.repartition(7), 10, 1, "o_orderpriority", "o_orderkey")
    key = lambda df: sorted(r["o_orderkey"] for r in df.collect())
    assert key(one) == key(many)
    points = Q.points(spark, sf)
    key = lambda df: sorted((r["id"], r["label"], [round(x, 9) for x in r["features"]]) for r in df.collect())
    assert key(sampling.smote(points.coalesce(1))) == key(sampling.smote(points.repartition(5)))


def test_failed_models_are_left_out(spark):
    cells = spark.createDataFrame([("a", "d", "keel", 0.5, ""), ("a", "e", "keel", 0.6, ""), ("b", "d", "keel", 0.9, ""), ("b", "e", "keel", 0.9, " x ")], "Model string, Dataset string, Source string, F1 double, Error string")
    got = report.rankings(report.with_group(cells), ("F1",)).collect()
    assert {(r["Group"], r["Model"]) for r in got} == {("Overall", "a"), ("keel", "a")}


@pytest.mark.parametrize("slices", [2, 7, 64])
def test_ranks_by_slices(spark, slices):
    """Many rows of one score, few rows, and no scores at all but one."""
    made = [(i, "a", float(i % 3 == 0)) for i in range(300)] + [(i, "b", float(i * 37 % 101)) for i in range(300, 400)] + [(400, "c", 1.0)] + [(401 + i, None, 2.0) for i in range(9)]
    got = sampling.with_rank(spark.createDataFrame(made, "id long, label string, s double"), F.col("s"), "label", slices=slices).collect()
    want = {}
    for label in ("a", "b", "c", None):
        want |= {i: r for r, (_, i) in enumerate(sorted((s, i) for i, y, s in made if y == label), 1)}
    assert {r["id"]: r["place"] for r in got} == want


@pytest.mark.parametrize("name", ["soup_undersample", "soup_replicate", "roulette_delete", "largest_remainder", "weighted_sample", "did_scores", "inverse_density"])
def test_no_window_gathers_a_class(spark, sf, name):
    text = plan(Q.QUERIES[name](spark, sf))
    for keys in re.findall(r"Window \[.*?\], \[(.*?)\]", text):
        assert not re.fullmatch(r"(label|o_orderpriority)#\d+", keys.strip()) or "__before" in text, keys
