"""Operators on small rows, against plain Python."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from unskew.functions import dempster
from unskew.functions import vectors as V
from unskew.operators import knn, learners, metrics, optimise, report, resamplers, sampling, trees
from unskew.operators.learners import LEARNERS, SMOKE, paced
from unskew.sources import config, tabular
from unskew.streaming import monitor

RNG = np.random.default_rng(0)
X = np.concatenate([RNG.normal(0, 1, (90, 3)), RNG.normal(1.5, 1, (30, 3)), RNG.normal([3, 0, 1], 1, (10, 3))])
Y = np.repeat([0, 1, 2], [90, 30, 10])


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, int(c), x.tolist()) for i, (x, c) in enumerate(zip(X, Y, strict=True))], "id long, label int, features array<double>")


def test_neighbours_by_blocks(rows):
    whole = sorted(map(tuple, knn.neighbours(rows, 4).collect()))
    assert whole == sorted(map(tuple, knn.neighbours(rows, 4, block=17).collect()))
    at, away = resamplers.near(X, 4)
    got = {(r["id"], r["rank"]): (r["neighbour"], r["dist"]) for r in knn.neighbours(rows, 4).collect()}
    assert all(got[i, k + 1][0] == at[i, k] and math.isclose(got[i, k + 1][1], away[i, k]) for i in range(len(X)) for k in range(4))


def test_duplicates_are_neighbours(spark):
    df = spark.createDataFrame([(1, 0, [0.0]), (2, 0, [0.0]), (3, 1, [5.0])], "id long, label int, features array<double>")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in knn.neighbours(df, 2).collect()}
    assert got[1, 1] == 2 and got[2, 1] == 1 and got[3, 1] == 1
    assert knn.neighbours(df.limit(0), 2).collect() == []
    assert {r["id"]: r["safe"] for r in knn.safe_level(df.where("id = 3"), 2).collect()} == {3: 1.0}


def test_regions_match_kernels(rows):
    found = knn.neighbours(rows, len(X))
    cut, clean = {}, {}
    for r in knn.consecutive_cut(found, 5).collect():
        cut.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    for r in knn.clean_directions(knn.neighbours(rows, 20), rows).collect():
        clean.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    blocked = 0
    for i in range(0, len(X), 9):
        # the plan keeps the run of others itself, the kernel ends before it
        region, _ = resamplers.candidate_region(X, Y, i, 5)
        assert [n for _, n in sorted(cut.get(i, []))][: len(region)] == region.tolist()
        at, away = resamplers.near(X, 20)
        want = resamplers.clean_region(X, Y, i, at[i], away[i])
        assert [n for _, n in sorted(clean[i])] == want.tolist()
        blocked += 20 - len(want)
    assert blocked > 0


@pytest.mark.parametrize("method", sorted(resamplers.KERNELS))
def test_kernels(method):
    settings = {"mc_rbo": {"steps": 20}, "soup": {"update": False}}.get(method, {})
    x, y = resamplers.run_kernel(method, X, Y, 3, **settings)
    again, _ = resamplers.run_kernel(method, X, Y, 3, **settings)
    assert np.isfinite(x).all() and (x == again).all() and set(y) == {0, 1, 2}
    n = np.bincount(y)
    if method in ("SMOTE", "glos", "mdo", "orem_m", "QC-SMOTE", "smom", "mc_ccr", "mc_rbo"):
        assert (n == 90).all()
    if method in ("shsampler", "soup"):
        assert (n == round(np.mean([90, 30, 10]))).all()
    one = resamplers.run_kernel(method, X[:5], np.zeros(5, int), 3)
    assert len(one[1]) == 5
    lone = resamplers.run_kernel(method, X[:21], np.r_[np.zeros(20, int), 1], 3, **settings)
    assert np.isfinite(lone[0]).all()


@pytest.mark.parametrize("model", sorted(LEARNERS))
def test_learners(model):
    p = LEARNERS[model](X, Y, 3, 1, **SMOKE.get(model, {}))(X)
    assert p.shape == (len(X), 3) and np.allclose(p.sum(1), 1) and (p >= 0).all()
    if model not in ("DMSAM-OAdB", "DDPM"):  # the networks have few epochs here
        assert (p.argmax(1) == Y).mean() > 0.55


def test_trees_split_exactly():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    t = trees.fit_tree(x, np.array([0, 0, 1, 1]), 2)
    assert t.threshold[0] == 1.5 and (t.predict_proba(x).argmax(1) == [0, 0, 1, 1]).all()
    heavy = trees.fit_tree(x, np.array([0, 1, 1, 0]), 2, w=np.array([1, 1, 1, 100.0]), depth=1)
    assert heavy.threshold[0] == 2.5
    assert math.isclose(trees.balance(np.array([4.0, 4.0])), 8 * (math.log2(8) - math.log2(4)))


def test_linear_programs():
    got = optimise.linear_program([-1, -2], [[1, 1], [1, 3]], [4, 6])
    assert np.allclose(got, [3, 1], atol=1e-5)
    game = np.array([[1.0, -1.0], [-1.0, 1.0]])
    got = optimise.linear_program([0, 0, 1, -1], np.hstack([game, -np.ones((2, 1)), np.ones((2, 1))]), [0, 0], [[1, 1, 0, 0]], [1])
    assert np.allclose(got[:2], 0.5, atol=1e-5)


def test_programs_of_a_constraint_a_row_match_plain_ones():
    rng = np.random.default_rng(4)
    n, t = 150, 6
    m, cost, cap = rng.uniform(-1, 1, (n, t)), rng.uniform(0.5, 2, n) / n, rng.uniform(1, 3, n) / n
    want = optimise.linear_program(np.r_[np.zeros(t), cost], -np.hstack([m, np.eye(n)]), -np.ones(n), np.r_[np.ones(t), np.zeros(n)][None], [1])
    assert np.allclose(learners.soft_margin(m, cost), want, atol=1e-6)
    # the heaviest of t sums is least
    f = np.where(m.T > 0, 1.0, -1.0)
    want = optimise.linear_program(np.r_[np.zeros(n), 1, -1], np.vstack([np.hstack([f, -np.ones((t, 1)), np.ones((t, 1))]), np.hstack([np.eye(n), np.zeros((n, 2))])]), np.r_[np.zeros(t), cap], np.r_[np.ones(n), 0, 0][None], [1])
    free = np.vstack([np.hstack([-np.ones((t, 1)), np.ones((t, 1)), np.eye(t)]), np.zeros((1, t + 2))])
    got = optimise.tall_program(np.r_[np.zeros(n), 1, -1, np.zeros(t)], np.zeros((t + 1, 0)), np.vstack([f, np.ones((1, n))]), free, np.r_[np.zeros(t), 1], np.zeros((n, 0)), 1, cap)
    assert np.allclose(got[:n], want[:n], atol=1e-6) and (got[:n] <= cap + 1e-7).all() and abs(got[:n].sum() - 1) < 1e-7


def test_each_cell_is_trained_once_in_a_task_by_cells(spark, rows):
    from unskew.plans import benchmark

    once = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            once.add(b.num_rows)
            yield b

    schema = "dataset string, fold int, split string, id long, features array<double>, label_idx int"
    folds = spark.createDataFrame([("d", f, "test" if i % 2 == f - 1 else "train", i, X[i].tolist(), int(i >= 90)) for i in range(120) for f in (1, 2)], schema)
    pred = benchmark.predictions(folds, ["EASS", "HRIELM"], smoke=True)
    assert pred.rdd.getNumPartitions() == 16
    assert benchmark.results(pred.mapInArrow(counted, pred.schema), "s").count() == 2 and once.value == 240


@pytest.mark.parametrize("name", ["LexiBoost", "DualLexiBoost", "ILMNN"])
def test_a_fold_of_many_rows_needs_no_square_of_them(name):
    import tracemalloc

    rng = np.random.default_rng(6)
    y = rng.choice(3, 1500, p=(0.6, 0.3, 0.1))
    x = rng.normal(size=(1500, 3)) + 0.8 * y[:, None]
    tracemalloc.start()
    try:
        proba = learners.LEARNERS[name](x, y, 3, 5, **learners.SMOKE[name])(x)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 8 * 1500**2 and np.allclose(proba.sum(1), 1)


def test_paced_takes_balanced_samples():
    h = np.linspace(0, 1, len(Y))
    n = np.bincount(Y[paced(h, Y, np.random.default_rng(0), 0.1)])
    assert (n == 10).all()


def test_metrics_by_hand(spark):
    y, p = [0, 0, 1, 1, 2, 2, 2], [[0.7, 0.2, 0.1], [0.1, 0.6, 0.3], [0.2, 0.6, 0.2], [0.2, 0.6, 0.2], [0.1, 0.1, 0.8], [0.3, 0.3, 0.4], [0.5, 0.2, 0.3]]
    df = spark.createDataFrame([("m", a, int(np.argmax(b)), b) for a, b in zip(y, p, strict=True)], "model string, y int, yhat int, proba array<double>")
    got = metrics.all_metrics(df, ["model"], 3).first()
    yhat = [int(np.argmax(b)) for b in p]
    recall = [np.mean([h == c for a, h in zip(y, yhat, strict=True) if a == c]) for c in range(3)]
    assert math.isclose(got["Accuracy"], 5 / 7) and math.isclose(got["Recall"], np.mean(recall)) and math.isclose(got["GMean"], math.exp(np.mean(np.log(recall))))

    def auc(c):
        pos, neg = [b[c] for a, b in zip(y, p, strict=True) if a == c], [b[c] for a, b in zip(y, p, strict=True) if a != c]
        return np.mean([(i > j) + 0.5 * (i == j) for i, j in itertools.product(pos, neg)])

    assert math.isclose(got["AUC"], np.mean([auc(c) for c in range(3)]))
    missing = metrics.ranking(df.where("y < 2"), ["model"], 3).first()
    assert missing["AUC"] == 0 and missing["AUPRC"] == 0
    one = metrics.from_confusion(metrics.confusion(df.where("y = 1 and yhat = 1"), ["model"]), ["model"], 3).first()
    assert one["Kappa"] is None and one["MCC"] == 0 and one["F1"] == 1


def test_dempster(spark):
    m = lambda *x: spark.createDataFrame([(1, list(f), v) for f, v in x], "id int, focal array<int>, mass double")
    got = {tuple(r["focal"]): r["mass"] for r in dempster.combine_all([m(((0,), 0.6), ((0, 1), 0.4)), m(((1,), 0.5), ((0, 1), 0.5))]).collect()}
    assert math.isclose(got[(0,)], 0.3 / 0.7) and math.isclose(got[(1,)], 0.2 / 0.7) and math.isclose(got[(0, 1)], 0.2 / 0.7)
    clash = {tuple(r["focal"]): r["mass"] for r in dempster.combine(m(((0,), 1.0)), m(((1,), 1.0))).collect()}
    assert clash == {(0,): 0.5, (1,): 0.5}
    assert {r["class"]: r["probability"] for r in dempster.pignistic(m(((0,), 0.5), ((0, 1), 0.5))).collect()} == {0: 0.75, 1: 0.25}


def test_vector_expressions(spark):
    one = spark.range(1).select(F.array(F.lit(1.0), F.lit(2.0)).alias("a"), F.array(F.lit(4.0), F.lit(6.0)).alias("b"), F.array(F.lit(0.5), F.lit(1.0)).alias("g"))
    got = one.select(
        V.distance("a", "b").alias("l2"), V.distance("a", "b", 1).alias("l1"), V.distance("a", "b", 3).alias("l3"), V.interpolate("a", "b", F.lit(0.5)).alias("mid"), V.interpolate_each("a", "b", "g", F.lit(True)).alias("half"),
        V.rbf(F.lit(2.0), 2.0).alias("r"), V.rbf(F.lit(2.0), 0).alias("r0"), V.softmax("a").alias("s"), V.min_max(F.lit(3), F.lit(3), F.lit(3)).alias("mm"), V.normal_name(F.lit("MC-CCR_x")).alias("n"), V.argmax(F.array(F.lit(1), F.lit(3), F.lit(3))).alias("am"),
    ).first()
    assert (got["l2"], got["l1"], got["mid"], got["half"], got["mm"], got["n"], got["am"], got["r0"]) == (5.0, 7.0, [2.5, 4.0], [1.75, 4.0], 1.0, "mcccrx", 1, 0.0)
    assert math.isclose(got["l3"], (27 + 64) ** (1 / 3)) and math.isclose(got["r"], math.exp(-1)) and math.isclose(sum(got["s"]), 1)


def test_smote_lies_between_rows_of_the_class(rows):
    got = sampling.smote(rows, 3).collect()
    assert {c: sum(r["label"] == c for r in got) for c in range(3)} == {0: 90, 1: 90, 2: 90}
    made = [r for r in got if r["id"] < 0]
    for r in made[::15]:
        pool = X[Y == r["label"]]
        z = np.array(r["features"])
        gaps = [np.linalg.norm(a - z) + np.linalg.norm(b - z) - np.linalg.norm(a - b) for a in pool for b in pool]
        assert min(gaps) < 1e-9


def test_self_paced_is_balanced(rows):
    for i in range(0, 4):
        got = sampling.self_paced(rows.withColumn("h", F.pow(V.uniform(1, "id"), 3)), "h", i, 4).groupBy("label").count().collect()
        assert {r["count"] for r in got} == {10}


def test_report_helpers(spark):
    cells = spark.createDataFrame([("a", "d", 0.5, ""), ("b", "d", 0.7, None), ("a", "e", None, "")], "Model string, Dataset string, F1 double, Error string")
    assert [tuple(r) for r in report.failed_cells(cells, ("F1",)).collect()] == [("a", "e")]
    base = spark.createDataFrame([("b", 0.1), ("c", 0.2)], "Model string, F1 double")
    assert sorted(r["Model"] for r in report.with_baselines(cells.select("Model", "F1").where("Model = 'b'"), base).collect()) == ["b", "c"]
    again = spark.createDataFrame([("a", "d", "boom", 1), ("a", "d", "", 2), ("a", "d", "boom", 3), ("b", "d", "boom", 1), ("b", "d", "bang", 2)], "Model string, Dataset string, Error string, run int")
    assert {r["Model"]: (r["Error"], r["run"]) for r in report.last_results(again, "run").collect()} == {"a": ("", 2), "b": ("bang", 2)}


def test_paper_names(spark):
    models, titles = spark.createDataFrame([("MC-CCR",), ("x_y",)], "Model string"), spark.createDataFrame([("mc_ccr",), ("McCcr",), ("other",)], "Title string")
    assert {r["Model"]: r["Paper"] for r in report.paper_names(models, titles).collect()} == {"MC-CCR": "McCcr", "x_y": "x_y"}


def test_sources(spark, tmp_path):
    (tmp_path / "KEEL/complete").mkdir(parents=True)
    (tmp_path / "KEEL/5fold/five").mkdir(parents=True)
    (tmp_path / "Bearing/IR5").mkdir(parents=True)
    head = "F1,F2,Class\n"
    (tmp_path / "KEEL/complete/whole.csv").write_text(head + "".join(f"{i},{i * 2},{'b' if i % 5 == 0 else 'a'}\n" for i in range(20)))
    for k in range(1, 6):
        (tmp_path / f"KEEL/5fold/five/fold{k}_train.csv").write_text(head + "1,2,0\n3,4,1\n5,6,0\n")
        (tmp_path / f"KEEL/5fold/five/fold{k}_test.csv").write_text(head + "7,8,0\n")
    (tmp_path / "Bearing/IR5/x.csv").write_text("name,feat_a,feat_b,label\nq,1,2,0\nr,3,4,1\n")
    found = tabular.discover(str(tmp_path))
    assert [(d.name, d.source, d.ir) for d in found] == [("five", "keel", None), ("whole", "keel_complete", None), ("IR5_x", "bearing", 5)]
    assert tabular.discover(str(tmp_path), names=[]) == [] and len(tabular.discover(str(tmp_path), irs=[])) == 2
    assert tabular.catalog(spark, found).count() == 3
    whole = tabular.load_folds(spark, found[1]).collect()
    assert sum(r["split"] == "test" for r in whole) == 6 and {r["label_idx"] for r in whole} == {0, 1}
    five = tabular.load_folds(spark, found[0]).collect()
    assert len(five) == 20 and {r["fold"] for r in five} == {1, 2, 3, 4, 5}
    assert tabular.read_csv(spark, found[2].path, bearing=True).first()["features"] == [1.0, 2.0]
    out = spark.createDataFrame([("m", "d", 1.0, "x")], "Model string, Dataset string, F1 double, _hidden string")
    for _ in range(2):
        tabular.write_results(out, str(tmp_path / "r.parquet"))
    assert tabular.read_results(spark, str(tmp_path / "r.parquet")).columns == ["Model", "Dataset", "F1"]
    with pytest.raises(ValueError):
        (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
        tabular.read_results(spark, str(tmp_path / "bad.csv"))


def test_benchmark_reports_errors(spark, rows):
    from unskew.plans import benchmark

    folds = rows.select(F.lit("d").alias("dataset"), F.lit(1).alias("fold"), F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"), "id", "features", F.col("label").alias("label_idx"))
    got = {r["Model"]: r for r in benchmark.results(benchmark.predictions(folds, ["SPE", "mdo"], smoke=True, params={"mdo": {"nonsense": 1}}), "s").collect()}
    assert got["SPE"]["Error"] is None and got["SPE"]["Accuracy_mean"] > 0.5 and "nonsense" in got["mdo"]["Error"] and got["mdo"]["F1_mean"] is None
    late = benchmark.predictions(folds, ["DBCF"], limit=0.02).collect()
    assert len(late) == 1 and "TimeoutError" in late[0]["error"]
    with pytest.raises(ValueError):
        benchmark.predictions(folds, ["no such"])


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("models: [SPE]\nirs: []\nn_folds: 3\n")
    c = config.load(str(path), n_folds=4)
    assert c.models == ["SPE"] and c.irs == [] and c.n_folds == 4 and c.datasets is None
    assert config.load(str(tmp_path / "none.yaml")).irs == [5, 10, 20, 30] and config.load(keel_folds="complete").n_folds == 1
    with pytest.raises(ValueError):
        config.load(keel_folds="other")


def test_stream_monitor(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    q = monitor.class_balance(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("balance").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    q.awaitTermination(120)
    batch = monitor.class_balance(spark.read.parquet(f"{sf}/events.parquet"), "ts", "event_type")
    assert sorted(map(tuple, spark.table("balance").collect())) == sorted(map(tuple, batch.collect()))


def test_cli_runs_ranks_and_resumes(spark, tmp_path):
    from unskew import cli

    (tmp_path / "Heart").mkdir()
    rng = np.random.default_rng(4)
    for name in ("one", "two"):
        x = np.r_[rng.normal(0, 1, (40, 2)), rng.normal(2, 1, (12, 2))]
        (tmp_path / f"Heart/{name}.csv").write_text("a,b,Class\n" + "".join(f"{p},{q},{int(i >= 40)}\n" for i, (p, q) in enumerate(x)))
    out = str(tmp_path / "r.parquet")
    args = cli.parser().parse_args(["run", "--root", str(tmp_path), "--models", "SPE,mdo", "--out", out, "--n-folds", "3"])
    first = {(r["Model"], r["Dataset"]): r["Runtime_mean"] for r in cli.run(spark, args).collect()}
    assert len(first) == 4
    args.models = ["SPE", "mdo", "glos"]
    second = {(r["Model"], r["Dataset"]): r["Runtime_mean"] for r in cli.run(spark, args).collect()}
    assert len(second) == 6 and all(second[k] == v for k, v in first.items())
    ranked = cli.rank(spark, [out]).where("Group = 'Overall'").collect()
    assert {r["Model"] for r in ranked} == {"SPE", "mdo", "glos"} and sum(r["F1_rank"] for r in ranked) == 6


def test_plan_generators_stay_in_their_regions(rows):
    from unskew.operators import neighbourhood

    for r in neighbourhood.sphere_oversample(rows, 2, 40, 3).collect():
        z, reach = np.array(r["features"]), [np.sort(np.linalg.norm(X[Y != 2] - x, axis=1))[2] for x in X[Y == 2]]
        assert any(np.linalg.norm(z - x) <= d + 1e-9 for x, d in zip(X[Y == 2], reach, strict=True))
    made = neighbourhood.orem_generate(rows, 2, 25).collect()
    assert len(made) == 25 and len({r["id"] for r in made}) == 25
    for r in made:
        z = np.array(r["features"])
        assert any((np.minimum(x, o) - 1e-9 <= z).all() and (z <= np.maximum(x, o) + 1e-9).all() for x in X[Y == 2] for o in X)
    sets = {}
    for r in neighbourhood.balanced_sets(rows).collect():
        sets.setdefault(r["set"], []).append(r["label"])
    assert {k: [v.count(c) for c in range(3)] for k, v in sets.items()} == {0: [90, 30, 10], 1: [30, 30, 10], 2: [10, 10, 10]}


def test_workbook(spark, tmp_path):
    import zipfile
    from xml.etree import ElementTree

    from unskew.sources import xlsx

    xlsx.write(str(tmp_path / "r.xlsx"), {"Means & more": spark.createDataFrame([("a<b", 1.5, None), ("c", float("nan"), True)], "m string, x double, b boolean"), "Notes": spark.range(2)})
    with zipfile.ZipFile(tmp_path / "r.xlsx") as z:
        for n in z.namelist():
            ElementTree.fromstring(z.read(n))
        text = z.read("xl/worksheets/sheet1.xml").decode()
        assert "a&lt;b" in text and "<v>1.5</v>" in text and "nan" not in text and len(z.namelist()) == 6
    assert xlsx._name(0) == "A" and xlsx._name(27) == "AB"


def test_excluded_models_come_last_and_are_noted(spark, tmp_path):
    from unskew import cli

    made = [("a", "d", "keel", 0.5, ""), ("a", "e", "keel", 0.6, ""), ("Zb", "d", "keel", 0.9, ""), ("c", "d", "keel", 0.4, "x"), ("c", "e", "keel", 0.4, "")]
    rows = spark.createDataFrame([(m, d, s, v, v, v, v, 1.0, e) for m, d, s, v, e in made], "Model string, Dataset string, Source string, F1_mean double, GMean_mean double, AUC_mean double, AUPRC_mean double, Runtime_mean double, Error string")
    rows.write.parquet(str(tmp_path / "r.parquet"))
    got = [r["Model"] for r in cli.rank(spark, [str(tmp_path / "r.parquet")], {"a": "A"}).where("Group = 'Overall'").collect()]
    assert got == ["A", "c", "Zb"]
    from unskew.operators import report

    notes = {r["Item"]: r["Text"] for r in report.notes(cli.read_ranked(spark, [str(tmp_path / "r.parquet")], {"a": "A"})).collect()}
    assert notes == {"Excluded Zb": "datasets without result: keel: 1", "Excluded c": "datasets without result: keel: 1", "Renamed a": "to A, 2 rows"}
    with pytest.raises(ValueError, match="GMean"):
        rows.drop("GMean_mean").write.parquet(str(tmp_path / "less.parquet"))
        cli.rank(spark, [str(tmp_path / "less.parquet")])


def test_a_lost_writer_leaves_the_old_table(spark, tmp_path):
    import os

    from unskew.sources import tabular

    path = str(tmp_path / "t.parquet")
    tabular.write_results(spark.createDataFrame([("a", "d")], "Model string, Dataset string"), path)
    tabular.write_results(spark.createDataFrame([("b", "d")], "Model string, Dataset string"), path)
    assert [r["Model"] for r in tabular.read_results(spark, path).collect()] == ["b"] and not os.path.exists(path + ".old")
    os.rename(path, path + ".old")  # lost between the two renames
    assert [r["Model"] for r in tabular.read_results(spark, path).collect()] == ["b"]


def test_selection_keeps_every_class():
    from unskew.operators.learners import select_rows

    p, y = np.array([0.9, 0.8, 0.7, 0.2, 0.1, 0.6]), np.array([0, 0, 0, 1, 1, 2])
    assert select_rows(p, y).tolist() == [True, True, True, True, False, True]
    assert select_rows(p, y, 4).tolist() == [True, True, False, True, False, True]
    assert select_rows(p, y, 1).tolist() == [True, False, False, True, False, True]


def test_density_peaks_and_groups():
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 0.3, (40, 2)), rng.normal(5, 0.3, (40, 2))
    label = resamplers.density_peaks(np.concatenate([a, b]))
    assert not set(label[:40]) & set(label[40:])
    group, nearer = resamplers.nromm_groups(np.concatenate([a, b[:1]]), b[1:])
    assert (group[:40] == resamplers.INLAND).mean() > 0.8 and group[40] == resamplers.TRAPPED and nearer[40]
    z = resamplers.within_boundary(a[0], b[0], b)
    assert np.isclose(np.linalg.norm(z - a[0]), 0.95 * np.linalg.norm(b - a[0], axis=1).min())


@pytest.mark.parametrize("settings", [{"cleaning": "remove"}, {"cleaning": "ignore"}, {"selection": "random"}, {"rivals": "complete"}])
def test_cleaning_of_spheres(settings):
    x, y = resamplers.run_kernel("mc_ccr", X, Y, 3, **settings)
    n = np.bincount(y)
    assert np.isfinite(x).all() and abs(n[2] - 90) <= 15
    if settings.get("cleaning") != "remove":
        assert n[0] == 90


def test_updated_neighbour_lists_match_new_ones():
    x = np.round(np.random.default_rng(1).normal(0, 1, (60, 2)), 1)
    at, away = resamplers.near(x, 5)
    for b in (3, 3, 17):
        x, at, away = resamplers.with_copy(x, at, away, b)
        new_at, new_away = resamplers.near(x, 5)
        assert np.allclose(away, new_away) and (at == new_at).all()
