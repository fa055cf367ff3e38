"""Self-paced ensembles, boosting by margins and random-layer machines against plain versions."""

import math

import numpy as np
import pytest

from unskew.operators import elm, ensembles as E, forest
from unskew.operators.knn import neighbours


def table(spark, n=240, d=3, seed=0, sizes=(0.6, 0.3, 0.1)):
    rng = np.random.default_rng(seed)
    y = rng.choice(3, n, p=sizes)
    x = np.round(rng.normal(size=(n, d)) + y[:, None], 1)
    return x, y, spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], "id long, label int, features array<double>")


def plain_take(h, target, round_, rounds, bins):
    b = np.minimum(bins - 1, (h * bins).astype(int))
    names = np.unique(b)
    have = np.array([(b == k).sum() for k in names])
    if len(h) <= target:
        return dict(zip(names.tolist(), have.tolist(), strict=True))
    w = 1 / (np.array([h[b == k].mean() for k in names]) + math.tan(math.pi * round_ / (2 * max(1, rounds - 1))))
    w = w / (w.sum() + 1e-12)
    take = np.minimum(np.floor(w * target).astype(int), have)
    while take.sum() < target:
        for j in sorted(np.flatnonzero(have > take), key=lambda j: (-w[j], names[j])):
            if take.sum() < target:
                take[j] += 1
    return dict(zip(names.tolist(), take.tolist(), strict=True))


@pytest.mark.parametrize("round_,target", [(1, 30), (4, 60), (9, 25), (5, 1), (3, 120)])
def test_hardness_bins_match_plain_version(spark, round_, target):
    rng = np.random.default_rng(round_)
    y = rng.choice(3, 400, p=(0.6, 0.3, 0.1))
    h = np.clip(rng.beta(0.4, 2.5, 400) * (1 + y), 0, 1)
    rows = spark.createDataFrame([(i, int(y[i]), float(h[i])) for i in range(400)], "id long, label int, h double")
    got = {(r["label"], r["bin"]): r["take"] for r in E.hardness_bins(rows, "h", round_, 10, target, 20).collect()}
    assert got == {(c, b): n for c in range(3) for b, n in plain_take(h[y == c], target, round_, 10, 20).items()}
    drawn = E.paced_sample(rows, "h", round_, 10, target).collect()
    assert len(drawn) == len({r["id"] for r in drawn}) == sum(got.values())


def test_sample_with_replacement(spark):
    rows = spark.createDataFrame([(i, i % 2, "a" if i < 30 else "b") for i in range(40)], "id long, label int, bin string")
    wanted = spark.createDataFrame([(0, "a", 1000), (1, "a", 0), (1, "b", 3), (5, "b", 9)], "label int, bin string, n long")
    got = E.sample_with_replacement(rows, wanted, ["label", "bin"]).collect()
    a = [r["id"] for r in got if r["bin"] == "a"]
    assert len(a) == 1000 and set(a) == set(range(0, 30, 2)) and max(map(a.count, set(a))) < 120
    assert sum(r["bin"] == "b" for r in got) == 3 and sorted(r["draw"] for r in got if r["bin"] == "b") == [0, 1, 2]
    assert E.sample_with_replacement(rows.limit(0), wanted, ["label", "bin"]).collect() == []


def test_self_paced_ensemble(spark):
    x, y, rows = table(spark)
    e = E.fit_self_paced(rows, rounds=4, trees=5, depth=4)
    got = np.array([r["proba"] for r in e.predict(rows).orderBy("id").collect()])
    assert len(e.models) == 4 and np.allclose(got.sum(1), 1)
    assert np.mean([(got.argmax(1)[y == c] == c).mean() for c in range(3)]) > 0.65
    for kind in ("squared", "entropy"):
        assert len(E.fit_self_paced(rows, rounds=2, trees=2, kind=kind, depth=2).models) == 2
    with pytest.raises(ValueError):
        E.fit_self_paced(rows.limit(0), 2, 2)


def test_margin_rounds_match_plain_version(spark):
    x, y, rows = table(spark, 120, 2, 4)
    start = E.margin_state(rows).orderBy("id").collect()
    gamma, density = np.array([r["gamma"] for r in start]), np.array([r["density"] for r in start])
    assert np.allclose(gamma, (np.bincount(y) / np.bincount(y).min())[y])
    w, votes = np.full(120, 1 / 120), np.zeros((120, 3))
    boosted, state = E.fit_margin_boost(rows, rounds=3)
    for model, beta in zip(boosted.models, boosted.votes, strict=True):
        root = model._call_java("rootNode")
        split = root.split()
        low = x[:, split.featureIndex()] <= split.threshold()
        counts = lambda m: np.bincount(y[m], w[m], 3)
        said = np.where(low, counts(low).argmax(), counts(~low).argmax())
        gini = lambda c: c.sum() - (c * c).sum() / c.sum()
        best = min(gini(counts(x[:, f] <= t)) + gini(counts(x[:, f] > t)) for f in range(2) for t in (np.unique(x[:, f])[:-1] + np.unique(x[:, f])[1:]) / 2)
        assert gini(counts(low)) + gini(counts(~low)) <= best + 1e-9
        hit = said == y
        assert abs(beta - math.log(w[hit].sum() / w[~hit].sum())) < 1e-9
        votes[np.arange(120), said] += beta
        p = np.exp(votes - votes.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        others = np.where(np.eye(3)[y] > 0, -np.inf, p).max(1)
        w = w * np.exp(-gamma * density * (p[np.arange(120), y] - others + 1)) * np.exp(-beta * hit)
        w /= w.sum()
    got = state.orderBy("id").collect()
    assert np.allclose([r["w"] for r in got], w) and np.allclose([r["votes"] for r in got], votes)
    proba = np.array([r["proba"] for r in boosted.predict(rows).orderBy("id").collect()])
    assert np.allclose(proba, np.exp(votes) / np.exp(votes).sum(1, keepdims=True))


@pytest.mark.parametrize("parts", [1, 5])
def test_machine_equals_numpy_solve(spark, parts):
    x, y, rows = table(spark, 200, 4, 7)
    machine = elm.fit_machine(rows.repartition(parts), 3, hidden=150, seed=3)
    h = 1 / (1 + np.exp(-np.clip(x @ machine.w + machine.b, -40, 40)))
    want = np.linalg.solve(h.T @ h + 0.01 * np.eye(150), h.T @ np.eye(3)[y])
    assert np.allclose(h @ machine.beta, h @ want, atol=1e-6)
    got = np.array([r["probas"] for r in elm.with_probas(rows, [machine]).orderBy("id").collect()])
    assert np.allclose(got, machine.proba(x))


def test_even_sets_have_even_classes(spark):
    x, y, rows = table(spark)
    near = neighbours(rows, 5, which="same").select("id", "rank", "neighbour")
    for c in range(3):
        target = int((y == c).sum())
        made = elm.even_set(rows, near, target, c).collect()
        assert np.bincount([r["label"] for r in made]).tolist() == [target] * 3 and len({r["id"] for r in made}) == 3 * target


def test_council_matches_plain_vote(spark):
    x, y, rows = table(spark, 240, 3, 9)
    council = elm.fit_council(rows, hidden=60)
    checked = council.checked.orderBy("id").collect()
    cx, hits = np.array([r["features"] for r in checked]), np.array([r["right"] for r in checked])
    ids = np.array([r["id"] for r in checked])
    p = np.array([m.proba(x) for m in council.machines])
    got = {r["id"]: r["proba"] for r in council.predict(rows).collect()}
    assert len(got) == 240
    for i in range(240):
        d = np.sqrt(((cx - x[i]) ** 2).sum(1))
        near = np.lexsort((ids, d))[:5]
        acc = hits[near].mean(0)
        alpha = np.where(acc >= acc.mean() - 1e-12, (hits[near] / np.maximum(d[near], 1e-12)[:, None]).sum(0), 0)
        alpha = alpha if alpha.sum() > 0 else np.ones(3)
        want = (p[:, i] * alpha[:, None]).sum(0)
        assert np.allclose(got[i], want / want.sum(), atol=1e-9)
    with pytest.raises(ValueError):
        elm.fit_machine(rows.limit(0), 3)


def test_a_machine_holds_the_layer_of_few_rows_at_once(monkeypatch):
    from unskew.operators import elm

    machine, x = elm.random_layer(4, 3, 20), np.random.default_rng(3).normal(size=(2 * elm.STEP + 7, 4))
    machine.beta = np.random.default_rng(4).normal(size=(20, 3))
    h = 1 / (1 + np.exp(-(x @ machine.w + machine.b)))
    e = np.exp(h @ machine.beta)
    seen, plain = [], elm.Machine.hidden
    monkeypatch.setattr(elm.Machine, "hidden", lambda m, v: seen.append(len(v)) or plain(m, v))
    assert np.allclose(machine.proba(x), e / e.sum(1, keepdims=True)) and max(seen) <= elm.STEP
    assert machine.proba(x[:0]).shape == (0, 3)


def plain_gini(x, y, w, classes, depth):
    """The leaf shares of each row: a Gini tree that tries all midpoints of all features, ties to the smaller feature, then cut."""
    out = np.zeros((len(x), classes))

    def gini(c):
        return 1 - ((c / c.sum()) ** 2).sum()

    def grow(rows, left):
        c = np.bincount(y[rows], w[rows], classes)
        best = None
        if left and (c > 0).sum() > 1:
            for f in range(x.shape[1]):
                v = np.unique(x[rows][w[rows] > 0, f])
                for t in (v[:-1] + v[1:]) / 2:
                    low = x[rows, f] <= t
                    a, b = np.bincount(y[rows][low], w[rows][low], classes), np.bincount(y[rows][~low], w[rows][~low], classes)
                    gain = round(gini(c) - a.sum() / c.sum() * gini(a) - b.sum() / c.sum() * gini(b), 12)
                    if best is None or gain > best[0]:
                        best = gain, low
        if best is None:
            out[rows] = c / c.sum()
        else:
            grow(rows[best[1]], left - 1)
            grow(rows[~best[1]], left - 1)

    grow(np.arange(len(x)), depth)
    return out


@pytest.mark.parametrize("tasks", [1, 5])
def test_gini_tree_matches_plain_tree(spark, tasks):
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 9, (150, 1)).astype(float), rng.choice(3, 150)
    y = np.where(x[:, 0] > 5, np.maximum(y, 1), y)
    rows = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(150)], "id long, label int, features array<double>")
    cuts = [(np.arange(8) + np.arange(1, 9)) / 2]
    model = forest.grow_gini(forest.prepared(rows, cuts, tasks), cuts, 3, tasks, 4, 3, seed=9)
    salts = forest.hashed(np.arange(4), 9).astype(np.int64) & 0x7FFFFFFFFFFF
    w = forest.draws(np.arange(150), salts).astype(float)
    got = model.shares()[model.nodes(model.bins(x), np.arange(4))]
    for t in range(4):
        assert model.counts[t].tolist() == np.bincount(y, w[:, t], 3).tolist()
        assert np.allclose(got[:, t], plain_gini(x, y, w[:, t], 3, 3))


def test_sums_of_a_level_equal_its_rows(spark):
    """Where sums take more than rows, rows are sent: the same trees."""
    x, y, rows = table(spark, 300, 4, 5)
    cuts = forest.cut_points(rows)
    ready = forest.prepared(rows, cuts, 3)
    one, two = (forest.grow_gini(ready, cuts, 3, tasks, 5, 6) for tasks in (1, 40))
    assert (one.feature == two.feature).all() and (one.cut == two.cut).all() and (one.counts == two.counts).all() and one.depth == 6


def test_a_round_scores_rows_with_its_own_forest_alone(spark, monkeypatch):
    """Totals are kept, so that no forest is asked again by later rounds, nor for each of a sample's scans."""
    _, _, rows = table(spark)
    asked, leaves = spark.sparkContext.accumulator(0), E._leaves

    def counted(models, votes, bins):
        asked.add(len(bins) * len(models))
        return leaves(models, votes, bins)

    monkeypatch.setattr(E, "_leaves", counted)
    E.fit_self_paced(rows, rounds=7, trees=2, depth=2)
    assert asked.value == 6 * 240


def test_prediction_is_the_mean_of_the_forests(spark):
    x, y, rows = table(spark, 200, 3, 6)
    e = E.fit_self_paced(rows, rounds=3, trees=4, depth=3)
    want = np.mean([m.shares()[m.nodes(m.bins(x), np.arange(4))].mean(1) for m in e.models], 0)
    got = e.predict(rows.withColumn("proba", rows["id"])).orderBy("id").collect()
    assert got[0].asDict().keys() == {"id", "label", "features", "proba"} and np.allclose([r["proba"] for r in got], want)
    assert [m.counts[0].sum() > 0 for m in e.models] == [True] * 3
    assert e.predict(rows.limit(0)).collect() == []


def test_tasks_of_rounds_grow_with_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert forest.few_tasks(spark, 1) == 1 and forest.few_tasks(spark, 3000) == min(cores, 3)
    assert forest.few_tasks(spark, 10**6) == 16 and forest.few_tasks(spark, 10**8) == 1526
