"""Energy spheres, potential climbs and ellipsoids against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from unskew.operators import generators as G

SCHEMA = "id long, label int, features array<double>"


def table(spark, n=90, d=3, seed=1, parts=3):
    rng = np.random.default_rng(seed)
    y = np.array([0] * (n * 6 // 9) + [1] * (n * 2 // 9) + [2] * (n - n * 6 // 9 - n * 2 // 9))
    x = np.round(rng.normal(size=(n, d)) + y[:, None] * 0.7, 2)
    return x, y, spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], SCHEMA).repartition(parts)


def plain_spheres(x, y, label, energy, p=1.0):
    own, others = np.flatnonzero(y == label), np.flatnonzero(y != label)
    radii, moves, inside = {}, np.zeros_like(x), {}
    for i in own:
        d = (np.abs(x[others] - x[i]) ** p).sum(1) ** (1 / p)
        order = np.lexsort((others, d))
        left, radius, m = energy, 0.0, 0
        while True:
            if m == len(order):
                radius += left / max(1, m)
                break
            change = left / (m + 1)
            if d[order[m]] >= radius + change:
                radius += change
                break
            change = d[order[m]] - (d[order[m - 1]] if m else 0.0)
            radius, left, m = radius + change, left - change * (m + 1), m + 1
        radii[i], inside[i] = radius, others[order[:m]]
        for j, dist in zip(others[order[:m]], d[order[:m]], strict=True):
            moves[j] += (radius - dist) / dist * (x[j] - x[i])
    return radii, moves, inside


@pytest.mark.parametrize("energy,reach", [(0.25, 50), (3.0, 4), (9.0, 2), (1e6, 8)])
def test_spheres_match_plain_version(spark, energy, reach):
    x, y, rows = table(spark, 60)
    radii, inside = G.spheres(rows, 2, energy, 1.0, reach)
    want_r, want_m, want_in = plain_spheres(x, y, 2, energy)
    got = {r["id"]: r["radius"] for r in radii.collect()}
    assert set(got) == set(want_r) and all(abs(got[i] - want_r[i]) < 1e-9 * max(1, want_r[i]) for i in got)
    pairs = {(r["id"], r["neighbour"]) for r in inside.collect()}
    assert pairs == {(int(i), int(j)) for i, js in want_in.items() for j in js}
    moved = {r["id"]: np.array(r["features"]) for r in G.pushed(rows, inside, 1.0).collect()}
    assert len(moved) == 60 and all(np.allclose(moved[i], x[i] + want_m[i], rtol=1e-9, atol=1e-6) for i in moved)


def test_points_lie_in_spheres(spark):
    x, y, rows = table(spark)
    radii, _ = G.spheres(rows, 2, 2.0)
    made = G.in_spheres(rows.where("label = 2"), radii, 2, 40).collect()
    r = {i: v for i, v in ((q["id"], q["radius"]) for q in radii.collect())}
    want = sum(int(np.round(1 / r[i] / sum(1 / v for v in r.values()) * 40)) for i in r)
    assert len(made) == want and len({m["id"] for m in made}) == want
    own = np.flatnonzero(y == 2)
    for m in made:
        assert any(np.abs(np.array(m["features"]) - x[i]).sum() <= r[i] + 1e-9 for i in own)


def test_row_at_a_centre_is_pushed_out(spark):
    rows = spark.createDataFrame([(1, 1, [0.0, 0.0]), (2, 0, [0.0, 0.0]), (3, 0, [9.0, 9.0])], SCHEMA)
    radii, inside = G.spheres(rows, 1, 1.0)
    moved = {r["id"]: np.array(r["features"]) for r in G.pushed(rows, inside).collect()}
    radius = radii.first()["radius"]
    assert abs(np.abs(moved[2]).sum() - radius) < 1e-5 and (moved[3] == 9).all()


def test_energy_resample_fills_classes(spark):
    x, y, rows = table(spark)
    got = G.energy_resample(rows, 2.0).collect()
    assert len({r["id"] for r in got}) == len(got) and {r["id"] for r in got if r["id"] >= 0} == set(range(90))
    counts = np.bincount([r["label"] for r in got])
    assert abs(counts[1] - 60) <= 20 and abs(counts[2] - 60) <= 10 and counts[0] == 60


def plain_climb(point, near, sign, key, gamma, size, steps):
    order = lambda moved: np.argsort(G.hashed(G.hashed(np.array([key * 1_000_003 + moved]), 7)[:, None] + np.arange(2 * len(point), dtype=np.uint64), 11), 1)[0].tolist()
    value = lambda z: sum(s * np.exp(-((np.abs(q - z).sum() / gamma) ** 2)) for q, s in zip(near, sign, strict=True))
    at, moved, ways, now = point.copy(), 0, order(0), abs(value(point))
    for _ in range(steps):
        if not ways:
            break
        w = ways.pop()
        z = at.copy()
        z[w // 2] += size if w % 2 else -size
        if abs(value(z)) < now - 1e-15:
            at, now, moved = z, abs(value(z)), moved + 1
            ways = [v for v in order(moved) if v != w ^ 1]
    return at


def test_climb_matches_plain_climb():
    rng = np.random.default_rng(3)
    points, near = rng.normal(size=(20, 3)), rng.normal(size=(20, 6, 3))
    sign, keys = rng.choice([-1.0, 1.0], (20, 6)), np.arange(20)
    got = G.climb(points, near, sign, keys, 1.5, 0.05, 60)
    for i in range(20):
        assert np.allclose(got[i], plain_climb(points[i], near[i], sign[i], i, 1.5, 0.05, 60), atol=1e-9)
    assert np.abs(got - points).max() > 0.04


def test_climbs_don_t_depend_on_partitions(spark):
    outs = []
    for parts in (1, 2, 8):
        _, _, rows = table(spark, 60, parts=parts)
        outs.append(sorted((r["id"], r["label"], tuple(r["features"])) for r in G.potential_resample(rows, gamma=1.0, size=0.05, steps=30).collect()))
    assert outs[0] == outs[1] == outs[2]
    assert np.bincount([r[1] for r in outs[0]]).tolist() == [40, 40, 40]


def test_axes_and_ellipsoids(spark):
    x, y, rows = table(spark, 300, 2, 5)
    own = rows.where("label = 1")
    mean, vectors, variances = G.axes(own.withColumn("features", F.transform("features", lambda v: v + 1e6)))
    c = np.cov(x[y == 1].T, ddof=0)
    assert np.allclose(mean - 1e6, x[y == 1].mean(0)) and np.allclose(variances, np.sort(np.linalg.eigvalsh(c))[::-1], rtol=1e-5)
    assert np.allclose(vectors @ np.diag(variances) @ vectors.T, c, atol=1e-6)
    # two axes: no point is farther out than the row it was drawn from
    seeds = G.trusted_seeds(rows, 1)
    near = {r["id"]: r["weight"] for r in seeds.collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for i in np.flatnonzero(y == 1):
        order = [j for j in np.lexsort((np.arange(300), d[i])) if j != i][:5]
        same = int((y[order] == 1).sum())
        assert near.get(i) == (same if same >= 2 else None)
    m2, v2, s2 = G.axes(seeds)
    far = lambda z: ((np.array(z) - m2) @ v2) ** 2 / np.maximum(s2, 1e-3)
    made = G.on_ellipsoids(seeds, 1, 500).collect()
    most = max(far(r["features"]).sum() for r in seeds.collect())
    assert len(made) == 500 and max(far(r["features"]).sum() for r in made) <= most + 1e-9


def test_ellipsoid_resample(spark):
    _, _, rows = table(spark)
    got = G.ellipsoid_resample(rows).collect()
    assert np.bincount([r["label"] for r in got]).tolist() == [60, 60, 60] and len({r["id"] for r in got}) == 180


@pytest.mark.parametrize("f", [G.energy_resample, G.potential_resample, G.ellipsoid_resample])
def test_odd_tables(spark, f):
    extra = "id long, label int, features array<double>, slot string, place int, radius string, n int"
    made = [(i, 0, [float(i), 1.0], "s", 1, "r", 2) for i in range(6)] + [(10, 1, [0.5, 1.0], "s", 1, "r", 2)]
    rows = spark.createDataFrame(made, extra)
    got = f(rows).collect()
    assert sum(r["label"] == 0 for r in got) == 6 and sum(r["label"] == 1 for r in got) == 6
    assert f(rows.where("label = 0")).count() == 6 and f(rows.limit(0)).collect() == []


def test_balls_of_a_lonely_class_reach_to_its_own_rows(spark):
    from unskew.operators import neighbourhood

    rows = spark.createDataFrame([(i, 1, [float(4 * i), 0.0]) for i in range(5)], SCHEMA)
    made = np.array([r["features"] for r in neighbourhood.sphere_oversample(rows, 1, 200).collect()])
    away = np.abs(made[:, None] - np.array([[4.0 * i, 0.0] for i in range(5)])[None]) ** 2
    far = np.sqrt(away.sum(2)).min(1)
    assert far.max() <= 4 and far.max() > 1
