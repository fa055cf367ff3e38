"""The resampling models as kernels on one training fold: (x, y, rng, **settings) -> (x, y), originals first.

A fold of a tabular dataset is what one task holds; `resample` runs a kernel for every (dataset, fold) at once and refuses
folds beyond `most` rows instead of running out of memory (SMOTE, up-down and balance sampling of larger tables are plans
of their own in sampling.py). Neighbours go by distance, then by position; a row is no neighbour of itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .knn import _candidates

MOST_ROWS = 50_000


def near(x: np.ndarray, k: int, to: np.ndarray | None = None, p: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of the k nearest rows of `to` (default: x without the row itself)."""
    own = to is None
    to = x if own else to
    k = min(k, len(to) - own)
    if k <= 0 or not len(x):
        return np.empty((len(x), 0), np.int64), np.empty((len(x), 0))
    at, away = np.empty((len(x), k), np.int64), np.empty((len(x), k))
    step = 256 if p == 2 else 1
    for a in range(0, len(x), step):
        part = x[a : a + step]
        able = np.ones((len(part), len(to)), bool)
        if own:
            able[np.arange(len(part)), a + np.arange(len(part))] = False
        i, j = _candidates(part, to, able, k) if p == 2 else np.nonzero(able)
        d = np.sqrt(((to[j] - part[i]) ** 2).sum(1)) if p == 2 else (np.abs(to[j] - part[i]) ** p).sum(1) ** (1 / p)
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        at[a : a + step], away[a : a + step] = j[best].reshape(-1, k), d[best].reshape(-1, k)
    return at, away


def safe_levels(x, y, k=5) -> np.ndarray:
    at, _ = near(x, k)
    return (y[at] == y[:, None]).mean(1) if at.shape[1] else np.ones(len(y))


def interpolated(x, n, k, rng) -> np.ndarray:
    """n points between hashed seeds of x and one of their k nearest; copies if x has one row."""
    if n <= 0 or not len(x):
        return np.empty((0, x.shape[1]))
    at, _ = near(x, k)
    seed = rng.integers(0, len(x), n)
    if not at.shape[1]:
        return x[seed]
    other = at[seed, rng.integers(0, at.shape[1], n)]
    return x[seed] + rng.random((n, 1)) * (x[other] - x[seed])


def _by_size(y) -> list[tuple[int, int]]:
    """(class, rows), largest first; ties: the smaller class."""
    c, n = np.unique(y, return_counts=True)
    return sorted(zip(c.tolist(), n.tolist(), strict=True), key=lambda v: (-v[1], v[0]))


def _joined(x, y, made: list[tuple[np.ndarray, int]]):
    made = [(m, c) for m, c in made if len(m)]
    return np.concatenate([x, *(m for m, _ in made)]), np.concatenate([y, *(np.full(len(m), c) for m, c in made)])


def _quota(weights: np.ndarray, total: int) -> np.ndarray:
    """Largest remainders."""
    share = weights / weights.sum() * total if weights.sum() > 0 else np.full(len(weights), total / max(1, len(weights)))
    out = np.floor(share).astype(int)
    out[np.argsort(-(share - out), kind="stable")[: total - out.sum()]] += 1
    return out


def smote(x, y, rng, k=5):
    sizes = _by_size(y)
    return _joined(x, y, [(interpolated(x[y == c], sizes[0][1] - n, k, rng), c) for c, n in sizes[1:]])


def eb_smote(x, y, rng, k=5, spread=2, ratio=1.0):
    """Against the largest class, border rows of both sides (half to all but one of their k neighbours on the other side)
    breed: majority ones drawn 0.3 toward the minority, minority ones 0.5."""
    sizes = _by_size(y)
    big = sizes[0][0]
    made = []
    for c, n in sizes[1:]:
        both = np.flatnonzero((y == c) | (y == big))
        at, _ = near(x[both], k)
        other = (y[both][at] != y[both][:, None]).sum(1)
        border = (other >= -(-k // spread)) & (other < k)
        low, high = both[border & (y[both] == c)], both[border & (y[both] == big)]
        if len(low) and len(high):
            lam = rng.random((len(high), 1))
            mate, inner = _pick(x[high], x[y == big], k, rng, skip_self=True), _pick(x[high], x[low], k, rng)
            made.append((0.7 * (lam * x[high] + (1 - lam) * mate) + 0.3 * inner, big))
        if len(low) and (len(high) or len(low) > 1):
            each = max(0, -(-int(np.ceil(ratio * (sizes[0][1] + len(high)) - n)) // len(low)))
            seed = np.repeat(low, each)
            if len(seed):
                lam = rng.random((len(seed), 1))
                mate = _pick(x[seed], x[y == c], k, rng, skip_self=True)
                toward = _pick(x[seed], x[high] if len(high) else x[y == big], k, rng)
                made.append((0.5 * (lam * x[seed] + (1 - lam) * mate) + 0.5 * toward, c))
    return _joined(x, y, made)


def _pick(seed, pool, k, rng, skip_self=False) -> np.ndarray:
    """For each seed one of its k nearest of the pool."""
    at, away = near(seed, k + skip_self, pool)
    out = np.empty_like(seed)
    for i in range(len(seed)):
        able = at[i][away[i] > 0] if skip_self else at[i]
        able = (able if len(able) else at[i])[:k]
        out[i] = pool[rng.choice(able)]
    return out


def glos(x, y, rng, k=5):
    """Local and global view of a row: those far from their class against others are hard and get most of the new points.
    Rows among their own breed from the class's Gaussian, border rows by interpolation, lone rows by a small step."""
    sizes, made = _by_size(y), []
    at, away = near(x, k)
    same = y[at] == y[:, None]
    for c, n in sizes[1:]:
        rows = np.flatnonzero(y == c)
        need = sizes[0][1] - n
        if need <= 0:
            continue
        mean = lambda mask: np.array([away[i][mask[i]].mean() if mask[i].any() else 0.0 for i in rows])
        did = mean(~same) / np.maximum(mean(same), 1e-12)
        hard = did < did.mean()
        weight = np.where(hard, did.mean() - did, 0.0) + 1e-12
        quota = _quota(weight, need)
        own = same[rows].sum(1)
        pool = x[rows]
        kin, kin_away = near(pool, k)
        step = np.median(kin_away[:, 0]) if kin_away.size else 1.0
        cov = np.cov(pool.T, ddof=1).reshape(x.shape[1], -1) if n > 1 else np.zeros((x.shape[1],) * 2)
        root = np.linalg.cholesky(cov + 1e-3 * np.eye(x.shape[1]))
        for i, q in enumerate(quota):
            if not q:
                continue
            if own[i] == at.shape[1]:
                draw = pool.mean(0) + rng.standard_normal((q, x.shape[1])) @ root.T
                new = pool[i] + rng.random((q, 1)) * (draw - pool[i])
            elif own[i] == 0 or not kin.shape[1]:
                new = pool[i] + rng.normal(0, step, (q, x.shape[1]))
            else:
                new = pool[i] + rng.random((q, 1)) * (pool[rng.choice(kin[i], q)] - pool[i])
            made.append((new, c))
    return _joined(x, y, made)


def _spheres(pool, rest, energy, reach, p, rng):
    """Radii of the pool's spheres under an energy budget (a step costs as much as rows it holds, and one), how the rest
    moves to get out of them, and which of the rest lies in any."""
    at, away = near(pool, reach, rest, p=p)
    radius, moves, caught = np.zeros(len(pool)), np.zeros_like(rest), np.zeros(len(rest), bool)
    for i in range(len(pool)):
        left, r, inside = energy, 0.0, 0
        while inside < away.shape[1] and (away[i, inside] - r) * (inside + 1) < left:
            left -= (away[i, inside] - r) * (inside + 1)
            r, inside = away[i, inside], inside + 1
        r += left / (inside + 1 if inside < away.shape[1] or not inside else inside)
        radius[i] = r
        for j, d in zip(at[i, :inside], away[i, :inside], strict=True):
            way = rest[j] - pool[i]
            if d < 1e-20:  # on the row itself: any direction
                way = rng.choice([-1.0, 1.0], len(way)) * (1e-6 + 1e-6 * rng.random(len(way)))
                d = (np.abs(way) ** p).sum() ** (1 / p)
            moves[j] += (r - d) / d * way
            caught[j] = True
    return radius, moves, caught


def mc_ccr(x, y, rng, energy=0.25, reach=500, p=1.0, cleaning="translate", selection="proportional", rivals="sampling"):
    """Classes are lifted in turn, largest first, against the larger ones (rivals sampling: an equal draw of each of
    them, else against all): spheres around their rows grow on an energy budget; others inside are pushed to the surface,
    removed or left (cleaning: translate, remove, ignore); new points fill the spheres, most in the smallest or, with
    selection random, evenly by lot."""
    sizes = _by_size(y)
    held = {c: x[y == c].astype(float) for c, _ in sizes}
    for pos, (c, n) in enumerate(sizes[1:], 1):
        need = sizes[0][1] - n
        if need <= 0:
            continue
        asked, aside = {}, {}
        for other, _ in sizes:
            rows = held[other]
            if other == c:
                continue
            if rivals != "sampling":
                asked[other], aside[other] = rows, rows[:0]
            elif other in [q for q, _ in sizes[:pos]]:
                pick = np.zeros(len(rows), bool)
                pick[rng.choice(len(rows), min(len(rows), int(sizes[0][1] / pos)), replace=False)] = True
                asked[other], aside[other] = rows[pick], rows[~pick]
            else:
                asked[other], aside[other] = rows[:0], rows
        pool, rest = held[c], np.concatenate(list(asked.values()))
        owner = np.repeat(list(asked), [len(v) for v in asked.values()])
        radius, moves, caught = _spheres(pool, rest, energy, reach, p, rng)
        if cleaning == "translate":
            rest = rest + moves
        elif cleaning == "remove":
            rest, owner = rest[~caught], owner[~caught]
        share = 1 / np.maximum(radius, 1e-12)
        seed = np.repeat(np.arange(n), np.round(share / share.sum() * need).astype(int)) if selection == "proportional" else rng.integers(0, n, need)
        way = rng.standard_exponential((len(seed), x.shape[1])) * rng.choice([-1.0, 1.0], (len(seed), x.shape[1]))
        way /= np.maximum(np.abs(way).sum(1, keepdims=True), 1e-12)
        new = pool[seed] + way * (rng.random(len(seed)) * radius[seed])[:, None]
        held = {other: np.concatenate([rest[owner == other], aside[other]]) for other in asked} | {c: np.concatenate([pool, new])}
    return np.concatenate([held[c] for c, _ in sizes]), np.repeat([c for c, _ in sizes], [len(held[c]) for c, _ in sizes])


def mc_rbo(x, y, rng, gamma=0.05, step=0.001, steps=500, support=25):
    """New minority points climb from a seed, one axis at a time, to where the potential of both sides nearly cancels."""
    sizes, made = _by_size(y), []
    for c, n in sizes[1:]:
        pool, rest = x[y == c], x[y != c]
        both, side = np.concatenate([pool, rest]), np.r_[-np.ones(n), np.ones(len(rest))]
        at, _ = near(pool, support + 1, both)
        new = []
        for seed in rng.integers(0, n, sizes[0][1] - n):
            local, sign = both[at[seed]], side[at[seed]]
            potential = lambda z: float((sign * np.exp(-((np.abs(local - z).sum(1) / gamma) ** 2))).sum())  # noqa: B023, E731
            z, here = pool[seed].copy(), abs(potential(pool[seed]))
            ways = [(f, s) for f in range(x.shape[1]) for s in (-1.0, 1.0)]
            todo = list(ways)
            for _ in range(steps):
                if not todo:
                    break
                f, s = todo.pop(int(rng.integers(0, len(todo))))
                moved = z.copy()
                moved[f] += s * step
                value = abs(potential(moved))
                if value < here:
                    z, here = moved, value
                    todo = [w for w in ways if w != (f, -s)]
            new.append(z)
        made.append((np.array(new).reshape(-1, x.shape[1]), c))
    return _joined(x, y, made)


def mdo(x, y, rng, k1=5, k2=6, share=0.5):
    """Points of the same Mahalanobis distance to their class's mean as a seed that has enough of its class around."""
    sizes, made = _by_size(y), []
    at, _ = near(x, k1)
    own = (y[at] == y[:, None]).sum(1)
    for c, n in sizes[1:]:
        need, rows = sizes[0][1] - n, np.flatnonzero(y == c)
        if n == 1:
            made.append((np.repeat(x[rows], need, 0), c))
            continue
        seeds = rows[own[rows] >= max(1, int(k1 * share))]
        seeds = seeds if len(seeds) else rows
        weight = np.maximum(own[seeds], 1) / k2
        mean = x[seeds].mean(0)
        values, basis = np.linalg.eigh(np.cov((x[seeds] - mean).T, ddof=0).reshape(x.shape[1], -1) if len(seeds) > 1 else np.zeros((x.shape[1],) * 2))
        values = np.maximum(values, 1e-3)
        t = (x[seeds] - mean) @ basis
        pick = rng.choice(len(seeds), need, p=weight / weight.sum())
        way = rng.standard_normal((need, x.shape[1]))
        way /= np.linalg.norm(way, axis=1, keepdims=True)
        radius = np.sqrt((t[pick] ** 2 / values).sum(1))
        made.append((mean + (way * radius[:, None] * np.sqrt(values)) @ basis.T, c))
    return _joined(x, y, made)


def density_peaks(x) -> np.ndarray:
    """A cluster for each row: centres are the rows of largest density times distance to a denser row, the square root of half
    the rows in number; all others go with their nearest denser row."""
    n = len(x)
    if n <= 2:
        return np.zeros(n, np.int64)
    _, away = near(x, min(max(15, int(np.sqrt(n))), n - 1))
    rho = np.exp(-((away / max(float(np.median(away[:, -1])), 1e-12)) ** 2)).sum(1)
    order = np.argsort(-rho, kind="stable")
    parent, delta = np.full(n, -1), np.zeros(n)
    delta[order[0]] = away[order[0]].max()
    for place in range(1, n):
        i, denser = order[place], order[:place]
        d = np.sqrt(((x[denser] - x[i]) ** 2).sum(1))
        parent[i], delta[i] = denser[d.argmin()], d.min()
    label = np.full(n, -1)
    centres = np.argsort(-rho * delta, kind="stable")[: int(np.ceil(np.sqrt(n / 2)))]
    label[centres] = np.arange(len(centres))
    for i in order:  # the denser row has its cluster already
        if label[i] < 0:
            label[i] = label[parent[i]] if parent[i] >= 0 else 0
    return label


INLAND, BORDER, TRAPPED = range(3)


def nromm_groups(pool, rest, k=5) -> tuple[np.ndarray, np.ndarray]:
    """Inland, border or trapped for each row of a class against the rest, by purity of its neighbourhood, its margin (how much
    farther the rest is than its class) and its cluster's mean margin; and whether the rest is nearer than its own class."""
    kin = near(pool, 1)[1]
    same = kin[:, 0] if kin.shape[1] else np.ones(len(pool))
    if not len(rest):
        return np.full(len(pool), INLAND), np.zeros(len(pool), bool)
    other = near(pool, 1, rest)[1][:, 0]
    both = np.concatenate([pool, rest])
    at = near(both, min(k, len(both) - 1))[0][: len(pool)]
    purity, margin, cluster = (at < len(pool)).mean(1), other - same, density_peaks(pool)
    mean = (np.bincount(cluster, margin) / np.maximum(np.bincount(cluster), 1))[cluster]
    inland = (purity >= 0.75) & (margin > 0) & (mean >= 0)
    trapped = ~inland & ((purity <= 0.25) | (margin <= 0) | ((mean < 0) & (purity < 0.5)))
    return np.where(inland, INLAND, np.where(trapped, TRAPPED, BORDER)), other < same


def within_boundary(seed, point, rest) -> np.ndarray:
    """The point, drawn back toward its seed to 0.95 of the way to the nearest of the rest."""
    if not len(rest):
        return point
    bound = max(0.95 * np.sqrt(((rest - seed) ** 2).sum(1)).min(), 1e-12)
    far = np.sqrt(((point - seed) ** 2).sum())
    return seed + (point - seed) / far * bound if far > bound else point


def nromm(x, y, rng, k=5, margin=1.05, ratio=20):
    """Each class against the inland rows of the larger ones: its rows breed by group (inland .5, border 1, trapped 1.5),
    trapped ones from half the way or more toward others of their class; points are kept within the seed's boundary
    and count if they are nearer to their class than to the rest by the margin. At last inland rows to which others are
    nearer than their own go."""
    sizes = _by_size(y)
    held = {c: x[y == c] for c, _ in sizes}
    for pos, (c, n) in enumerate(sizes[1:], 1):
        need, pool = sizes[0][1] - n, held[c]
        if need <= 0:
            continue
        if n == 1:
            held[c] = np.concatenate([pool, np.repeat(pool, need, 0)])
            continue
        larger = []
        for other, _ in sizes[:pos]:
            inland = nromm_groups(held[other], pool, k)[0] == INLAND
            larger.append(held[other][inland] if inland.any() else held[other])
        rest = np.concatenate(larger)
        group, _ = nromm_groups(pool, rest, k)
        weight = np.array([0.5, 1.0, 1.5])[group]
        kin, some = near(pool, k)[0], lambda mask: pool[mask] if mask.any() else pool  # noqa: B023
        free, inland = some(group != TRAPPED), pool[group == INLAND]
        new, seeds = [], iter(rng.choice(n, need * ratio + 50, p=weight / weight.sum()))
        while len(new) < need and (i := next(seeds, None)) is not None:
            start = pool[i]
            if group[i] == TRAPPED:
                start = start + rng.uniform(0.5, 1) * (free[rng.integers(len(free))] - start)
            toward = free if group[i] == BORDER or not len(inland) else inland
            z = start + rng.random() * (toward[rng.integers(len(toward))] - start)
            step = pool[i] + rng.random() * (pool[rng.choice(kin[i])] - pool[i])
            z = within_boundary(pool[i], (z + step) / 2, rest)
            if np.sqrt(((rest - z) ** 2).sum(1)).min() > margin * np.sqrt(((pool - z) ** 2).sum(1)).min():
                new.append(z)
        for i in rng.choice(n, need - len(new), p=weight / weight.sum()):
            new.append(within_boundary(pool[i], pool[i] + rng.random() * (pool[rng.choice(kin[i])] - pool[i]), rest))
        held[c] = np.concatenate([pool, np.array(new)])
    out_x, out_y = np.concatenate([held[c] for c, _ in sizes]), np.repeat([c for c, _ in sizes], [len(held[c]) for c, _ in sizes])
    keep = np.ones(len(out_y), bool)
    for c, _ in sizes:
        rows = np.flatnonzero(out_y == c)
        group, nearer = nromm_groups(out_x[rows], out_x[out_y != c], k)
        gone = (group == INLAND) & nearer
        if not gone.all():
            keep[rows[gone]] = False
    return (out_x[keep], out_y[keep]) if keep.sum() >= 2 else (out_x, out_y)


def candidate_region(x, y, i, stop=5) -> tuple[np.ndarray, np.ndarray]:
    """Ordered neighbours of row i until `stop` of other classes follow each other, and their distances."""
    d = np.sqrt(((x - x[i]) ** 2).sum(1))
    order = np.lexsort((np.arange(len(x)), d))
    order = order[order != i]
    other = y[order] != y[i]
    run = 0
    for j, o in enumerate(other):
        run = run + 1 if o else 0
        if run == stop:
            return order[: j + 1 - stop], d[order[: j + 1 - stop]]
    return order, d[order]


def clean_region(x, y, i, order, away) -> np.ndarray:
    """Of a candidate region the rows to whose midpoint no earlier row of another class is closer than half the way."""
    kept = []
    for j, (a, d) in enumerate(zip(order, away, strict=True)):
        mid = (x[i] + x[a]) / 2
        before = order[:j][y[order[:j]] != y[i]]
        if not len(before) or (((x[before] - mid) ** 2).sum(1) >= d * d / 4).all():
            kept.append(a)
    return np.array(kept, np.int64)


def orem_m(x, y, rng, stop=5):
    """Classes from the smallest up; each seed steps, dimension by dimension, toward rows of its clean region, at most
    half the way if those are of another class."""
    sizes = _by_size(y)
    big = sizes[0][1]
    x, y = x.astype(float), y.copy()
    for c, n in sorted(sizes[1:], key=lambda v: (v[1], v[0])):
        need, rows = big - n, np.flatnonzero(y == c)
        if need <= 0:
            continue
        times = np.full(n, need // n)
        times[rng.permutation(n)[: need - times.sum()]] += 1
        new = []
        for i, q in zip(rows, times, strict=True):
            if not q:
                continue
            region = clean_region(x, y, i, *candidate_region(x, y, i, stop))
            if not len(region):
                new += [x[i]] * q
                continue
            for a in rng.choice(region, q):
                gap = rng.random(x.shape[1]) * (1.0 if y[a] == c else 0.5)
                new.append(x[i] + gap * (x[a] - x[i]))
        x, y = np.concatenate([x, np.array(new)]), np.concatenate([y, np.full(len(new), c)])
    return x, y


def _unit(v):
    return (v - v.min()) / (v.max() - v.min()) if len(v) and v.max() > v.min() else np.ones(len(v))


def qc_smote(x, y, rng, k=5, eta=0.5, least=0.3, clear=0.05):
    """Trusted rows (support, density, isolation) breed several candidates; the purest and clearest is kept if it is good
    enough, else the most trusted neighbour is copied."""
    sizes, made = _by_size(y), []
    support = safe_levels(x, y, k)
    for c, n in sizes[1:]:
        pool, rest, need = x[y == c], x[y != c], sizes[0][1] - n
        kin, kin_away = near(pool, k)
        _, away = near(pool, 1, rest)
        tau = float(np.median(kin_away[:, 0])) if kin_away.size else 1.0
        density = _unit(1 / np.maximum(kin_away.mean(1), 1e-12)) if kin_away.size else np.ones(n)
        trust = 0.4 * support[y == c] + 0.3 * density + 0.3 * _unit(away[:, 0])
        overlap = 1 - support[y == c].mean()
        candidates = 1 if overlap < 0.33 else 3 if overlap < 0.66 else 5
        purity = lambda z: float((y[near(z[None], k, x)[0][0]] == c).mean())  # noqa: B023, E731
        new = []
        for i in np.repeat(np.arange(n), _quota(trust + 1e-12, need)):
            if not kin.shape[1]:
                new.append(pool[i])
                continue
            best, found = -1.0, None
            for _ in range(candidates):
                z_to = pool[rng.choice(kin[i])]
                z = pool[i] + rng.random() * (z_to - pool[i])
                own, far = purity(z), np.sqrt(((rest - z) ** 2).sum(1)).min()
                score = eta * own + (1 - eta) * purity((pool[i] + z_to) / 2) + 0.25 * min(1.0, far / max(tau, 1e-12))
                if score > best and own >= least and far >= clear * tau:
                    best, found = score, z
            new.append(found if found is not None else pool[kin[i][trust[kin[i]].argmax()]])
        made.append((np.array(new).reshape(-1, x.shape[1]), c))
    return _joined(x, y, made)


def shsampler(x, y, rng, k=5, target="mean"):
    """To the mean class size: larger classes lose rows (unsafe first, by lot), smaller ones gain points in balls around
    safe rows that reach as far as the k-th row of another class."""
    sizes = _by_size(y)
    goal = int(np.round(np.mean([n for _, n in sizes]))) if target == "mean" else sizes[0][1]
    safe, keep, made = safe_levels(x, y, k), np.ones(len(y), bool), []
    for c, n in sizes:
        rows = np.flatnonzero(y == c)
        if n > goal:
            weight = 1 - safe[rows] + 1e-6
            keep[rng.choice(rows, n - goal, replace=False, p=weight / weight.sum())] = False
        elif n < goal:
            _, away = near(x[rows], k, x[y != c])
            radius = away[:, -1] if away.size else np.ones(n)
            pick = rng.choice(n, goal - n, p=(safe[rows] + 1e-6) / (safe[rows] + 1e-6).sum())
            way = rng.standard_normal((len(pick), x.shape[1]))
            way /= np.maximum(np.linalg.norm(way, axis=1, keepdims=True), 1e-12)
            made.append((x[rows][pick] + way * (radius[pick] * rng.random(len(pick)) ** (1 / x.shape[1]))[:, None], c))
    return _joined(x[keep], y[keep], made)


def clusters(x, eps, least=3) -> np.ndarray:
    """Density clusters: rows with `least` rows within eps (themselves too) and what they reach; -1 for the rest."""
    close = np.stack([np.sqrt(((x - r) ** 2).sum(1)) <= eps for r in x]) if len(x) else np.zeros((0, 0), bool)
    core, label, number = close.sum(1) >= least, np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            label[i], todo = number, [i]
            while todo:
                j = todo.pop()
                for m in np.flatnonzero(close[j] & (label < 0)):
                    label[m] = number
                    if core[m]:
                        todo.append(m)
            number += 1
    return label


def smom(x, y, rng, k=5, trapped=0.2, least=3):
    """Seeds in turn; the direction to a neighbour is drawn by how pure the midpoint is, less where seed or neighbour lie
    in a cluster of low safety."""
    sizes, made = _by_size(y), []
    safe = safe_levels(x, y, k)
    for c, n in sizes[1:]:
        pool, need = x[y == c], sizes[0][1] - n
        kin, away = near(pool, k)
        if not kin.shape[1]:
            made.append((np.repeat(pool, need, 0), c))
            continue
        kth = away[:, -1]
        eps = max(float(np.median(kth[kth > 0])) if (kth > 0).any() else 0.0, 1e-6)
        group = clusters(pool, eps, least)
        bad = np.array([(safe[y == c][group == g] if g >= 0 else safe[y == c][[i]]).mean() < 0.5 for i, g in enumerate(group)])
        seeds = np.arange(need) % n
        rng.shuffle(seeds)
        ways: dict[int, np.ndarray] = {}
        new = []
        for i in seeds:
            if i not in ways:
                mid = (pool[i] + pool[kin[i]]) / 2
                pure = (y[near(mid, k, x)[0]] == c).mean(1)
                w = pure * np.where(bad[i], np.sqrt(trapped), 1.0) * np.where(bad[kin[i]], trapped, 1.0) + 1e-9
                ways[i] = w / w.sum()
            a = rng.choice(kin[i], p=ways[i])
            new.append(pool[i] + rng.random() * (pool[a] - pool[i]))
        made.append((np.array(new).reshape(-1, x.shape[1]), c))
    return _joined(x, y, made)


def class_similarity(y, at) -> np.ndarray:
    """Symmetric: how often classes stand among each other's neighbours (at); 1 on the diagonal."""
    classes = int(y.max()) + 1
    mix = np.bincount(np.repeat(y, at.shape[1]) * classes + y[at].ravel(), minlength=classes**2).reshape(classes, classes).astype(float)
    mix /= np.maximum(mix.sum(1, keepdims=True), 1.0)
    out = (mix + mix.T) / 2
    np.fill_diagonal(out, 1.0)
    return out


def with_copy(x, at, away, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x with a copy of row b at its end, and the neighbour lists as they are then: the copy comes after what is as near."""
    k, new = at.shape[1], len(x)
    d = np.sqrt(((x - x[b]) ** 2).sum(1))
    at, away = at.copy(), away.copy()
    for i in np.flatnonzero(d < away[:, -1]):
        spot = int(np.searchsorted(away[i], d[i], "right"))
        at[i], away[i] = np.insert(at[i], spot, new)[:k], np.insert(away[i], spot, d[i])[:k]
    own = np.lexsort((np.arange(new), d))[:k]
    return np.concatenate([x, x[b : b + 1]]), np.concatenate([at, own[None]]), np.concatenate([away, d[own][None]])


def soup(x, y, rng, k=5, update=True):
    """To the mean class size: larger classes lose their least safe rows, smaller ones copy their safest; safety is the mean
    similarity of a row's class to its neighbours', taken anew after each class (and each copy if update)."""
    sizes = _by_size(y)
    goal = int(np.round(np.mean([n for _, n in sizes])))

    def safety(y, at, rows):
        return class_similarity(y, at)[y[rows, None], y[at[rows]]].mean(1) if at.shape[1] else np.ones(len(rows))

    for c, n in sizes:
        if n > goal:
            rows = np.flatnonzero(y == c)
            s = safety(y, near(x, k)[0], rows) + rng.random(n) * 1e-9
            drop = rows[np.argsort(s)[: n - goal]]
            x, y = np.delete(x, drop, 0), np.delete(y, drop)
    at, away = near(x, k)
    for c, n in reversed(sizes):
        while n < goal:
            rows = np.flatnonzero(y == c)
            s = safety(y, at, rows) + rng.random(len(rows)) * 1e-9
            times = 1 if update else goal - n
            best = rows[np.argsort(-s)[np.arange(times) % len(rows)]]
            if at.shape[1] < k:  # too few rows yet for whole lists
                x = np.concatenate([x, x[best]])
                at, away = near(x, k)
            else:
                for b in best:
                    x, at, away = with_copy(x, at, away, b)
            y, n = np.concatenate([y, y[best]]), n + times
    return x, y


def up_down(x, y, rng, k=7):
    """Rows of the majority go by the inverse of their reception rate (never all); smaller classes are lifted toward it."""
    sizes = _by_size(y)
    at, away = near(x, k)
    rate = np.where(y[at] == y[:, None], away, 0).sum(1) / np.maximum(away.sum(1), 1e-12)
    big = np.flatnonzero(y == sizes[0][0])
    p = 1 / np.maximum(rate[big], 1e-6)
    gone = rng.random(len(big)) < p / p.max()
    gone[p.argmin()] = False
    keep = np.ones(len(y), bool)
    keep[big[gone]] = False
    return smote(x[keep], y[keep], rng, k)


KERNELS: dict[str, Callable] = {
    "SMOTE": smote, "EB-SMOTE": eb_smote, "glos": glos, "mc_ccr": mc_ccr, "mc_rbo": mc_rbo, "mdo": mdo, "nromm": nromm, "orem_m": orem_m, "QC-SMOTE": qc_smote,
    "shsampler": shsampler, "smom": smom, "soup": soup, "up_down": up_down,
}


def run_kernel(method: str, x: np.ndarray, y: np.ndarray, seed: int, **settings) -> tuple[np.ndarray, np.ndarray]:
    """The kernel's result, or the originals if it leaves fewer than two classes."""
    if len(np.unique(y)) < 2:
        return x, y
    new_x, new_y = KERNELS[method](x, y, np.random.default_rng(seed), **settings)
    return (new_x, new_y) if len(np.unique(new_y)) >= 2 else (x, y)


def resample(rows: DataFrame, method: str, keys: list[str], seed: int = 42, most: int = MOST_ROWS, **settings) -> DataFrame:
    """keys, features, label of every fold after the method. rows: keys, id, features array<double>, label int."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", features array<double>, label int"

    def one(df: pd.DataFrame) -> pd.DataFrame:
        if len(df) > most:
            raise ValueError(f"a fold of {len(df)} rows is beyond the bound of {most} for {method}")
        df = df.sort_values("id")
        x, y = run_kernel(method, np.stack(df["features"].to_numpy()).astype(float), df["label"].to_numpy().astype(int), seed, **settings)
        return pd.DataFrame({k: df[k].iloc[0] for k in keys} | {"features": list(x), "label": y.astype("int32")})

    return rows.select(*keys, "id", "features", "label").groupBy(*keys).applyInPandas(one, schema)
