"""Imbalance-aware learners as kernels on one training fold: fit(x, y, classes, seed, **settings) -> probabilities of rows.

Every learner is a function that returns another one, (rows) -> (rows x classes). They run inside one task for each
dataset, fold and model (plans/benchmark.py); the grid of cells is what is distributed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import resamplers
from .optimise import Perceptron, tall_program
from .trees import balance, fit_forest, fit_tree

Predict = Callable[[np.ndarray], np.ndarray]


def forest(x, y, classes, seed, trees=30) -> Predict:
    return fit_forest(x, y, classes, trees, seed).predict_proba


def after_resampling(method: str):
    def fit(x, y, classes, seed, trees=30, **settings) -> Predict:
        new_x, new_y = resamplers.run_kernel(method, x, y, seed, **settings)
        return forest(new_x, new_y, classes, seed, trees)

    return fit


def _balanced(y, rng, size=None) -> np.ndarray:
    """Positions of as many rows of each class as the smallest has (or size)."""
    least = size or min(np.bincount(y)[np.unique(y)])
    return np.concatenate([rng.choice(np.flatnonzero(y == c), min(least, (y == c).sum()), replace=False) for c in np.unique(y)])


def paced(h, y, rng, alpha, bins=20) -> np.ndarray:
    """A balanced sample in which harder bins weigh 1 / (mean hardness + alpha); bins give what they hold at most."""
    least, picked = min(np.bincount(y)[np.unique(y)]), []
    for c in np.unique(y):
        rows = np.flatnonzero(y == c)
        low, high = h[rows].min(), h[rows].max()
        b = np.minimum(((h[rows] - low) / (high - low) * bins).astype(int), bins - 1) if high > low else np.zeros(len(rows), int)
        names, at, have = np.unique(b, return_inverse=True, return_counts=True)
        w = 1 / (np.bincount(at, h[rows]) / have + alpha + 1e-12)
        take = np.minimum(np.floor(least * w / w.sum()).astype(int), have)
        while take.sum() < least:
            for i in np.argsort(-w, kind="stable"):
                if take[i] < have[i] and take.sum() < least:
                    take[i] += 1
        picked += [rng.choice(rows[at == i], take[i], replace=False) for i in range(len(names)) if take[i]]
    return np.concatenate(picked)


def spe(x, y, classes, seed, rounds=30, trees=30, bins=20) -> Predict:
    """Self-paced ensemble: forests on balanced samples that move from easy to evenly hard rows."""
    rng, models, total = np.random.default_rng(seed), [], np.zeros((len(y), classes))
    for i in range(rounds):
        if not i:
            rows = _balanced(y, rng)
        else:
            h = 1 - (total / i)[np.arange(len(y)), y]
            rows = paced(h, y, rng, np.tan(np.pi * i / (2 * max(1, rounds - 1))) if i < rounds - 1 else 1e16, bins)
        models.append(fit_forest(x[rows], y[rows], classes, trees, seed + i))
        total += models[-1].predict_proba(x)
    return lambda z: np.mean([m.predict_proba(z) for m in models], 0)


def spe_boost(x, y, classes, seed, rounds=30, trees=10, bins=12) -> Predict:
    """Self-paced samples with boosting weights; models vote by their clipped weight."""
    rng, models, votes = np.random.default_rng(seed), [], []
    w, total = np.full(len(y), 1 / len(y)), np.zeros((len(y), classes))
    for i in range(rounds):
        h = 1 - (total / max(1, i))[np.arange(len(y)), y] if i else rng.random(len(y))
        rows = paced(h, y, rng, 0.15 + i / rounds, bins)
        m = fit_forest(x[rows], y[rows], classes, trees, seed + i, w=w[rows] * len(y))
        p = m.predict_proba(x)
        right = p.argmax(1) == y
        error = np.clip(w[~right].sum(), 1e-4, 1 - 1e-4)
        alpha = np.clip(0.4 * np.log((1 - error) / error), 0.02, 2.5)
        w = w * np.exp(np.where(right, -alpha, alpha)) + 1e-12
        w /= w.sum()
        models.append(m)
        votes.append(alpha)
        total += p
    return lambda z: np.average([m.predict_proba(z) for m in models], 0, votes)


def spe_diverse(x, y, classes, seed, trees=60) -> Predict:
    """0.65 of a forest on balanced bootstraps, 0.35 of extremely random trees."""
    rng = np.random.default_rng(seed)
    bags = [fit_forest(x[r], y[r], classes, 1, seed + i) for i, r in enumerate(_balanced(y, rng) for _ in range(trees))]
    extra = fit_forest(x, y, classes, trees, seed, w=_class_weight(y, classes), bootstrap=False, random_cut=True)
    return lambda z: 0.65 * np.mean([b.predict_proba(z) for b in bags], 0) + 0.35 * extra.predict_proba(z)


def spe_nromm(x, y, classes, seed, **settings) -> Predict:
    a, b = after_resampling("nromm")(x, y, classes, seed), spe_boost(x, y, classes, seed, **settings)
    return lambda z: 0.75 * a(z) + 0.25 * b(z)


def _class_weight(y, classes) -> np.ndarray:
    n = np.bincount(y, minlength=classes)
    return (len(y) / (np.maximum(n, 1) * (n > 0).sum()))[y]


def inverse_density(x, y, k=5) -> np.ndarray:
    at, away = resamplers.near(x, k)
    same = y[at] == y[:, None]
    rho = np.array([(1 / np.maximum(a[s], 1e-10)).mean() if s.any() else 1.0 for a, s in zip(away, same, strict=True)])
    mean = np.array([rho[y == c].mean() for c in range(int(y.max()) + 1)])[y]
    e = np.exp(-rho / mean)
    return e / np.array([e[y == c].mean() for c in range(int(y.max()) + 1)])[y]


def ada_boost_ad(x, y, classes, seed, rounds=50, k=5) -> Predict:
    """Boosted stumps; a row's weight falls with its margin, scaled by class size and inverse density."""
    rng, models, votes = np.random.default_rng(seed), [], []
    sizes = np.bincount(y, minlength=classes)
    gamma, density = (sizes / max(1, sizes[sizes > 0].min()))[y], inverse_density(x, y, k)
    w = np.full(len(y), 1 / len(y))
    for _ in range(rounds):
        t = fit_tree(x, y, classes, w, depth=1, rng=rng)
        p = t.predict_proba(x)
        right = p.argmax(1) == y
        beta = np.log(max(w[right].sum(), 1e-10) / max(w[~right].sum(), 1e-10))
        margin = p[np.arange(len(y)), y] - np.where(np.eye(classes)[y] > 0, -1, p).max(1)
        w = w * np.exp(-density / gamma * margin) * np.exp(-beta * right)
        w /= w.sum()
        models.append(t)
        votes.append(max(beta, 0.0))
        if right.all():
            break
    return _vote(models, votes, classes)


def _vote(models, votes, classes) -> Predict:
    def predict(z):
        total = np.full((len(z), classes), 1e-12)
        for m, a in zip(models, votes, strict=True):
            total[np.arange(len(z)), m.predict_proba(z).argmax(1)] += a
        return total / total.sum(1, keepdims=True)

    return predict


def _samme(x, y, classes, seed, rounds, depth):
    rng, w, models = np.random.default_rng(seed), np.full(len(y), 1 / len(y)), []
    for _ in range(rounds):
        t = fit_tree(x, y, classes, w, depth=depth, rng=rng)
        wrong = t.predict_proba(x).argmax(1) != y
        error = w[wrong].sum()
        if error >= 1 - 1 / classes:
            break
        models.append(t)
        if error <= 0:
            break
        w = w * np.exp((np.log((1 - error) / error) + np.log(classes - 1)) * wrong)
        w /= w.sum()
    return models or [fit_tree(x, y, classes, depth=depth, rng=rng)]


def class_program(margins) -> float:
    """The least mean slack of one class's rows: min mean xi, M alpha + xi >= 1, alpha on the simplex."""
    n, t = margins.shape
    return float(soft_margin(margins, np.full(n, 1 / n))[t:].mean())


def soft_margin(margins, cost) -> np.ndarray:
    """(alpha, xi): min cost xi, M alpha + xi >= 1, alpha on the simplex."""
    n, t = margins.shape
    return tall_program(np.r_[np.zeros(t), cost], np.ones((1, t)), np.zeros((1, n)), np.zeros((1, 0)), [1.0], -margins, -1, -np.ones(n))


def lexi_boost(x, y, classes, seed, rounds=50, depth=1) -> Predict:
    """Votes that come lexicographically close to each class's own best slack: two stages of linear programs."""
    models = _samme(x, y, classes, seed, rounds, depth)
    margins = np.stack([2 * m.predict_proba(x)[np.arange(len(y)), y] - 1 for m in models], 1)
    present = np.unique(y)
    best = {c: class_program(margins[y == c]) for c in present}
    n, t = margins.shape
    k = len(present)
    # each class's mean slack is at most its best and a common excess, the first of u; the others are the slacks of that
    mean = np.vstack([(y == present[:, None]) / (y == present[:, None]).sum(1, keepdims=True), np.zeros((1, n))])
    excess = np.vstack([np.hstack([-np.ones((k, 1)), np.eye(k)]), np.zeros((1, k + 1))])
    got = tall_program(np.r_[np.zeros(t + n), 1.0, np.zeros(k)], np.vstack([np.zeros((k, t)), np.ones((1, t))]), mean, excess, np.r_[[best[c] for c in present], 1.0], -margins, -1, -np.ones(n))
    return _vote(models, np.maximum(got[:t], 1e-9), classes)


def dual_lexi_boost(x, y, classes, seed, rounds=20, depth=10) -> Predict:
    """Trees are added against the row weights of the dual program; the final votes come from the primal one."""
    rng, d, models, edges = np.random.default_rng(seed), None, [], []
    n = len(y)
    cap = np.array([1 / max(1, (y == c).sum()) for c in range(classes)])[y]
    d = cap / cap.sum()
    for _ in range(rounds):
        t = fit_tree(x, y, classes, d * n, depth=depth, rng=rng)
        sign = np.where(t.predict_proba(x).argmax(1) == y, 1.0, -1.0)
        error = d[sign < 0].sum()
        if error >= 1 - 1 / classes:
            break
        models.append(t)
        edges.append(sign)
        if error <= 0:
            break
        # min z: every tree's edge under D is at most z, D on the simplex, D_i within its class's bound
        f = np.array(edges)
        k = len(f)
        free = np.vstack([np.hstack([-np.ones((k, 1)), np.ones((k, 1)), np.eye(k)]), np.zeros((1, k + 2))])  # z as a difference, and slacks
        got = tall_program(np.r_[np.zeros(n), 1.0, -1.0, np.zeros(k)], np.zeros((k + 1, 0)), np.vstack([f, np.ones((1, n))]), free, np.r_[np.zeros(k), 1.0], np.zeros((n, 0)), 1, cap)
        d = np.maximum(got[:n], 1e-9)
        d /= d.sum()
    if not models:
        return fit_tree(x, y, classes, depth=depth, rng=rng).predict_proba
    margins = np.array(edges).T
    t = margins.shape[1]
    weight = cap / len(np.unique(y))
    got = soft_margin(margins, weight)
    return _vote(models, np.maximum(got[:t], 1e-9), classes)


def dbcf(x, y, classes, seed, channels=2, layers=5, forests=4, folds=3, trees=50, depth=12) -> Predict:
    """Cascades of forests of balance-entropy trees on up-down sampled data; each layer sees the features and the layer
    before; layers are added while a held-out quarter gains."""
    rng = np.random.default_rng(seed)
    stacks = []
    for ch in range(channels):
        new_x, new_y = resamplers.run_kernel("up_down", x, y, seed + ch)
        order = rng.permutation(len(new_y))
        grow, check = order[len(order) // 4 :], order[: len(order) // 4]
        grow = grow if len(np.unique(new_y[grow])) == len(np.unique(new_y)) else order
        gx, cx = new_x[grow], new_x[check]
        stack, best = [], -1.0
        for layer in range(layers):
            part = np.arange(len(gx)) % folds
            slots, oof, checked = [], [], []
            for f in range(forests):
                own, out = [], np.zeros((len(gx), classes))
                for k in range(folds):
                    rows = part != k
                    m = fit_forest(gx[rows], new_y[grow][rows], classes, trees, seed + 97 * layer + 13 * f + k, depth=depth, least_leaf=2, least_split=4, impurity=balance)
                    own.append(m)
                    out[~rows] = m.predict_proba(gx[~rows])
                slots.append(own)
                oof.append(out)
                checked.append(np.mean([m.predict_proba(cx) for m in own], 0) if len(cx) else np.zeros((0, classes)))
            gain = (np.mean(checked, 0).argmax(1) == new_y[check]).mean() if len(cx) else 0.0
            if stack and gain <= best:
                break
            stack.append(slots)
            best = gain
            gx, cx = np.hstack([new_x[grow], *oof]), np.hstack([new_x[check], *checked])
        stacks.append(stack)

    def predict(z):
        out = []
        for stack in stacks:
            seen = z
            for slots in stack:
                p = [np.mean([m.predict_proba(seen) for m in own], 0) for own in slots]
                seen = np.hstack([z, *p])
            out.append(np.mean(p, 0))
        return np.mean(out, 0)

    return predict


def membership_entropy(x, y, classes, m=2.0) -> np.ndarray:
    """Entropy of fuzzy memberships by distance to the class centres."""
    centres = np.stack([x[y == c].mean(0) if (y == c).any() else np.full(x.shape[1], np.inf) for c in range(classes)])
    d = np.maximum(np.sqrt(((x[:, None] - centres) ** 2).sum(2)), 1e-12)
    u = d ** (-2 / (m - 1))
    u /= u.sum(1, keepdims=True)
    return -(u * np.log(np.maximum(u, 1e-12))).sum(1)


def deahs(x, y, classes, seed, rounds=30, trees=10, actions=4) -> Predict:
    """Rounds of under- and oversampling by hardness: a policy proposes (mean, width) of a Gaussian over the normalised
    loss, and the best of a few by validation reward is kept; overlap (membership entropy) rows are bred more.

    The policy is a cross-entropy search in NumPy instead of an actor-critic network."""
    rng = np.random.default_rng(seed)
    hold = np.zeros(len(y), bool)
    for c in np.unique(y):
        rows = rng.permutation(np.flatnonzero(y == c))
        hold[rows[: int(0.2 * len(rows))]] = True
    tx, ty = x[~hold], y[~hold]
    entropy = membership_entropy(tx, ty, classes)
    models, loss = [], rng.random(len(ty))
    mean, width = np.array([0.5, 0.3]), np.array([0.25, 0.15])
    for i in range(rounds):
        scale = (loss - loss.min()) / max(np.ptp(loss), 1e-12)
        best = None
        for a in np.clip(rng.normal(mean, width, (actions, 2)), 0.02, 1.0):
            goal = int(np.mean(np.bincount(ty)[np.unique(ty)]))
            picked = []
            for c in np.unique(ty):
                rows = np.flatnonzero(ty == c)
                w = 0.95 * np.exp(-0.5 * ((scale[rows] - a[0]) / a[1]) ** 2) + 0.05 if len(rows) > goal else entropy[rows] + 1e-6
                picked.append(rng.choice(rows, goal, replace=len(rows) <= goal, p=w / w.sum()))
            rows = np.concatenate(picked)
            m = fit_forest(tx[rows], ty[rows], classes, trees, seed + i)
            got = _reward(y[hold], m.predict_proba(x[hold]).argmax(1), classes) if hold.any() else 0.0
            if best is None or got > best[0]:
                best = (got, a, m)
        models.append(best[2])
        mean = 0.7 * mean + 0.3 * best[1]
        p = np.mean([m.predict_proba(tx) for m in models], 0)
        loss = -np.log(np.maximum(p[np.arange(len(ty)), ty], 1e-12))
    return lambda z: np.mean([m.predict_proba(z) for m in models], 0)


def _reward(y, p, classes) -> float:
    present = np.unique(y)
    recall = np.array([(p[y == c] == c).mean() for c in present])
    f1 = np.array([2 * ((p == c) & (y == c)).sum() / max(1, (p == c).sum() + (y == c).sum()) for c in present])
    return float(np.mean([recall.mean(), np.exp(np.log(np.maximum(recall, 1e-3)).mean()), f1.mean(), (p == y).mean()]))


def ilmnn(x, y, classes, seed, k=5, steps=30, rate=1e-3, trees=30) -> Predict:
    """A projection that pulls same-class neighbours and pushes impostors, weighted toward small and crowded classes; then
    SMOTE and a forest in the projected space."""
    at = np.full((len(y), k), -1)
    for c in np.unique(y):
        rows = np.flatnonzero(y == c)
        got, _ = resamplers.near(x[rows], k)
        at[rows[:, None], np.arange(got.shape[1])] = rows[got]
    sizes = np.bincount(y, minlength=classes)
    weight = (sizes[sizes > 0].min() / np.maximum(sizes, 1))[y]
    proj = np.eye(x.shape[1])
    for _ in range(steps):
        z = x @ proj.T
        grad = np.zeros_like(proj)
        for i in range(len(y)):
            target = at[i][at[i] >= 0]
            if not len(target):
                continue
            diff = x[i] - x[target]
            grad += weight[i] * 2 * proj @ (diff.T @ diff) / len(y)
            d2 = ((z[i] - z) ** 2).sum(1)  # of one row at a time, as all pairs grow with the square
            bound = d2[target].max() + 1
            push = np.flatnonzero((y != y[i]) & (d2 < bound))
            if len(push):
                far = x[i] - x[push]
                grad -= weight[i] * 2 * proj @ (far.T @ far) / (len(y) * len(push))
        grad += 2 * proj @ proj.T @ proj * 1e-2
        norm = np.linalg.norm(grad)
        proj = proj - rate * grad * min(1.0, 10 / max(norm, 1e-12))
    predict = after_resampling("SMOTE")(x @ proj.T, y, classes, seed, trees)
    return lambda z: predict(z @ proj.T)


def imdef(x, y, classes, seed, sets=10, trees=10, referees=5, stop=5) -> Predict:
    """Trees on sets bred along clean directions with class priors to powers from 1 to -1; referees learn on which rows
    each set's trees are right, and weigh their probabilities."""
    rng = np.random.default_rng(seed)
    regions = [resamplers.clean_region(x, y, i, *(v[:50] for v in resamplers.candidate_region(x, y, i, stop))) for i in range(len(y))]
    share = np.bincount(y, minlength=classes) / len(y)
    members = []
    for power in np.linspace(1, -1, sets):
        w = np.where(share > 0, np.maximum(share, 1e-12) ** power, 0)
        want = np.round(len(y) * w / w.sum()).astype(int)
        nx, ny = [], []
        for c in np.flatnonzero(want):
            for i in rng.choice(np.flatnonzero(y == c), want[c]):
                to = x[rng.choice(regions[i])] if len(regions[i]) else x[i]
                nx.append(x[i] + rng.random(x.shape[1]) * (to - x[i]))
                ny.append(c)
        m = fit_forest(np.array(nx), np.array(ny), classes, trees, int(rng.integers(1 << 30)))
        right = (m.predict_proba(x).argmax(1) == y).astype(int)
        rate = right.mean()
        judge = None if rate >= 0.99 or rate <= 0.01 else fit_forest(x, right, 2, referees, int(rng.integers(1 << 30)), w=_class_weight(y, classes), depth=8)
        members.append((m, judge, rate))

    def predict(z):
        total = np.full((len(z), classes), 1e-12)
        for m, judge, rate in members:
            total += m.predict_proba(z) * ((judge.predict_proba(z)[:, 1] if judge else np.full(len(z), float(rate > 0.5)))[:, None] + 1e-9)
        return total / total.sum(1, keepdims=True)

    return predict


def frame(x, y, classes, seed, hidden=32, epochs=100) -> Predict:
    """Column-mean imputation, then a network of weighted cross entropy whose last hidden layer is compared with up to three
    centres a class: logits are log-mean-exp of negative squared distances. Centres are class clusters in NumPy."""
    fill = np.nan_to_num(np.nanmean(np.where(np.isfinite(x), x, np.nan), 0))
    clean = lambda v: np.where(np.isfinite(v), v, fill)
    net = Perceptron([x.shape[1], hidden, classes], seed).fit(clean(x), y, _class_weight(y, classes), epochs)
    deep = lambda v: net.layers(clean(v))[-2]
    z, rng, centres = deep(x), np.random.default_rng(seed), []
    for c in range(classes):
        rows = z[y == c]
        if not len(rows):
            centres.append(None)
            continue
        means = rows[rng.choice(len(rows), min(3, len(rows)), replace=False)]
        for _ in range(10):
            near = ((rows[:, None] - means) ** 2).sum(2).argmin(1)
            means = np.stack([rows[near == i].mean(0) if (near == i).any() else means[i] for i in range(len(means))])
        centres.append(means)
    scale = max(float(z.var(0).sum()), 1e-9)

    def predict(v):
        h = deep(v)
        logits = np.full((len(v), classes), -50.0)
        for c, means in enumerate(centres):
            if means is not None:
                d = -((h[:, None] - means) ** 2).sum(2) / scale
                logits[:, c] = np.log(np.exp(d - d.max(1, keepdims=True)).mean(1)) + d.max(1)
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    return predict


def hrielm(x, y, classes, seed, hidden=200, ridge=0.01, k=5, share=0.2) -> Predict:
    """Random-layer networks on sets balanced at each class's size; a row is judged by those that do well near it."""
    rng = np.random.default_rng(seed)
    hold = rng.random(len(y)) < share
    hold[[np.flatnonzero(y == c)[0] for c in np.unique(y)]] = False
    tx, ty, vx, vy = x[~hold], y[~hold], x[hold], y[hold]
    nets = []
    for c in np.unique(ty):
        goal, parts = int((ty == c).sum()), []
        for o in np.unique(ty):
            rows = tx[ty == o]
            more = resamplers.interpolated(rows, goal - len(rows), k, rng)
            parts.append((np.concatenate([rows, more])[:goal] if len(rows) < goal else rows[rng.choice(len(rows), goal, replace=False)], o))
        sx, sy = np.concatenate([p for p, _ in parts]), np.concatenate([np.full(len(p), o) for p, o in parts])
        w, b = rng.uniform(-1, 1, (x.shape[1], hidden)), rng.uniform(-1, 1, hidden)
        h = 1 / (1 + np.exp(-(sx @ w + b)))
        beta = np.linalg.solve(h.T @ h + ridge * np.eye(hidden), h.T @ np.eye(classes)[sy])
        nets.append((w, b, beta))
    out = lambda n, z: 1 / (1 + np.exp(-(z @ n[0] + n[1]))) @ n[2]
    right = np.stack([out(n, vx).argmax(1) == vy for n in nets], 1) if len(vx) else np.ones((0, len(nets)))

    def predict(z):
        scores = np.stack([np.exp(out(n, z) - out(n, z).max(1, keepdims=True)) for n in nets])
        scores /= scores.sum(2, keepdims=True)
        if not len(vx):
            return scores.mean(0)
        at, away = resamplers.near(z, k, vx)
        weight = (right[at] / np.maximum(away, 1e-9)[:, :, None]).sum(1)
        local = right[at].mean(1)
        weight = np.where(local >= local.mean(1, keepdims=True), weight, 0) + 1e-9
        return np.einsum("mzc,zm->zc", scores, weight / weight.sum(1, keepdims=True))

    return predict


def eass(x, y, classes, seed, episodes=5, members=5, depth=12) -> Predict:
    """Episodes of ensembles on class-wise Gaussian selections by loss (random actions); the best by validation F1 stays."""
    rng = np.random.default_rng(seed)
    hold = rng.random(len(y)) < 0.2
    hold[[np.flatnonzero(y == c)[0] for c in np.unique(y)]] = False
    tx, ty, best = x[~hold], y[~hold], None
    least = min(np.bincount(ty)[np.unique(ty)])
    for _ in range(episodes):
        models, loss = [], np.full(len(ty), 1 - 1 / classes)
        for _ in range(members):
            rows = []
            for c in np.unique(ty):
                own, a = np.flatnonzero(ty == c), rng.random(2)
                w = np.exp(-0.5 * ((loss[own] - a[0]) / max(a[1], 0.05)) ** 2) + 1e-6
                rows.append(rng.choice(own, least, replace=False, p=w / w.sum()))
            rows = np.concatenate(rows)
            models.append(fit_tree(tx[rows], ty[rows], classes, depth=depth, rng=rng))
            loss = 1 - np.mean([m.predict_proba(tx) for m in models], 0)[np.arange(len(ty)), ty]
        got = _reward(y[hold], np.mean([m.predict_proba(x[hold]) for m in models], 0).argmax(1), classes) if hold.any() else 0.0
        if best is None or got > best[0]:
            best = (got, models)
    return lambda z: np.mean([m.predict_proba(z) for m in best[1]], 0)


def select_rows(p: np.ndarray, y: np.ndarray, most: int = 0) -> np.ndarray:
    """Rows of selection probability .5 or more, the most probable of a class without any, and of over `most` (0: all) the most
    probable of each class and then overall."""
    keep = p >= 0.5
    for c in np.unique(y):
        own = np.flatnonzero(y == c)
        keep[own[p[own].argmax()]] |= not keep[own].any()
    if most and keep.sum() > most:
        first = np.zeros(len(y), bool)
        for c in np.unique(y):
            own = np.flatnonzero((y == c) & keep)
            first[own[p[own].argmax()]] = True
        rest = np.flatnonzero(keep & ~first)
        first[rest[np.argsort(-p[rest], kind="stable")[: max(0, most - first.sum())]]] = True
        keep = first
    return keep


def diag_select(x, y, classes, seed, trees=100, episodes=5, draws=2, rate=0.5, most=0) -> Predict:
    """A policy chooses the rows that a class-weighted forest learns from. Its state are a row's probability, margin and entropy
    under a forest that hasn't seen it, its class's share, and how many neighbours share its class. The policy, logistic,
    is first fitted to whether that forest is right, then moved by REINFORCE: the forest of a drawn selection is rewarded
    by its F1 on a fifth of the rows. The best deterministic selection of the episodes trains the model."""
    rng = np.random.default_rng(seed)
    hold = rng.random(len(y)) < 0.2
    hold[[np.flatnonzero(y == c)[0] for c in np.unique(y)]] = False
    tx, ty, few = x[~hold], y[~hold], max(5, trees // 10)
    part, proba = rng.integers(0, 2, len(ty)), np.full((len(ty), classes), 1 / classes)
    for k in (0, 1):
        if len(np.unique(ty[part != k])) > 1 and (part == k).any():
            proba[part == k] = fit_forest(tx[part != k], ty[part != k], classes, few, seed + k, w=_class_weight(ty[part != k], classes)).predict_proba(tx[part == k])
    own = proba[np.arange(len(ty)), ty]
    other = np.where(np.arange(classes) == ty[:, None], -1.0, proba).max(1)
    entropy = -(proba * np.log(np.maximum(proba, 1e-12))).sum(1) / np.log(max(2, classes))
    share = (np.bincount(ty, minlength=classes) / len(ty))[ty]
    state = np.column_stack([own, own - other, entropy, share, resamplers.safe_levels(tx, ty), np.ones(len(ty))])
    policy, right = np.zeros(state.shape[1]), (own > other).astype(float)
    score = lambda: 1 / (1 + np.exp(-np.clip(state @ policy, -30, 30)))
    for _ in range(200):
        policy += state.T @ (right - score()) / len(ty)

    def head(keep, trees, seed):
        return fit_forest(tx[keep], ty[keep], classes, trees, seed, w=_class_weight(ty[keep], classes))

    def reward(keep, seed):
        return _reward(y[hold], head(keep, few, seed).predict_proba(x[hold]).argmax(1), classes) if hold.any() else 0.0

    best = None
    for episode in range(episodes):
        keep = select_rows(score(), ty, most)
        base = reward(keep, seed + episode)
        if best is None or base > best[0]:
            best = (base, keep)
        for _ in range(draws):
            p = score()
            drawn = rng.random(len(ty)) < p
            gain = reward(drawn | select_rows(np.where(drawn, p, 0.0), ty), seed + episode) - base
            policy += rate * gain * state.T @ (drawn - p) / len(ty)
    return head(best[1], trees, seed).predict_proba


def dmsam_oadb(x, y, classes, seed, members=4, epochs=50) -> Predict:
    """Boosted networks: easy majority rows lose their weight (a tenth at most), the others gain as in SAMME; members vote
    by log probability."""
    w, models, votes = np.full(len(y), 1 / len(y)), [], []
    sizes = np.bincount(y, minlength=classes)
    for i in range(members):
        net = Perceptron([x.shape[1], 32, classes], seed + i).fit(x, y, w * len(y) * _class_weight(y, classes), epochs)
        p = net.predict_proba(x)
        right = p.argmax(1) == y
        error = np.clip(w[~right].sum() / w.sum(), 1e-6, 1 - 1e-6)
        alpha = max(0.05, np.log((1 - error) / error) + np.log(max(2, classes) - 1))
        models.append(net)
        votes.append(alpha)
        w = w * np.exp(alpha * ~right)
        easy = np.flatnonzero(right & (y == sizes.argmax()))
        some = easy[np.argsort(-p[easy, y[easy]], kind="stable")][: min(int(0.1 * len(y)), int(sizes[sizes > 0].min()))]
        w[some] = 0
        w /= max(w.sum(), 1e-12)

    def predict(z):
        total = sum(a * np.log(np.maximum(m.predict_proba(z), 1e-12)) for a, m in zip(votes, models, strict=True))
        e = np.exp(total - total.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    return predict


def ddpm(x, y, classes, seed, steps=50, epochs=60, most=500) -> Predict:
    """Rows of smaller classes from a denoising diffusion model (a class-conditional Gaussian denoiser in closed form), then
    a class-weighted network."""
    rng = np.random.default_rng(seed)
    beta = np.linspace(1e-4, 0.2, steps)
    alpha_bar = np.cumprod(1 - beta)
    sizes = resamplers._by_size(y)
    made = []
    for c, n in sizes[1:]:
        mean = x[y == c].mean(0)
        cov = (np.cov(x[y == c].T, ddof=0).reshape(x.shape[1], -1) if n > 1 else np.zeros((x.shape[1],) * 2)) + 1e-6 * np.eye(x.shape[1])
        z = rng.standard_normal((min(most, sizes[0][1] - n), x.shape[1]))
        for t in range(steps - 1, -1, -1):
            a = alpha_bar[t]
            noise = np.sqrt(1 - a) * (z - np.sqrt(a) * mean) @ np.linalg.inv(a * cov + (1 - a) * np.eye(x.shape[1]))
            z = (z - beta[t] / np.sqrt(1 - a) * noise) / np.sqrt(1 - beta[t]) + (np.sqrt(beta[t]) * rng.standard_normal(z.shape) if t else 0)
        made.append((z, c))
    new_x, new_y = resamplers._joined(x, y, made)
    return Perceptron([x.shape[1], 64, classes], seed).fit(new_x, new_y, _class_weight(new_y, classes), epochs).predict_proba


LEARNERS: dict[str, Callable[..., Predict]] = {
    **{k: after_resampling(k) for k in ("EB-SMOTE", "glos", "mc_ccr", "mc_rbo", "mdo", "nromm", "orem_m", "QC-SMOTE", "shsampler", "smom", "soup")},
    "SPE": spe, "SPEBoost": spe_boost, "DiverseSPE": spe_diverse, "NROMMSPE": spe_nromm, "AdaBoostAD": ada_boost_ad, "LexiBoost": lexi_boost, "DualLexiBoost": dual_lexi_boost, "DBCF": dbcf,
    "DEAHS": deahs, "ILMNN": ilmnn, "imDEF": imdef, "FRAME": frame, "HRIELM": hrielm, "EASS": eass, "DiagSelect": diag_select, "DMSAM-OAdB": dmsam_oadb, "DDPM": ddpm,
}
#: Smaller settings for a quick look.
SMOKE = {
    "SPE": {"rounds": 3, "trees": 5}, "SPEBoost": {"rounds": 3, "trees": 5}, "DiverseSPE": {"trees": 10}, "NROMMSPE": {"rounds": 3, "trees": 5}, "AdaBoostAD": {"rounds": 5}, "LexiBoost": {"rounds": 5},
    "DualLexiBoost": {"rounds": 3, "depth": 3}, "DBCF": {"channels": 1, "layers": 2, "forests": 2, "trees": 5}, "DEAHS": {"rounds": 3, "trees": 5, "actions": 2}, "ILMNN": {"steps": 5}, "imDEF": {"sets": 3, "trees": 5},
    "FRAME": {"epochs": 20}, "HRIELM": {"hidden": 64}, "EASS": {"episodes": 1}, "DiagSelect": {"trees": 10, "episodes": 2, "draws": 1}, "DMSAM-OAdB": {"members": 2, "epochs": 10}, "DDPM": {"epochs": 10}, "mc_rbo": {"steps": 50},
}
