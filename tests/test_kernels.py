"""Functionals against slow versions, identities and processes whose answer is known."""

import itertools
import math

import numpy as np
import pytest

from riverbed.functions import kernels as K
from riverbed.operators import search as G


def ar(phi, n, seed=0):
    e, x = np.random.default_rng(seed).normal(size=n), np.zeros(n)
    for t in range(1, n):
        x[t] = phi * x[t - 1] + e[t]
    return x


def test_hurst_of_noise_and_trend():
    noise = np.random.default_rng(0).normal(size=4000)
    assert 0.4 < K.hurst(noise) < 0.6 and K.hurst(np.cumsum(noise)) > 1.2 and math.isnan(K.hurst(noise[:99]))
    y, s = np.cumsum(noise[:200] - noise[:200].mean()), 16
    slow = []
    for a in range(0, 192, s):
        c = np.polyfit(np.arange(s), y[a : a + s], 1)
        slow.append(np.mean((y[a : a + s] - np.polyval(c, np.arange(s))) ** 2))
    assert K.detrended(y, s) == pytest.approx(slow)


def test_multifractal_width_tells_a_cascade_from_noise():
    mass = np.ones(1)
    rng = np.random.default_rng(0)
    for _ in range(12):
        p = np.where(rng.random(len(mass)) < 0.5, 0.7, 0.3)
        mass = np.ravel(np.column_stack((mass * p, mass * (1 - p))))
    scales = (16, 32, 64, 128, 256)
    assert K.multifractal_width(mass, 5, scales) > 3 * abs(K.multifractal_width(rng.normal(size=4096), 5, scales))


def test_unit_roots():
    noise = ar(0.5, 800)
    assert K.augmented_df(noise)[0] < -5 and K.augmented_df(np.cumsum(noise))[0] > -2.86 and math.isnan(K.augmented_df(noise[:20])[0])
    d = K.least_d(np.cumsum(np.random.default_rng(1).normal(size=1500)), tuple(np.arange(0, 1.05, 0.1)), 1e-2)
    assert 0 < d <= 1
    assert K.frac_weights(1.0, 1e-6) == pytest.approx([1, -1]) and K.frac_weights(0.4, 0.01)[:3] == pytest.approx([1, -0.4, -0.12])


def test_entropies_equal_slow_versions():
    x = np.random.default_rng(3).normal(size=120)

    def pairs(m, tol):
        t = [x[i : i + m] for i in range(len(x) - m + 1)]
        return sum(np.abs(a - b).max() < tol for a, b in itertools.combinations(t, 2))

    tol = 0.2 * x.std()
    assert K.sample_entropy(x) == pytest.approx(-math.log(pairs(3, tol) / pairs(2, tol)))
    assert K.sample_entropy(np.ones(50)) == 0 and math.isnan(K.sample_entropy(x[:3]))
    counts = {}
    for i in range(len(x) - 2):
        k = tuple(np.argsort(x[i : i + 3], kind="stable"))
        counts[k] = counts.get(k, 0) + 1
    p = np.array(list(counts.values())) / (len(x) - 2)
    assert K.permutation_entropy(x) == pytest.approx(-(p * np.log(p)).sum() / math.log(6))
    assert K.permutation_entropy(np.arange(50.0)) == 0 and K.permutation_entropy(ar(0.0, 4000)) > 0.99


def test_recurrence_equals_slow_version():
    x = ar(0.6, 60)
    v = np.array([x[i : i + 3] for i in range(len(x) - 2)])
    n = len(v)
    d = np.array([[np.linalg.norm(a - b) for b in v] for a in v])
    r = d <= np.quantile(d[np.triu_indices(n, 1)], 0.1)
    np.fill_diagonal(r, False)
    runs = lambda b: [len(list(g)) for k, g in itertools.groupby(b) if k]
    diag = [q for k in range(1, n) for q in runs(np.diagonal(r, k)) if q >= 2]
    vert = [q for j in range(n) for q in runs(r[:, j]) if q >= 2]
    want = r.sum() / (n * (n - 1)), 2 * sum(diag) / r.sum(), sum(vert) / r.sum(), np.mean(vert) if vert else 0
    assert K.recurrence(x) == pytest.approx(want)


def test_tails():
    rng = np.random.default_rng(0)
    gauss, heavy = np.abs(rng.normal(size=4000)), np.abs(rng.standard_t(3, size=4000))
    assert K.hill(heavy, 100) < K.hill(gauss, 100) and K.pareto_shape(heavy) > K.pareto_shape(gauss)
    assert K.hill(
        rng.pareto(2.5, 50_000) + 1, 500
    ) == pytest.approx(2.5, rel=0.15) and math.isnan(K.hill(gauss, 4)) and math.isnan(K.pareto_shape(gauss[:20]))


def test_signature_identities():
    steps = np.random.default_rng(0).normal(size=(12, 3))
    fast, slow = K.signature(steps, 3), K.signature_product(steps, 3)
    assert fast == pytest.approx(slow) and fast[:3] == pytest.approx(steps.sum(0))
    first, second = fast[:3], fast[3:12].reshape(3, 3)
    assert second + second.T == pytest.approx(np.outer(first, first))


def test_merge_lengths_are_the_least_spanning_tree():
    pts = np.random.default_rng(0).normal(size=(25, 2))
    d = K.distances(pts)
    edges, up, want = sorted((d[i, j], i, j) for i in range(25) for j in range(i)), list(range(25)), []
    for w, i, j in edges:
        if up[i] != up[j]:
            want.append(w)
            up = [up[i] if u == up[j] else u for u in up]
    assert K.merge_lengths(pts) == pytest.approx(want)
    total, norm, longest, l1, l2, gap, near = K.shape_features(pts)
    assert total == pytest.approx(sum(want)) and longest == pytest.approx(want[-1]) and gap == pytest.approx(want[-1] - np.median(want))
    # a tent over [0, d] has area d^2 / 4 and squared area d^3 / 12
    assert l1 == pytest.approx(sum(w * w / 4 for w in want), rel=1e-2) and l2**2 == pytest.approx(sum(w**3 / 12 for w in want), rel=1e-2)
    assert near == pytest.approx(np.sort(d + np.eye(25) * 9, 1)[:, 0].mean())


def test_self_excitation():
    t = np.array([1.0, 1.5, 4.0, 4.2, 9.0])
    slow = [sum(math.exp(-0.7 * (t[k] - t[i])) for i in range(k)) for k in range(5)]
    assert K.excitation(t, 0.7) == pytest.approx(slow)
    grid = np.linspace(0, 10, 200_001)
    rate = 0.3 + 0.5 * np.array([np.exp(-0.7 * (grid - e)) * (grid > e) for e in t]).sum(0)
    want = np.trapezoid(rate, grid) - sum(math.log(0.3 + 0.5 * a) for a in slow)
    assert K.hawkes_loss(np.log([0.3, 0.5, 0.7]), t, 10.0) == pytest.approx(want, rel=1e-3)
    rng, events, now = np.random.default_rng(5), [], 0.0
    while now < 3000:  # thinning
        top = 0.2 + 0.6 * sum(math.exp(-1.0 * (now - e)) for e in events[-60:]) + 0.6
        now += rng.exponential(1 / top)
        if rng.random() * top < 0.2 + 0.6 * sum(math.exp(-1.0 * (now - e)) for e in events[-60:]):
            events.append(now)
    n, ratio, base = K.hawkes(np.array(events), 3000.0)
    assert 0.4 < n < 0.75 and 0.12 < base < 0.3 and ratio >= 1
    assert math.isnan(K.hawkes(np.arange(5.0), 9.0)[0])


def test_transfer_goes_one_way():
    rng = np.random.default_rng(2)
    x = rng.normal(size=1500)
    y = np.concatenate(([0], x[:-1])) + 0.5 * rng.normal(size=1500)
    a, b = K.binned(x, 3), K.binned(y, 3)
    there, back = K.transfer_score(a, b, 1, 3, 30, 0), K.transfer_score(b, a, 1, 3, 30, 0)
    assert there[0] > 10 * back[0] and there[1] > 5 > back[1] and K.transfer(a[:3], b[:3], 1, 3) == 0.0


def test_factors_and_scores():
    rng = np.random.default_rng(0)
    market = rng.normal(size=(120, 1))
    r = market @ np.ones((1, 12)) + 0.5 * rng.normal(size=(120, 12))
    assert K.cleaned_factors(r).shape == (12, 1) and K.cleaned_factors(rng.normal(size=(120, 12))).shape[1] >= 1
    scores, k = K.residual_scores(r)
    assert k == 1 and len(scores) == 12
    s, kappa, hl = K.reversion_score(np.diff(ar(0.8, 400)))
    assert 1 < hl < 8 and kappa > 0 and math.isnan(K.reversion_score(np.ones(30))[0])


def test_fits():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.01 * rng.normal(size=400)
    assert K.ridge(x, y, 1e-9) == pytest.approx([1, -2, 0.5, 3], abs=0.01) and abs(K.ridge(x, y, 1e6)[:3]).max() < 0.01
    up = (rng.random(400) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    w = K.logistic(x, up, 1.0)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert x.T @ (p - up) + w[:-1] == pytest.approx(np.zeros(3), abs=1e-6) and w[0] > 1
    walk = K.walk_forward(x, y, 100, 20, 1e-6)
    assert np.isnan(walk[:100]).all() and walk[100:] == pytest.approx(y[100:], abs=0.1)
    assert K.greedy_apart(np.array([[1, 0.9, 0], [0.9, 1, 0], [0, 0, 1]]), 5, 0.5) == [0, 2]
    assert K.grid_product(a=(1, 2), b=("x", "y"))[1] == {"a": 1, "b": "y"}


@pytest.mark.parametrize("fn", [lambda x: K.permutation_entropy(x, 4), lambda x: K.hill(-x, 10), K.multifractal_width, lambda x: K.recurrence(x)[1]])
def test_functionals_know_the_past_alone(fn):
    """A window's value is the same on a prefix of the series: nothing behind the window is read."""
    x = ar(0.3, 400, 4)
    for end in (150, 231, 399):
        assert fn(x[:end][-120:]) == fn(x[end - 120 : end])


def test_random_trees_are_read_back_and_bounded():
    features = ["a", "b"]
    trees = G.population(3, 200, features)
    from riverbed.operators import formulas

    assert all(G.parsed(formulas.text(t)) == t for t in trees) and len({formulas.text(t) for t in trees}) == len(trees)
    rng = np.random.default_rng(0)
    young = [G.mutated(rng, t, features) for t in trees]
    assert any(a != b for a, b in zip(trees, young, strict=True)) and all(formulas.nodes(t) < 64 for t in young)


def test_information_equals_slow_version():
    rng = np.random.default_rng(0)
    a, f = rng.normal(size=(40, 9)).round(1), rng.normal(size=(40, 9))
    a[3, 2] = np.nan
    import pandas as pd

    ic = [pd.Series(x).rank().corr(pd.Series(y).where(~np.isnan(x)).rank()) for x, y in zip(a, f, strict=True)]
    assert G.information(a, f) == pytest.approx((np.mean(ic), np.mean(ic) / (np.std(ic) + 1e-9)))
    assert G.information(a[:20], f[:20]) == (0.0, 0.0)
    w = G.weights(a)
    assert np.abs(w).sum(1) == pytest.approx(np.ones(40)) and w.sum(1) == pytest.approx(np.zeros(40), abs=1e-9)
    net = G.long_short(a, f, 10.0)
    assert net[0] == pytest.approx(-0.001) and net[1] == pytest.approx((w[0] * f[1]).sum() - 0.001 * np.abs(w[1] - w[0]).sum())
    assert G.fifths(np.tile(np.arange(11.0), (3, 1)), np.tile(np.arange(11.0), (3, 1))) == pytest.approx([0.5, 2.5, 4.5, 6.5, 9.0])
