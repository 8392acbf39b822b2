"""The sequence recursions against enumeration of all segmentations."""

import math
from itertools import product

import numpy as np
import pytest

from seqwatch.functions import kernels, special


def tables(k=3, d=3, n=6, seed=0):
    draw = np.random.default_rng(seed)
    init = np.log(draw.dirichlet(np.full(k, 2.0)))
    trans = draw.dirichlet(np.full(k, 2.0), k) * (1 - np.eye(k))
    with np.errstate(divide="ignore"):
        trans = np.log(trans / trans.sum(1, keepdims=True))
    pmf = draw.dirichlet(np.full(d, 2.0), k)
    survival = np.log(np.cumsum(pmf[:, ::-1], 1)[:, ::-1])
    return draw.normal(size=(n, k)) * 0.4, init, trans, np.log(pmf), survival


def segmentations(n, k, d):
    def tile(left):
        if left == 0:
            yield ()
        for x in range(1, min(d, left) + 1):
            for rest in tile(left - x):
                yield (x, *rest)

    for durations in tile(n):
        for states in product(range(k), repeat=len(durations)):
            if all(a != b for a, b in zip(states, states[1:])):
                yield list(zip(states, durations))


def weight(path, look, init, trans, pmf, survival):
    total, at = init[path[0][0]], 0
    for i, (s, d) in enumerate(path):
        total += look[at : at + d, s].sum() + (survival if i == len(path) - 1 else pmf)[s, d - 1]
        if i:
            total += trans[path[i - 1][0], s]
        at += d
    return total


@pytest.mark.parametrize("seed", range(3))
def test_expectations_equal_enumeration(seed):
    t = tables(seed=seed)
    look, init, trans, pmf, survival = t
    n, k = look.shape
    d = pmf.shape[1]
    paths = list(segmentations(n, k, d))
    w = np.array([weight(p, *t) for p in paths])
    total = float(kernels.lse(w, 0))
    p = np.exp(w - total)
    xi, closed, open_, gamma = np.zeros((k, k)), np.zeros((k, d)), np.zeros((k, d)), np.zeros((n, k))
    for path, q in zip(paths, p):
        at = 0
        for i, (s, x) in enumerate(path):
            gamma[at : at + x, s] += q
            (open_ if i == len(path) - 1 else closed)[s, x - 1] += q
            if i:
                xi[path[i - 1][0], s] += q
            at += x
    found = kernels.expectations(*t)
    for got, expected in zip(found, (xi, closed, open_, gamma, total)):
        np.testing.assert_allclose(got, expected, atol=1e-8)
    assert kernels.forward(*t)[3] == pytest.approx(total, abs=1e-9)
    best = max(w)
    path, value = kernels.viterbi(*t)
    assert value == pytest.approx(best) and weight(path, *t) == pytest.approx(best) and sum(x for _, x in path) == n


def test_beliefs_only_look_back():
    t = tables(n=6, seed=4)
    look, *rest = t
    before = kernels.forward(*t)[0]
    for cut in range(1, 6):
        changed = look.copy()
        changed[cut:] += 3.0
        np.testing.assert_allclose(kernels.forward(changed, *rest)[0][: cut + 1], before[: cut + 1])
    np.testing.assert_allclose(np.exp(before).sum(1), 1.0)


def test_plain_hmm_equals_enumeration():
    draw = np.random.default_rng(2)
    init, trans, emit = np.log(draw.dirichlet(np.ones(3))), np.log(draw.dirichlet(np.ones(3), 3)), np.log(draw.dirichlet(np.ones(4), 3))
    symbols = np.array([0, 3, 1, 1, 2])
    gamma, xi, total = np.zeros((5, 3)), np.zeros((3, 3)), []
    for path in product(range(3), repeat=5):
        w = init[path[0]] + sum(emit[s, o] for s, o in zip(path, symbols)) + sum(trans[a, b] for a, b in zip(path, path[1:]))
        total.append(w)
        for t, s in enumerate(path):
            gamma[t, s] += math.exp(w)
        for a, b in zip(path, path[1:]):
            xi[a, b] += math.exp(w)
    z = sum(map(math.exp, total))
    g, x, lz = kernels.hmm_expectations(symbols, init, trans, emit)
    np.testing.assert_allclose(g, gamma / z)
    np.testing.assert_allclose(x, xi / z)
    assert lz == pytest.approx(math.log(z))


def test_special_functions():
    x = np.array([0.1, 0.7, 1, 2.5, 9, 60])
    np.testing.assert_allclose(special.lgamma(x), [math.lgamma(v) for v in x], atol=1e-9)
    h = 1e-5
    np.testing.assert_allclose(special.digamma(x), [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x], rtol=1e-4)
    np.testing.assert_allclose(special.trigamma(x), (special.digamma(x + h) - special.digamma(x - h)) / (2 * h), rtol=1e-4)
    assert float(special.betainc(2, 3, 0.4)) == pytest.approx(0.5248)


@pytest.mark.parametrize("r,p", [(3, 0.3), (5, 0.2), (10, 0.1), (2, 0.5)])
def test_duration_tables(r, p):
    pmf, survival = special.duration_tables([r], [p], 150)
    assert np.exp(pmf).sum() == pytest.approx(1) and survival[0, 0] == 0
    raw = np.exp(special.nb_log_pmf(np.arange(1, 2000), r, p))
    tail = np.cumsum(raw[::-1])[::-1]
    np.testing.assert_allclose(np.exp(survival[0]), tail[:150], rtol=1e-6, atol=1e-12)
    np.testing.assert_allclose(np.exp(special.nb_log_cdf(np.arange(1, 40), r, p)), np.cumsum(raw)[:39], rtol=1e-7)


@pytest.mark.parametrize("r,p", [(4, 0.3), (1, 0.1), (20, 0.5), (8, 0.4)])
def test_fit_recovers_durations(r, p):
    hist = np.exp(special.nb_log_pmf(np.arange(1, 400), r, p)) * 1e6
    assert special.fit_nb(hist, 999.0, steps=8) == pytest.approx((r, p), rel=2e-3)
    assert special.fit_nb(np.zeros(10), 7.0)[0] == 7.0


def test_imputation_conserves_mass():
    from seqwatch.plans.fit import imputed

    pmf, survival = special.duration_tables([5], [0.2], 60)
    open_ = np.zeros((1, 60))
    open_[0, [9, 29]] = 5.0, 3.0
    full = imputed(np.zeros((1, 60)), open_, pmf, survival)
    assert full.sum() == pytest.approx(8.0) and full[0, :9].sum() == 0
