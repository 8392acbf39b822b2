"""Fits of durations that are partly cut off, against a grid and what they came from."""

import numpy as np
import pytest

from seqwatch.functions import special
from seqwatch.plans import durations


def sample(seed, n=400, r=4.0, p=0.3, d_max=40):
    draw = np.random.default_rng(seed)
    d, cut = 1 + draw.negative_binomial(r, p, n), draw.integers(1, 25, n)
    closed, open_ = np.zeros(d_max), np.zeros(d_max)
    for x, c in zip(d, cut):
        (closed if x < c else open_)[min(x, c, d_max) - 1] += 1
    return closed, open_


@pytest.mark.parametrize("seed", range(5))
def test_the_fit_is_flat_and_no_grid_point_is_likelier(seed):
    closed, open_ = sample(seed, r=1 + 2 * seed, p=0.2 + 0.1 * seed)
    r, p, value = special.fit_censored(closed, open_)
    at = np.array([np.log(r), np.log(p / (1 - p))])
    found, slope = special.censored_gradient(at, closed, open_)
    assert found == pytest.approx(value) and np.abs(slope).max() < 1e-6
    for a in np.linspace(-1.5, 1.5, 25):
        for b in np.linspace(-1.5, 1.5, 25):
            assert special.censored_gradient(at + [a, b], closed, open_)[0] <= value + 1e-12


def test_slopes_equal_differences():
    closed, open_ = sample(9)
    for at in ([0.3, -1.0], [2.0, 0.5]):
        _, slope = special.censored_gradient(np.array(at), closed, open_)
        for k, e in enumerate(np.eye(2) * 1e-6):
            up, down = (special.censored_gradient(np.array(at) + s * e, closed, open_)[0] for s in (1, -1))
            assert slope[k] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_the_fit_undoes_the_cuts():
    closed, open_ = sample(3, n=6000)
    r, p, _ = special.fit_censored(closed, open_)
    naive = (closed * np.arange(1, 41)).sum() / closed.sum()
    assert 1 + r * (1 - p) / p == pytest.approx(1 + 4 * 0.7 / 0.3, rel=0.05) and naive < 9
    for odd in ([5.0, 0, 0], [0, 5.0, 0], [1.0, 0, 0]):
        assert all(np.isfinite(special.fit_censored(odd, [0, 0, 0.0])))


def test_hazards():
    d = np.arange(1, 30)
    mass, hazard = np.exp(special.nb_log_pmf(d, 2.5, 0.4)), np.exp(special.nb_log_hazard(d, 2.5, 0.4))
    left = 1 - np.concatenate([[0], np.cumsum(mass)[:-1]])
    np.testing.assert_allclose(hazard, mass / left, rtol=1e-6)
    assert special.nb_log_hazard(5000.0, 1.0, 0.999) == -np.inf


def test_refit_of_cells(spark):
    rows = []
    for recipe, (r, p) in enumerate([(3.0, 0.4), (8.0, 0.5)]):
        closed, open_ = sample(recipe, r=r, p=p)
        rows += [(recipe, 1, d + 1, False) for d, n in enumerate(closed) for _ in range(int(n))] + [(recipe, 1, d + 1, True) for d, n in enumerate(open_) for _ in range(int(n))]
    rows += [(0, 2, 4, True)]
    found = {(x["recipe"], x["state"]): x for x in durations.refit(spark.createDataFrame(rows, "recipe int, state int, duration int, is_last boolean"), 40).collect()}
    assert set(found) == {(0, 1), (1, 1)}
    for recipe, (r, p) in enumerate([(3.0, 0.4), (8.0, 0.5)]):
        closed, open_ = sample(recipe, r=r, p=p)
        open_[-1] += closed[-1]
        closed[-1] = 0
        fitted = special.fit_censored(closed, open_)
        x = found[recipe, 1]
        assert (x["r"], x["p"], x["log_likelihood"]) == pytest.approx(fitted) and (x["n_closed"], x["n_open"]) == (closed.sum(), open_.sum())
        assert len(x["hazard"]) == 40 and x["hazard"][0] == pytest.approx(fitted[1] ** fitted[0])
