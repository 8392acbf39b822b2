"""Special functions on arrays: log gamma, digamma, trigamma, incomplete beta; tables of shifted negative binomials."""

from __future__ import annotations

import numpy as np


def lgamma(x):
    """Log gamma of positive numbers, by shifting to at least 8 and Stirling's series."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift = np.where(small, shift + np.log(np.where(small, y, 1.0)), shift)
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y - shift


def digamma(x):
    x = np.asarray(x, float)
    total, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        small = y < 8
        total = np.where(small, total - 1 / np.where(small, y, 1.0), total)
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    return total + np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))


def trigamma(x):
    x = np.asarray(x, float)
    total, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        small = y < 8
        total = np.where(small, total + 1 / np.where(small, y * y, 1.0), total)
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    return total + 1 / y + z / 2 + z / y * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z / 30)))


def nb_log_pmf(d, r, p):
    """Log probability of duration d = 1, 2, ...: d - 1 failures before r successes of probability p."""
    d, r, p = np.broadcast_arrays(np.asarray(d, float), np.asarray(r, float), np.asarray(p, float))
    k = d - 1
    return lgamma(k + r) - lgamma(r) - lgamma(k + 1) + r * np.log(p) + np.where(k > 0, k * np.log1p(-p), 0.0)


def betainc(a, b, x, steps: int = 300):
    """The regularised incomplete beta function by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, steps):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * d * c
    out = np.where(y <= 0, 0.0, front * f)
    return np.where(flip, 1 - out, out)


def nb_log_cdf(d, r, p):
    with np.errstate(divide="ignore"):
        return np.log(betainc(r, np.maximum(np.asarray(d, float), 1e-300), p))


def nb_log_survival(d, r, p):
    """Log probability of durations of at least d, straight from the upper tail."""
    d, r, p = np.broadcast_arrays(np.asarray(d, float), np.asarray(r, float), np.asarray(p, float))
    with np.errstate(divide="ignore"):
        return np.where(d <= 1, 0.0, np.log(betainc(np.maximum(d - 1, 1e-9), r, 1 - p)))


def duration_tables(r, p, d_max: int):
    """(K, d_max) log probabilities and log survivals; the last column of the former takes the whole rest."""
    r, p = np.maximum(np.asarray(r, float), 1e-8)[:, None], np.clip(np.asarray(p, float), 1e-8, 1 - 1e-8)[:, None]
    d = np.arange(1, d_max + 1)[None, :]
    pmf, survival = nb_log_pmf(d, r, p), nb_log_survival(d, r, p)
    pmf[:, -1] = survival[:, -1]
    return pmf, survival


def fit_nb(hist, r_old=5.0, r_max: float = 1e4, steps: int = 5):
    """(r, p) of a histogram over durations 1..D: moments, then Newton steps; an empty histogram keeps r."""
    hist = np.asarray(hist, float)
    k = np.arange(len(hist))
    n, s = hist.sum(), (hist * k).sum()
    if n <= 1e-8:
        return float(r_old), float(np.clip(r_old * n / (r_old * n + s + 1e-8), 1e-8, 1 - 1e-8)) if n else 0.5
    mean = s / n
    var = (hist * k * k).sum() / n - mean * mean
    r = min(mean * mean / (var - mean), r_max) if var > mean > 0 else 5.0
    for _ in range(steps):
        slope = (hist * (digamma(k + r) - digamma(r))).sum() + n * np.log(r / (r + mean))
        curve = (hist * (trigamma(k + r) - trigamma(r))).sum() + n * (1 / r - 1 / (r + mean))
        if not np.isfinite(curve) or abs(curve) < 1e-12:
            break
        new = r - slope / curve
        r = float(np.clip(new if new > 0 else r / 2, 1e-3, r_max))
    return r, float(np.clip(r * n / (r * n + s + 1e-8), 1e-8, 1 - 1e-8))


def nb_log_hazard(d, r, p):
    """Log probability of a duration of d among those of d or more; minus infinity where the tail has vanished."""
    survival = nb_log_survival(d, r, p)
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(survival), nb_log_pmf(d, r, p) - survival, -np.inf)


#: Bounds of log r and of the log odds of p in the fit below.
BOUNDS = np.array([[np.log(1e-3), np.log(1e4)], [-12.0, 12.0]])


def censored_gradient(at: np.ndarray, closed: np.ndarray, open_: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean log likelihood of durations 1..D, closed ones by mass and open ones by survival, and its slope in (log r, log
    odds of p). The slope of a survival is that of the mass below it."""
    r, p = np.exp(at[0]), 1 / (1 + np.exp(-at[1]))
    d = np.arange(1, len(closed) + 1)
    mass, survival = nb_log_pmf(d, r, p), nb_log_survival(d, r, p)
    slopes = np.stack([r * (digamma(d - 1 + r) - digamma(r) + np.log(p)), (1 - p) * r - p * (d - 1)])
    below = np.cumsum(np.exp(mass) * slopes, axis=1) - np.exp(mass) * slopes
    total = closed.sum() + open_.sum()
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        of_open = np.where(open_ > 0, -below / np.exp(survival), 0.0)
        value = np.where(closed > 0, closed * mass, 0.0).sum() + np.where(open_ > 0, open_ * survival, 0.0).sum()
    return value / total, (slopes @ closed + of_open @ open_) / total


def fit_censored(closed, open_, steps: int = 100) -> tuple[float, float, float]:
    """(r, p, mean log likelihood) that are likeliest for closed and open durations, by Newton steps that never lose.

    A step goes along the gradient where the likelihood isn't concave, is halved until it gains, and stays within `BOUNDS`,
    where fits of durations without spread end. Without any closed duration only the bounds hold the fit.
    """
    closed, open_ = np.asarray(closed, float), np.asarray(open_, float)
    r, p = fit_nb(closed + open_)
    at = np.clip([np.log(r), np.log(p) - np.log1p(-p)], *BOUNDS.T)
    value, slope = censored_gradient(at, closed, open_)
    for _ in range(steps):
        free = ~((at <= BOUNDS[:, 0]) & (slope < 0) | (at >= BOUNDS[:, 1]) & (slope > 0))
        if not free.any() or np.abs(slope[free]).max() < 1e-9:
            break
        h = 1e-5
        bend = np.stack([(censored_gradient(at + h * e, closed, open_)[1] - censored_gradient(at - h * e, closed, open_)[1]) / (2 * h) for e in np.eye(2)])
        bend = ((bend + bend.T) / 2)[np.ix_(free, free)]
        step = np.zeros(2)
        step[free] = np.linalg.solve(-bend, slope[free]) if np.linalg.eigvalsh(bend).max() < -1e-12 else slope[free]
        step *= min(1.0, 3.0 / np.abs(step).max())
        for _ in range(40):
            new = np.clip(at + step, *BOUNDS.T)
            gain, after = censored_gradient(new, closed, open_)
            if gain > value or gain == value and np.abs(after).max() < np.abs(slope).max():
                break
            step /= 2
        else:
            break
        at, value, slope = new, gain, after
    return float(np.exp(at[0])), float(1 / (1 + np.exp(-at[1]))), float(value)
