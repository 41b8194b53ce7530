"""Student t probabilities and quantiles, vectorised in NumPy."""

from __future__ import annotations

import math

import numpy as np

_ERFC = np.vectorize(math.erfc, otypes=[float])
_LGAMMA = np.vectorize(math.lgamma, otypes=[float])
# Above this the normal expansion of Hill (CACM algorithm 395) is exact to
# double precision.
_LARGE_DF = 2000


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    value = d.copy()
    for m in range(1, 1000):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            value = value * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-14):
            break
    return value


def _beta_regularised(a, b, x):
    x = np.clip(x, 0.0, 1.0)
    inner = (x > 0.0) & (x < 1.0)
    xs = np.where(inner, x, 0.5)
    front = np.exp(
        _LGAMMA(a + b) - _LGAMMA(a) - _LGAMMA(b) + a * np.log(xs) + b * np.log1p(-xs)
    )
    direct = xs < (a + 1.0) / (a + b + 2.0)
    pa, pb = np.where(direct, a, b), np.where(direct, b, a)
    part = front * _beta_fraction(pa, pb, np.where(direct, xs, 1.0 - xs)) / pa
    return np.where(inner, np.where(direct, part, 1.0 - part), x)


def two_sided_p(t, df):
    """P(|T| > |t|) for T with ``df`` degrees of freedom."""
    t = np.abs(np.atleast_1d(np.asarray(t, dtype=float)))
    df = np.broadcast_to(np.asarray(df, dtype=float), t.shape)
    out = np.full(t.shape, np.nan)
    valid = np.isfinite(t) & (df > 0)
    out[np.isinf(t)] = 0.0
    small = valid & (df <= _LARGE_DF)
    if small.any():
        ts, n = t[small], df[small]
        out[small] = _beta_regularised(n / 2.0, np.full_like(n, 0.5), n / (n + ts * ts))
    large = valid & (df > _LARGE_DF)
    if large.any():
        ts, n = t[large], df[large]
        b = 48 * (n - 0.5) ** 2
        y = (n - 0.5) * np.log1p(ts * ts / n)
        inner = ((-0.4 * y - 3.3) * y - 24.0) * y - 85.5
        z = ((inner / (0.8 * y * y + 100.0 + b) + y + 3.0) / b + 1.0) * np.sqrt(y)
        out[large] = _ERFC(z / math.sqrt(2.0))
    return np.minimum(out, 1.0)


def quantile(prob: float, df):
    """t with P(T <= t) = prob, for prob > 1/2.

    Newton steps from the left: the tail is convex there, so the steps never
    overshoot.
    """
    df = np.atleast_1d(np.asarray(df, dtype=float))
    tail = 2.0 * (1.0 - prob)
    log_scale = (
        _LGAMMA((df + 1) / 2) - _LGAMMA(df / 2) - 0.5 * np.log(df * math.pi)
    )
    t = np.ones_like(df)
    for _ in range(60):
        density = np.exp(log_scale - (df + 1) / 2 * np.log1p(t * t / df))
        step = (two_sided_p(t, df) - tail) / (2.0 * density)
        t = t + step
        if np.all(np.abs(step) <= 1e-12 * np.abs(t)):
            break
    return t
