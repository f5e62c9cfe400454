"""Distribution functions Spark SQL lacks, as Arrow-batched expressions.

They are applied to parameter tables (one row per series and phase), never to
charted rows, and work on all rows of a batch together.  Distribution functions are
iterated until the last bits of a double, however many steps that takes; quantiles are
good to a relative 1e-12.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL = NormalDist()

# Ship these functions with the tasks, so that workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Corrections of Stirling's formula are used from here on (a fixed value, as are their coefficients below).
LARGE = 20.0
TINY = 1e-300


def _correction(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) less (x - 1/2) ln x - x + ln(2 pi) / 2, for large x."""
    r = 1.0 / (x * x)
    return (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / x


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x.ravel()]).reshape(x.shape)


def _gamma_ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln gamma(a + b) - ln gamma(b) without cancellation for large b."""
    big = np.maximum(b, LARGE)
    close = (big - 0.5) * np.log1p(a / big) + a * np.log(a + big) - a + _correction(a + big) - _correction(big)
    small = np.minimum(b, LARGE)
    return np.where(b >= LARGE, close, _log_gamma(a + small) - _log_gamma(small))


def _until_settled(step, size: int) -> None:
    """Run ``step(i, rows still moving)``, which says which of them moved, until none does."""
    active, i = np.arange(size), 0
    while len(active):
        i += 1
        active = active[step(i, active)]


def lower_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized lower incomplete gamma: series below a + 1, continued fraction above."""
    a, x = (v.astype(float) for v in np.broadcast_arrays(a, x))
    out = np.zeros(a.shape)
    some = x > 0
    a, x = a[some], x[some]
    big = np.maximum(a, LARGE)
    d = x / big - 1.0
    near = -big * (d - np.log1p(d)) + 0.5 * np.log(big / (2 * math.pi)) - _correction(big)
    far = a * np.log(x) - x - _log_gamma(np.minimum(a, LARGE))
    scale = np.exp(np.where(a >= LARGE, near, far))
    low = x < a + 1
    p, (b, y) = np.empty(len(a)), (a[low], x[low])
    term = 1.0 / b
    total = term.copy()

    def add(i: int, k: np.ndarray) -> np.ndarray:
        term[k] *= y[k] / (b[k] + i)
        total[k] += term[k]
        return term[k] > total[k] * 1e-17

    _until_settled(add, len(b))
    p[low] = total * scale[low]
    b, y = a[~low], x[~low]
    bottom = y + 1 - b
    c, e = np.full(len(b), 1 / TINY), 1 / bottom
    h = e.copy()

    def divide(i: int, k: np.ndarray) -> np.ndarray:
        step = -i * (i - b[k])
        bottom[k] += 2
        e[k] = 1 / _away(step * e[k] + bottom[k])
        c[k] = _away(bottom[k] + step / c[k])
        change = e[k] * c[k]
        h[k] *= change
        return np.abs(change - 1) > 4e-16

    _until_settled(divide, len(b))
    p[~low] = 1.0 - scale[~low] * h
    out[some] = p
    return out


def _away(v: np.ndarray) -> np.ndarray:
    """``v``, but never so near zero that its inverse overflows."""
    return np.where(np.abs(v) > TINY, v, TINY)


def log_of(x: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """ln x from the smaller of x and 1 - x, which has more digits."""
    return np.where(rest < 0.5, np.log1p(-np.minimum(rest, 0.5)), np.log(x))


def lower_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta; ``rest`` is 1 - x.

    By a series of positive terms where x is small, as it is for large b, else by the
    continued fraction from the nearer end.
    """
    a, b, x, rest = (v.astype(float) for v in np.broadcast_arrays(a, b, x, rest))
    series = (x < 0.3) & ((a + b) * x < 1000)
    turned = ~series & (x > (a + 1) / (a + b + 2))
    p, q, y, z = (np.where(turned, u, v) for u, v in ((b, a), (a, b), (rest, x), (x, rest)))
    inside = (y > 0) & (z > 0)
    out = np.where(z <= 0, 1.0, 0.0)
    p, q, y, z = p[inside], q[inside], y[inside], z[inside]
    least, most = np.minimum(p, q), np.maximum(p, q)
    front = np.exp(_gamma_ratio(least, most) - _log_gamma(least) + p * log_of(y, z) + q * log_of(z, y)) / p
    c, d = np.ones(len(p)), 1 / _away(1 - (p + q) * y / (p + 1))
    h = d.copy()

    def divide(m: int, k: np.ndarray) -> np.ndarray:
        u, v, w = p[k], q[k], y[k]
        change = 1.0
        for step in (m * (v - m) * w / ((u + 2 * m - 1) * (u + 2 * m)), -(u + m) * (u + v + m) * w / ((u + 2 * m) * (u + 2 * m + 1))):
            d[k] = 1 / _away(1 + step * d[k])
            c[k] = _away(1 + step / c[k])
            change = d[k] * c[k]
            h[k] *= change
        return np.abs(change - 1) > 4e-16

    series = series[inside]
    term = np.ones(int(series.sum()))
    total = term.copy()
    u, v, w = p[series], q[series], y[series]

    def add(n: int, k: np.ndarray) -> np.ndarray:
        term[k] *= (u[k] + v[k] + n - 1) / (u[k] + n) * w[k]
        total[k] += term[k]
        return term[k] > total[k] * 1e-17

    _until_settled(add, len(u))
    fraction = np.flatnonzero(~series)
    p, q, y, c, d, h = (column[fraction] for column in (p, q, y, c, d, h))
    _until_settled(divide, len(fraction))
    made = np.empty(len(series))
    made[series], made[fraction] = total, h
    out[inside] = front * made
    return np.where(turned, 1.0 - out, out)


def inverted(cdf: Callable[[np.ndarray], np.ndarray], p: float, size: int) -> np.ndarray:
    """Where each of ``size`` increasing functions reaches ``p``, to the last bits of a double: all are halved together."""
    low, high = np.zeros(size), np.ones(size)
    while (short := cdf(high) < p).any():
        low, high = np.where(short, high, low), np.where(short, 2 * high, high)
    while True:
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high) | (high - low <= 1e-15 * high)).all():
            return middle
        below = cdf(middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)


def chi2_quantiles(p: float, df: np.ndarray) -> np.ndarray:
    df = np.asarray(df, float)
    if p <= 0 or p >= 1:
        return np.full(df.shape, 0.0 if p <= 0 else math.inf)
    return 2.0 * inverted(lambda x: lower_gamma(df / 2.0, x), p, len(df))


def f_quantiles(p: float, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Through the beta distribution: F = d2 y / (d1 (1 - y))."""
    d1, d2 = np.asarray(d1, float), np.asarray(d2, float)
    if p <= 0 or p >= 1:
        return np.full(d1.shape, 0.0 if p <= 0 else math.inf)
    return inverted(lambda f: lower_beta(d1 / 2.0, d2 / 2.0, d1 * f / (d1 * f + d2), d2 / (d1 * f + d2)), p, len(d1))


def chi2_quantile(p: float, df: float) -> float:
    return float(chi2_quantiles(p, np.array([df]))[0])


def f_quantile(p: float, d1: float, d2: float) -> float:
    return float(f_quantiles(p, np.array([d1]), np.array([d2]))[0])


def normal_two_sided(z: Column) -> Column:
    @F.pandas_udf("double")
    def p_value(z: pd.Series) -> pd.Series:
        return z.map(
            lambda v: None if pd.isna(v) else min(1.0, max(0.0, 2 * (1 - NORMAL.cdf(abs(v)))))
        ).astype("float64")

    return p_value(z)


def chi2_quantile_of(p: float, df: Column) -> Column:
    @F.pandas_udf("double")
    def quantile(df: pd.Series) -> pd.Series:
        out, known = pd.Series(np.nan, df.index), df.notna()
        out[known] = chi2_quantiles(p, df[known].to_numpy(float))
        return out

    return F.nanvl(quantile(df), F.lit(None).cast("double"))


def f_quantile_of(p: float, d1: Column, d2: Column) -> Column:
    @F.pandas_udf("double")
    def quantile(d1: pd.Series, d2: pd.Series) -> pd.Series:
        out, known = pd.Series(np.nan, d2.index), d2.notna() & (d2 > 0)
        out[known] = f_quantiles(p, d1[known].to_numpy(float), d2[known].to_numpy(float))
        return out

    return F.nanvl(quantile(d1, d2), F.lit(None).cast("double"))
