"""Tail probabilities as column expressions; vectorised UDFs only where Spark has no function for them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def binomial_tail(count: str, n: str, p: float) -> Column:
    """P(X >= count) for X ~ Binomial(n, p); names of integer columns. The first term by logarithms, the rest by ratios."""
    first = (
        f"exp(aggregate(sequence(1, greatest({count}, 1)), 0D, (a, i) -> a + ln(({n} - {count} + i) / i))"
        f" + {count} * ln({p}D) + ({n} - {count}) * ln({1 - p}D))"
    )
    tail = (
        f"aggregate(sequence({count}, {n}), struct({first} as t, 0D as s),"
        f" (a, k) -> struct(a.t * ({n} - k) / (k + 1) * {p / (1 - p)}D as t, a.s + a.t as s), a -> a.s)"
    )
    return F.expr(f"case when {count} <= 0 then 1D else least(1D, {tail}) end")


def chi2_sf(x: np.ndarray, df: int) -> np.ndarray:
    """Survival function by the closed forms of integer degrees of freedom."""
    x = np.maximum(np.asarray(x, float), 0)
    if df % 2 == 0:
        term, total = np.ones_like(x), np.ones_like(x)
        for k in range(1, df // 2):
            term = term * (x / 2) / k
            total += term
        return np.exp(-x / 2) * total
    total = np.array([math.erfc(math.sqrt(v / 2)) for v in x.ravel()]).reshape(x.shape)
    term = np.exp(-x / 2) * np.sqrt(2 * x / math.pi)
    for k in range(1, (df + 1) // 2):
        total = total + term
        term = term * x / (2 * k + 1)
    return total


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    turn = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turn, b, a), np.where(turn, a, b), np.clip(np.where(turn, 1 - x, x), 0, 1)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner)) / a
    tiny, c = 1e-300, np.ones_like(x)
    d = 1 / (1 - (a + b) * x / (a + 1))
    value = d.copy()
    for m in range(1, 400):
        for even in (True, False):
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if even else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / np.where(np.abs(d) > tiny, d, tiny), np.where(np.abs(c) > tiny, c, tiny)
            value *= d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    got = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * value))
    return np.where(turn, 1 - got, got)


def gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function: by its series below a + 1, by its continued fraction above."""
    a, x = (np.array(v, float) for v in np.broadcast_arrays(a, x))
    low, inner = x < a + 1, np.maximum(x, 1e-300)
    scale = np.exp(a * np.log(inner) - inner - _lgamma(a))
    y = np.where(low, inner, 1.0)
    term = total = 1 / a
    for k in range(1, 2000):
        term = term * y / (a + k)
        total = total + term
        if (term <= 1e-17 * total).all():
            break
    z = np.where(low, a + 2, inner)
    step, c, d = z + 1 - a, np.full_like(a, 1e300), 1 / (z + 1 - a)
    value = d.copy()
    for i in range(1, 2000):
        num = -i * (i - a)
        step = step + 2
        d = 1 / (num * d + step)
        c = step + num / c
        value = value * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return np.where(x <= 0, 1.0, np.where(low, 1 - scale * total, scale * value))


@F.pandas_udf(T.DoubleType())
def chi2_sf_9(x: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(x.to_numpy(float), 9))


def chi2_sf_8(x: Column) -> Column:
    """Eight degrees of freedom, as a column expression."""
    half = x / 2
    return F.exp(-half) * (1 + half + half * half / 2 + half * half * half / 6)


@F.pandas_udf(T.DoubleType())
def test_p_value(kind: pd.Series, value: pd.Series, df: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Of a t (two-sided), F or chi-square statistic; null where it can't be had."""
    name, v = kind.fillna("").str.lower().to_numpy(), value.to_numpy(float)
    d, d1, d2 = (x.to_numpy(float) for x in (df, df1, df2))
    out = np.full(len(v), np.nan)
    t = (name == "t") & (d > 0) & ~np.isnan(v)
    out[t] = beta_inc(d[t] / 2, 0.5, d[t] / (d[t] + v[t] * v[t]))
    f = (name == "f") & (d1 > 0) & (d2 > 0) & (v >= 0)
    out[f] = beta_inc(d2[f] / 2, d1[f] / 2, d2[f] / (d2[f] + d1[f] * v[f]))
    chi = np.isin(name, ("chi2", "chi-square", "chi_square")) & (d > 0) & (v >= 0)
    out[chi] = gamma_q(d[chi] / 2, v[chi] / 2)
    return pd.Series(out).astype("Float64").mask(np.isnan(out))
