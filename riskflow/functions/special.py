"""Tail probabilities from the standard library, and Arrow-batched columns of them."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(min(max(p, 1e-12), 1 - 1e-12))


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(2000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1 + num / c
        c = c if abs(c) > 1e-300 else 1e-300
        f *= c * d
        if i and abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def f_sf(x: float, d1: float, d2: float) -> float:
    if math.isinf(x):
        return 0.0
    return 1.0 if x <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def kolmogorov_sf(x: float) -> float:
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101))))


def binomial_two_sided(k: int, n: int) -> float:
    low = min(k, n - k)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2 ** n)


@F.pandas_udf(DoubleType())
def chi2_sf_col(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else chi2_sf(a, b) for a, b in zip(x, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_ppf_col(p: pd.Series) -> pd.Series:
    return p.map(lambda v: None if pd.isna(v) else normal_ppf(v)).astype("float64")
