"""Tail probabilities and correlation helpers that Spark SQL lacks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_sf_value(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees of freedom > x), by the recurrence over df."""
    if x is None or math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        q, term, k = math.exp(-x / 2), math.exp(-x / 2), 2
        while k < df:
            term *= x / k
            q += term
            k += 2
        return min(1.0, q)
    q = math.erfc(math.sqrt(x / 2))
    term, k = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 1
    while k < df:
        q += term
        k += 2
        term *= x / k
    return min(1.0, q)


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def f_sf_value(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_two_sided_value(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def chi2_sf(x: Column, df: int) -> Column:
    """Closed forms stay in Spark SQL for even ``df``; odd ones take an Arrow UDF."""
    if df % 2 == 0:
        half, term, total = x / 2, F.lit(1.0), F.lit(1.0)
        for k in range(1, df // 2):
            term = term * half / k
            total = total + term
        return F.when(x <= 0, F.lit(1.0)).otherwise(F.exp(-half) * total)

    @F.pandas_udf("double")
    def tail(s: pd.Series) -> pd.Series:
        return s.map(lambda v: chi2_sf_value(v, df))

    return tail(x.cast("double"))


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([f_sf_value(x, y, z) for x, y, z in zip(a, b, c, strict=True)])

    return tail(f.cast("double"), d1.cast("double"), d2.cast("double"))


def t_two_sided(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided_value(x, y) for x, y in zip(a, b, strict=True)])

    return tail(t.cast("double"), df.cast("double"))


def safe_div(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, or the default where b is 0 or null."""
    got = F.try_divide(a.cast("double"), b.cast("double"))
    return got if default is None else F.coalesce(got, F.lit(default))
