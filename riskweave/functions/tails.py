"""Tail probabilities of the reference distributions, for summary tables.

Spark has no error, incomplete gamma or incomplete beta function. These Arrow-batched helpers are
applied to result tables with one row per variable or per model pair, and ``normal_cdf`` to the
distinct values of a histogram; never to data rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: power series below a + 1, continued fraction above."""
    if not (x > 0):
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - front * total
    value = 0.0
    for k in range(int(12 * math.sqrt(a)) + 300, 0, -1):
        value = k * (a - k) / (x + 2 * k + 1 - a + value)
    return front / (x + 1 - a + value)


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its even/odd continued fraction, evaluated backwards."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_i(b, a, 1 - x)
    value = 0.0
    for m in range(int(12 * math.sqrt(max(a, b))) + 200, 0, -1):
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = even / (1 + odd / (1 + value))
    first = -(a + b) * x / (a + 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    return front / (a * (1 + first / (1 + value)))


def _t_p(t: float, df: float) -> float:
    if df > 1e7:  # the normal tail with its first-order correction is exact to 1e-14 here
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        return math.erfc(abs(t) / math.sqrt(2)) + density * (abs(t) ** 3 + abs(t)) / (2 * df)
    return _beta_i(df / 2, 0.5, df / (df + t * t))


def _binomial_p(k: float, n: float) -> float:
    low = int(min(k, n - k))
    return min(1.0, 2 * sum(math.comb(int(n), i) for i in range(low + 1)) * 0.5 ** n)


def _both(f, x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([f(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(x, y)],
                     dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| > |z|) for a standard normal."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore").astype("float64")


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(chi-squared with df degrees of freedom > x)."""
    return _both(lambda v, k: _gamma_q(k / 2, v / 2) if k > 0 else 1.0, x, df)


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| > |t|) for Student's t."""
    return _both(_t_p, t, df)


@F.pandas_udf(T.DoubleType())
def binomial_half_two_sided(k: pd.Series, n: pd.Series) -> pd.Series:
    """Exact two-sided p of k successes out of n fair trials."""
    return _both(_binomial_p, k, n)


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """P(Z <= z) for a standard normal."""
    return z.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), na_action="ignore").astype("float64")


def kolmogorov_sf(d: Column, n: Column, terms: int = 100) -> Column:
    """P(D > d) for the distance D between a continuous law and the n draws' own step function.

    The limiting law at a point moved by its corrections of order 1 / sqrt(n) and 1 / n.
    """
    root = F.sqrt(n)
    t = root * d + 1 / (6 * root) + (root * d - 1) / (4 * n)
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * t * t))
    # below this point the law is 1e-19 and the series alternates without converging
    return F.when(t < 0.16, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))
