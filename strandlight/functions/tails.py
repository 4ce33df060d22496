"""Tail probabilities as Arrow UDFs for small tables of aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_cf(a, b, x) / a
    return 1.0 - front * _beta_cf(b, a, 1.0 - x) / b


def gamma_q(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    tiny = 1e-300
    b = x + 1.0 - s
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - s)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def pearson_p_value(r: float, n: float) -> float:
    """Two-sided p of a correlation through Student's t with n - 2 degrees of freedom."""
    if not (math.isfinite(r) and n > 2):
        return 1.0 if n == 2 and math.isfinite(r) else math.nan
    r2 = min(r * r, 1.0)
    return beta_inc((n - 2) / 2.0, 0.5, 1.0 - r2)


def signed_rank_exact(w: float, n: int) -> float:
    """Two-sided exact p of a signed-rank statistic: counts of subset sums of 1..n."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for k in range(1, n + 1):
        counts[k:] += counts[:-k].copy()
    return float(min(1.0, 2.0 * counts[: int(w) + 1].sum() / counts.sum()))


def rank_sum_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of U: number of ways to reach each U for the two sample sizes.

    The counts are the coefficients of the Gaussian binomial, built by one multiplication and one
    division by (1 - x^k) per step on a single array of n1 n2 + 1 numbers.
    """
    size = n1 * n2 + 1
    c = np.zeros(size)
    c[0] = 1.0
    for i in range(1, min(n1, n2) + 1):
        k = max(n1, n2) + i
        if k < size:
            c[k:] -= c[:-k].copy()
        for r in range(i):  # cumulative sums in steps of i
            c[r::i] = np.cumsum(c[r::i])
    return float(min(1.0, 2.0 * c[int(max(u, n1 * n2 - u)) :].sum() / c.sum()))


@F.pandas_udf(T.DoubleType())
def norm_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if v is not None and math.isfinite(v) else math.nan)


@F.pandas_udf(T.DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """T2."""
    return pd.Series([pearson_p_value(float("nan") if a is None else float(a), float(b)) for a, b in zip(r, n)])


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail."""
    return pd.Series([gamma_q(k / 2.0, v / 2.0) if k > 0 and math.isfinite(v) else math.nan for v, k in zip(x, df)])


@F.pandas_udf(T.DoubleType())
def signed_rank_p(stat: pd.Series, n: pd.Series, tie: pd.Series, zeros: pd.Series, method: pd.Series) -> pd.Series:
    """Signed-rank p: ``exact``, ``normal`` (tie-corrected) or ``auto`` (exact for n <= 50 without ties or zeros)."""
    out = []
    for w, k, t, z0, how in zip(stat, n, tie, zeros, method):
        plain = t == 0 and z0 == 0
        if k == 0:
            out.append(1.0)
        elif how == "exact" and not plain:
            out.append(math.nan)
        elif plain and (how == "exact" or how == "auto" and k <= 50):
            out.append(signed_rank_exact(w, int(k)))
        else:
            sd = math.sqrt(k * (k + 1) * (2 * k + 1) / 24.0 - t / 48.0)
            out.append(math.erfc(abs(w - k * (k + 1) / 4.0) / sd / math.sqrt(2.0)) if sd > 0 else math.nan)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def rank_sum_p(u1: pd.Series, n1: pd.Series, n2: pd.Series, tie: pd.Series, method: pd.Series) -> pd.Series:
    """Mann-Whitney p: ``exact``, ``normal`` (with continuity correction) or ``auto`` (exact for a tie-free
    sample of at most 8 on one side)."""
    out = []
    for u, a, b, t, how in zip(u1, n1, n2, tie, method):
        n = a + b
        if a == 0 or b == 0:
            out.append(math.nan)
        elif how == "exact" and t != 0:
            out.append(math.nan)
        elif t == 0 and (how == "exact" or how == "auto" and min(a, b) <= 8):
            out.append(rank_sum_exact(u, int(a), int(b)))
        else:
            sd = math.sqrt(a * b / 12.0 * ((n + 1) - t / (n * (n - 1.0))))
            z = (max(u, a * b - u) - a * b / 2.0 - 0.5) / sd if sd > 0 else math.nan
            out.append(min(1.0, math.erfc(z / math.sqrt(2.0))) if math.isfinite(z) else math.nan)
    return pd.Series(out, dtype="float64")
