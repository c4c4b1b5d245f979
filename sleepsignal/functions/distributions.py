"""Normal and Student t probabilities and the Shapiro-Wilk test, on result-sized columns.

All are pandas UDFs over tables with one row per feature or value; the heavy sums
are done by Spark aggregates before.
"""

from __future__ import annotations

import math
from functools import cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

_N = NormalDist()

#: Up to this size of the smaller sample U is counted in closed form, whatever the size of the other.
CLOSED_MAX = 8
#: Largest product of the sample sizes beyond ``CLOSED_MAX``: that many counts are held as whole numbers.
EXACT_CELLS = 100_000


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
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
            return front * h
    raise ArithmeticError(f"the continued fraction did not settle for a={a}, b={b}, x={x}")


def t_two_sided(t: float, df: float) -> float:
    """Two-sided tail of Student's t; from 1000 degrees of freedom on by Hill's normalising expansion (1970)."""
    if df < 1000:
        return beta_inc(df / 2.0, 0.5, df / (df + t * t))
    a = df - 0.5
    b = 48.0 * a * a
    y = a * math.log1p(t * t / df)
    z = math.sqrt(y) * (1.0 + ((((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b) + y + 3.0) / b)
    return min(1.0, 2.0 * norm_sf(z))


@cache
def _change_counts(n: int) -> tuple[int, list[int]]:
    """Period L and the coefficients of ``(1 - q^L)^(n+1) / ((1 - q) (1 - q) (1 - q^2) ... (1 - q^n))``."""
    period = math.lcm(*range(1, n + 1))
    parts = [1, *range(1, n + 1)]
    out = np.zeros(sum(period - j for j in parts) + 1, object)
    out[0] = 1
    for j in parts:  # times (1 - q^L) / (1 - q^j) = 1 + q^j + ... + q^(L-j)
        out[period:] -= out[:-period].copy()
        for r in range(j):
            out[r::j] = np.cumsum(out[r::j])
    return period, out.tolist()


def _small_u(s: int, n: int, m: int) -> int:
    """Ways in which U of ``n`` among ``n + m`` untied values is at most ``s``.

    The cumulated Gaussian binomial is a product of n factors ``1 - q^(m+j)`` over fixed ones: 2^n shifted terms, each
    a sum of n + 1 binomials, so neither time nor memory depends on m.
    """
    period, counts = _change_counts(n)

    def at_most(x: int) -> int:
        places = range(x % period, min(x + 1, len(counts)), period) if x >= 0 else ()
        return sum(counts[i] * math.comb((x - i) // period + n, n) for i in places)

    terms = {0: 1}
    for j in range(1, n + 1):
        for shift, sign in list(terms.items()):
            terms[shift + m + j] = terms.get(shift + m + j, 0) - sign
    return sum(sign * at_most(s - shift) for shift, sign in terms.items())


def _small_u_by_table(s: int, n: int, m: int) -> int:
    """As ``_small_u`` from all n * m + 1 counts."""
    if n * m > EXACT_CELLS:
        raise ValueError(f"the exact test of {n} against {m} values needs more than {EXACT_CELLS} counts; use the asymptotic one")
    counts = np.zeros(n * m + 1, object)
    counts[0] = 1
    for j in range(1, n + 1):  # times (1 - q^(m+j)) / (1 - q^j), the Gaussian binomial step
        if m + j < len(counts):
            counts[m + j :] -= counts[: len(counts) - m - j].copy()
        for r in range(min(j, len(counts))):
            counts[r::j] = np.cumsum(counts[r::j])
    return int(counts[: s + 1].sum())


def exact_u_two_sided(u: float, n: int, m: int) -> float:
    """Two-sided exact p of the Mann-Whitney U without ties, from whole numbers.

    Any size of the larger sample if the smaller has at most ``CLOSED_MAX`` values; else n * m up to ``EXACT_CELLS``.
    """
    n, m = min(n, m), max(n, m)
    s = n * m - math.ceil(max(u, n * m - u))
    ways = (_small_u if n <= CLOSED_MAX else _small_u_by_table)(s, n, m)
    return min(1.0, 2 * ways / math.comb(n + m, n))


def _each(fn, *cols: pd.Series) -> pd.Series:
    ok = ~pd.concat(cols, axis=1).isna().any(axis=1)
    out = pd.Series([None] * len(cols[0]), index=cols[0].index, dtype="float64")
    out[ok] = [fn(*row) for row in zip(*(c[ok] for c in cols))]
    return out


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return _each(lambda v: min(1.0, 2.0 * norm_sf(abs(v))), z)


@F.pandas_udf(DoubleType())
def normal_ppf(p: pd.Series) -> pd.Series:
    return _each(_N.inv_cdf, p)


@F.pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def exact_u(u: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return _each(lambda a, b, c: exact_u_two_sided(a, int(b), int(c)), u, n, m)


def royston(n: int, ssq: float, m_last: float, m_second: float, ends: tuple[float, float, float, float], inner: float, ss: float) -> tuple[float, float]:
    """W and p after Royston (1995) from sums over the ordered values.

    ``ssq`` is the sum of squared normal scores, ``m_last`` and ``m_second`` the two largest scores, ``ends`` the
    first, second, second last and last value, ``inner`` the sum of score times value between them, ``ss`` the
    sum of squared deviations. The polynomials for p were fitted for up to 5000 values.
    """
    first, second, before_last, last = ends
    if n < 3:
        return math.nan, math.nan
    if last - first < 1e-19:
        return 1.0, 1.0
    rsn = 1.0 / math.sqrt(n)
    if n == 3:
        w = (math.sqrt(0.5) * (last - first)) ** 2 / ss
        return min(1.0, w), max(0.0, 6.0 / math.pi * (math.asin(math.sqrt(min(1.0, w))) - math.asin(math.sqrt(0.75))))
    # Royston's polynomial coefficients for the outer weights.
    a_n = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], rsn) + m_last / math.sqrt(ssq)
    a_n1 = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], rsn) + m_second / math.sqrt(ssq)
    if n > 5:
        phi = (ssq - 2 * m_last**2 - 2 * m_second**2) / (1 - 2 * a_n**2 - 2 * a_n1**2)
        top = a_n * (last - first) + a_n1 * (before_last - second) + inner / math.sqrt(phi)
    else:
        phi = (ssq - 2 * m_last**2) / (1 - 2 * a_n**2)
        top = a_n * (last - first) + (m_second * (before_last - second) + inner) / math.sqrt(phi)
    w = min(1.0, top**2 / ss)
    # Royston's polynomials for the transformed statistic.
    y = math.log1p(-w) if w < 1 else -math.inf
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 1e-99
        y = -math.log(g - y)
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sigma = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        ln = math.log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, norm_sf((y - mu) / sigma)


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p of a local sample."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3:
        return math.nan, math.nan
    m = np.array([_N.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    d = x - x.mean()
    return royston(n, float(m @ m), m[-1], m[-2], (x[0], x[1], x[-2], x[-1]), float(m[2:-2] @ x[2:-2]), float(d @ d))


@F.pandas_udf(StructType([StructField("W", DoubleType()), StructField("p", DoubleType())]))
def shapiro_from_sums(
    n: pd.Series, ssq: pd.Series, m_last: pd.Series, m_second: pd.Series, x1: pd.Series, x2: pd.Series, x3: pd.Series, x4: pd.Series, inner: pd.Series, ss: pd.Series
) -> pd.DataFrame:
    rows = [
        royston(int(a), b, c, d, (e, f, g, h), i, j) if a >= 3 else (None, None)
        for a, b, c, d, e, f, g, h, i, j in zip(n, ssq, m_last, m_second, x1, x2, x3, x4, inner.fillna(0.0), ss, strict=True)
    ]
    return pd.DataFrame(rows, columns=["W", "p"], dtype="float64")
