"""Distribution functions: Spark expressions where a closed form exists, Arrow UDFs over numpy elsewhere."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def _arrow(f, *cols: Column) -> Column:
    """An Arrow UDF of a series function, made when it is used: executors import this module without a session."""
    return F.pandas_udf(f, "double")(*cols)


_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma of positive numbers: Stirling's series above 7, the recurrence below (error under 1e-13 relative)."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    low = y < 7
    while low.any():
        shift[low] += np.log(y[low])
        y[low] += 1
        low = y < 7
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def digamma(x: float) -> float:
    out = 0.0
    while x < 16:
        out, x = out - 1 / x, x + 1
    z = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240)))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 16:
        out, x = out + 1 / (x * x), x + 1
    z = 1 / (x * x)
    return out + 1 / x + z / 2 + z / x * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z / 30)))


def trigamma_inverse(y: float) -> float:
    """x with trigamma(x) = y, by bisection on ln x; y not above 0 gives infinity."""
    if y <= 1e-12:
        return math.inf
    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if trigamma(math.exp(middle)) > y else (low, middle)
    return math.exp((low + high) / 2)


def chi2_upper(x: np.ndarray, df: float) -> np.ndarray:
    """P(chi-square with ``df`` degrees of freedom > x): the series of the lower tail, or the continued fraction of the upper."""
    a, z = df / 2, np.maximum(np.asarray(x, float), 0) / 2
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(z) - z - math.lgamma(a))
        term = np.full_like(z, 1 / a)
        total = term.copy()
        for n in range(1, 500):
            term = term * z / (a + n)
            total = total + term
        b = z + 1 - a
        c, d = np.full_like(z, 1e300), 1 / np.where(np.abs(b) < 1e-300, 1e-300, b)
        h = d.copy()
        for n in range(1, 500):
            b = b + 2
            d = 1 / (b - n * (n - a) * d)
            c = b - n * (n - a) / c
            h = h * d * c
    return np.where(z <= 0, 1.0, np.where(z < a + 1, 1 - front * total, front * h))


def f_upper(f: np.ndarray, d1: float, d2: np.ndarray) -> np.ndarray:
    """P(F with d1 and d2 degrees of freedom > f); an infinite d2 gives the chi-square tail."""
    f, d2 = np.broadcast_arrays(np.maximum(np.asarray(f, float), 0), np.asarray(d2, float))
    far = np.isinf(d2)
    v = np.where(far, 1.0, d2)
    return np.where(far, chi2_upper(f * d1, d1), beta_fraction(v / 2, np.full_like(v, d1 / 2), v / (v + d1 * f)))


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < 1e-300, 1e-300, c)
                h = h * d * c
        out = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| > |z|)."""

    def run(z: pd.Series) -> pd.Series:
        return pd.Series(_erfc(np.abs(z.fillna(0).to_numpy(float)) / math.sqrt(2))).where(~z.isna().to_numpy())

    return _arrow(run, z)


def normal_upper(z: Column) -> Column:
    """P(Z > z)."""

    def run(z: pd.Series) -> pd.Series:
        return pd.Series(0.5 * _erfc(z.fillna(0).to_numpy(float) / math.sqrt(2))).where(~z.isna().to_numpy())

    return _arrow(run, z)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) with any positive degrees of freedom."""

    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        ok = (~(t.isna() | df.isna()) & (df > 0)).to_numpy()
        x, v = np.where(ok, t.fillna(0), 0.0), np.where(ok, df.fillna(1), 1.0)
        return pd.Series(beta_fraction(v / 2, np.full_like(v, 0.5), v / (v + x * x))).where(ok)

    return _arrow(run, t, df)


@functools.cache
def rank_sum_counts(n1: int, n2: int) -> np.ndarray:
    """Cumulative shares of W = 0, 1, ..., n1 n2 over all ways to deal ranks to two groups: sums of n1 of the ranks 1..n1 + n2, a rank at a time."""
    most = n1 * n2
    ways = np.zeros((n1 + 1, most + 1))  # of k ranks whose excess over 1..k sums to w
    ways[0, 0] = 1
    for rank in range(1, n1 + n2 + 1):
        for k in range(min(rank, n1), 0, -1):
            more = rank - k  # a rank's excess as the k-th smallest
            if more <= most:
                ways[k, more:] += ways[k - 1, : most + 1 - more]
    return np.cumsum(ways[n1]) / ways[n1].sum()


@functools.cache
def signed_rank_counts(n: int) -> np.ndarray:
    """Cumulative shares of V = 0, 1, ..., n (n + 1) / 2 over all signs of the ranks 1..n."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for rank in range(1, n + 1):
        ways[rank:] += ways[:-rank].copy()
    return np.cumsum(ways) / ways.sum()


#: Numbers of values below which rank tests without ties are exact.
EXACT_BELOW = 50


def _two_sided(shares: np.ndarray, stat: float) -> float:
    """Twice the smaller tail that holds the statistic; shares are symmetric."""
    at = int(round(stat))
    tail = shares[at] if at <= (len(shares) - 1) / 2 else 1 - (shares[at - 1] if at else 0.0)
    return min(1.0, 2 * tail)


def rank_sum_exact(w: Column, n1: Column, n2: Column) -> Column:
    """Two-sided exact p of a rank-sum statistic without ties; null where a number is null, 0, or ``EXACT_BELOW`` and more."""

    def run(w: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        ok = w.notna() & n1.between(1, EXACT_BELOW - 1) & n2.between(1, EXACT_BELOW - 1)
        return pd.Series([_two_sided(rank_sum_counts(int(min(a, b)), int(max(a, b))), x) if k else None for k, x, a, b in zip(ok, w, n1, n2, strict=True)], dtype=float)

    return _arrow(run, w, n1.cast("double"), n2.cast("double"))


def signed_rank_exact(v: Column, n: Column) -> Column:
    """Two-sided exact p of a signed-rank statistic without ties and zeros; null where n is null, 0, or ``EXACT_BELOW`` and more."""

    def run(v: pd.Series, n: pd.Series) -> pd.Series:
        ok = v.notna() & n.between(1, EXACT_BELOW - 1)
        return pd.Series([_two_sided(signed_rank_counts(int(m)), x) if k else None for k, x, m in zip(ok, v, n, strict=True)], dtype=float)

    return _arrow(run, v, n.cast("double"))


def conditional_odds_ratio(n11: Column, n01: Column, n10: Column, n00: Column) -> Column:
    """The odds ratio under which the first cell's mean, given all margins, is what was seen; 0 and infinity at the ends of its support.

    The mean rises with the logarithm of the ratio, which is halved in on. The support is cut where it is beyond twelve
    standard deviations of what was seen; a support of a single table has no ratio.
    """

    def one(a: float, b: float, c: float, d: float) -> float | None:
        row, col, n = a + b, a + c, a + b + c + d
        low, high = max(0.0, row + col - n), min(row, col)
        if low == high:
            return None
        if a in (low, high):
            return 0.0 if a == low else math.inf
        reach = 12 / math.sqrt(sum(1 / (x + 0.5) for x in (a, b, c, d))) + 60
        k = np.arange(max(low, math.floor(a - reach)), min(high, math.ceil(a + reach)) + 1)
        log_w = -(log_gamma(k + 1) + log_gamma(row - k + 1) + log_gamma(col - k + 1) + log_gamma(n - row - col + k + 1))
        lo, hi = -60.0, 60.0
        for _ in range(200):
            mid = (lo + hi) / 2
            t = log_w + k * mid
            w = np.exp(t - t.max())
            lo, hi = (mid, hi) if (w * k).sum() / w.sum() < a else (lo, mid)
        return math.exp((lo + hi) / 2)

    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(a, b, c, d, strict=True)], dtype=float)

    return _arrow(run, *[x.cast("double") for x in (n11, n01, n10, n00)])


#: The published coefficients of Acklam's rational approximation to the normal quantile.
_QA = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_QB = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_QC = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_QD = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def quantile(p: np.ndarray) -> np.ndarray:
    """Normal quantile: rational approximation and one Halley step."""
    p = np.asarray(p, float)
    with np.errstate(all="ignore"):
        tail = np.minimum(p, 1 - p)
        q = np.sqrt(-2 * np.log(tail))
        outer = np.polyval(_QC, q) / np.polyval((*_QD, 1.0), q) * np.where(p < 0.5, 1.0, -1.0)
        r = (p - 0.5) ** 2
        inner = np.polyval(_QA, r) * (p - 0.5) / np.polyval((*_QB, 1.0), r)
        z = np.where(tail < 0.02425, outer, inner)
        e = 0.5 * _erfc(-z / math.sqrt(2)) - p
        u = e * math.sqrt(2 * math.pi) * np.exp(z * z / 2)
        z = np.where(np.isfinite(z), z - u / (1 + z * u / 2), z)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, z))


def normal_quantile(p: Column) -> Column:
    def run(p: pd.Series) -> pd.Series:
        return pd.Series(quantile(p.fillna(0.5).to_numpy(float))).where(~p.isna().to_numpy())

    return _arrow(run, p)


def cauchy_upper(t: Column) -> Column:
    """P(C > t), exact in the far tail."""
    return F.when(t > 0, F.atan2(F.lit(1.0), t) / F.pi()).otherwise(F.lit(0.5) - F.atan(t) / F.pi())


def chi2_upper_even(x: Column, half: Column) -> Column:
    """P(chi-square with 2 * half degrees of freedom > x), by the finite Poisson sum."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] * x / (2.0 * i)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    terms = F.when(half > 1, F.sequence(F.lit(1), (half - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(half >= 1, F.exp(-x / 2) * F.aggregate(terms, start, step, lambda a: a["sum"]))


def chi2_upper_one(x: Column) -> Column:
    return normal_two_sided(F.sqrt(x))


def log_factorial(n: Column) -> Column:
    """ln n! for counts: exact sum below 32, Stirling's series beyond (error below 1e-12)."""
    m = n.cast("double") + 1
    series = (m - 0.5) * F.ln(m) - m + 0.5 * math.log(2 * math.pi) + 1 / (12 * m) - 1 / (360 * m**3) + 1 / (1260 * m**5) - 1 / (1680 * m**7)
    table = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(32)])
    return F.when(n < 32, F.get(table, n.cast("int"))).otherwise(series)
