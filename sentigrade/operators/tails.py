"""Upper tails of the test distributions, for the few rows a test has after aggregation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, df: float) -> float:
    """Regularized upper incomplete gamma Q(df/2, x/2): series below, continued fraction above."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return h * scale


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 10_000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(r: float, n: float, controls: int = 0) -> float:
    """Two-sided p of a correlation over ``n`` rows, t distribution with n - 2 - controls."""
    df = n - 2 - controls
    if df <= 0 or math.isnan(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    return beta_cdf(df / 2, 0.5, 1 - r * r)


def studentized_range_tail(q: float, k: int) -> float:
    """P(range of k standard normals > q), integrated with the trapezoid rule."""
    if q <= 0:
        return 1.0
    z = np.linspace(-9.0, 9.0 + q, 20_001)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))
    inside = np.clip(cdf(z) - cdf(z - q), 0.0, 1.0)
    return float(min(1.0, max(0.0, 1 - np.trapezoid(k * density * inside ** (k - 1), z))))


def signed_rank_exact_p(w: float, m: int) -> float:
    """Two-sided exact p of the smaller signed-rank sum for m untied differences."""
    counts = np.zeros(m * (m + 1) // 2 + 1)
    counts[0] = 1.0
    for rank in range(1, m + 1):
        shifted = counts.copy()
        shifted[rank:] += counts[:-rank]
        counts = shifted
    return float(min(1.0, 2 * counts[: int(math.floor(w)) + 1].sum() / 2.0**m))


def signed_rank_p(w: float, m: int, ties: float, zeros: int, exact_limit: int) -> float:
    """Exact for small samples without ties and zeros, else normal with tie correction."""
    if m == 0:
        return 1.0
    if m <= exact_limit and ties == 0 and zeros == 0:
        return signed_rank_exact_p(w, m)
    variance = (m * (m + 1) * (2 * m + 1) - ties / 2) / 24
    if variance <= 0:
        return 1.0
    return min(1.0, normal_two_sided((w - m * (m + 1) / 4) / math.sqrt(variance)))


def _column(function, *args: Column) -> Column:
    """Applies a scalar tail to columns; NULL in any argument gives NULL."""

    @F.pandas_udf("double")
    def tail(*series: pd.Series) -> pd.Series:
        table = pd.concat(series, axis=1).astype(float)
        values = [
            None if row_has_null else function(*row)
            for row, row_has_null in zip(table.to_numpy(), table.isna().any(axis=1))
        ]
        return pd.Series(values, dtype="float64")

    result = tail(*[a.cast("double") for a in args])
    return F.when(~F.isnan(result), result)


def chi2_p(statistic: Column, df: Column) -> Column:
    return _column(chi2_tail, statistic, df)


def correlation_p_column(r: Column, n: Column, controls: int = 0) -> Column:
    return _column(lambda a, b: correlation_p(a, b, controls), r, n)


def nemenyi_p(q: Column, k: Column) -> Column:
    """``q`` is the rank difference over its standard error; the range needs a factor sqrt(2)."""
    return _column(lambda a, b: studentized_range_tail(a * math.sqrt(2), int(b)), q, k)


def wilcoxon_p(w: Column, m: Column, ties: Column, zeros: Column, exact_limit: int = 50) -> Column:
    return _column(
        lambda a, b, c, d: signed_rank_p(a, int(b), c, int(d), exact_limit), w, m, ties, zeros
    )
