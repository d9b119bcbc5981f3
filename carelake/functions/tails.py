"""Tail probabilities for a handful of test statistics (one row per tested pair)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


STEPS = 100_000
#: Pairs beyond which a correlation's t is normal to more digits than a double's tail needs.
NORMAL_FROM = 10_000_000


class NotConverged(ArithmeticError):
    """A series that has not settled within ``STEPS`` terms."""


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, STEPS):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return total
    raise NotConverged


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - front * total
    b, c = x + 1.0 - a, 1e300
    d = 1.0 / b
    total = d
    for i in range(1, STEPS):
        step = -i * (i - a)
        b += 2.0
        d = 1.0 / (step * d + b)
        c = b + step / c
        total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return front * total
    raise NotConverged


def correlation_tail(r: float, n: int) -> float | None:
    """Two-sided p of a Pearson r over n pairs: I_{1-r^2}((n-2)/2, 1/2), by the normal tail for very many pairs."""
    if r * r >= 1.0:
        return 0.0
    if n > NORMAL_FROM:
        return math.erfc(abs(r) * math.sqrt((n - 2) / (2.0 * (1.0 - r * r))))
    try:
        return beta_tail((n - 2) / 2.0, 0.5, 1.0 - r * r)
    except NotConverged:
        return None


def chi2_tail(stat: float, dof: float) -> float | None:
    try:
        return gamma_upper(dof / 2.0, stat / 2.0)
    except NotConverged:
        return None


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """p of each correlation; null below three pairs and where the series does not converge."""
    return pd.Series([None if pd.isna(ri) or ni < 3 else correlation_tail(ri, ni) for ri, ni in zip(r, n)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(s) else chi2_tail(s, d) for s, d in zip(stat, dof)], dtype="float64")
