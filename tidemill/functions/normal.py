"""The normal distribution, which SQL lacks. For tables of few rows (one a strategy)."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329


def cdf(x: Column) -> Column:
    def run(xs: pd.Series) -> pd.Series:
        return pd.Series([None if v != v else 0.5 * math.erfc(-v / math.sqrt(2)) for v in xs], dtype=float)

    return F.nanvl(F.pandas_udf(run, "double")(x.cast("double")), F.lit(None).cast("double"))


def quantile(p: Column) -> Column:
    """Null outside (0, 1)."""

    def run(ps: pd.Series) -> pd.Series:
        q = NormalDist().inv_cdf
        return pd.Series([q(v) if 0 < v < 1 else None for v in ps], dtype=float)

    return F.nanvl(F.pandas_udf(run, "double")(p.cast("double")), F.lit(None).cast("double"))


def expected_max(n: int) -> float | None:
    """About what the greatest of ``n`` standard normals is expected to be; None for fewer than 2."""
    if n < 2:
        return None
    q = NormalDist().inv_cdf
    return (1 - EULER_GAMMA) * q(1 - 1 / n) + EULER_GAMMA * q(1 - 1 / (n * math.e))


def expected_max_of(n: Column) -> Column:
    return (1 - EULER_GAMMA) * quantile(1 - 1 / n) + EULER_GAMMA * quantile(1 - 1 / (n * math.e))


#: Sizes of samples up to which a two-sample statistic's p-value is exact.
EXACT = 10_000


def kolmogorov_p(stat: Column, n: Column) -> Column:
    """The p-value of a two-sample statistic of ``n`` values each, that is, how likely it is at least that large by chance.

    Exact up to ``EXACT``: of the paths that take n steps up and n to the right in any order, those that get as far as
    ``stat * n`` from the diagonal, counted by reflection. Beyond, the asymptotic series.
    """
    k = F.round(stat * n).cast("long")
    reach = lambda j: F.aggregate(F.sequence(F.lit(1).cast("long"), j), F.lit(1.0), lambda p, t: p * (n - t + 1) / (n + t))
    sign = lambda i: F.when(i % 2 == 1, 1.0).otherwise(-1.0)
    exact = F.aggregate(F.sequence(F.lit(1).cast("long"), F.floor(n / k)), F.lit(0.0), lambda p, i: p + 2 * sign(i) * reach(i * k))
    root = F.sqrt(n / 2)
    z = (root + 0.12 + 0.11 / root) * stat
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda p, i: p + 2 * sign(i) * F.exp(-2 * i * i * z * z))
    p = F.when(n <= EXACT, exact).when(z > 0.2, series).otherwise(1.0)
    return F.when(k <= 0, 1.0).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
