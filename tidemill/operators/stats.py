"""Statistics of strategy returns. Long tables: (key, strategy, t0, ret), keys being pair and scheme or the like."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import normal

YEAR = 252


def daily_returns(m: DataFrame, keys: Sequence[str] = (), t0: str = "t0") -> DataFrame:
    """(key, strategy, day, ret): sums by calendar day, 0 on days without an event, from a key's first day to its last."""
    sums = m.groupBy(*keys, "strategy", F.to_date(t0).alias("day")).agg(F.sum("ret").alias("ret"))
    spans = m.groupBy(*keys).agg(F.min(F.to_date(t0)).alias("_a"), F.max(F.to_date(t0)).alias("_b"))
    names = m.select(*keys, "strategy").distinct()
    grid = names.join(spans, [*keys]) if keys else names.join(F.broadcast(spans), F.lit(True))  # one row without keys
    grid = grid.select(*keys, "strategy", F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias("day"))
    return grid.join(sums, [*keys, "strategy", "day"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))


def sharpe(r: Column, rf: float = 0.0, periods: int = YEAR) -> Column:
    """Of an aggregation: mean excess over its sample deviation, per year; 0 for fewer than two or without deviation."""
    x = r - rf / periods
    return F.when((F.count(x) >= 2) & (F.stddev_samp(x) > 0), F.avg(x) / F.stddev_samp(x) * periods**0.5).otherwise(0.0)


def sortino(r: Column, rf: float = 0.0, periods: int = YEAR) -> Column:
    """As ``sharpe`` with the root mean square of the losses over all days."""
    x = r - rf / periods
    down = F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2.0))))
    return F.when((F.count(x) >= 2) & (down > 0), F.avg(x) / down * periods**0.5).otherwise(0.0)


def skew(x: Column) -> Column:
    """Of an aggregation: the unbiased skewness; 0 for three values or fewer, null without deviation."""
    n = F.count(x)
    return F.when(n > 3, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))).otherwise(0.0)


def kurtosis(x: Column) -> Column:
    """Of an aggregation: the unbiased total kurtosis; 3 for three values or fewer."""
    n = F.count(x)
    return F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * F.kurtosis(x) + 6) + 3).otherwise(3.0)


def psr_argument(sr: Column, benchmark: Column, t: Column, skew: Column, kurt: Column) -> Column:
    """What the probabilistic Sharpe ratio is the normal probability of; null for one observation or none."""
    width = F.sqrt(F.greatest(F.lit(1e-12), 1 - skew * sr + (kurt - 1) / 4 * sr * sr))
    return F.when(t > 1, (sr - benchmark) * F.sqrt(t - 1) / width)


def deflated(df: DataFrame, keys: Sequence[str] = (), sr0: float = 0.0) -> DataFrame:
    """``df`` (sharpe, T_daily, skew, kurt a strategy) with dsr_argument and dsr. The benchmark is what the best of a key's
    strategies is expected to reach by chance; with one strategy it is ``sr0``."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row a strategy
    spread = F.sqrt(F.greatest(F.lit(1e-12), F.coalesce(F.var_samp("sharpe").over(w), F.lit(0.0))))
    df = df.withColumns({"_n": F.count("sharpe").over(w), "_spread": spread})
    z = normal.expected_max_of(F.col("_n").cast("double"))
    star = F.when(F.col("_n") > 1, sr0 + F.col("_spread") * F.coalesce(z, F.lit(0.0))).otherwise(sr0)
    df = df.withColumn("_star", star).withColumn("dsr_argument", psr_argument(F.col("sharpe"), F.col("_star"), F.col("T_daily"), F.col("skew"), F.col("kurt")))
    return df.withColumn("dsr", normal.cdf(F.col("dsr_argument"))).drop("_n", "_spread", "_star")


def strategy_metrics(m: DataFrame, keys: Sequence[str] = (), rf: float = 0.0, periods: int = YEAR, t0: str = "t0") -> DataFrame:
    """A row a strategy: trades (returns other than zero), hit rate, mean and deviation of traded returns, daily Sharpe and
    Sortino, the moments and days they rest on, and the deflated Sharpe ratio."""
    traded = F.when(F.col("ret") != 0, F.col("ret"))
    events = m.groupBy(*keys, "strategy").agg(
        F.count(traded).alias("n_trades"),
        F.coalesce(F.avg((traded > 0).cast("double")), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.avg(traded), F.lit(0.0)).alias("mean_evt_ret"),
        F.coalesce(F.stddev_samp(traded), F.lit(0.0)).alias("std_evt_ret"),
    )
    r = F.col("ret")
    days = daily_returns(m, keys, t0).groupBy(*keys, "strategy").agg(sharpe(r, rf, periods).alias("sharpe"), sortino(r, rf, periods).alias("sortino"), skew(r).alias("skew"), kurtosis(r).alias("kurt"), F.count("*").alias("T_daily"))
    return deflated(events.join(days, [*keys, "strategy"]), keys)


def cumulative_return(r: Column, w) -> Column:
    """The compound return along a window, for returns above -1."""
    return F.exp(F.sum(F.log1p(r)).over(w)) - 1
