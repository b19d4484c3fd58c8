"""What the best of many skill-less strategies looks like, simulated and in theory."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import normal


def max_sharpe(spark: SparkSession, sims: int, strategies: int | Sequence[int], steps: int, periods: float = 252.0, mu: float = 0.0, sigma: float = 0.01, seed: int = 42) -> DataFrame:
    """(strategies, sim, max_sr): the best Sharpe ratio of each simulation. Each strategy's ``steps`` normal returns are
    drawn from a seed of its own in its own row, so memory is one row's and a rerun gives the same."""
    counts = [strategies] if isinstance(strategies, int) else list(strategies)
    ids = None
    for n in counts:
        part = spark.range(sims * n).select(F.lit(n).alias("strategies"), F.floor(F.col("id") / n).alias("sim"), F.col("id"))
        ids = part if ids is None else ids.unionByName(part)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.empty(len(b))
            for k, (n, i) in enumerate(zip(b["strategies"], b["id"], strict=True)):
                r = np.random.default_rng((seed, int(n), int(i))).normal(mu, sigma, steps)
                sd = r.std(ddof=1)
                out[k] = r.mean() / sd * periods**0.5 if sd > 0 else 0.0
            yield pd.DataFrame({"strategies": b["strategies"], "sim": b["sim"], "sr": out})

    return ids.mapInPandas(draw, "strategies int, sim long, sr double").groupBy("strategies", "sim").agg(F.max("sr").alias("max_sr"))


def max_sharpe_curve(spark: SparkSession, counts: Sequence[int], sims: int, steps: int, **given) -> DataFrame:
    """(strategies, simulated mean, expected maximum, bound sqrt(2 ln n)) in units of a Sharpe ratio's own deviation."""
    periods = given.get("periods", 252.0)
    mean = max_sharpe(spark, sims, counts, steps, **given).groupBy("strategies").agg(F.avg("max_sr").alias("simulated"))
    n = F.col("strategies").cast("double")
    scale = (periods / steps) ** 0.5
    return mean.withColumns({"expected": scale * normal.expected_max_of(n), "bound": scale * F.sqrt(2 * F.ln(n))})


def min_backtest_length(n: int, target: float) -> float | None:
    """Years after which the best of ``n`` is expected to stay below ``target`` by chance; None for fewer than two."""
    z = normal.expected_max(n)
    return None if z is None else (z / target) ** 2


def with_min_backtest(df: DataFrame, n: str = "n", target: float = 1.0) -> DataFrame:
    """``df`` with (min_years, bound) for ``n`` strategies that were tried: null ``min_years`` for fewer than two."""
    tried = F.col(n).cast("double")
    years = F.when(tried > 1, F.pow(normal.expected_max_of(tried) / target, F.lit(2.0)))
    return df.withColumns({"min_years": years, "bound": 2 * F.ln(tried) / target**2})


def min_backtest_curve(spark: SparkSession, target: float = 1.0, most: int = 1000) -> DataFrame:
    """(n, min_years, bound) for n from 1; null min_years for n = 1."""
    return with_min_backtest(spark.range(1, most + 1).withColumnRenamed("id", "n"), "n", target)
