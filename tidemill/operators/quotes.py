"""Bid and ask side by side, and statistics of their spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.frames import KEYS, TS
from tidemill.sources.bars import OHLC


def consistent(columns: Sequence[str]) -> Column:
    """Every ask at or above its bid (1e-10 aside), and a close spread above zero. A null fails."""
    fits = F.lit(True)
    for c in OHLC:
        if f"{c}_bid" in columns and f"{c}_ask" in columns:
            fits = fits & (F.col(f"{c}_ask") + 1e-10 >= F.col(f"{c}_bid"))
    return fits & (F.col("close_ask") - F.col("close_bid") > 0)


def join_sides(bars: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, side: str = "side") -> DataFrame:
    """One row for each key and time that both sides have, with ``{price}_bid`` and ``{price}_ask``, if consistent.

    The join of the two sides is one aggregation by key and time: a single shuffle, combined before it.
    """
    of = lambda c, s: F.max(F.when(F.col(side) == s.upper(), F.col(c))).alias(f"{c}_{s}")
    rows = bars.groupBy(*keys, ts).agg(*(of(c, s) for s in ("bid", "ask") for c in OHLC), F.count_if(F.col(side) == "BID").alias("_b"), F.count_if(F.col(side) == "ASK").alias("_a"))
    rows = rows.filter((F.col("_b") > 0) & (F.col("_a") > 0)).drop("_b", "_a")
    return rows.filter(consistent(rows.columns))


def spread_columns(df: DataFrame) -> DataFrame:
    spread, mid = F.col("close_ask") - F.col("close_bid"), (F.col("close_ask") + F.col("close_bid")) / 2
    return df.withColumns({"spread": spread, "mid": mid, "spread_bps": spread / F.nullif(mid, F.lit(0.0)) * 1e4})


def spread_stats(df: DataFrame, most_bps: float = 200, keys: Sequence[str] = KEYS) -> DataFrame:
    """Of rows with a spread above zero and below ``most_bps``: least, percentiles 1, 5, 50, 95, 99, mean and most, in
    price and in basis points, how many rows these are and how many others there were. Keys without one are left out."""
    rows = spread_columns(df)
    fits = F.coalesce((F.col("spread_bps") > 0) & (F.col("spread_bps") < most_bps), F.lit(False))
    out = []
    for name in ("spread", "spread_bps"):
        x = F.when(fits, F.col(name))
        out += [F.min(x).alias(f"{name}_min"), F.percentile(x, F.array(*map(F.lit, (0.01, 0.05, 0.5, 0.95, 0.99)))).alias(f"_{name}"), F.avg(x).alias(f"{name}_mean"), F.max(x).alias(f"{name}_max")]
    rows = rows.groupBy(*keys).agg(*out, F.count_if(fits).alias("n"), (F.count("*") - F.count_if(fits)).alias("outliers_removed")).filter("n > 0")
    at = ("p01", "p05", "median", "p95", "p99")
    return rows.select(*keys, "n", "outliers_removed", *(F.col(f"{s}_{k}") for s in ("spread", "spread_bps") for k in ("min", "mean", "max")), *(F.col(f"_{s}")[i].alias(f"{s}_{p}") for s in ("spread", "spread_bps") for i, p in enumerate(at)))
