"""Features of bars and of events: mid prices, differences, rolling and exponentially weighted moments, sides."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.frames import BLOCK, KEYS, TS, alike, full, look_back

TINY = 1e-8


def with_mid(df: DataFrame) -> DataFrame:
    """Mid prices of whatever prices have both sides, and the log of the mid close (null at zero)."""
    have = [c for c in ("open", "high", "low", "close") if f"{c}_bid" in df.columns and f"{c}_ask" in df.columns]
    df = alike(df.withColumns({f"{c}_mid": 0.5 * (F.col(f"{c}_bid") + F.col(f"{c}_ask")) for c in have}), df)
    return alike(df.withColumn("log_mid", F.ln(F.nullif(F.col("close_mid"), F.lit(0.0)))), df)


def with_returns(df: DataFrame, price: str = "log_mid", vol: int = 60, keys: Sequence[str] = KEYS, ts: str = TS, block: int | None = BLOCK) -> DataFrame:
    """ret_1 and ret_5 (differences of ``price`` by rows) and vol (sample deviation of ret_1 over ``vol`` full rows)."""
    made = lambda w: ({f"ret_{k}": F.col(price) - F.lag(price, k).over(w) for k in (1, 5)}, {f"vol_{vol}": full(F.stddev_samp, F.col("ret_1"), w, vol)})
    return look_back(df, max(5, vol), made, keys, ts, block)


def with_ewma(df: DataFrame, x: str = "ret_1", span: int = 50, name: str | None = None, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """``df`` with the exponentially weighted deviation of ``x`` by time within each key, unbiased, null where undefined. Weights
    are a * (1 - a) ** k with a = 2 / (span + 1), and (1 - a) ** k for the first value. Leading nulls only delay the start; at a
    null within, the last value holds and older weights decay one step further.

    The recurrence is affine, so running sums of values and squares by weights that grow with time give it. A key's rows
    are dealt in blocks short enough for such weights, each after the rows before it that still weigh 1e-17. After so many nulls
    in a row that all older weights together are below 1e-10, the next value's figure has fewer than six digits.
    """
    a, c = 2 / (span + 1), F.col(x).cast("double")
    rate = -math.log1p(-a)  # weights grow by exp(rate) a row, and their squares must stay below 1e308
    back, block = math.ceil(39.2 / rate), math.ceil(250 / rate)

    def terms(w) -> dict[str, Column]:
        before = F.last(F.when(c.isNotNull(), F.col("_pos")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return {"_gap": F.col("_pos") - before, "_x": c - F.first(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))}

    def sums(w) -> dict[str, Column]:
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        old = F.pow(F.lit(1 - a), F.col("_gap"))
        decay = F.when(c.isNotNull() & F.col("_gap").isNotNull(), F.ln(old / (old + a)))
        share = F.when(F.col("_gap").isNull(), 1.0).otherwise(a / (old + a))
        weight = F.when(c.isNotNull(), share * F.exp(-F.coalesce(F.sum(decay).over(upto), F.lit(0.0))))
        return {"_w": weight}

    def value(w) -> dict[str, Column]:
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        total, mean = F.sum("_w").over(upto), F.sum(F.col("_w") * F.col("_x")).over(upto)
        squares, same = F.sum(F.col("_w") * F.col("_x") * F.col("_x")).over(upto), F.sum(F.col("_w") * F.col("_w")).over(upto)
        var = (squares / total - mean / total * mean / total) / (1 - same / total / total)
        return {name or f"ewma_{span}": F.when(F.count(c).over(upto) > 1, F.sqrt(F.greatest(var, F.lit(0.0))))}

    out = look_back(df, back, lambda w: (terms(w), sums(w), value(w)), keys, ts, block, strict=True)
    return alike(out.drop("_gap", "_x", "_w"), out)


def with_ewma_tail(df: DataFrame, x: str = "ret_1", span: int = 50, tail: int = 1000, name: str | None = None, keys: Sequence[str] = KEYS, ts: str = TS, block: int | None = BLOCK) -> DataFrame:
    """As ``with_ewma`` for values without nulls inside, from the last ``tail`` values alone: with span 50 what is older
    weighs below 1e-17. JVM only, and with ``block`` a long history is many tasks' work."""
    a = 2 / (span + 1)
    zero = F.struct(F.lit(None).cast("double").alias("m"), F.lit(0.0).alias("v"), F.lit(1.0).alias("q"))

    def step(s: Column, y: Column) -> Column:
        d = y - s["m"]
        return F.when(s["m"].isNull(), F.struct(y.alias("m"), F.lit(0.0).alias("v"), F.lit(1.0).alias("q"))).otherwise(F.struct((s["m"] + a * d).alias("m"), ((1 - a) * (s["v"] + a * d * d)).alias("v"), ((1 - a) ** 2 * s["q"] + a * a).alias("q")))

    made = lambda w: {name or f"ewma_{span}": F.when(F.count(F.col(x)).over(w.rowsBetween(-(tail - 1), 0)) > 1, F.aggregate(F.collect_list(F.col(x)).over(w.rowsBetween(-(tail - 1), 0)), zero, step, lambda s: F.sqrt(s["v"] / F.nullif(1 - s["q"], F.lit(0.0)))))}
    return look_back(df, tail, made, keys, ts, block)


def event_features(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, block: int | None = BLOCK, vol: str = "vol_60") -> DataFrame:
    """Features of events in event time: the frames are over the rows of ``df``, whatever time lies between them.

    From what columns there are: ret_1 (absolute, deviation of 20, ratios), ret_5 momentum, the volatility's lag, change and
    long deviation; with prices of both sides the spread, close changes, ranges and open spread; rolling side score.
    """
    have, c = set(df.columns), F.col
    quotes = {f"{p}_{side}" for p in ("open", "high", "low", "close") for side in ("bid", "ask")}
    ratio = lambda a, b: c(a) / (c(b) + TINY)

    def windows(w) -> dict[str, Column]:
        out = {}
        if "ret_1" in have:
            out["ret_1_roll_std_20"] = full(F.stddev_samp, c("ret_1"), w, 20, 10)
        if vol in have:
            out[f"{vol}_lag1"] = F.lag(vol).over(w)
            change = c(vol) / F.nullif(F.lag(vol).over(w), F.lit(0.0)) - 1
            out[f"{vol}_roc"] = change
            out["vol_300"] = full(F.stddev_samp, c("ret_1"), w, 300, 60) if "ret_1" in have else F.lit(None).cast("double")
        if quotes <= have:
            out["CBP"] = c("close_bid") - F.lag("close_bid").over(w)
            out["CAP"] = c("close_ask") - F.lag("close_ask").over(w)
        if "side_score" in have:
            out["side_score_roll_mean_30"] = full(F.avg, c("side_score"), w, 30, 10)
            out["side_score_roll_std_30"] = full(F.stddev_samp, c("side_score"), w, 30, 10)
        return out

    df = look_back(df, 300, windows, keys, ts, block)
    rows = {}
    if "ret_1" in have:
        rows["ret_1_abs"] = F.abs("ret_1")
        if vol in have:
            rows[f"ret_1_to_{vol}"] = ratio("ret_1", vol)
            rows[f"{vol}_to_vol_300"] = ratio(vol, "vol_300")
        if "ret_5" in have:
            rows["ret_5_mom_std_ratio"] = ratio("ret_5", "ret_1_roll_std_20")
    if quotes <= have:
        rows["SP"] = c("close_bid") - c("close_ask")  # bid less ask
        rows["VBP"], rows["VAP"] = c("high_bid") - c("low_bid"), c("high_ask") - c("low_ask")
        rows["spread_proxy"] = c("open_ask") - c("open_bid")
    return alike(df.withColumns(rows), df)


def momentum_side(df: DataFrame, lookback: int = 60, floor: float = 0.5, clip: float = 3.0, vol: str = "vol_60", price: str = "log_mid", keys: Sequence[str] = KEYS, ts: str = TS, block: int | None = BLOCK, sign: float = 1.0) -> DataFrame:
    """side_score: the move of ``lookback`` rows over its expected deviation, clipped; side: its sign, null within the
    dead zone of ``floor``."""
    move = lambda w: {"_move": F.col(price) - F.lag(price, lookback).over(w)}
    z = sign * F.col("_move") / (F.nullif(F.col(vol), F.lit(0.0)) * math.sqrt(lookback))
    back = look_back(df, lookback, move, keys, ts, block)
    df = back.withColumn("side_score", F.when(z.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))).drop("_move")
    return alike(df.withColumn("side", F.when(F.abs("side_score") >= floor, F.signum("side_score"))), back)


def reversion_side(df: DataFrame, lookback: int = 20, floor: float = 0.5, clip: float = 3.0, vol: str = "vol_60", price: str = "log_mid", keys: Sequence[str] = KEYS, ts: str = TS, block: int | None = BLOCK) -> DataFrame:
    """As ``momentum_side`` against the move."""
    return momentum_side(df, lookback, floor, clip, vol, price, keys, ts, block, -1.0)


def correlations(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """(key, f1, f2, corr) for all pairs of ``columns`` over rows where none is null: one aggregation."""
    rows = df.dropna(subset=list(columns))
    pairs = [F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), (F.lit(1.0) if a == b else F.corr(a, b)).alias("corr")) for a in columns for b in columns]
    return rows.groupBy(*keys).agg(F.array(*pairs).alias("x")).select(*keys, F.explode("x").alias("x")).select(*keys, "x.*")


def mean_correlations(corr: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(f1, f2, corr, n): the mean over keys of the pairs of features that every key has."""
    n = corr.select(*keys).distinct().count()
    if not n:
        raise ValueError("no correlation matrices")
    return corr.groupBy("f1", "f2").agg(F.avg("corr").alias("corr"), F.count("*").alias("n")).filter(F.col("n") == n)
