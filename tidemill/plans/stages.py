"""The stages of the whole pipeline: raw bars, labelled events, backtests, analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.frames import BLOCK, KEYS, TS, alike
from tidemill.operators import clean, cscv, events, features, labels, quotes, stats
from tidemill.storage import saved


@dataclass(frozen=True)
class FeatureParams:
    """Sampling and labelling. Barriers count rows of the session frame; ``minutes`` is the length of a bar; ``block`` deals long histories
    in parts (see ``look_back``)."""

    horizon: int = 60
    minutes: int = 1
    vol: int = 60
    ewma: int = 50
    k: float = 5.0
    spacing_minutes: int = 15
    barrier: float = 5.0
    lookback: int = 15
    start: int = 8
    end: int = 18
    block: int | None = BLOCK


def clean_stage(raw: DataFrame, step: int = 1, block: int | None = BLOCK) -> dict[str, DataFrame]:
    """Cleaned bars of each side with their short (to two days) and long gaps and invalid blocks."""
    keys = ("pair", "side")
    bars = saved(clean.clean_bars(raw, keys, block=block))
    return {"bars": bars, "short_gaps": clean.gaps(bars, step, 2880, step, keys, block=block), "long_gaps": clean.gaps(bars, 2880, None, step, keys, block=block), "invalid_blocks": clean.invalid_blocks(bars, step=step, keys=keys)}


def join_stage(bars: DataFrame, step: int = 1, block: int | None = BLOCK) -> dict[str, DataFrame]:
    """Bid and ask bars of every pair that has both, with their gaps and invalid blocks."""
    joined = saved(quotes.join_sides(bars))
    prices = [c for c in joined.columns if c.endswith(("_bid", "_ask"))]
    return {"bars": joined, "short_gaps": clean.gaps(joined, step, 2880, step, block=block), "long_gaps": clean.gaps(joined, 2880, None, step, block=block), "invalid_blocks": clean.invalid_blocks(joined, prices, step)}


def feature_stage(joined: DataFrame, p: FeatureParams = FeatureParams(), start=None, end=None) -> DataFrame:
    """Joined bars to labelled, weighted events, each with the features of its bar. Events are sampled on session bars with
    room for the horizon and labelled on all session bars; a pair without events has no rows."""
    vol = f"vol_{p.vol}"
    span = joined if start is None else joined.filter(F.col(TS).between(start, end))
    bars = saved(features.with_ewma(features.with_returns(features.with_mid(span), vol=p.vol, block=p.block), span=p.ewma))
    floor = events.sigma_floor(bars, vol)
    eligible = alike(bars.join(floor, [*KEYS]).filter(events.in_session_with_runway(F.col(TS), p.horizon, p.minutes, p.start, p.end)), bars)
    found = events.cusum_events(eligible, sigma=vol, k=p.k, spacing_seconds=60 * p.spacing_minutes, floor="floor")
    session = saved(features.reversion_side(alike(bars.filter(events.in_session(F.col(TS), p.start, p.end)), bars), p.lookback, vol=vol, block=p.block))
    barrier = saved(labels.triple_barrier(session, found, labels.Barriers(p.horizon, p.barrier, p.barrier, vol=vol, session_end=p.end)))
    weights = labels.sample_weights(bars, barrier)
    out = session.join(barrier.withColumnRenamed("t0", TS), [*KEYS, TS])
    return out.join(weights.select(*KEYS, F.col("t0").alias(TS), "weight"), [*KEYS, TS], "left")


def modelling_rows(labelled: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """Labelled events to rows for models: event features, payoff (exits from ``bars``, or from the events alone), valid
    ones only, with row_idx by time within a pair."""
    from tidemill.frames import with_position

    x = features.event_features(labelled, vol=next((c for c in labelled.columns if c.startswith("vol_")), "vol_60"))
    x = x.withColumn("t0", F.col(TS))
    x = labels.payoffs(x, labelled if bars is None else bars)
    return with_position(x.filter(labels.valid_events()), KEYS, TS, "row_idx")


def analyse(m: DataFrame, keys: tuple[str, ...] = ("pair", "scheme"), blocks: int = 8, most: int | None = None, least: int = 200) -> DataFrame:
    """Metrics a strategy, with the overfitting figures of its key where that has 3 strategies and ``least`` rows, else nulls.
    Rows are numbered from 0 within a key."""
    enough = m.groupBy(*keys).agg(F.max("row_idx").alias("_r"), F.count_distinct("strategy").alias("_s")).filter((F.col("_r") + 1 >= least) & (F.col("_s") >= 3)).select(*keys)
    found = cscv.cscv(m.join(enough, [*keys], "left_semi"), None, blocks, most=most, keys=keys)
    return stats.strategy_metrics(m, keys).join(cscv.overfitting(found, keys), [*keys], "left")


def walk_forward_only(m: DataFrame, first_train: int) -> DataFrame:
    """A return matrix without the rows that only ever trained."""
    return m.filter(F.col("row_idx") >= first_train)

