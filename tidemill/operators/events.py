"""Sampling of events: session masks, and a CUSUM filter with volatility-scaled thresholds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.frames import BLOCK, KEYS, TS, alike, exact_quantile, exact_quantiles, in_blocks, look_back, seconds


def in_session(ts: Column, start: int = 8, end: int = 18) -> Column:
    """The hour is in [start, end)."""
    return F.hour(ts).between(start, end - 1)


def in_session_with_runway(ts: Column, horizon: int, minutes: int = 1, start: int = 8, end: int = 18) -> Column:
    """In the session, and ``horizon`` bars of ``minutes`` later it has not ended (its very end counts)."""
    left = F.lit(end * 3600) - (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts).cast("int"))
    return in_session(ts, start, end) & (left >= horizon * minutes * 60)


def sigma_floor(df: DataFrame, sigma: str, share: float = 0.05, keys: Sequence[str] = KEYS) -> DataFrame:
    """(key, floor): the exact quantile of ``sigma`` over the key's whole history."""
    return exact_quantile(df, sigma, share, keys).withColumnRenamed("_q", "floor")


class Cusum:
    """The sampler's state for one ordered series: both sums, and the time of the last event."""

    def __init__(self, k: float, spacing: float, columns: list[str]):
        self.k, self.spacing, self.columns = k, spacing, columns
        self.up = self.down = 0.0
        self.last: float | None = None

    def steps(self, times: list[float], r: list[float], sigma: list[float], floor: list[float]) -> list[tuple[int, int]]:
        """(place, direction) of the events among the next rows; ``times`` in seconds, NaN as missing."""
        up, down, out = self.up, self.down, []
        for i, (x, s, low) in enumerate(zip(r, sigma, floor, strict=True)):
            if x != x or s != s:
                continue
            h = self.k * (s if s > low or low != low else low)
            if not 0 < h < float("inf"):
                continue
            up, down = max(0.0, up + x), min(0.0, down + x)
            way = 1 if up > h else -1 if down < -h else 0
            if way:
                up = down = 0.0  # also where the spacing keeps the event back
                if self.last is None or times[i] - self.last >= self.spacing:
                    out.append((i, way))
                    self.last = times[i]
        self.up, self.down = up, down
        return out


class Resets:
    """Where the sums pass their threshold, for ``in_blocks``: (direction,) of each, kept back by the spacing or not."""

    start = (0.0, 0.0)

    def __init__(self, k: float):
        self.k = k

    def walk(self, rows: pd.DataFrame, state: tuple[float, float]) -> Iterator[tuple[tuple[float, float], tuple[int] | None]]:
        machine = Cusum(self.k, 0.0, [])
        machine.up, machine.down = state
        for row in zip(rows["_r"].tolist(), rows["_s"].tolist(), rows["_f"].tolist(), strict=True):
            machine.last = None
            way = machine.steps([0.0], *([x] for x in row))
            yield (machine.up, machine.down), (way[0][1],) if way else None


class Spaced:
    """Events that are ``spacing`` seconds or more after the last that counted, for ``in_blocks``."""

    start = (float("-inf"),)

    def __init__(self, spacing: float):
        self.spacing = spacing

    def walk(self, rows: pd.DataFrame, state: tuple[float]) -> Iterator[tuple[tuple[float], tuple[int] | None]]:
        (last,) = state
        for at, way in zip(rows["_at"].tolist(), rows["direction"].tolist(), strict=True):
            counts = at - last >= self.spacing
            last = at if counts else last
            yield (last,), (way,) if counts else None


def cusum_events(df: DataFrame, r: str = "ret_1", sigma: str = "vol_60", k: float = 3.0, spacing_seconds: float = 0.0, floor: str | None = None, keys: Sequence[str] = KEYS, ts: str = TS, block: int = BLOCK) -> DataFrame:
    """(key, ts, direction): where the running sum of ``r`` passes ``k`` times ``sigma`` (at least ``floor``, a column).

    State is carried over days and never forgotten; still a key's blocks of ``block`` rows are many tasks' work (``in_blocks``),
    as are its events when those that come too soon are left out. Rows with a missing value are passed over; so are those
    with a threshold of zero, which leave the sums as they are.
    """
    rows = alike(df.select(*keys, ts, F.col(r).cast("double").alias("_r"), F.col(sigma).cast("double").alias("_s"), (F.col(floor).cast("double") if floor else F.lit(0.0)).alias("_f")), df)
    found = in_blocks(rows, f"{__name__}.Resets", {"direction": "int"}, keys, ts, block, k=k)
    if spacing_seconds <= 0:
        return found
    zero = F.lit("1970-01-01").cast(dict(df.dtypes)[ts])
    found = alike(found.withColumn("_at", F.timestamp_diff("MICROSECOND", zero, F.col(ts)) / 1e6), found)
    return in_blocks(found, f"{__name__}.Spaced", {"direction": "int"}, keys, ts, block, spacing=spacing_seconds)


def filter_stats(df: DataFrame, eligible: Column, events: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """(key, bars, eligible, events, shares, quantiles of the minutes between events)."""
    bars = df.groupBy(*keys).agg(F.count("*").alias("bars"), F.count_if(eligible).alias("eligible"))
    gap = look_back(alike(events.select(*keys, ts), events), 1, lambda w: {"_gap": seconds(F.lag(ts).over(w), F.col(ts)) / 60}, keys, ts)
    seen = gap.groupBy(*keys).agg(F.count("*").alias("events"), F.percentile("_gap", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("gap_minutes"))
    out = bars.join(seen, [*keys], "left").withColumn("events", F.coalesce("events", F.lit(0)))
    return out.withColumns({"eligible_share": F.col("eligible") / F.col("bars"), "event_share": F.col("events") / F.nullif("eligible", F.lit(0))})


def abs_quantiles(df: DataFrame, x: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(key, p50, p90, p99) of the size of ``x``."""
    q = exact_quantiles(df, F.abs(x), (0.5, 0.9, 0.99), keys)
    return q.select(*keys, *(F.col("_q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p99"))))
