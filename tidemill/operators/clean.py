"""Cleaning of bars: times, trading week, duplicates, impossible prices, stale runs, gaps, invalid blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.frames import BLOCK, KEYS, TS, alike, look_back, minutes_after, running_sum, seconds
from tidemill.functions.times import utc_time
from tidemill.sources.bars import OHLC
from tidemill.storage import saved


def parse_time(df: DataFrame, column: str, tz: str = "UTC") -> DataFrame:
    """``column`` as a timestamp in UTC; rows where it does not parse are dropped. A value with a zone or offset is an instant;
    others are of ``tz``."""
    return df.withColumn(column, utc_time(df, column, tz)).filter(F.col(column).isNotNull())


def strict_time(df: DataFrame, column: str, tz: str = "UTC") -> DataFrame:
    """As ``parse_time``, but nulls stay, and a value that does not parse is an error."""
    at = utc_time(df, column, tz)
    bad = F.raise_error(F.concat(F.lit("no time: "), F.col(column).cast("string"))).cast("timestamp_ntz")
    return df.withColumn(column, F.when(F.col(column).isNull() | at.isNotNull(), at).otherwise(bad))


def numeric(df: DataFrame, columns: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """``columns`` as doubles; what is no number, and NaN, becomes ``fill``."""
    bare = {c: F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(None).cast("double")) for c in columns}
    return df.withColumns({c: x if fill is None else F.coalesce(x, F.lit(fill)) for c, x in bare.items()})


def without_empty_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` without those of ``columns`` that have no value at all."""
    counts = df.agg(*(F.count(c).alias(c) for c in columns)).first()
    return df.drop(*(c for c in columns if not counts[c]))


def sane(o: str = "open", h: str = "high", low: str = "low", c: str = "close") -> Column:
    """Not: a price of zero or less, a high below or a low above open or close. A test with a null is not failed."""
    top, bottom = F.greatest(o, c), F.least(o, c)
    return ~F.coalesce((F.least(o, h, low, c) <= 0) | F.coalesce(F.col(h) < top, F.lit(False)) | F.coalesce(F.col(low) > bottom, F.lit(False)) | F.coalesce(F.col(h) < F.col(low), F.lit(False)), F.lit(False))


def in_fx_week(ts: Column) -> Column:
    """Sunday 22:00 to Friday 22:00."""
    day, hour = F.weekday(ts), F.hour(ts)
    return (day <= 3) | (day == 4) & ((hour < 22) | (hour == 22) & (F.minute(ts) == 0)) | (day == 6) & (hour >= 22)


def last_of_each(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """One row for each key: that with the greatest ``ordinal``. Aggregated before the shuffle; no sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("_row"))
    return picked.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(df.columns)


def _previous(df: DataFrame, name: str, column: str, keys: Sequence[str], ts: str, block: int | None) -> DataFrame:
    """``column`` of the row before."""
    return look_back(df, 1, lambda w: {name: F.lag(column).over(w)}, keys, ts, block)


def without_stale(df: DataFrame, price: str = "close", longest: int = 60, keys: Sequence[str] = KEYS, ts: str = TS, block: int | None = BLOCK) -> DataFrame:
    """Of a run of ``longest`` rows or more with one price, only the first row; as it is if there is no such column."""
    if price not in df.columns:
        return df
    before = _previous(df, "_last_price", price, keys, ts, block)
    rows = alike(before.withColumn("_same", F.coalesce(F.col(price) == F.col("_last_price"), F.lit(False))).drop("_last_price"), before)
    rows = running_sum(rows, F.when(F.col("_same"), 0).otherwise(1), "_run", keys, ts, block)
    size = F.count("*").over(Window.partitionBy(*keys, "_run"))
    return rows.withColumn("_size", size).filter(~(F.col("_same") & (F.col("_size") >= longest))).drop("_same", "_run", "_size")


def gaps(df: DataFrame, above: int, upto: int | None, step: int = 1, keys: Sequence[str] = KEYS, ts: str = TS, block: int | None = BLOCK) -> DataFrame:
    """Spans between neighbours more than ``above`` and at most ``upto`` minutes apart: first and last missing bar, how
    many bars of ``step`` minutes are missing, and the seconds between the neighbours."""
    rows = _previous(alike(df.select(*keys, ts), df), "_a", ts, keys, ts, block).withColumnRenamed(ts, "_b").withColumn("gap_seconds", seconds(F.col("_a"), F.col("_b")))
    rows = rows.filter((F.col("gap_seconds") > above * 60) & (F.lit(True) if upto is None else F.col("gap_seconds") <= upto * 60))
    missing = F.greatest(F.floor(F.col("gap_seconds") / (60 * step)) - 1, F.lit(0)).cast("int")
    return rows.select(*keys, minutes_after(F.col("_a"), step).alias("gap_start"), minutes_after(F.col("_b"), -step).alias("gap_end"), missing.alias("gap_missing"), "gap_seconds")


def invalid_blocks(df: DataFrame, columns: Sequence[str] = OHLC, step: int = 1, least: int = 1, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Runs of rows with a null or zero price, of ``least`` minutes or more. A run ends with its day, at a step other than
    ``step`` minutes, and where the state changes; it lasts until ``step`` after its last row."""
    w = Window.partitionBy(*keys, "_day").orderBy(ts)  # no run goes beyond its day
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.coalesce(F.col(c) == 0, F.lit(False))
    rows = df.select(*keys, ts, F.to_date(ts).alias("_day"), bad.alias("is_invalid"))
    fresh = (seconds(F.lag(ts).over(w), F.col(ts)) != step * 60) | (F.col("is_invalid") != F.lag("is_invalid").over(w))
    rows = rows.withColumn("_block", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(w))
    found = rows.groupBy(*keys, "_day", "_block").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.first("is_invalid").alias("is_invalid"), F.count("*").alias("n_rows"))
    found = found.withColumn("seconds", seconds(F.col("start"), F.col("end")) + step * 60)
    return found.filter(F.col("is_invalid") & (F.col("seconds") >= least * 60)).drop("_day", "_block")


def clean_bars(raw: DataFrame, keys: Sequence[str] = ("pair", "side"), ts: str = TS, ordinal: str = "ordinal", longest: int = 60, block: int | None = BLOCK) -> DataFrame:
    """Trading week, then last of duplicate times, then sane prices, then no stale runs: the order matters."""
    rows = last_of_each(raw.filter(F.col(ts).isNotNull() & in_fx_week(F.col(ts))), [*keys, ts], ordinal)
    rows = saved(rows.filter(sane()))  # read several times from here on
    return without_stale(rows, longest=longest, keys=keys, ts=ts, block=block).drop(ordinal)
