"""Labels: triple barriers, concurrency, sample weights, payoffs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.frames import KEYS, TS, alike, exact_quantile, longest, running_sum, with_position
from tidemill.storage import saved


@dataclass(frozen=True)
class Barriers:
    """Rows until the vertical barrier; how many deviations up and down; the columns of log price and deviation."""

    horizon: int = 60
    up: float = 5.0
    down: float = 5.0
    price: str = "log_mid"
    vol: str = "vol_60"
    session_end: int | None = 18


def triple_barrier(frame: DataFrame, events: DataFrame, b: Barriers = Barriers(), keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """(key, t0, t1_vert, t_end, label) of each event that is a row of ``frame``.

    Positions are those of the rows of ``frame`` with a price and deviation. The vertical barrier is ``horizon`` rows on,
    the last row, or the last row of the day's session, whichever is first. The first row after the event at or beyond the
    upper barrier gives 1 (it is tested first), beyond the lower -1; none gives 0 at the vertical barrier. Bars are met by
    buckets of ``horizon`` positions, so a join partition holds a bucket's bars and the events that look into it.
    """
    rows = with_position(alike(frame.dropna(subset=[b.price, b.vol]).select(*keys, ts, F.col(b.price).alias("_p"), F.col(b.vol).alias("_v")), frame), keys, ts, "_pos")
    rows = saved(rows.withColumn("_day", F.to_date(ts)))
    ends = rows.groupBy(*keys, "_day").agg(F.max(F.col("_pos") if b.session_end is None else F.when((F.hour(ts) < b.session_end) | (F.hour(ts) == b.session_end) & (F.minute(ts) == 0) & (F.second(ts) == 0), F.col("_pos"))).alias("_cap"))
    last = rows.groupBy(*keys).agg(F.max("_pos").alias("_last"))
    e = events.select(*keys, F.col(ts)).distinct().join(rows, [*keys, ts]).join(last, [*keys])
    if b.session_end is None:
        e = e.withColumn("_cap", F.col("_last"))
    else:
        e = e.join(ends, [*keys, "_day"])
    end = F.least(F.col("_last"), F.col("_pos") + b.horizon, F.greatest(F.coalesce("_cap", "_pos"), F.col("_pos")))
    wide = F.greatest(F.col("_v"), F.lit(1e-12))
    e = e.select(*keys, F.col(ts).alias("t0"), F.col("_pos").alias("_i"), end.alias("_end"), (F.col("_p") + b.up * wide).alias("_up"), (F.col("_p") - b.down * wide).alias("_down"))
    first, final = F.floor((F.col("_i") + 1) / b.horizon), F.floor(F.col("_end") / b.horizon)
    probes = e.filter("_end > _i").withColumn("_bucket", F.explode(F.sequence(first, final)))
    bars = rows.select(*keys, ts, "_p", "_pos", F.floor(F.col("_pos") / b.horizon).alias("_bucket"))
    met = probes.join(bars, [*keys, "_bucket"]).filter("_pos > _i and _pos <= _end")
    side = F.when(F.col("_p") >= F.col("_up"), 1).when(F.col("_p") <= F.col("_down"), -1)
    hit = F.when(side.isNotNull(), F.col("_pos"))
    found = met.groupBy(*keys, "t0").agg(F.max_by(ts, "_pos").alias("t1_vert"), F.min_by(F.when(side.isNotNull(), F.col(ts)), hit).alias("_t"), F.min_by(side, hit).alias("_label"))
    out = e.select(*keys, "t0").join(found, [*keys, "t0"], "left")
    return out.select(*keys, "t0", F.coalesce("t1_vert", "t0").alias("t1_vert"), F.coalesce("_t", "t1_vert", "t0").alias("t_end"), F.coalesce("_label", F.lit(0)).cast("tinyint").alias("label"))


def _valid(bars: DataFrame, intervals: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """(keys, t0, t_end, _times): the different intervals that begin and end at a bar, and how often each is there."""
    x = intervals.groupBy(*keys, "t0", "t_end").agg(F.count("*").alias("_times")).filter("t_end >= t0")
    ends = x.withColumn("_at", F.explode(F.array("t0", "t_end")))
    met = ends.join(bars.select(*keys, F.col(ts).alias("_at")), [*keys, "_at"], "left_semi")
    return met.groupBy(*keys, "t0", "t_end", "_times").count().filter("count = 2").drop("count")


def _line(bars: DataFrame, intervals: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str] = ()) -> DataFrame:
    """Bars (``_kind`` 1) with the beginnings of intervals (0) right before theirs and the ends (2) right after, and ``_c``: how
    many intervals cover a bar. Both tables are saved ones."""
    none = [F.lit(None).cast(dict(bars.dtypes)[c]).alias(c) for c in columns]
    steps = intervals.withColumn("_x", F.explode(F.array(*(F.struct(F.col(c).alias(ts), F.lit(k).alias("_kind"), (F.lit(1 - k) * F.col("_times")).alias("_d")) for c, k in (("t0", 0), ("t_end", 2))))))
    steps = steps.select(*keys, "_x.*", "t0", "t_end", "_times", *none)
    at = [F.lit(None).cast(kind).alias(c) for c, kind in intervals.dtypes if c in ("t0", "t_end", "_times")]
    line = bars.select(*keys, ts, F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_d"), *at, *columns).unionByName(steps)
    line._longest = {tuple(keys): longest(bars, keys) + 2 * longest(intervals, keys)}
    return running_sum(line, F.col("_d"), "_c", keys, ts, ties=["_kind"])


def concurrency(bars: DataFrame, intervals: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """(key, ts, pos, concurrency): how many intervals [t0, t_end] cover each bar, from steps up and down at their ends."""
    bars = saved(bars.select(*keys, ts))
    line = _line(bars, saved(_valid(bars, intervals, keys, ts)), keys, ts)
    line = running_sum(line, F.when(F.col("_kind") == 1, 1).otherwise(0), "_n", keys, ts, ties=["_kind"])
    return line.filter("_kind = 1").select(*keys, ts, (F.col("_n") - 1).alias("pos"), F.col("_c").alias("concurrency"))


def sample_weights(bars: DataFrame, intervals: DataFrame, r: str = "ret_1", cap: float = 0.99, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """(key, t0, t_end, weight) of the valid intervals: the size of the sum of returns, each shared among the intervals over
    its bar, scaled to sum to their number, cut at the ``cap`` quantile and scaled again. All zero gives ones. A missing
    return counts as zero.

    Bars and ends of intervals are put in one order; a running sum of the shares, read right before an interval's first bar and
    right after its last, gives its sum without a join.
    """
    bars = saved(bars.select(*keys, ts, F.col(r).cast("double").alias("_r")))
    line = _line(bars, saved(_valid(bars, intervals, keys, ts)), keys, ts, ["_r"])
    part = F.when((F.col("_kind") == 1) & (F.col("_c") > 0), F.coalesce("_r", F.lit(0.0)) / F.col("_c")).otherwise(0.0)
    line = running_sum(line, part, "_sum", keys, ts, ties=["_kind"]).filter("_kind <> 1")
    x = line.groupBy(*keys, "t0", "t_end", "_times").agg(F.abs(F.sum(F.when(F.col("_kind") == 2, F.col("_sum")).otherwise(-F.col("_sum")))).alias("_w"))
    x = saved(x.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*keys, "t0", "t_end", "_w"))
    top = exact_quantile(x, "_w", cap, keys)  # scaling keeps the order, so the cut is scaled with the rest
    per = x.join(top, [*keys]).groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("_w").alias("_total"), F.sum(F.least("_w", "_q")).alias("_cut"), F.first("_q").alias("_q"))
    x = x.join(per, [*keys])
    low = F.least("_w", "_q")
    return x.select(*keys, "t0", "t_end", F.when(F.col("_total") <= 0, 1.0).when(F.col("_cut") > 0, low * F.col("_n") / F.col("_cut")).otherwise(low * F.col("_n") / F.col("_total")).alias("weight"))


def payoffs(events: DataFrame, exits: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """``events`` (t0, t_end, side, open_bid, open_ask) with fwd_log_ret: long from the open ask to the close bid at t_end,
    short from the open bid to the close ask. ``exits`` gives the close prices by exact time: all bars, or the events alone
    where an exit counts only at another event. Null without an exit, a side, or with a price of zero or less."""
    out = exits.select(*keys, F.col(ts).alias("t_end"), F.col("close_bid").alias("_xb"), F.col("close_ask").alias("_xa"))
    e = events.join(out, [*keys, "t_end"], "left")
    log = lambda c: F.ln(F.when(F.col(c) > 0, F.col(c)))
    gain = F.when(F.col("side") > 0, log("_xb") - log("open_ask")).when(F.col("side") < 0, log("open_bid") - log("_xa"))
    return e.withColumn("fwd_log_ret", gain).drop("_xb", "_xa")


def valid_events(side: str = "side", label: str = "label", payoff: str = "fwd_log_ret") -> Column:
    return F.col(label).isNotNull() & F.col(payoff).isNotNull() & F.col(side).isNotNull() & (F.col(side) != 0)
