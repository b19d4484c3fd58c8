"""Reports as tidy tables: diagnostics of events and labels, and summaries of metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.frames import KEYS, TS, alike, exact_quantiles, look_back, numbered, same, seconds, with_average_rank
from tidemill.functions.times import utc_time, with_nanoseconds
from tidemill.operators.cv import block_of
from tidemill.operators.labels import concurrency


def share(x: Column) -> Column:
    """Of an aggregation: the share of rows where ``x`` holds; null if there are none."""
    return F.avg(x.cast("double"))


def describe(df: DataFrame, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """(key, n, mean, std, min, p25, p50, p75, max) of ``x``, quantiles exact; null where a key has no value."""
    out = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    out = _with_quantiles(out, exact_quantiles(df, F.col(x), (0.25, 0.5, 0.75), keys), keys)
    return out.select(*keys, "n", "mean", "std", "min", *(F.col("_q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))), "max")


def _with_quantiles(rows: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows``, of a row a key, with the quantiles of each; null where there are none."""
    found = found.select(*(F.col(k).alias(f"{k}_") for k in keys), "_q")
    return rows.join(found, same(rows, found, keys) if keys else F.lit(True), "left").drop(*(f"{k}_" for k in keys))


def quantiles(df: DataFrame, x: Column, keys: Sequence[str] = (), at: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(key, q10, ...): exact quantiles; null where there is no value."""
    every = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    out = _with_quantiles(every, exact_quantiles(df, x, at, keys), keys)
    return out.select(*keys, *(F.col("_q")[i].alias(f"q{round(100 * p):02d}") for i, p in enumerate(at)))


def value_shares(df: DataFrame, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """(key, value, n, share) of the values of ``x`` that are not null."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row a value
    n = df.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("value")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(w))


def events_per_day(df: DataFrame, ts: str = TS, keys: Sequence[str] = ()) -> DataFrame:
    """(key, days, median, q1, q3, iqr) of events on days that have any."""
    days = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    q = days.groupBy(*keys).agg(F.count("*").alias("days"), F.percentile("n", F.array(*map(F.lit, (0.5, 0.25, 0.75)))).alias("q"))
    return q.select(*keys, "days", *(F.col("q")[i].alias(n) for i, n in enumerate(("median", "q1", "q3"))), (F.col("q")[2] - F.col("q")[1]).alias("iqr"))


def label_shares(labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return labels.groupBy(*keys).agg(F.count("*").alias("n"), *((100 * share(F.col("label") == v)).alias(n) for v, n in ((1, "pct_up"), (0, "pct_none"), (-1, "pct_down"))))


def label_shares_by_day(labels: DataFrame, keys: Sequence[str] = KEYS, t0: str = "t0") -> DataFrame:
    return label_shares(labels.withColumn("day", F.to_date(t0)), [*keys, "day"])


def holding_times(labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(key, quantiles of the minutes an event lasts, share that last a minute or less)."""
    held = labels.withColumn("_m", seconds(F.col("t0"), F.col("t_end")) / 60)
    return quantiles(held, F.col("_m"), keys).join(held.groupBy(*keys).agg(share(F.col("_m") <= 1).alias("share_upto_1m")), [*keys])


def no_hit_check(labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Of events that hit no barrier: how many end at the vertical barrier, and how many where they began."""
    return labels.filter("label = 0").groupBy(*keys).agg(F.count("*").alias("n"), share(F.col("t_end") == F.col("t1_vert")).alias("at_vertical"), share(F.col("t_end") == F.col("t0")).alias("at_start"))


def side_checks(events: DataFrame, least: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """(key, share of events without a side, correlation of side_score and label over complete rows if ``least`` or more)."""
    both = F.col("side_score").isNotNull() & F.col("label").isNotNull()
    corr = F.corr(F.when(both, F.col("side_score")), F.when(both, F.col("label").cast("double")))
    return events.groupBy(*keys).agg(share(F.col("side").isNull()).alias("side_missing"), F.count_if(both).alias("n"), F.when(F.count_if(both) >= least, corr).alias("score_label_corr"))


def score_jumps(bars: DataFrame, events: DataFrame, least: int = 20, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Quantiles of how far side_score at an event is from the bar before: large ones hint at looking ahead."""
    steps = look_back(alike(bars.select(*keys, ts, "side_score"), bars), 1, lambda w: {"_j": F.abs(F.col("side_score") - F.lag("side_score").over(w))}, keys, ts)
    jump = steps.join(events.select(*keys, ts).distinct(), [*keys, ts])
    enough = jump.groupBy(*keys).agg(F.count("_j").alias("n")).filter(F.col("n") >= least)
    return quantiles(jump, F.col("_j"), keys).join(enough, [*keys])


def concurrency_stats(bars: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """(key, active bars, mean, p50, p90) of how many events are open at a bar, over bars with any."""
    c = concurrency(bars, labels, keys, ts).filter("concurrency > 0")
    q = c.groupBy(*keys).agg(F.count("*").alias("bars"), F.avg("concurrency").alias("mean"), F.percentile("concurrency", F.array(F.lit(0.5), F.lit(0.9))).alias("q"))
    return q.select(*keys, "bars", "mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"))


def tidy(section: str, df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(key, section, metric, value) of a table with one row a key."""
    rest = [c for c, kind in df.dtypes if c not in keys and kind in ("double", "bigint", "int", "float")]
    cells = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in rest))
    return df.select(*keys, F.lit(section).alias("section"), F.explode(cells).alias("x")).select(*keys, "section", "x.*")


def diagnostics(bars: DataFrame, events: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """All checks of labelled events (t0, t1_vert, t_end, label, side, side_score) in one tidy table."""
    gap = events.select(*keys, (seconds(F.lag("t0").over(Window.partitionBy(*keys).orderBy("t0")), F.col("t0")) / 60).alias("_g"))
    parts = {
        "events per day": events_per_day(events, "t0", keys),
        "minutes between events": quantiles(gap, F.col("_g"), keys),
        "concurrency": concurrency_stats(bars, events, keys, ts),
        "labels": label_shares(events, keys),
        "holding": holding_times(events, keys),
        "no hit": no_hit_check(events, keys),
        "side": side_checks(events, keys=keys),
        "score jumps": score_jumps(bars, events.withColumnRenamed("t0", ts), keys=keys, ts=ts),
    }
    out = None
    for name, df in parts.items():
        out = tidy(name, df, keys) if out is None else out.unionByName(tidy(name, df, keys))
    return out


def diagnostics_of_files(spark: SparkSession, events: str, bars: str, time: str = "t0", keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """``diagnostics`` of labelled events that were written, by the bars they were sampled from. Rows whose ``time`` is null
    don't count; a file without that column or a label is an error."""
    found = with_nanoseconds(spark).read.parquet(events)
    if missing := {time, "label"} - set(found.columns):
        raise ValueError(f"no {', '.join(sorted(missing))} in {events}")
    rows = found.filter(F.col(time).isNotNull()).withColumn("t0", utc_time(found, time))
    ends = [utc_time(rows, c).alias(c) if c in rows.columns else F.lit(None).cast("timestamp_ntz").alias(c) for c in ("t_end", "t1_vert")]
    sides = [F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in ("side", "side_score")]
    return diagnostics(spark.read.parquet(bars), rows.select(*keys, "t0", *ends, "label", *sides), keys, ts)


def preview(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows, as reports show them."""
    return df.orderBy(*order).limit(n)


def deciles(df: DataFrame, score: str, outcome: str, tie: str, keys: Sequence[str] = (), n: int = 10) -> DataFrame:
    """(key, bucket, n, mean score, mean outcome): rows in ``n`` buckets of equal size by ``score``, ties by ``tie``."""
    x = numbered(df.filter(F.col(score).isNotNull() & F.col(outcome).isNotNull()), [score, tie], keys)
    size = x.groupBy(*keys).agg(F.count("*").alias("_size"))
    size = size.select(*(F.col(k).alias(f"{k}_") for k in keys), "_size")
    x = x.join(size, same(x, size, keys)) if keys else x.join(F.broadcast(size), F.lit(True))  # one row without keys
    x = x.withColumn("bucket", block_of(F.col("_n"), F.col("_size"), n) + 1)
    return x.groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(outcome).alias("mean_outcome"))


def decile_order(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(key, rank_corr): the rank correlation of buckets' mean score and mean outcome; equals share their average rank."""
    x = with_average_rank(with_average_rank(table, "mean_score", "_a", keys), "mean_outcome", "_b", keys)
    return x.groupBy(*keys).agg(F.corr("_a", "_b").alias("rank_corr"))


def take_rates(df: DataFrame, take: Column, side: str = "side", keys: Sequence[str] = ()) -> DataFrame:
    """(key, side, n, share of all, taken, share of taken, take_rate)."""
    n = df.filter(F.col(side).isNotNull()).groupBy(*keys, F.col(side).alias("side")).agg(F.count("*").alias("n"), F.count_if(take).alias("taken"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row a side
    return n.withColumns({"share": F.col("n") / F.sum("n").over(w), "share_taken": F.col("taken") / F.nullif(F.sum("taken").over(w), F.lit(0)), "take_rate": F.col("taken") / F.col("n")})


def backtest_report(df: DataFrame, take: Column, splits: DataFrame, payoff: str = "fwd_log_ret", side: str = "side", first: int = 3) -> DataFrame:
    """(section, item, metric, value) of a backtest's rows (row_idx, t0, t_end): how payoffs are distributed, sides and how
    often they are taken, and what the ``first`` folds share between training and test."""
    from tidemill.operators.cv import overlaps

    def cells(section: str, x: DataFrame, item: str | None) -> DataFrame:
        at = F.lit("") if item is None else F.col(item).cast("string")
        rest = [c for c in x.columns if c != item]
        return x.select(F.lit(section).alias("section"), at.alias("item"), F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in rest))).alias("x")).select("section", "item", "x.*")

    above = df.agg(share(F.col(payoff) > 0).alias("share_above_zero"))
    out = cells("payoff", describe(df, payoff), None).unionByName(cells("payoff", above, None))
    out = out.unionByName(cells("side", take_rates(df, take, side), "side"))
    return out.unionByName(cells("fold", overlaps(df, splits.filter(F.col("fold") <= first)), "fold"))


def family(strategy: Column) -> Column:
    return F.regexp_replace(strategy, r"__q\d{2,3}$", "")


def best_strategies(metrics: DataFrame, keys: Sequence[str] = ("pair", "scheme")) -> DataFrame:
    """Per key the row with the greatest dsr, or without any the greatest sharpe; of equals that with the greater sharpe."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("dsr"), F.desc_nulls_last("sharpe"), "strategy")
    return metrics.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").withColumnRenamed("strategy", "best_strategy")


def model_summary(metrics: DataFrame) -> DataFrame:
    """Per model family: strategies, means without nulls, shares above thresholds (a null is not above)."""
    over = lambda c, t: share(F.coalesce(F.col(c) > t, F.lit(False)))
    return metrics.groupBy(family(F.col("strategy")).alias("model")).agg(
        F.count("*").alias("n_strategies"), F.avg("sharpe").alias("avg_sharpe"), F.avg("dsr").alias("avg_dsr"), over("dsr", 0.5).alias("frac_dsr_gt_0_5"), F.avg("PBO").alias("avg_PBO"),
        F.avg("perf_degradation").alias("avg_perf_degradation"), F.avg("prob_loss").alias("avg_prob_loss"), over("sharpe", 1.0).alias("frac_sharpe_gt_1"),
    )


def best_cases(metrics: DataFrame) -> DataFrame:
    """Per model family the row with the greatest sharpe."""
    rows = metrics.withColumn("model", family(F.col("strategy")))
    w = Window.partitionBy("model").orderBy(F.desc_nulls_last("sharpe"), "pair", "scheme", "strategy")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def robustness(metrics: DataFrame, sharpe: float = 1.0, dsr: float = 0.5, pbo: float = 0.1, degradation: float = -0.3) -> DataFrame:
    """Per model family the shares of rows past each threshold."""
    past = lambda x: share(F.coalesce(x, F.lit(False)))
    c = F.col
    return metrics.groupBy(family(c("strategy")).alias("model")).agg(
        F.count("*").alias("n_scenarios"), past(c("sharpe") > sharpe).alias("frac_sharpe_gt_thr"), past(c("dsr") > dsr).alias("frac_dsr_gt_thr"), past(c("PBO") < pbo).alias("frac_pbo_lt_thr"), past(c("perf_degradation") > degradation).alias("frac_perfdeg_gt_thr")
    )
