"""Frames dealt in parts give what whole ones give; writers; properties of labels and cleaning."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill import frames
from tidemill.operators import clean, features, labels, report
from tidemill.plans import stages
from tidemill.sources import sinks


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(11)
    start, rows = datetime(2024, 1, 8), []
    for pair in ("AAA_BBB", "CCC_DDD"):
        price = 100 + np.cumsum(rng.normal(size=900)) * 0.2
        for i, p in enumerate(price):
            if rng.random() > 0.05:
                o, c = float(round(p, 1)), float(round(p + rng.normal() * 0.2, 1))
                rows.append((pair, start + timedelta(minutes=10 * i), o, max(o, c) + 0.1, min(o, c) - 0.1, c))
    df = spark.createDataFrame(rows, "pair string, ts timestamp_ntz, open double, high double, low double, close double")
    return df.cache()


@pytest.mark.parametrize("block", [25, 1000, None])
def test_positions_and_sums(bars, block):
    x = frames.running_sum(frames.with_position(bars, block=block), F.col("close"), "total", block=block).orderBy("pair", "ts").toPandas()
    for _, g in x.groupby("pair"):
        assert g.pos.tolist() == list(range(len(g))) and np.allclose(g.total, g.close.cumsum())


def test_lengths_of_keys_are_counted_once(spark, bars):
    first = frames.longest(bars)
    assert first == bars.groupBy("pair").count().agg(F.max("count")).first()[0]
    made = features.with_returns(bars.withColumn("log_mid", F.ln("close")), vol=20)
    assert made._longest == {("pair",): first}
    spark.sparkContext.setJobGroup("none", "none")
    frames.running_sum(features.momentum_side(made, vol="vol_20"), F.col("close"), "s")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("none")) <= 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("back, block", [(1, 10), (30, 40), (200, 90), (700, 300)])
def test_days_are_dealt_with_what_is_before(bars, back, block):
    """A window that reads far back, over blocks that are smaller than that, sees the rows that the whole key shows it."""
    build = lambda w: {"n": F.count("*").over(w.rowsBetween(-back, 0)), "s": F.sum("close").over(w.rowsBetween(-back, 0))}
    a, b = (frames.look_back(bars, back, build, block=x).orderBy("pair", "ts").select("n", "s").toPandas() for x in (None, block))
    assert len(a) == len(b) and np.allclose(a, b)


@pytest.mark.parametrize("block", [25, 300])
def test_blocks_give_what_whole_keys_give(bars, block):
    x = bars.withColumn("log_mid", F.ln("close"))
    whole, parts = (features.with_returns(x, vol=20, block=b).orderBy("pair", "ts").select("ret_1", "ret_5", "vol_20").toPandas() for b in (None, block))
    assert np.allclose(whole, parts, equal_nan=True)
    a, b = (clean.gaps(bars, 10, None, 10, block=n).orderBy("pair", "gap_start").toPandas() for n in (None, block))
    assert a.equals(b)


def test_stale_filter_settles(bars):
    once = clean.without_stale(bars, longest=2)
    assert once.count() < bars.count() and clean.without_stale(once, longest=2).count() == once.count()


def test_wider_barriers_are_hit_less(bars):
    x = features.with_returns(bars.withColumn("log_mid", F.ln("close")), vol=20).filter("vol_20 is not null and hour(ts) between 8 and 17")
    hits = [labels.triple_barrier(x, x, labels.Barriers(12, m, m, vol="vol_20")).agg(F.count_if(F.col("label") != 0)).first()[0] for m in (0.5, 1.0, 2.0, 8.0)]
    assert hits == sorted(hits, reverse=True) and hits[0] > hits[-1]


def test_stages_from_raw_bars_to_labels(bars):
    ask = bars.select("pair", "ts", *((F.col(c) + 0.05).alias(c) for c in ("open", "high", "low", "close")), F.lit("ASK").alias("side"))
    raw = bars.withColumn("side", F.lit("BID")).unionByName(ask).withColumn("ordinal", F.monotonically_increasing_id())
    cleaned = stages.clean_stage(raw, 10, block=200)
    joined = stages.join_stage(cleaned["bars"], 10, block=200)
    assert joined["bars"].count() == bars.filter(clean.in_fx_week(F.col("ts"))).count() and joined["invalid_blocks"].count() == 0
    p = stages.FeatureParams(horizon=6, minutes=10, vol=20, k=1.0, spacing_minutes=20, barrier=1.0, lookback=5)
    whole, parts = (stages.feature_stage(joined["bars"], stages.FeatureParams(**{**p.__dict__, "block": b})) for b in (None, 100))
    key = lambda d: sorted((r.pair, r.ts, r.label, r.t_end, round(r.weight, 9)) for r in d.collect())
    rows = key(whole)
    assert rows and rows == key(parts)
    for pair in {r[0] for r in rows}:
        assert sum(r[4] for r in rows if r[0] == pair) == pytest.approx(sum(r[0] == pair for r in rows))
    x = stages.modelling_rows(whole.withColumn("side", F.coalesce("side", F.lit(1.0))), joined["bars"])
    assert x.filter("fwd_log_ret is null").count() == 0
    text = report.diagnostics(stages.features.reversion_side(features.with_returns(features.with_mid(joined["bars"]), vol=20), 5, vol="vol_20"), whole.withColumnRenamed("ts", "t0"))
    assert {r.section for r in text.select("section").distinct().collect()} >= {"labels", "holding", "side", "concurrency"}


def test_writers(spark, bars, tmp_path):
    sinks.write_parquet(bars, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("pair = 'AAA_BBB'").count() == bars.filter("pair = 'AAA_BBB'").count()
    sinks.write_csv(bars.limit(3), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == bars.columns
    assert sinks.rounded(bars.select((F.lit(1.23456789)).alias("x")), 3).first().x == 1.235
    w = sinks.wide(spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "a", 4.0)], "row_idx int, strategy string, ret double"), ["row_idx"], "strategy", "ret").orderBy("row_idx").collect()
    assert [tuple(r) for r in w] == [(1, 2.0, 3.0), (2, 4.0, None)]
    seen, metrics = sinks.observed(bars, "rows", n=F.count(F.lit(1)))
    seen.write.format("noop").mode("overwrite").save()
    assert metrics.get["n"] == bars.count()


def test_times(spark):
    from pyspark.errors import PySparkException

    rows = spark.createDataFrame([("2024-01-08 09:00:00",), ("x",), (None,)], "t string")
    assert clean.parse_time(rows, "t", "Europe/Berlin").first().t == datetime(2024, 1, 8, 8)
    assert clean.strict_time(rows.filter("t <> 'x' or t is null"), "t").count() == 2
    with pytest.raises(PySparkException):
        clean.strict_time(rows, "t").collect()
    x = clean.without_empty_columns(clean.numeric(spark.createDataFrame([("1", "a"), ("NaN", "b")], "u string, v string"), ["u", "v"], None), ["u", "v"])
    assert x.columns == ["u"]


@pytest.mark.parametrize("k, spacing, block", [(1.5, 0.0, 24), (3.0, 7 * 3600.0, 100), (40.0, 0.0, 150), (1e9, 0.0, 200), (2.0, 5400.0, 100_000)])
def test_blocks_of_cusum_equal_one_walk(spark, k, spacing, block):
    """Random series with missing values and thresholds of zero; with a large ``k`` states are carried through many blocks."""
    from tidemill.operators import events

    rng, start, rows, want = np.random.default_rng(int(k)), datetime(2024, 1, 1), [], []
    for pair in ("A", "B"):
        n = 500 if pair == "A" else 40
        r = rng.normal(size=n) + (0.3 if k > 3 else 0.0)
        s = np.where(rng.random(n) < 0.05, 0.0, rng.uniform(0.5, 1.5, n))
        r[rng.random(n) < 0.05] = np.nan
        times = [start + timedelta(hours=int(h)) for h in np.cumsum(rng.integers(1, 4, n))]
        rows += [(pair, t, float(x), float(v)) for t, x, v in zip(times, r, s)]
        found = events.Cusum(k, spacing, []).steps([t.timestamp() for t in times], r.tolist(), s.tolist(), [0.0] * n)
        want += [(pair, times[i], way) for i, way in found]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "pair string, ts timestamp_ntz, ret_1 double, vol_60 double")
    got = events.cusum_events(df, k=k, spacing_seconds=spacing, block=block).collect()
    assert sorted(tuple(x) for x in got) == sorted(want) and (len(want) > 3 or k == 1e9)


def test_blocks_of_a_long_key_are_many_groups(spark):
    from tidemill.frames import with_block

    df = spark.range(20_000).select(F.lit("A").alias("pair"), (F.timestamp_seconds(F.col("id") * 600)).cast("timestamp_ntz").alias("ts"))
    sizes = [r["count"] for r in with_block(df, block=1000).groupBy("_b").count().collect()]
    assert len(sizes) >= 17 and max(sizes) <= 1000 + 144


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("most", [10, 10**6])
def test_many_quantiles_in_one_selection(spark, keys, most):
    """Ties, heavy tails, a null key, keys of one value and of none; by a sketch and by one aggregation."""
    import pandas as pd

    rng, shares = np.random.default_rng(3), [0.0, 0.01, 0.25, 0.5, 0.5001, 0.9, 0.999, 1.0]
    rows = [("a", float(x)) for x in np.round(rng.standard_cauchy(5000), 2)] + [("b", float(x)) for x in rng.integers(0, 3, 900)] + [("c", 7.0), ("d", None)] + [(None, float(x)) for x in range(40)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r.k if keys else "": r["_q"] for r in frames.exact_quantiles(df, F.col("x"), shares, keys, accuracy=200, most=most).collect()}
    x = pd.DataFrame(rows, columns=["k", "x"]).dropna(subset=["x"])
    want = {(None if k != k else k): g.x.quantile(shares).tolist() for k, g in x.groupby("k", dropna=False)} if keys else {"": x.x.quantile(shares).tolist()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9)
