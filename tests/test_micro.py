"""Hand-made cases whose results follow from the definitions."""

import math
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import normal
from tidemill.operators import clean, cscv, cv, events, labels, montecarlo, stats
from tidemill.operators.costs import takes
from tidemill.sources import bars as sources
from tidemill.sources.sinks import sheet_name

D = datetime


def series(spark, rows, names):
    return spark.createDataFrame(rows, names)


def ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def minutes(*at):
    return [D(2024, 1, 8, 9) + timedelta(minutes=m) for m in at]


def test_trading_week(spark):
    times = [D(2024, 1, 5, 22), D(2024, 1, 5, 22, 1), D(2024, 1, 6, 12), D(2024, 1, 7, 21, 59), D(2024, 1, 7, 22), D(2024, 1, 8)]
    rows = series(spark, [(i, t) for i, t in enumerate(times)], "i int, ts timestamp_ntz")
    assert sorted(r.i for r in rows.filter(clean.in_fx_week(F.col("ts"))).collect()) == [0, 4, 5]


def test_stale_runs(spark):
    rows = series(spark, [("P", t, c) for t, c in zip(minutes(0, 1, 2, 3, 4), (1.0, 1.0, 1.0, 2.0, 2.0))], "pair string, ts timestamp_ntz, close double")
    assert [r.ts.minute for r in clean.without_stale(rows, longest=3).orderBy("ts").collect()] == [0, 3, 4]
    assert clean.without_stale(rows.drop("close")).count() == 5


def test_gaps(spark):
    make = lambda *at: series(spark, [("P", t) for t in at], "pair string, ts timestamp_ntz")
    g = clean.gaps(make(*minutes(0, 1, 5)), 1, 2880).first()
    assert (g.gap_start.minute, g.gap_end.minute, g.gap_missing, g.gap_seconds) == (2, 4, 3, 240)
    g = clean.gaps(make(D(2024, 1, 8), D(2024, 1, 8, 0, 1, 30)), 1, 2880).first()
    assert (g.gap_missing, g.gap_start, g.gap_end) == (0, D(2024, 1, 8, 0, 1), D(2024, 1, 8, 0, 0, 30))
    weekend = make(D(2024, 1, 5, 22), D(2024, 1, 7, 22))
    assert clean.gaps(weekend, 1, 2880).count() == 1 and clean.gaps(weekend, 2880, None).count() == 0


def test_sane_prices(spark):
    rows = series(spark, [(1, 1.0, 1.0, 1.0, 1.0), (2, 1.0, 0.9, 0.8, 1.0), (3, None, 1.0, 0.9, 0.95), (4, 0.0, 1.0, 0.0, 1.0)], "i int, open double, high double, low double, close double")
    assert sorted(r.i for r in rows.filter(clean.sane()).collect()) == [1, 3]


def test_last_of_duplicates(spark):
    rows = series(spark, [(1, 1, "a"), (1, 2, "b"), (2, 3, None)], "k int, n int, x string")
    assert {(r.k, r.x) for r in clean.last_of_each(rows, ["k"], "n").collect()} == {(1, "b"), (2, None)}


def test_weights_and_concurrency(spark):
    at = minutes(0, 1, 2, 3)
    bars = series(spark, [("P", t, float(i)) for i, t in enumerate(at)], "pair string, ts timestamp_ntz, ret_1 double")
    spans = series(spark, [("P", at[0], at[1]), ("P", at[1], at[2]), ("P", at[3], at[2])], "pair string, t0 timestamp_ntz, t_end timestamp_ntz")
    assert [r.concurrency for r in labels.concurrency(bars, spans).orderBy("ts").collect()] == [1, 2, 1, 0]
    w = [r.weight for r in labels.sample_weights(bars, spans).orderBy("t0").collect()]
    assert w == pytest.approx([0.33557047, 1.66442953], abs=1e-8) and sum(w) == pytest.approx(2)


def steps(times, r, sigma, k, spacing):
    return events.Cusum(k, spacing, []).steps(times, r, sigma, [0.0] * len(r))


def test_cusum():
    r = [2.0, 2.0, -5.0, 1.0]
    assert steps([0, 1, 2, 3], r, [1.0] * 4, 3, 0) == [(1, 1), (2, -1)]
    assert steps([0, 1, 2, 3], r, [1.0] * 4, 3, 2) == [(1, 1)]
    assert steps([0, 1], [float("nan"), 9.0], [1.0, 0.0], 3, 0) == []
    parts = events.Cusum(3, 0, [])
    assert parts.steps([0], r[:1], [1.0], [0.0]) == [] and parts.steps([1, 2, 3], r[1:], [1.0] * 3, [0.0] * 3) == [(0, 1), (1, -1)]


@pytest.mark.parametrize("span", [3, 10])
def test_weighted_deviation(spark, span):
    """Against pandas, with nulls at the start, within and across the borders of blocks."""
    import numpy as np
    import pandas as pd

    from tidemill.operators.features import with_ewma

    rng = np.random.default_rng(0)
    x = rng.normal(size=3500) + 1000
    x[[0, 1, 20, 21, 50, 149, 150, 1650, *range(1400, 1420)]] = np.nan
    rows = [(p, D(2024, 1, 1) + timedelta(minutes=i), None if v != v else float(v) * k) for p, k in (("a", 1), ("b", 3)) for i, v in enumerate(x)]
    got = with_ewma(spark.createDataFrame([*rows, ("c", D(2024, 1, 1), None)], "pair string, ts timestamp_ntz, r double"), "r", span).toPandas()
    want = pd.Series(x).ewm(span=span, adjust=False).std()
    for p, k in (("a", 1), ("b", 3)):
        own = got[got.pair == p].sort_values("ts")[f"ewma_{span}"].to_numpy(float)
        assert np.allclose(own, want * k, rtol=1e-7, equal_nan=True)
    assert got[got.pair == "c"][f"ewma_{span}"].isna().all() and len(got) == 7001


def test_exact_quantiles(spark):
    import numpy as np

    from tidemill.frames import exact_quantile

    rng = np.random.default_rng(1)
    sets = {"ties": [0.0] * 500 + [1.0] * 3, "few": [3.0], "two": [1.0, 2.0], "many": rng.normal(size=5000).tolist(), "null": [None, None]}
    df = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "pair string, x double")
    for share in (0.0, 0.05, 0.5, 0.99, 1.0):
        for most in (0, 10**6):
            got = {r.pair: r["_q"] for r in exact_quantile(df, "x", share, accuracy=100, most=most).collect()}
            assert got == pytest.approx({k: np.quantile(v, share) for k, v in sets.items() if k != "null"})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-3, 3), max_size=60), st.integers(0, 5))
def test_cusum_spacing(r, spacing):
    found = steps(list(range(len(r))), r, [1.0] * len(r), 1.5, spacing)
    assert all(b - a >= spacing for (a, _), (b, _) in zip(found, found[1:]))


def test_barriers(spark):
    at = minutes(0, 1, 2, 3)
    frame = series(spark, [("P", t, p, 1.0) for t, p in zip(at, (0.0, 0.5, 1.2, -2.0))], "pair string, ts timestamp_ntz, log_mid double, vol double")
    run = lambda h, i: labels.triple_barrier(frame, frame.filter(F.col("ts") == F.lit(at[i]).cast("timestamp_ntz")), labels.Barriers(h, 1, 1, vol="vol")).first()
    a = run(3, 0)
    assert (a.label, a.t_end, a.t1_vert) == (1, at[2], at[3])
    a = run(1, 0)
    assert (a.label, a.t_end, a.t1_vert) == (0, at[1], at[1])
    a = run(3, 3)
    assert (a.label, a.t_end, a.t1_vert) == (0, at[3], at[3])


def test_daily_sharpe(spark):
    m = series(spark, [("s", D(2024, 1, 1, 9), 0.01), ("s", D(2024, 1, 1, 10), 0.02), ("s", D(2024, 1, 3), -0.01)], "strategy string, t0 timestamp_ntz, ret double")
    days = stats.daily_returns(m)
    assert [r.ret for r in days.orderBy("day").collect()] == pytest.approx([0.03, 0, -0.01])
    r = days.groupBy("strategy").agg(stats.sharpe(F.col("ret")).alias("a"), stats.sortino(F.col("ret")).alias("b")).first()
    assert (r.a, r.b) == pytest.approx((5.08391127, 18.33030278), abs=1e-7)


def test_relative_rank(spark):
    rows = [(i, s, v) for i in range(8) for s, v in (("A", 5.0 if i < 4 else 0.1), ("B", 0.2), ("C", 0.2))]
    m = series(spark, rows, "row_idx int, strategy string, ret double")
    first = cscv.cscv(m, 8, blocks=2).filter("combo = 0").first()
    assert (first.best_IS, first.relative_rank_OOS) == ("A", 0.75) and first.logit == pytest.approx(math.log(3))
    second = cscv.cscv(m, 8, blocks=2).filter("combo = 1").first()
    assert (second.best_IS, second.relative_rank_OOS) == ("B", 0.625)


def test_walk_forward():
    assert cv.walk_forward_bounds(20, 5) == [(1, 5, 8), (2, 8, 11), (3, 11, 14), (4, 14, 17), (5, 17, 20)]
    assert [b - a for a, b in cv.block_bounds(20, 6)] == [4, 4, 3, 3, 3, 3]


def test_cpcv_coverage(spark):
    x = spark.range(20).withColumnRenamed("id", "row_idx")
    n = {r.row_idx: r.n for r in cv.test_counts(cv.cpcv(x, 20, 6, 12)).collect()}
    assert [n[a] for a, _ in cv.block_bounds(20, 6)] == [2, 6, 6, 7, 7, 8]
    assert cv.cpcv(x, 20, 6).select("fold").distinct().count() == 20
    with pytest.raises(ValueError):
        cv.cpcv(x, 20, 6, drop_remainder=True)


def test_purge_and_embargo(spark):
    t = lambda h, m: D(2024, 1, 8, h, m)
    spans = [(t(10, 33), t(11, 0)), (t(10, 20), t(10, 30)), (t(10, 10), t(10, 27)), (t(11, 45), t(12, 10)), (t(12, 1), t(12, 20))]
    x = series(spark, [(i, a, b) for i, (a, b) in enumerate(spans)], "row_idx int, t0 timestamp_ntz, t_end timestamp_ntz")
    kept = lambda end: {r.row_idx for r in cv.cpcv(x, 5, 2, purge=300, embargo=3600, end=end).filter("fold = 2 and role = 'train'").collect()}
    assert kept("last") == {3, 4}  # the test run 0..2 ends at 10:27, when its last row does
    assert kept("max") == {4}  # or at 11:00, when the last of its events does: 3 starts within the embargo
    single = [(0, t(9, 0), t(9, 1)), (1, *spans[1]), (2, *spans[2]), (3, *spans[3]), (4, *spans[4])]
    y = series(spark, single, "row_idx int, t0 timestamp_ntz, t_end timestamp_ntz")
    assert cv.overlaps(y, cv.cpcv(y, 5, 2, purge=0)).filter("overlapping > 0").count() == 0


def test_runs(spark):
    x = series(spark, [(1, i) for i in (1, 2, 2, 3, 7, 9, 10)], "g int, row_idx int")
    assert sorted((r.start, r.stop) for r in cv.contiguous_runs(x, ["g"]).collect()) == [(1, 3), (7, 7), (9, 10)]


def test_normal(spark):
    assert normal.expected_max(20) == pytest.approx(1.90070795, abs=1e-7)
    assert montecarlo.min_backtest_length(1, 1.0) is None
    r = spark.range(1).select(normal.cdf(F.lit(1.96)).alias("a"), normal.quantile(F.lit(0.975)).alias("b"), normal.quantile(F.lit(0.0)).alias("c")).first()
    assert (r.a, r.b) == pytest.approx((0.9750021, 1.959964), abs=1e-6) and r.c is None


def test_takes(spark):
    x = series(spark, [(2e-4,), (-1e-4,), (1e-4,)], "p double")
    own, compat = ([r[0] for r in x.select(takes(F.col("p"), F.lit(1.5e-4), c)).collect()] for c in (False, True))
    assert own == [True, False, False] and compat == [False, False, True]


def test_average_twice(spark):
    x = series(spark, [(1, "s", 2.0), (1, "s", 4.0)], "row_idx int, strategy string, ret double")
    assert cv.accumulate(x).first().ret == 3 and cv.accumulate(x, compat=True).first().ret == 1.5


def test_csv_reader(spark, tmp_path):
    (tmp_path / "EURUSD_BID_2007.csv").write_text("timestamp,open,high,low,close,volume\n2024-01-08 09:00:00,1,2,0.5,1.5,9\nbad,1,1,1,1,1\n2024-01-08 09:01:00,NaN,x,1,1,1\n")
    (tmp_path / "eur_usd_ASK_all.csv").write_text("timestamp,open,close\n2024-01-08 09:00:00,1,2\n")
    rows = sources.read_bars(spark, f"{tmp_path}/*.csv", mixed=True).orderBy("side", "ordinal").collect()
    assert {(r.pair, r.side) for r in rows} == {("EUR_USD", "BID"), ("EUR_USD", "ASK")}
    assert rows[0].high is None and rows[3].open is None and rows[3].high is None and rows[2].ts is None and rows[0].close == 2
    assert sources.paired_sides(sources.read_bars(spark, f"{tmp_path}/*.csv", mixed=True)).first().complete


def test_index_lists(spark):
    x = series(spark, [("[1, 2]",), ("(3,4,)",), ("",), (None,)], "c string")
    assert [r[0] for r in x.select(sources.index_list(F.col("c"))).collect()] == [[1, 2], [3, 4], [], []]


def test_discovery(spark):
    x = series(spark, [("/d/EUR_USD_x_WF_M.parquet",), ("/d/EUR_USD_x_WF_splits.parquet",), ("/d/GBP_USD_y_CPCV_M.parquet",), ("/d/z_WF_counts.parquet",)], "path string")
    got = {r.base: r for r in sources.discover_backtests(x).collect()}
    assert set(got) == {"EUR_USD_x", "GBP_USD_y"} and got["EUR_USD_x"].pair == "EUR_USD" and got["EUR_USD_x"].WF_splits and got["GBP_USD_y"].WF_M is None


def test_sheet_names(spark):
    assert spark.range(1).select(sheet_name(F.lit("a/b:c" + "x" * 40))).first()[0] == ("a_b_c" + "x" * 40)[:31]


def test_times_with_zones_are_instants(spark):
    from datetime import datetime as d

    from tidemill.operators import clean

    cells = ["2024-01-01T10:00:00+02:00", "2024-01-01 05:00:00+05:00", "2024-01-01T10:00:00Z", "2024-01-01 10:00", "2024-01-01", "2024-01-01 10:00:00-0830", "x", None, "2024-11-03 01:30:00 America/New_York"]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, t string")
    want = {0: d(2024, 1, 1, 8), 1: d(2024, 1, 1), 2: d(2024, 1, 1, 10), 3: d(2024, 1, 1, 10), 4: d(2024, 1, 1), 5: d(2024, 1, 1, 18, 30), 8: d(2024, 11, 3, 5, 30)}
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "America/New_York"):  # the session's zone changes nothing
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert {r.i: r.t for r in clean.parse_time(df, "t").collect()} == want
            east = {r.i: r.t for r in clean.parse_time(df, "t", "Asia/Tokyo").collect()}
            assert east == {**want, 3: d(2024, 1, 1, 1), 4: d(2023, 12, 31, 15)}
            stored = df.select("i", F.expr("timestamp_micros(1730619000000000L)").alias("t"))  # in an hour that New York repeats
            assert {r.t for r in clean.strict_time(stored, "t").collect()} == {d(2024, 11, 3, 7, 30)}
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)


def test_row_numbers_that_are_none_are_an_error(spark):
    from tidemill.sources.bars import index_list

    df = spark.createDataFrame([("[1, 2]",), ("(3,4,)",), ("",), (None,), ("[5.0, 6]",)], "x string")
    assert [r[0] for r in df.select(index_list(F.col("x"))).collect()] == [[1, 2], [3, 4], [], [], [5, 6]]
    with pytest.raises(Exception, match="no row number: x"):
        spark.createDataFrame([("[1,x,3]",)], "x string").select(index_list(F.col("x"))).collect()


def test_artefacts_of_published_names(spark):
    from tidemill.sources.bars import discover_backtests

    paths = [f"out/EUR_USD_a_{s}.parquet" for s in ("WF_split", "WF_M", "WF_results", "CPCV_split", "CPCV_M", "CPCV_counts")]
    row = discover_backtests(spark.createDataFrame([(p,) for p in paths], "path string")).first()
    assert (row.base, row.pair, row.WF_splits, row.CPCV_splits, row.CPCV_results) == ("EUR_USD_a", "EUR_USD", paths[0], paths[3], None)
