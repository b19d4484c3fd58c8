"""The registered queries over the driver's tables, each with the SQL that says the same.

Doubles are rounded on both sides, as sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.frames import TS, alike, running_sum, with_position
from tidemill.operators import clean, cscv, cv, events, features, labels, montecarlo, quotes, report, stats
from tidemill.operators.costs import classified_return, selected_return, takes, thresholds
from tidemill.plans import adapters as a
from tidemill.plans import backtest, folds, models, stages
from tidemill.sources import bars, published
from tidemill.sources.bars import quotes_from_events
from tidemill.sources.sinks import observed, rounded, sheet_name, wide, write_csv, write_parquet
from tidemill.storage import new_folder, saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 8


def query(sql: str | None = None, digits: int | None = DIGITS):
    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out if digits is None else rounded(out, digits)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rnd(*names: str, digits: int = DIGITS) -> str:
    return ", ".join(f"round({n}, {digits}) as {n.split('.')[-1]}" for n in names)


def bars_sql(minutes: int = 60) -> str:
    return f"""bars as (select 'P' || (e.user_id % 7) as pair, time_bucket(interval '{minutes} minutes', e.ts) as ts, min_by(e.value, e.ts) as open,
        max(e.value) as high, min(e.value) as low, max_by(e.value, e.ts) as close from events e group by 1, 2)"""


BARS = bars_sql()
ASK = "0.0001 * (1 + cast(substr(pair, 2, 3) as double))"
QUOTES = f"""{BARS}, q as (select pair, ts, open as open_bid, high as high_bid, low as low_bid, close as close_bid,
    open + {ASK} as open_ask, high + {ASK} as high_ask, low + {ASK} as low_ask, close + {ASK} as close_ask from bars)"""
FEAT = f"""{QUOTES},
    mids as (select *, 0.5 * (open_bid + open_ask) as open_mid, 0.5 * (high_bid + high_ask) as high_mid, 0.5 * (low_bid + low_ask) as low_mid,
        0.5 * (close_bid + close_ask) as close_mid, ln(nullif(0.5 * (close_bid + close_ask), 0)) as log_mid from q),
    rets as (select *, log_mid - lag(log_mid) over w as ret_1, log_mid - lag(log_mid, 5) over w as ret_5 from mids window w as (partition by pair order by ts)),
    feat as (select *, case when count(ret_1) over w = 20 then stddev_samp(ret_1) over w end as vol_20
        from rets window w as (partition by pair order by ts rows between 19 preceding and current row))"""
SESS = f"""{FEAT}, sess as (select *, row_number() over (partition by pair order by ts) - 1 as pos, cast(ts as date) as d from feat
    where hour(ts) between 8 and 17 and log_mid is not null and vol_20 is not null)"""


def labels_sql(horizon: int, chosen: str, before: str = "") -> str:
    return f"""{SESS}{before}, caps as (select pair, d, max(pos) as cap from sess group by all), lasts as (select pair, max(pos) as final from sess group by all),
    ev as (select pair, ts as t0, pos as i, least(final, pos + {horizon}, greatest(cap, pos)) as j, log_mid + greatest(vol_20, 1e-12) as up, log_mid - greatest(vol_20, 1e-12) as down
        from sess join caps using (pair, d) join lasts using (pair) where {chosen}),
    met as (select ev.pair, t0, b.pos, b.ts, case when b.log_mid >= up then 1 when b.log_mid <= down then -1 end as side
        from ev join sess b on b.pair = ev.pair and b.pos > i and b.pos <= j),
    lab as (select ev.pair, ev.t0, coalesce(max_by(met.ts, met.pos), ev.t0) as t1_vert,
        coalesce(min_by(met.ts, met.pos) filter (where side is not null), max_by(met.ts, met.pos), ev.t0) as t_end,
        coalesce(min_by(side, met.pos) filter (where side is not null), 0) as label
        from ev left join met on met.pair = ev.pair and met.t0 = ev.t0 group by ev.pair, ev.t0)"""


LABELS = labels_sql(6, "abs(ret_1) > vol_20")
COVER_OF = """, full_pos as (select *, row_number() over (partition by pair order by ts) - 1 as p from feat),
    iv as (select lab.*, a.p as s, b.p as e from lab join full_pos a on a.pair = lab.pair and a.ts = t0 join full_pos b on b.pair = lab.pair and b.ts = t_end where b.p >= a.p),
    cover as (select f.pair, f.ts, f.p as pos, count(iv.t0) as concurrency, any_value(f.ret_1) as r from full_pos f left join iv on iv.pair = f.pair and f.p between s and e group by all)"""
COVER = LABELS + COVER_OF
WEIGHTS = """, raw as (select iv.pair, t0, t_end, abs(sum(coalesce(r, 0) / concurrency)) as w from iv join cover c on c.pair = iv.pair and c.pos between s and e group by iv.pair, t0, t_end),
    sc as (select *, w * count(*) over (partition by pair) / sum(w) over (partition by pair) as w1 from raw), tp as (select pair, quantile_cont(w1, 0.99) as top from sc group by pair), cl as (select sc.*, least(w1, top) as w2 from sc join tp using (pair)),
    wt as (select pair, t0, t_end, round(w2 * count(*) over (partition by pair) / sum(w2) over (partition by pair), 6) as weight from cl)"""
MATRIX = """m as (select e.event_id - (select min(event_id) from events) as row_idx, e.ts as t0, k.strategy, case when e.event_type = k.strategy then (e.value - 50) / 10000 else 0.0 end as ret
    from events e, (select distinct event_type as strategy from events) k)"""
DAILY = f"""{MATRIX}, days as (select cast(t0 as date) as day, strategy, sum(ret) as ret from m group by all),
    span as (select min(cast(t0 as date)) as a, max(cast(t0 as date)) as b from m),
    grid as (select cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from span),
    daily as (select k.strategy, g.day, coalesce(d.ret, 0.0) as ret from grid g cross join (select distinct strategy from m) k left join days d on d.day = g.day and d.strategy = k.strategy)"""


# ---- bars and their cleaning


@query(f"with {BARS} select * from bars", None)
def bars_hourly(spark, sf):
    return a.bars(spark, sf)


@query(f"with {bars_sql(15)} select * from bars", None)
def bars_15min(spark, sf):
    return a.bars(spark, sf, 15)


def zoned(ts, k):
    """A time as text: of no zone, in UTC, half past five east, or eight west as files write it in short, by ``k`` from 0 to 3."""
    text = lambda hours, minutes, zone: F.concat(F.date_format(ts + F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(minutes)), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(zone))
    return F.when(k == 0, text(0, 0, "")).when(k == 1, F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit("T"), F.date_format(ts, "HH:mm:ss.SSSSSS"), F.lit("Z"))).when(k == 2, text(5, 30, "+05:30")).otherwise(text(-8, 0, "-0800"))


@query("select event_id, ts, coalesce(try_cast(case when event_id % 7 = 0 then 'n/a' else event_id::varchar end as double), 0) as value from events where event_id % 10 <> 0", None)
def parsed_times(spark, sf):
    """Times of several zones, with offsets and without, in one column."""
    e, at = a.table(spark, sf, "events"), zoned(F.col("ts").cast("timestamp_ntz"), F.col("event_id") % 4)
    e = e.select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("x"), at)).otherwise(at).alias("ts"), F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("event_id").cast("string")).alias("value"))
    return clean.numeric(clean.parse_time(e, "ts"), ["value"])


BENT = "bent as (select pair, ts, open, case when hour(ts) % 5 = 0 then low * 0.9 else high end as high, case when hour(ts) % 7 = 0 then null else low end as low, close from bars)"


@query(f"with {BARS}, {BENT} select * from bent where not coalesce(least(open, high, low, close) <= 0 or coalesce(high < greatest(open, close), false) or coalesce(low > least(open, close), false) or coalesce(high < low, false), false)", None)
def clean_sanity(spark, sf):
    bent = a.bars(spark, sf).withColumns({"high": F.when(F.hour(TS) % 5 == 0, F.col("low") * 0.9).otherwise(F.col("high")), "low": F.when(F.hour(TS) % 7 != 0, F.col("low"))})
    return bent.filter(clean.sane())


WEEK = "(isodow(ts) <= 4 or isodow(ts) = 5 and (hour(ts) < 22 or hour(ts) = 22 and minute(ts) = 0) or isodow(ts) = 7 and hour(ts) >= 22)"


@query(f"with {bars_sql(15)} select * from bars where {WEEK}", None)
def clean_session(spark, sf):
    return a.bars(spark, sf, 15).filter(clean.in_fx_week(F.col(TS)))


@query("select event_type, date_trunc('minute', ts) as ts, max(event_id) as event_id, max_by(value, event_id) as value from events group by 1, 2", None)
def clean_dedupe(spark, sf):
    e = a.table(spark, sf, "events").select("event_type", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), "event_id", "value")
    return clean.last_of_each(e, ["event_type", "ts"], "event_id")


@query(
    f"""with {BARS}, x as (select pair, ts, floor(close / 25) as close from bars), s as (select *, coalesce(close = lag(close) over (partition by pair order by ts), false) as same from x),
    r as (select *, sum(case when same then 0 else 1 end) over (partition by pair order by ts) as run from s), n as (select *, count(*) over (partition by pair, run) as size from r)
    select pair, ts, cast(close as bigint) as close from n where not (same and size >= 3)""",
    None,
)
def stale_runs(spark, sf):
    return clean.without_stale(a.bars(spark, sf).select("pair", TS, F.floor(F.col("close") / 25).alias("close")), longest=3)


def gaps_sql(step: int, above: int, upto: int | None) -> str:
    return f"""with {bars_sql(step)}, g as (select pair, lag(ts) over (partition by pair order by ts) as x, ts as y from bars), h as (select *, date_diff('second', x, y) as gap_seconds from g)
    select pair, x + interval '{step} minutes' as gap_start, y - interval '{step} minutes' as gap_end, cast(greatest(floor(gap_seconds / {60 * step}) - 1, 0) as int) as gap_missing, gap_seconds
    from h where gap_seconds > {above * 60} {f"and gap_seconds <= {upto * 60}" if upto else ""}"""


@query(gaps_sql(15, 15, 120), None)
def gaps_short(spark, sf):
    return clean.gaps(a.bars(spark, sf, 15), 15, 120, 15)


@query(gaps_sql(15, 120, None), None)
def gaps_long(spark, sf):
    return clean.gaps(a.bars(spark, sf, 15), 120, None, 15)


@query(
    f"""with {bars_sql(15)}, b as (select pair, ts, hour(ts) % 3 = 0 or open is null or open = 0 or low = 0 or high = 0 as is_invalid from bars),
    f as (select *, case when lag(ts) over w is null or cast(ts as date) <> cast(lag(ts) over w as date) or date_diff('second', lag(ts) over w, ts) <> 900 or is_invalid <> lag(is_invalid) over w then 1 else 0 end as fresh from b window w as (partition by pair order by ts)),
    k as (select *, sum(fresh) over (partition by pair order by ts) as block from f)
    select pair, min(ts) as start, max(ts) as "end", true as is_invalid, count(*) as n_rows, date_diff('second', min(ts), max(ts)) + 900 as seconds from k where is_invalid group by pair, block having date_diff('second', min(ts), max(ts)) + 900 >= 1800""",
    None,
)
def invalid_blocks(spark, sf):
    return clean.invalid_blocks(a.bars(spark, sf, 15).withColumn("close", F.when(F.hour(TS) % 3 != 0, F.col("close"))), step=15, least=30)


@query(
    f"""with {bars_sql(15)}, w as (select * from bars where {WEEK} and low > 0),
    s as (select *, coalesce(close = lag(close) over (partition by pair order by ts), false) as same from w), r as (select *, sum(case when same then 0 else 1 end) over (partition by pair order by ts) as run from s),
    n as (select *, count(*) over (partition by pair, run) as size from r) select pair, 'BID' as side, ts, open, high, low, close from n where not (same and size >= 60)""",
    None,
)
def cleaned_bars(spark, sf):
    raw = a.bars(spark, sf, 15).withColumn("side", F.lit("BID"))
    twice = raw.withColumn("ordinal", F.lit(2)).unionByName(raw.withColumns({"ordinal": F.lit(1), "close": F.col("close") + 1}))
    return clean.clean_bars(twice).select("pair", "side", TS, "open", "high", "low", "close")


# ---- quotes and features

SIDES = [f"{p}_{s}" for s in ("bid", "ask") for p in ("open", "high", "low", "close")]


@query(f"with {QUOTES} select pair, ts, {rnd(*SIDES)} from q where close_ask > close_bid")
def join_bid_ask(spark, sf):
    return a.quotes(spark, sf).select("pair", TS, *SIDES)


@query(
    f"""with {QUOTES}, s as (select pair, close_ask - close_bid as spread, (close_ask - close_bid) / nullif((close_ask + close_bid) / 2, 0) * 1e4 as spread_bps from q), v as (select * from s where spread_bps > 0 and spread_bps < 1)
    select pair, count(*) as n, (select count(*) from s where s.pair = v.pair) - count(*) as outliers_removed, """
    + ", ".join(f"round({f}({s}), 6) as {s}_{n}" for s in ("spread", "spread_bps") for n, f in (("min", "min"), ("mean", "avg"), ("max", "max")))
    + ", "
    + ", ".join(f"round(quantile_cont({s}, {p}), 6) as {s}_{n}" for s in ("spread", "spread_bps") for n, p in (("p01", 0.01), ("p05", 0.05), ("median", 0.5), ("p95", 0.95), ("p99", 0.99)))
    + " from v group by pair",
    6,
)
def spread_stats(spark, sf):
    return quotes.spread_stats(a.quotes(spark, sf), most_bps=1)


@query(f"with {FEAT} select pair, ts, {rnd('close_mid', 'log_mid', 'ret_1', 'ret_5', 'vol_20')} from feat")
def returns_vol(spark, sf):
    return a.feature_bars(spark, sf).select("pair", TS, "close_mid", "log_mid", "ret_1", "ret_5", "vol_20")


@query(f"with {FEAT} select pair, ts, {rnd('ret_1', 'ret_5', 'vol_20')} from feat")
def returns_vol_by_blocks(spark, sf):
    x = features.with_mid(a.quotes(spark, sf))
    return features.with_returns(x, vol=20, block=100).select("pair", TS, "ret_1", "ret_5", "vol_20")


EWMA_OF = f""", o as (select pair, ts, ret_1 as x, row_number() over (partition by pair order by ts) as n from feat where ret_1 is not null),
    e as (select pair, ts, n, x as mean, 0.0::double as v, 1.0::double as q from o where n = 1
      union all select o.pair, o.ts, o.n, e.mean + 2.0 / 51 * (o.x - e.mean), (1 - 2.0 / 51) * (e.v + 2.0 / 51 * (o.x - e.mean) * (o.x - e.mean)), (1 - 2.0 / 51) * (1 - 2.0 / 51) * e.q + 2.0 / 51 * 2.0 / 51 from e join o on o.pair = e.pair and o.n = e.n + 1),
    ew as (select feat.pair, feat.ts, round(case when e.n > 1 then sqrt(e.v / (1 - e.q)) end, {DIGITS}) as ewma_50 from feat left join e on e.pair = feat.pair and e.ts = feat.ts)"""
EWMA = f"with recursive {FEAT}{EWMA_OF} select * from ew"


@query(EWMA)
def ewma_vol(spark, sf):
    return features.with_ewma(a.feature_bars(spark, sf)).select("pair", TS, "ewma_50")


@query(EWMA)
def ewma_vol_tail(spark, sf):
    return features.with_ewma_tail(a.feature_bars(spark, sf), tail=1000).select("pair", TS, "ewma_50")


EVENT_FEATURES = ["ret_1_abs", "ret_1_roll_std_20", "ret_5_mom_std_ratio", "ret_1_to_vol_20", "vol_20_lag1", "vol_20_roc", "vol_300", "vol_20_to_vol_300", "SP", "CBP", "CAP", "VBP", "VAP", "spread_proxy", "side_score_roll_mean_30", "side_score_roll_std_30"]
SCORED = f"""{SESS}, moves as (select *, log_mid - lag(log_mid, 5) over (partition by pair order by ts) as move from sess),
    zs as (select *, greatest(-3, least(3, -move / (nullif(vol_20, 0) * sqrt(5)))) as score0 from moves), scored as (select *, case when move is not null and vol_20 <> 0 then score0 end as side_score from zs),
    sided as (select *, case when abs(side_score) >= 0.5 then sign(side_score)::double end as side from scored)"""


@query(
    f"""with {SCORED}, w as (select pair, ts, abs(ret_1) as ret_1_abs, case when count(ret_1) over w20 >= 10 then stddev_samp(ret_1) over w20 end as ret_1_roll_std_20,
      ret_1 / (vol_20 + 1e-8) as ret_1_to_vol_20, lag(vol_20) over w as vol_20_lag1, vol_20 / nullif(lag(vol_20) over w, 0) - 1 as vol_20_roc, case when count(ret_1) over w300 >= 60 then stddev_samp(ret_1) over w300 end as vol_300,
      close_bid - close_ask as SP, close_bid - lag(close_bid) over w as CBP, close_ask - lag(close_ask) over w as CAP, high_bid - low_bid as VBP, high_ask - low_ask as VAP, open_ask - open_bid as spread_proxy,
      case when count(side_score) over w30 >= 10 then avg(side_score) over w30 end as side_score_roll_mean_30, case when count(side_score) over w30 >= 10 then stddev_samp(side_score) over w30 end as side_score_roll_std_30, ret_5, vol_20
      from scored window w as (partition by pair order by ts), w20 as (w rows between 19 preceding and current row), w30 as (w rows between 29 preceding and current row), w300 as (w rows between 299 preceding and current row)),
    x as (select *, ret_5 / (ret_1_roll_std_20 + 1e-8) as ret_5_mom_std_ratio, vol_20 / (vol_300 + 1e-8) as vol_20_to_vol_300 from w) select pair, ts, {rnd(*EVENT_FEATURES, digits=6)} from x""".replace("(w rows", "(partition by pair order by ts rows"),
    6,
)
def event_features(spark, sf):
    x = features.reversion_side(a.session_frame(spark, sf), 5, vol="vol_20")
    return features.event_features(x, vol="vol_20").select("pair", TS, *EVENT_FEATURES)


@query(
    f"with {FEAT}, mv as (select *, log_mid - lag(log_mid, 10) over (partition by pair order by ts) as move from feat), z as (select *, case when move is not null and vol_20 <> 0 then greatest(-3, least(3, move / (vol_20 * sqrt(10)))) end as side_score from mv) "
    "select pair, ts, round(side_score, 8) as side_score, case when abs(side_score) >= 0.5 then sign(side_score)::double end as side from z"
)
def side_momentum(spark, sf):
    return features.momentum_side(a.feature_bars(spark, sf), 10, vol="vol_20").select("pair", TS, "side_score", "side")


@query(f"with {SCORED} select pair, ts, round(side_score, 8) as side_score, side from sided")
def side_reversion(spark, sf):
    return features.reversion_side(a.session_frame(spark, sf), 5, vol="vol_20").select("pair", TS, "side_score", "side")


CORR = ("ret_1", "ret_5", "vol_20", "close_mid")


@query(f"with {FEAT}, x as (select * from feat where ret_1 is not null and ret_5 is not null and vol_20 is not null) " + " union all ".join(f"select pair, '{p}' as f1, '{q}' as f2, {'1.0::double' if p == q else f'round(corr({p}, {q}), 8)'} as corr from x group by pair" for p in CORR for q in CORR))
def feature_corr(spark, sf):
    return features.correlations(a.feature_bars(spark, sf), CORR)


@query(f"with {FEAT}, x as (select * from feat where ret_1 is not null and ret_5 is not null and vol_20 is not null), c as (" + " union all ".join(f"select pair, '{p}' as f1, '{q}' as f2, {'1.0::double' if p == q else f'corr({p}, {q})'} as corr from x group by pair" for p in CORR for q in CORR) + ") select f1, f2, round(avg(corr), 8) as corr, count(*) as n from c group by f1, f2")
def mean_feature_corr(spark, sf):
    return features.mean_correlations(features.correlations(a.feature_bars(spark, sf), CORR))


# ---- events and labels


@query(f"with {bars_sql(15)} select pair, ts, hour(ts) between 8 and 17 as in_session, hour(ts) between 8 and 17 and hour(ts) * 60 + minute(ts) + 45 <= 1080 as with_runway from bars", None)
def eligibility(spark, sf):
    t = F.col(TS)
    return a.bars(spark, sf, 15).select("pair", TS, events.in_session(t).alias("in_session"), events.in_session_with_runway(t, 3, 15).alias("with_runway"))


def _cusum(spark, sf):
    bars = saved(a.feature_bars(spark, sf))
    rows = alike(bars.join(events.sigma_floor(bars, "vol_20"), ["pair"]).filter(events.in_session_with_runway(F.col(TS), 2, 60)), bars)
    return rows, events.cusum_events(rows, sigma="vol_20", k=1.0, spacing_seconds=7200, floor="floor")




def cusum_sql(runway: int) -> str:
    return f""", fl as (select pair, quantile_cont(vol_20, 0.05) as floor from feat group by pair),
    el as (select feat.pair, ts, ret_1 as r, greatest(vol_20, floor) as h from feat join fl using (pair) where vol_20 is not null and hour(ts) between 8 and 17 and hour(ts) * 60 + minute(ts) + {runway} <= 1080),
    ok as (select *, row_number() over (partition by pair order by ts) as n from el where r is not null and h > 0),
    st as (select pair, 0::bigint as n, 0.0::double as up, 0.0::double as down, null::timestamp as last, null::timestamp as ts, 0 as way, false as out from (select distinct pair from ok)
      union all select pair, n, case when way = 0 then u else 0 end, case when way = 0 then d else 0 end, case when fire then ts else last end, ts, way, fire from (
        select *, way <> 0 and (last is null or date_diff('second', last, ts) >= 7200) as fire from (
          select *, case when u > h then 1 when d < -h then -1 else 0 end as way from (
            select st.pair, ok.n, ok.ts, ok.h, st.last, greatest(0, st.up + ok.r) as u, least(0, st.down + ok.r) as d from st join ok on ok.pair = st.pair and ok.n = st.n + 1)))),
    cus as (select pair, ts, way as direction from st where out)"""


CUSUM = FEAT + cusum_sql(120)


@query(f"with recursive {CUSUM} select pair, ts, direction from cus", None)
def cusum_events(spark, sf):
    return _cusum(spark, sf)[1]


@query(
    f"""with recursive {CUSUM}, g as (select pair, date_diff('second', lag(ts) over (partition by pair order by ts), ts) / 60 as gap from cus),
    s as (select pair, count(*) as events, quantile_cont(gap, 0.5) as gap_p50 from g group by pair), b as (select pair, count(*) as bars, count(*) filter (where hour(ts) between 8 and 17 and hour(ts) * 60 + minute(ts) + 120 <= 1080) as eligible from feat group by pair)
    select pair, bars, eligible, events, round(eligible / bars, 8) as eligible_share, round(events / eligible, 8) as event_share, round(gap_p50, 8) as gap_p50 from b join s using (pair)"""
)
def filter_stats(spark, sf):
    rows, found = _cusum(spark, sf)
    out = events.filter_stats(a.feature_bars(spark, sf), events.in_session_with_runway(F.col(TS), 2, 60), found)
    return out.select("pair", "bars", "eligible", "events", "eligible_share", "event_share", F.col("gap_minutes")[2].alias("gap_p50"))


@query(f"with {FEAT} select pair, {', '.join(f'round(quantile_cont(abs(ret_1), {p}), 8) as {n}' for n, p in (('p50', 0.5), ('p90', 0.9), ('p99', 0.99)))} from feat group by pair")
def abs_quantiles(spark, sf):
    return events.abs_quantiles(a.feature_bars(spark, sf), "ret_1")


BARRIERS = labels.Barriers(6, 1.0, 1.0, vol="vol_20")


def _labels(spark, sf):
    frame = saved(a.session_frame(spark, sf))
    return labels.triple_barrier(frame, a.large_moves(frame), BARRIERS)


@query(f"with {LABELS} select pair, t0, t1_vert, t_end, label from lab", None)
def triple_barrier(spark, sf):
    return _labels(spark, sf).withColumn("label", F.col("label").cast("int"))


@query(f"with {LABELS}, h as (select pair, date_diff('second', t0, t_end) / 60 as mins from lab) select pair, {', '.join(f'round(quantile_cont(mins, {p}), 8) as q{round(100 * p):02d}' for p in (0.1, 0.25, 0.5, 0.75, 0.9))}, round(avg(case when mins <= 1 then 1.0 else 0 end), 8) as share_upto_1m from h group by pair")
def holding_times(spark, sf):
    return report.holding_times(_labels(spark, sf))


@query(f"with {LABELS} select pair, count(*) as n, {', '.join(f'round(100 * avg(case when label = {v} then 1.0 else 0 end), 8) as {n}' for v, n in ((1, 'pct_up'), (0, 'pct_none'), (-1, 'pct_down')))} from lab group by pair")
def label_shares(spark, sf):
    return report.label_shares(_labels(spark, sf))


@query(f"with {LABELS} select pair, cast(t0 as date) as day, count(*) as n, {', '.join(f'round(100 * avg(case when label = {v} then 1.0 else 0 end), 8) as {n}' for v, n in ((1, 'pct_up'), (0, 'pct_none'), (-1, 'pct_down')))} from lab group by 1, 2")
def label_by_day(spark, sf):
    return report.label_shares_by_day(_labels(spark, sf))


@query(f"with {LABELS} select pair, count(*) as n, round(avg(case when t_end = t1_vert then 1.0 else 0 end), 8) as at_vertical, round(avg(case when t_end = t0 then 1.0 else 0 end), 8) as at_start from lab where label = 0 group by pair")
def nohit_check(spark, sf):
    return report.no_hit_check(_labels(spark, sf))


@query(f"with {COVER} select pair, ts, pos, concurrency from cover", None)
def concurrency(spark, sf):
    return labels.concurrency(a.feature_bars(spark, sf), _labels(spark, sf))


@query(f"with {COVER} select pair, count(*) as bars, round(avg(concurrency), 8) as mean, round(quantile_cont(concurrency, 0.5), 8) as p50, round(quantile_cont(concurrency, 0.9), 8) as p90 from cover where concurrency > 0 group by pair")
def concurrency_stats(spark, sf):
    return report.concurrency_stats(a.feature_bars(spark, sf), _labels(spark, sf))


@query(
    f"with {COVER}{WEIGHTS} select * from wt",
    6,
)
def sample_weights(spark, sf):
    return labels.sample_weights(a.feature_bars(spark, sf), _labels(spark, sf))


@query(
    f"""with {LABELS}, sided as (select lab.*, f.open_bid, f.open_ask, case when f.ret_1 > 0 then -1 else 1 end as side from lab join feat f on f.pair = lab.pair and f.ts = t0)
    select s.pair, s.t0, s.t_end, side, round(case when side > 0 then ln(x.close_bid) - ln(s.open_ask) else ln(s.open_bid) - ln(x.close_ask) end, 8) as fwd_log_ret from sided s left join feat x on x.pair = s.pair and x.ts = s.t_end and x.close_bid > 0"""
)
def fwd_payoff(spark, sf):
    bars = a.feature_bars(spark, sf)
    e = _labels(spark, sf).join(bars.select("pair", F.col(TS).alias("t0"), "open_bid", "open_ask", F.when(F.col("ret_1") > 0, -1).otherwise(1).alias("side")), ["pair", "t0"])
    return labels.payoffs(e, bars).select("pair", "t0", "t_end", "side", "fwd_log_ret")


def _scored(spark, sf):
    bars = features.reversion_side(a.session_frame(spark, sf), 5, vol="vol_20")
    return bars, _labels(spark, sf).join(bars.select("pair", F.col(TS).alias("t0"), "side_score", "side"), ["pair", "t0"])


@query(f"with {LABELS}, moves as{SCORED.split(', moves as')[1]} select l.pair, round(avg(case when side is null then 1.0 else 0 end), 8) as side_missing, count(*) filter (where side_score is not null) as n, case when count(*) filter (where side_score is not null) >= 20 then round(corr(side_score, label), 8) end as score_label_corr from lab l join sided s on s.pair = l.pair and s.ts = l.t0 group by l.pair")
def score_label_corr(spark, sf):
    return report.side_checks(_scored(spark, sf)[1])


@query(f"with {LABELS}, moves as{SCORED.split(', moves as')[1]}, j as (select pair, ts, abs(side_score - lag(side_score) over (partition by pair order by ts)) as jump from sided), k as (select j.* from j join lab on lab.pair = j.pair and lab.t0 = j.ts) select pair, {', '.join(f'round(quantile_cont(jump, {p}), 8) as q{round(100 * p):02d}' for p in (0.1, 0.25, 0.5, 0.75, 0.9))}, count(jump) as n from k group by pair having count(jump) >= 20")
def score_jumps(spark, sf):
    bars, found = _scored(spark, sf)
    return report.score_jumps(bars, found.withColumnRenamed("t0", TS))


def tidy_sql(section: str, sql: str, metrics: str) -> str:
    names = metrics.split()
    return f"select pair, '{section}' as section, unnest([{', '.join(repr(n) for n in names)}]) as metric, unnest([{', '.join(f'cast({n} as double)' for n in names)}]) as value from ({sql})"


DIAGNOSED = " union all ".join(
    tidy_sql(*x)
    for x in (
        ("events per day", f"with {LABELS}, d as (select pair, cast(t0 as date) as day, count(*) as n from lab group by 1, 2) select pair, count(*) as days, quantile_cont(n, 0.5) as median, quantile_cont(n, 0.25) as q1, quantile_cont(n, 0.75) as q3, quantile_cont(n, 0.75) - quantile_cont(n, 0.25) as iqr from d group by pair", "days median q1 q3 iqr"),
        ("minutes between events", f"with {LABELS}, g as (select pair, date_diff('second', lag(t0) over (partition by pair order by t0), t0) / 60 as gap from lab) select pair, {', '.join(f'quantile_cont(gap, {p}) as q{round(100 * p):02d}' for p in (0.1, 0.25, 0.5, 0.75, 0.9))} from g group by pair", "q10 q25 q50 q75 q90"),
        ("concurrency", ORACLES["concurrency_stats"], "bars mean p50 p90"),
        ("labels", ORACLES["label_shares"], "n pct_up pct_none pct_down"),
        ("holding", ORACLES["holding_times"], "q10 q25 q50 q75 q90 share_upto_1m"),
        ("no hit", ORACLES["nohit_check"], "n at_vertical at_start"),
        ("side", ORACLES["score_label_corr"], "side_missing n score_label_corr"),
        ("score jumps", ORACLES["score_jumps"], "q10 q25 q50 q75 q90 n"),
    )
)


@query(f"select pair, section, metric, round(value, 6) as value from ({DIAGNOSED})", 6)
def label_diagnostics(spark, sf):
    bars, found = _scored(spark, sf)
    return report.diagnostics(bars, found)


@query("with d as (select event_type, cast(ts as date) as day, count(*) as n from events group by 1, 2) select event_type, count(*) as days, round(quantile_cont(n, 0.5), 8) as median, round(quantile_cont(n, 0.25), 8) as q1, round(quantile_cont(n, 0.75), 8) as q3, round(quantile_cont(n, 0.75) - quantile_cont(n, 0.25), 8) as iqr from d group by event_type")
def events_per_day(spark, sf):
    return report.events_per_day(a.table(spark, sf, "events"), keys=["event_type"])


@query("with d as (select event_type, cast(ts as date) as day, count(*) as n from events group by 1, 2) select * from d order by n desc, event_type, day limit 10", None)
def busiest_days(spark, sf):
    days = a.table(spark, sf, "events").groupBy("event_type", F.to_date(TS).alias("day")).agg(F.count("*").alias("n"))
    return report.preview(days, (F.desc("n"), "event_type", "day"))


@query("select event_type, count(value) as n, round(avg(value), 8) as mean, round(stddev_samp(value), 8) as std, round(min(value), 8) as min, round(quantile_cont(value, 0.25), 8) as p25, round(quantile_cont(value, 0.5), 8) as p50, round(quantile_cont(value, 0.75), 8) as p75, round(max(value), 8) as max from events group by event_type")
def value_summary(spark, sf):
    return report.describe(a.table(spark, sf, "events"), "value", ["event_type"])


@query("select 'P' || (user_id % 7) as pair, event_type as value, count(*) as n, round(count(*) / sum(count(*)) over (partition by 'P' || (user_id % 7)), 8) as share from events group by 1, 2")
def type_shares(spark, sf):
    e = a.table(spark, sf, "events").withColumn("pair", F.concat(F.lit("P"), F.col("user_id") % 7))
    return report.value_shares(e, "event_type", ["pair"])


# ---- splits


def _rows(spark, sf):
    """Orders with intervals: (row_idx by key, t0, t_end)."""
    o, x = a.table(spark, sf, "events"), F.col("event_id")
    first = o.agg(F.min(x)).first()[0] or 0
    return o.select((x - first).alias("row_idx"), F.col("ts").alias("t0"), (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("user_id") % 500).cast("int"))).alias("t_end"))


ROWS = "x as (select event_id - (select min(event_id) from events) as row_idx, ts as t0, ts + to_minutes(cast(user_id % 500 as int)) as t_end from events), n as (select count(*) as n from events)"


@query(f"with {ROWS}, f as (select k as fold, n - (6 - k) * (n // 6) as a, n - (5 - k) * (n // 6) as b from n, range(1, 6) r(k)) select cast(fold as int) as fold, case when row_idx < a then 'train' else 'test' end as role, row_idx from x, f where row_idx < b", None)
def wf_splits(spark, sf):
    x = _rows(spark, sf)
    return cv.walk_forward(x, x.count())


COMBOS = """blk as (select x.*, case when row_idx < (n % 6) * (n // 6 + 1) then row_idx // (n // 6 + 1) else n % 6 + (row_idx - (n % 6) * (n // 6 + 1)) // (n // 6) end as block from x, n),
    cmb as (select row_number() over (order by a, b, c) as fold, a, b, c from range(6) p(a), range(6) q(b), range(6) r(c) where a < b and b < c),
    roles as (select cast(fold as int) as fold, case when block in (a, b, c) then 'train' else 'test' end as role, row_idx, t0, t_end from blk, cmb where fold <= 12)"""


@query(f"with {ROWS}, {COMBOS} select fold, role, row_idx from roles", None)
def cpcv_splits(spark, sf):
    x = _rows(spark, sf)
    return cv.cpcv(x, x.count(), 6, 12)


PURGED = f"""{ROWS}, {COMBOS}, tst as (select fold, row_idx, row_idx - row_number() over (partition by fold order by row_idx) as g from roles where role = 'test'), run as (select fold, min(row_idx) as lo, max(row_idx) as hi from tst group by fold, g),
    spans as (select run.fold, p.t0 as f, q.t_end as t from run join x p on p.row_idx = lo join x q on q.row_idx = hi),
    cut as (select fold, role, row_idx from roles r where role = 'test' or not exists (select 1 from spans s where s.fold = r.fold and (r.t0 <= s.t + interval 5 minutes and r.t_end >= s.f - interval 5 minutes or r.t0 > s.t and r.t0 <= s.t + interval 60 minutes)))"""


@query(f"with {PURGED} select fold, role, row_idx from cut", None)
def cpcv_purged(spark, sf):
    x = _rows(spark, sf)
    return cv.cpcv(x, x.count(), 6, 12, purge=300, embargo=3600)


@query(f"with {ROWS}, {COMBOS} select row_idx, count(*) as n from roles where role = 'test' group by row_idx", None)
def cpcv_counts(spark, sf):
    x = _rows(spark, sf)
    return cv.test_counts(cv.cpcv(x, x.count(), 6, 12))


@query("with i as (select distinct user_id % 5 as g, event_id as row_idx from events where value < 55), r as (select *, row_idx - row_number() over (partition by g order by row_idx) as k from i) select g, min(row_idx) as start, max(row_idx) as stop from r group by g, k", None)
def contiguous_runs(spark, sf):
    e = a.table(spark, sf, "events").filter("value < 55").select((F.col("user_id") % 5).alias("g"), F.col("event_id").alias("row_idx"))
    return cv.contiguous_runs(e, ["g"])


@query(f"with {ROWS} select n - 5 * (n // 6) as first_train_size from n", None)
def first_train_size(spark, sf):
    x = _rows(spark, sf)
    return cv.first_train_size(cv.walk_forward(x, x.count()))


@query(
    f"""with {PURGED}, tr as (select c.fold, t0, t_end from cut c join x using (row_idx) where role = 'train'), o as (select tr.fold, count(*) as overlapping from tr join spans s on s.fold = tr.fold and tr.t0 <= s.t and tr.t_end >= s.f group by tr.fold)
    select f.fold, 0::bigint as shared_rows, coalesce(overlapping, 0) as overlapping from (select distinct fold from cut) f left join o using (fold)""",
    None,
)
def overlap_report(spark, sf):
    x = _rows(spark, sf)
    return cv.overlaps(x, cv.cpcv(x, x.count(), 6, 12, purge=300, embargo=3600))


@query(f"select pair, section, metric, round(value, 6) as value from ({DIAGNOSED})", 6)
def diagnostics_of_file(spark, sf):
    """The same from a file of labelled events and one of bars."""
    bars, found = _scored(spark, sf)
    path = new_folder(spark, "labelled")
    write_parquet(found, f"{path}/events")
    write_parquet(bars.select("pair", TS, "side_score"), f"{path}/bars")
    return report.diagnostics_of_files(spark, f"{path}/events", f"{path}/bars")


WF_SQL = "f as (select k as fold, n - (6 - k) * (n // 6) as a, n - (5 - k) * (n // 6) as b from n, range(1, 6) r(k)), wf as (select cast(fold as int) as fold, case when row_idx < a then 'train' else 'test' end as role, row_idx, t0, t_end from x, f where row_idx < b)"


@query(f"with {ROWS}, {WF_SQL} select fold, {', '.join(f"""string_agg(row_idx::varchar, ',' order by row_idx) filter (where role = '{r}') as {r}_idx, min(row_idx) filter (where role = '{r}') as {r}_start, max(row_idx) filter (where role = '{r}') as {r}_end, cast(count(*) filter (where role = '{r}') as int) as n_{r}""" for r in ('train', 'test'))} from wf group by fold", None)
def split_lists(spark, sf):
    x = _rows(spark, sf)
    out = cv.split_lists(cv.walk_forward(x, x.count()))
    return out.withColumns({c: F.array_join(c, ",") for c in ("train_idx", "test_idx")})


@query(f"with {ROWS}, {WF_SQL} select fold, role, row_idx from wf", None)
def split_files(spark, sf):
    """Splits written with one list as JSON text and one as an array, read again and taken apart."""
    x, path = _rows(spark, sf), new_folder(spark, "splits")
    lists = cv.split_lists(cv.walk_forward(x, x.count())).select("fold", F.to_json("train_idx").alias("train_idx"), "test_idx")
    write_parquet(lists, path, ("fold",))
    of = lambda role: F.struct(F.lit(role).alias("role"), F.col(f"{role}_idx").alias("rows"))
    back = bars.read_splits(spark, path).select("fold", F.explode(F.array(of("train"), of("test"))).alias("x"))
    return back.select(F.col("fold").cast("int").alias("fold"), "x.role", F.explode("x.rows").alias("row_idx"))


TAKEN = "bt as (select x.row_idx, t0, t_end, (e.value - 50) / 1000 as pay, cast(e.user_id % 3 - 1 as bigint) as side, e.value > 60 as take from x join events e on e.event_id = x.row_idx + (select min(event_id) from events))"


def cells_sql(section: str, item: str, metrics: str, source: str) -> str:
    names = metrics.split()
    return f"select '{section}' as section, {item} as item, unnest([{', '.join(repr(n) for n in names)}]) as metric, unnest([{', '.join(f'cast({n} as double)' for n in names)}]) as value from {source}"


@query(
    f"""with {ROWS}, {WF_SQL}, {TAKEN}, d as (select count(pay) as n, avg(pay) as mean, stddev_samp(pay) as std, min(pay) as min, quantile_cont(pay, 0.25) as p25, quantile_cont(pay, 0.5) as p50, quantile_cont(pay, 0.75) as p75, max(pay) as max, avg(case when pay > 0 then 1.0 else 0 end) as share_above_zero from bt),
    sd as (select side, count(*) as n, count(*) filter (where take) as taken from bt group by side), st as (select *, n / sum(n) over () as share, taken / sum(taken) over () as share_taken, taken / n as take_rate from sd),
    sp as (select fold, min(t0) as f, max_by(t_end, row_idx) as t from wf where role = 'test' and fold <= 3 group by fold), ov as (select sp.fold, 0 as shared_rows, count(*) filter (where wf.t0 <= t and wf.t_end >= f) as overlapping from sp join wf on wf.fold = sp.fold and wf.role = 'train' group by sp.fold),
    r as ({cells_sql('payoff', "''", 'n mean std min p25 p50 p75 max share_above_zero', 'd')} union all {cells_sql('side', 'side::varchar', 'n taken share share_taken take_rate', 'st')} union all {cells_sql('fold', 'fold::varchar', 'shared_rows overlapping', 'ov')})
    select section, item, metric, round(value, 8) as value from r"""
)
def backtest_report(spark, sf):
    x, e = _rows(spark, sf), a.table(spark, sf, "events")
    first = e.agg(F.min("event_id")).first()[0] or 0
    rows = x.join(e.select((F.col("event_id") - first).alias("row_idx"), ((F.col("value") - 50) / 1000).alias("pay"), (F.col("user_id") % 3 - 1).alias("side"), (F.col("value") > 60).alias("take")), "row_idx")
    return report.backtest_report(rows, F.col("take"), cv.walk_forward(x, x.count()), "pay")


# ---- costs and returns

BPS = "case when hour(ts) in (22, 23) or hour(ts) <= 5 then 0.18 when hour(ts) = 6 then 0.15 when hour(ts) = 7 then 0.10 when hour(ts) = 8 or hour(ts) = 17 then 0.08 when hour(ts) between 9 and 12 or hour(ts) = 16 then 0.06 when hour(ts) between 13 and 15 then 0.05 when hour(ts) = 18 then 0.10 when hour(ts) = 19 then 0.12 when hour(ts) = 20 then 0.14 else 0.16 end"


@query(f"select event_id, round(sg * (exp((value - 50) / 10000) - 1) - case when sg <> 0 then 2 * (({BPS}) + 0.25) * 1e-4 else 0 end, 10) as ret from (select *, case when event_type = 'click' then -1 when event_type = 'purchase' then 1 else 0 end as sg from events)", 10)
def cost_short(spark, sf):
    e = a.table(spark, sf, "events")
    sg = F.when(F.col("event_type") == "click", -1).when(F.col("event_type") == "purchase", 1).otherwise(0)
    return e.select("event_id", classified_return(sg, (F.col("value") - 50) / 10000, F.col("ts")).alias("ret"))


LIMITS = "l as (select event_type, q, quantile_cont(value, q) as threshold from events, (values (0.7), (0.9)) v(q) group by 1, 2)".replace("quantile_cont(value, q)", "case when q = 0.7 then quantile_cont(value, 0.7) else quantile_cont(value, 0.9) end")


def _selected(spark, sf, compat):
    e = a.table(spark, sf, "events")
    limit = thresholds(e, ["event_type"], [0.7, 0.9], "value")
    x = e.join(F.broadcast(limit), "event_type")  # a row an event type and quantile
    gain = F.col("value") / 10 if not compat else F.col("value")
    return x.select("event_id", "q", F.when(takes(F.col("value"), F.col("threshold"), compat), 1).otherwise(0).alias("taken"), selected_return(takes(F.col("value"), F.col("threshold"), compat), gain / 1000, F.col("ts")).alias("ret"))


@query(f"with {LIMITS} select event_id, cast(q as double) as q, case when value >= threshold then 1 else 0 end as taken, round(case when value >= threshold then exp(value / 10 / 1000) - 1 - 2 * (({BPS}) + 0.25) * 1e-4 else 0 end, 10) as ret from events join l using (event_type)", 10)
def cost_long(spark, sf):
    return _selected(spark, sf, False)


@query(f"with {LIMITS} select event_id, cast(q as double) as q, case when value >= cast(value >= threshold as int) then 1 else 0 end as taken, round(case when value >= cast(value >= threshold as int) then exp(value / 1000) - 1 - 2 * (({BPS}) + 0.25) * 1e-4 else 0 end, 10) as ret from events join l using (event_type)", 10)
def cost_long_compat(spark, sf):
    return _selected(spark, sf, True)


@query(f"with {ROWS}, {COMBOS}, r as (select roles.row_idx, e.value / 1000 as ret from roles join events e on e.event_id = row_idx + (select min(event_id) from events) where role = 'test') select row_idx, round(sum(ret), 8) as total, count(*) as n, round(avg(ret), 8) as ret from r group by row_idx")
def accumulated_returns(spark, sf):
    x = _rows(spark, sf)
    e = a.table(spark, sf, "events")
    first = e.agg(F.min("event_id")).first()[0] or 0
    value = e.select((F.col("event_id") - first).alias("row_idx"), (F.col("value") / 1000).alias("ret"))
    tests = cv.cpcv(x, x.count(), 6, 12).filter("role = 'test'")
    return cv.accumulate(cv.gather(value, tests), ["row_idx"])


@query("select event_type, cast(user_id % 3 - 1 as bigint) as side, count(*) as n, count(*) filter (where value > 60) as taken, round(count(*) / sum(count(*)) over (partition by event_type), 8) as share, round(count(*) filter (where value > 60) / nullif(sum(count(*) filter (where value > 60)) over (partition by event_type), 0), 8) as share_taken, round(count(*) filter (where value > 60) / count(*), 8) as take_rate from events group by 1, 2")
def take_rates(spark, sf):
    e = a.table(spark, sf, "events").withColumn("side", F.col("user_id") % 3 - 1)
    return report.take_rates(e, F.col("value") > 60, keys=["event_type"])


DECILES = "d as (select event_type, value as score, value * 2 + user_id as outcome, ntile(10) over (partition by event_type order by value, event_id) as bucket from events), t as (select event_type, bucket, count(*) as n, avg(score) as mean_score, avg(outcome) as mean_outcome from d group by all)"


def _deciles(spark, sf):
    e = a.table(spark, sf, "events").withColumn("outcome", F.col("value") * 2 + F.col("user_id"))
    return report.deciles(e, "value", "outcome", "event_id", ["event_type"])


@query(f"with {DECILES} select event_type, bucket, n, round(mean_score, 6) as mean_score, round(mean_outcome, 6) as mean_outcome from t", 6)
def score_deciles(spark, sf):
    return _deciles(spark, sf).withColumn("bucket", F.col("bucket").cast("long"))


@query(f"with {DECILES}, r as (select *, rank() over (partition by event_type order by mean_score) as ra, rank() over (partition by event_type order by mean_outcome) as rb from t) select event_type, round(corr(ra, rb), 6) as rank_corr from r group by event_type", 6)
def decile_order(spark, sf):
    return report.decile_order(_deciles(spark, sf), ["event_type"])


# ---- statistics of returns


@query(f"with {DAILY} select strategy, day, round(ret, 8) as ret from daily")
def daily_returns(spark, sf):
    return stats.daily_returns(a.return_matrix(spark, sf))


SHARPE = "case when count(*) >= 2 and stddev_samp(ret) > 0 then avg(ret) / stddev_samp(ret) * sqrt(252) else 0 end"
SORTINO = "case when count(*) >= 2 and avg(pow(least(ret, 0), 2)) > 0 then avg(ret) / sqrt(avg(pow(least(ret, 0), 2))) * sqrt(252) else 0 end"


@query(f"with {DAILY} select strategy, round({SHARPE}, 6) as sharpe, round({SORTINO}, 6) as sortino from daily group by strategy", 6)
def sharpe_sortino(spark, sf):
    return stats.daily_returns(a.return_matrix(spark, sf)).groupBy("strategy").agg(stats.sharpe(F.col("ret")).alias("sharpe"), stats.sortino(F.col("ret")).alias("sortino"))


@query(f"with {DAILY} select strategy, round(skewness(ret), 6) as skew, round(kurtosis(ret) + 3, 6) as kurt from daily group by strategy", 6)
def moments(spark, sf):
    return stats.daily_returns(a.return_matrix(spark, sf)).groupBy("strategy").agg(stats.skew(F.col("ret")).alias("skew"), stats.kurtosis(F.col("ret")).alias("kurt"))


METRICS = f"""{DAILY}, ev as (select strategy, count(*) filter (where ret <> 0) as n_trades, coalesce(avg(case when ret > 0 then 1.0 else 0 end) filter (where ret <> 0), 0) as hit_rate, coalesce(avg(ret) filter (where ret <> 0), 0) as mean_evt_ret, coalesce(stddev_samp(ret) filter (where ret <> 0), 0) as std_evt_ret from m group by strategy),
    dy as (select strategy, {SHARPE} as sharpe, {SORTINO} as sortino, skewness(ret) as skew, kurtosis(ret) + 3 as kurt, count(*) as T_daily from daily group by strategy),
    met as (select *, (sharpe - sqrt(greatest(1e-12, var_samp(sharpe) over ())) * Z) * sqrt(T_daily - 1) / sqrt(greatest(1e-12, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe)) as dsr_argument from ev join dy using (strategy))"""
#: What the best of five standard normals is expected to reach.
Z5 = 1.192594001014789


@query(f"with {METRICS} select strategy, n_trades, {rnd('hit_rate', 'mean_evt_ret', 'std_evt_ret', 'sharpe', 'sortino', digits=6)}, T_daily from met".replace("* Z)", f"* {Z5})"), 6)
def strategy_metrics(spark, sf):
    return stats.strategy_metrics(a.return_matrix(spark, sf)).select("strategy", "n_trades", "hit_rate", "mean_evt_ret", "std_evt_ret", "sharpe", "sortino", "T_daily")


@query(f"with {METRICS} select strategy, round(dsr_argument, 5) as dsr_argument from met".replace("* Z)", f"* {Z5})"), 5)
def dsr_argument(spark, sf):
    return stats.strategy_metrics(a.return_matrix(spark, sf)).select("strategy", "dsr_argument")


def phi_sql(x: str) -> str:
    """The normal distribution as the series of odd powers over double factorials."""
    term = f"exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) + k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2))"
    return f"case when abs({x}) > 7 then (sign({x}) + 1) / 2 else 0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k: {term})) end"


@query(f"with {METRICS} select strategy, round(sharpe, 6) as sharpe, round({phi_sql('dsr_argument')}, 6) as dsr from met".replace("* Z)", f"* {Z5})"), 6)
def deflated_sharpe(spark, sf):
    return stats.strategy_metrics(a.return_matrix(spark, sf)).select("strategy", "sharpe", "dsr")


CSCV = f"""{MATRIX}, n as (select count(*) as n from events), blk as (select m.*, case when row_idx < (n % 8) * (n // 8 + 1) then row_idx // (n // 8 + 1) else n % 8 + (row_idx - (n % 8) * (n // 8 + 1)) // (n // 8) end as block from m, n),
    parts as (select strategy, block, sum(ret) as s, count(*) as c from blk group by all), cmb as (select row_number() over (order by a, b, c, d) - 1 as combo, a, b, c, d from range(8) p(a), range(8) q(b), range(8) r(c), range(8) t(d) where a < b and b < c and c < d),
    perf as (select combo, strategy, sum(s) filter (where block in (a, b, c, d)) / sum(parts.c) filter (where block in (a, b, cmb.c, d)) as perf_IS, sum(s) filter (where block not in (a, b, cmb.c, d)) / sum(parts.c) filter (where block not in (a, b, cmb.c, d)) as perf_OOS from parts, cmb group by combo, strategy),
    rk as (select *, rank() over (partition by combo order by perf_OOS desc) + (count(*) over (partition by combo, perf_OOS) - 1) / 2 as r, count(*) over (partition by combo) as k, row_number() over (partition by combo order by perf_IS desc, strategy) as f from perf),
    res as (select combo, strategy as best_IS, perf_IS, perf_OOS, least(greatest(r / (k + 1), 1e-8), 1 - 1e-8) as relative_rank_OOS from rk where f = 1)""".replace("block in (a, b, c, d)", "block in (a, b, cmb.c, d)")
KS = """ks as (select max(abs(g)) / (count(*) / 2) as ks_stat, count(*) // 2 as n from (select sum(own) over (order by v) - sum(1 - own) over (order by v) as g from (
        select relative_rank_OOS as v, 1 as own from res union all select cast('0x' || substr(md5('42:' || combo), 1, 13) as bigint) / pow(2::double, 52) as v, 0 as own from res))),
    kz as (select *, round(ks_stat * n)::bigint as k from ks),
    kp as (select ks_stat, case when k > 0 then least(1, greatest(0, 2 * list_sum(list_transform(range(1, n // k + 1), lambda i: (case when i % 2 = 1 then 1 else -1 end) * exp(2 * lgamma(n + 1) - lgamma(n - i * k + 1) - lgamma(n + i * k + 1)))))) else 1.0 end as ks_pval from kz),
    zr as (select *, rank() over (order by perf_IS) + (count(*) over (partition by perf_IS) - 1) / 2 as ra, rank() over (order by perf_OOS) + (count(*) over (partition by perf_OOS) - 1) / 2 as rb from res),
    ov as (select avg(case when relative_rank_OOS > 0.5 then 1.0 else 0 end) as PBO, corr(ra, rb) as perf_degradation, avg(case when perf_OOS < 0 then 1.0 else 0 end) as prob_loss, any_value(ks_stat) as ks_stat, any_value(ks_pval) as ks_pval from zr, kp)"""


@query(f"with {CSCV} select cast(combo as int) as combo, best_IS, {rnd('perf_IS', 'perf_OOS', 'relative_rank_OOS')}, round(ln(relative_rank_OOS / (1 - relative_rank_OOS)), 8) as logit from res")
def cscv_combos(spark, sf):
    return cscv.cscv(a.return_matrix(spark, sf), a.table(spark, sf, "events").count()).drop("name")


@query(f"with {CSCV}, {KS} select {rnd('PBO', 'perf_degradation', 'prob_loss', 'ks_stat', 'ks_pval', digits=6)} from ov", 6)
def pbo(spark, sf):
    found = cscv.cscv(a.return_matrix(spark, sf), a.table(spark, sf, "events").count())
    return cscv.overfitting(found)


@query(
    f"with {METRICS}, {CSCV.removeprefix(MATRIX + ', ')}, {KS} select 'all' as pair, 'WF' as scheme, strategy, n_trades, {rnd('hit_rate', 'mean_evt_ret', 'std_evt_ret', 'sharpe', 'sortino', 'skew', 'kurt', digits=6)}, T_daily, round(dsr_argument, 6) as dsr_argument, round({phi_sql('dsr_argument')}, 6) as dsr, {rnd('PBO', 'perf_degradation', 'prob_loss', 'ks_stat', 'ks_pval', digits=6)} from met, ov".replace("* Z)", f"* {Z5})"),
    6,
)
def scheme_analysis(spark, sf):
    m = a.return_matrix(spark, sf).withColumns({"pair": F.lit("all"), "scheme": F.lit("WF")})
    return stages.analyse(m)


SCEN = """sm as (select r_name as pair, c_mktsegment as scheme, 'm' || substr(o_orderpriority, 1, 1) || case when o_orderkey % 2 = 0 then '__q80' else '' end as strategy, count(*) as n_trades, round(avg(o_totalprice) / 200000, 6) as sharpe, round(avg(o_totalprice) / 150000, 6) as sortino,
    case when count(*) > 10 then round(avg(case when o_orderstatus = 'F' then 1.0 else 0 end), 6) end as dsr, round(avg(case when o_orderstatus = 'P' then 1.0 else 0 end), 6) as PBO, round(avg(case when o_orderstatus = 'O' then 1.0 else 0 end) - 1, 6) as perf_degradation, round(avg(case when o_totalprice < 50000 then 1.0 else 0 end), 6) as prob_loss
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all), fam as (select *, regexp_replace(strategy, '__q[0-9]{2,3}$', '') as model from sm)"""


@query(f"with {SCEN} select pair, scheme, strategy as best_strategy, n_trades, {rnd('sharpe', 'sortino', 'dsr', 'PBO', 'perf_degradation', 'prob_loss', digits=6)} from sm qualify row_number() over (partition by pair, scheme order by dsr desc nulls last, sharpe desc nulls last, strategy) = 1", 6)
def best_strategy(spark, sf):
    return report.best_strategies(a.scenario_metrics(spark, sf))


@query(f"with {SCEN} select model, count(*) as n_strategies, {', '.join(f'round(avg({c}), 10) as avg_{c}' for c in ('sharpe', 'dsr', 'PBO', 'perf_degradation', 'prob_loss'))}, round(avg(case when dsr > 0.5 then 1.0 else 0 end), 10) as frac_dsr_gt_0_5, round(avg(case when sharpe > 1 then 1.0 else 0 end), 10) as frac_sharpe_gt_1 from fam group by model", 10)
def model_summary(spark, sf):
    return report.model_summary(a.scenario_metrics(spark, sf))


@query(f"with {SCEN} select model, pair, scheme, strategy, n_trades, {rnd('sharpe', 'sortino', 'dsr', 'PBO', 'perf_degradation', 'prob_loss', digits=6)} from fam qualify row_number() over (partition by model order by sharpe desc nulls last, pair, scheme, strategy) = 1", 6)
def best_cases(spark, sf):
    return report.best_cases(a.scenario_metrics(spark, sf))


@query(f"with {SCEN} select model, count(*) as n_scenarios, round(avg(case when sharpe > 1 then 1.0 else 0 end), 6) as frac_sharpe_gt_thr, round(avg(case when dsr > 0.5 then 1.0 else 0 end), 6) as frac_dsr_gt_thr, round(avg(case when PBO < 0.1 then 1.0 else 0 end), 6) as frac_pbo_lt_thr, round(avg(case when perf_degradation > -0.3 then 1.0 else 0 end), 6) as frac_perfdeg_gt_thr from fam group by model", 6)
def robustness(spark, sf):
    return report.robustness(a.scenario_metrics(spark, sf))


TRIED = "tried as (select user_id, count(*) as n from events group by user_id)"


def _tried(spark, sf):
    """How many trades each user has tried."""
    return a.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"with {TRIED} select user_id, n, round(2 * ln(n), 6) as bound from tried", 6)
def minbtl_bound(spark, sf):
    return montecarlo.with_min_backtest(_tried(spark, sf)).drop("min_years")


ROOTS = f"""with recursive {TRIED}, p as (select n, q, case when q = 1 then 1 - 1 / n else 1 - 1 / (n * exp(1)) end as p from (select distinct n from tried where n > 1) r, range(1, 3) s(q)),
    b as (select n, q, p, 0 as i, -1.0::double as lo, 6.0::double as hi from p union all select n, q, p, i + 1, case when {phi_sql('(lo + hi) / 2')} < p then (lo + hi) / 2 else lo end, case when {phi_sql('(lo + hi) / 2')} < p then hi else (lo + hi) / 2 end from b where i < 44),
    z as (select n, max(lo) filter (where q = 1) as z1, max(lo) filter (where q = 2) as z2 from b where i = 44 group by n)"""


@query(f"{ROOTS} select user_id, t.n, round(pow((1 - 0.5772156649015329) * z1 + 0.5772156649015329 * z2, 2), 6) as min_years, round(2 * ln(t.n), 6) as bound from tried t left join z on z.n = t.n", 6)
def minbtl_curve(spark, sf):
    return montecarlo.with_min_backtest(_tried(spark, sf))


def _market(spark, sf) -> tuple[int, int, float]:
    """(strategies, steps, steps a year) of the table: kinds of trades of each pair, and hours with a bar."""
    bars = a.bars(spark, sf).agg(F.count_distinct(TS).alias("steps"), F.min(TS).alias("a"), F.max(TS).alias("z")).first()
    kinds = a.table(spark, sf, "events").select(F.col("user_id") % 7, "event_type").distinct().count()
    years = max(1, ((bars.z or bars.a) - bars.a).days) / 365 if bars.steps else 1.0
    return max(1, kinds), max(2, bars.steps), max(2, bars.steps) / years


@query()
def max_sharpe_mc(spark, sf):
    """The best of as many skill-less strategies as the table has kinds of trades, over as many steps as it has bars."""
    kinds, steps, periods = _market(spark, sf)
    return montecarlo.max_sharpe(spark, 2_000, kinds, steps, periods)


@query()
def max_sharpe_curve(spark, sf):
    """The same for more and more strategies."""
    _, steps, periods = _market(spark, sf)
    return montecarlo.max_sharpe_curve(spark, (*range(1, 11), 50, 100, 150, 200, 300, 400), 100, steps, periods=periods)


@query(f"with {BARS} select pair, ts, round(exp(sum(ln(1 + (close - 50) / 10000)) over (partition by pair order by ts)) - 1, 6) as equity from bars", 6)
def cumulative_return(spark, sf):
    bars = running_sum(a.bars(spark, sf), F.log1p((F.col("close") - 50) / 10000), "total")
    return bars.select("pair", TS, (F.exp("total") - 1).alias("equity"))


# ---- whole stages


CHAIN = labels_sql(4, "(pair, ts) in (select pair, ts from cus)", cusum_sql(240))
PARAMS = stages.FeatureParams(horizon=4, minutes=60, vol=20, k=1.0, spacing_minutes=120, barrier=1.0, lookback=5)
SIDED = """, hours as (select *, log_mid - lag(log_mid, 5) over (partition by pair order by ts) as move from feat where hour(ts) between 8 and 17),
    sided as (select *, case when abs(side_score) >= 0.5 then sign(side_score)::double end as side from (select *, case when move is not null and vol_20 <> 0 then greatest(-3, least(3, -move / (vol_20 * sqrt(5)))) end as side_score from hours))"""


def chain_sql(where: str = "true") -> str:
    return f"""with recursive {CHAIN}{COVER_OF}{WEIGHTS}{EWMA_OF}{SIDED} select l.pair, l.t0 as ts, round(ret_1, 8) as ret_1, round(vol_20, 8) as vol_20, ewma_50, round(side_score, 8) as side_score, side, t1_vert, l.t_end, cast(label as int) as label, weight
    from lab l join sided s on s.pair = l.pair and s.ts = l.t0 left join ew on ew.pair = l.pair and ew.ts = l.t0 left join wt on wt.pair = l.pair and wt.t0 = l.t0 where {where}"""


def _chain(spark, sf, start=None, end=None):
    out = stages.feature_stage(a.quotes(spark, sf), PARAMS, start, end)
    return out.select("pair", TS, "ret_1", "vol_20", "ewma_50", "side_score", "side", "t1_vert", "t_end", F.col("label").cast("int"), F.round("weight", 6).alias("weight"))


@query(chain_sql())
def labelled_events(spark, sf):
    """Joined bars to labelled, weighted events, by the sampler with state."""
    return _chain(spark, sf)


@query(chain_sql().replace("from events e group by 1, 2)", "from events e where date_trunc('hour', e.ts) between timestamp '2024-01-05' and timestamp '2024-01-20' group by 1, 2)"))
def labelled_events_in_range(spark, sf):
    """The same over a span of time alone."""
    return _chain(spark, sf, F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))


CLEANED = f"""{bars_sql(15)}, w as (select * from bars where {WEEK}), bs as (select *, 'BID' as side from w union all select pair, ts, {', '.join(f'{c} + {ASK} as {c}' for c in ('open', 'high', 'low', 'close'))}, 'ASK' from w),
    sd as (select * from bs where not coalesce(least(open, high, low, close) <= 0 or coalesce(high < greatest(open, close), false) or coalesce(low > least(open, close), false) or coalesce(high < low, false), false)),
    sm as (select *, coalesce(close = lag(close) over (partition by pair, side order by ts), false) as same from sd), rr as (select *, sum(case when same then 0 else 1 end) over (partition by pair, side order by ts) as run from sm),
    cb as (select pair, side, ts, open, high, low, close from (select *, count(*) over (partition by pair, side, run) as size from rr) where not (same and size >= 60))"""


def gap_parts_sql(source: str, key: str) -> str:
    parts = " union all ".join(f"select {key}, '{n}' as part, x + interval '15 minutes' as start, y - interval '15 minutes' as stop, cast(greatest(floor(s / 900) - 1, 0) as bigint) as n from gp where s > {lo} and s <= {hi}" for n, lo, hi in (("short gap", 900, 172800), ("long gap", 172800, 10**9)))
    return f"gp as (select *, date_diff('second', x, y) as s from (select {key}, lag(ts) over (partition by {key} order by ts) as x, ts as y from {source})), pt as (select {key}, 'bars' as part, min(ts) as start, max(ts) as stop, count(*) as n from {source} group by {key} union all {parts})"


def _parts(out: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    span = out["bars"].groupBy(*keys).agg(F.min(TS).alias("start"), F.max(TS).alias("stop"), F.count("*").alias("n")).select(*keys, F.lit("bars").alias("part"), "start", "stop", "n")
    for name, part in (("short_gaps", "short gap"), ("long_gaps", "long gap")):
        span = span.unionByName(out[name].select(*keys, F.lit(part).alias("part"), F.col("gap_start").alias("start"), F.col("gap_end").alias("stop"), F.col("gap_missing").cast("long").alias("n")))
    return span.unionByName(out["invalid_blocks"].select(*keys, F.lit("invalid").alias("part"), "start", F.col("end").alias("stop"), F.col("n_rows").alias("n")))


def _raw(spark, sf):
    return quotes_from_events(a.table(spark, sf, "events"), 15).withColumn("ordinal", F.lit(1))


@query(f"with {CLEANED}, {gap_parts_sql('cb', 'pair, side')} select * from pt", None)
def clean_stage(spark, sf):
    """Raw bars of both sides to clean ones, with their gaps and invalid blocks (no clean bar is in one)."""
    return _parts(stages.clean_stage(_raw(spark, sf), 15), ["pair", "side"])


@query(f"with {CLEANED}, jb as (select b.pair, b.ts from cb b join cb k on k.pair = b.pair and k.ts = b.ts and b.side = 'BID' and k.side = 'ASK'), {gap_parts_sql('jb', 'pair')} select * from pt", None)
def join_stage(spark, sf):
    """Clean bars of both sides to joined ones, with their gaps and invalid blocks."""
    return _parts(stages.join_stage(stages.clean_stage(_raw(spark, sf), 15)["bars"], 15), ["pair"])


# ---- sources and sinks

CODE = "'PX' || chr(cast(65 + cast(substr(pair, 2, 3) as int) as int)) || '_USD'"


def _code():
    return F.concat(F.lit("PX"), F.char(65 + F.substring("pair", 2, 3).cast("int")), F.lit("_USD"))


def _csv_files(spark, sf, name: str) -> str:
    """Bars as CSV, a folder for each pair and side as vendors name their files; the ask side's files have no open price."""
    path, rows = new_folder(spark, name), quotes_from_events(a.table(spark, sf, "events"))
    rows = rows.withColumn("timestamp", zoned(F.col(TS), F.hour(TS) % 4))
    for side, columns in (("BID", ("timestamp", "open", "high", "low", "close")), ("ASK", ("timestamp", "high", "low", "close"))):
        named = rows.filter(F.col("side") == side).select(F.concat(_code(), F.lit(f"_{side}_2024")).alias("file"), *columns)
        named.write.mode("append").partitionBy("file").option("header", True).csv(path)
    return path


@query(f"with {QUOTES} select {CODE} as pair, 'BID' as side, ts, open_bid as open, high_bid as high, low_bid as low, close_bid as close from q", None)
def csv_bars(spark, sf):
    """CSV files of one kind by a glob; pair and side from their names."""
    return bars.read_bars(spark, f"{_csv_files(spark, sf, 'csv')}/*_BID_*").drop("ordinal")


@query(f"with {QUOTES} select {CODE} as pair, 'BID' as side, ts, open_bid as open, high_bid as high, low_bid as low, close_bid as close from q union all select {CODE}, 'ASK', ts, null, high_ask, low_ask, close_ask from q", None)
def csv_bars_mixed(spark, sf):
    """CSV files of different headers together; what a file has no column for is null."""
    return bars.read_bars(spark, f"{_csv_files(spark, sf, 'csv')}/*", mixed=True).drop("ordinal")


@query(f"with {BARS}, k as (select distinct {CODE} as pair, cast(substr(pair, 2, 3) as int) as p from bars) select pair, case when p % 3 = 0 then 'BID' else 'ASK,BID' end as sides, p % 3 <> 0 as complete from k", None)
def paired_sides(spark, sf):
    """Which pairs have both sides, where every third has but one."""
    rows = quotes_from_events(a.table(spark, sf, "events")).filter((F.col("side") == "BID") | (F.substring("pair", 2, 3).cast("int") % 3 != 0))
    return bars.paired_sides(rows.withColumn("pair", _code())).withColumn("sides", F.array_join("sides", ","))


FILES = "fl as (select distinct user_id % 7 as k, event_type as kind from events)"


@query(f"with {FILES} select 'EUR_' || upper(substr(kind, 1, 3)) as pair, case when k % 2 = 0 then 'BID' else 'ASK' end as side, k, kind from fl", None)
def names_of_files(spark, sf):
    """Pair and side from paths of both ways of naming, some in small letters."""
    e = a.table(spark, sf, "events").select((F.col("user_id") % 7).alias("k"), F.col("event_type").alias("kind")).distinct()
    code, side = F.substring("kind", 1, 3), F.when(F.col("k") % 2 == 0, "bid").otherwise("ASK")
    path = F.when(F.col("k") < 4, F.concat(F.lit("in/eur"), code, F.lit("_"), side, F.lit("_2007.csv"))).otherwise(F.concat(F.lit("in/x_EUR_"), F.upper(code), F.lit("_"), side, F.lit(".csv")))
    return e.select(bars.pair_of(path).alias("pair"), bars.side_of(path).alias("side"), "k", "kind")


def _artefacts(spark, sf):
    e = a.table(spark, sf, "events").select((F.col("user_id") % 7).alias("k"), F.col("event_type").alias("kind")).distinct()
    base = F.concat(F.lit("out/EUR_"), F.upper(F.substring("kind", 1, 3)), F.lit("_v"), F.col("k"))
    ends = F.array(*map(F.lit, ("_WF_M.parquet", "_WF_split.parquet", "_CPCV_counts", "_notes.txt")))
    return e.select("k", F.explode(F.transform(ends, lambda x: F.concat(base, x))).alias("path")).filter("k % 3 <> 0 or path not like '%_M.parquet'").drop("k")


ARTEFACTS = {"WF_M": "_WF_M.parquet", "WF_splits": "_WF_split.parquet", "CPCV_counts": "_CPCV_counts"}
NAMED = ", ".join((f"'out/' || base || '{ARTEFACTS[n]}'" if n in ARTEFACTS else "cast(null as varchar)") + f" as {n}" for s in ("WF", "CPCV") for n in (f"{s}_M", f"{s}_splits", f"{s}_counts", f"{s}_results"))


@query(f"with {FILES}, b as (select 'EUR_' || upper(substr(kind, 1, 3)) || '_v' || k as base from fl where k % 3 <> 0) select base, {NAMED}, substr(base, 1, 7) as pair from b", None)
def backtest_discovery(spark, sf):
    """Which backtests are complete enough, from the paths of all artefacts."""
    return bars.discover_backtests(_artefacts(spark, sf))


@query(f"with {BARS}, u as (select * from bars union all select * from bars) select pair, 'parquet' as way, ts, open, high, low, close from bars union all select pair, 'csv', ts, open, high, low, close from bars", None)
def written_tables(spark, sf):
    """Bars written as Parquet by pair and as CSV, and both read again."""
    path, rows = new_folder(spark, "tables"), a.bars(spark, sf)
    write_parquet(rows, f"{path}/parquet")
    write_csv(rows, f"{path}/csv")
    text = spark.read.option("header", True).schema(rows.schema).csv(f"{path}/csv").withColumn("way", F.lit("csv"))
    return spark.read.parquet(f"{path}/parquet").withColumn("way", F.lit("parquet")).unionByName(text).select("pair", "way", TS, "open", "high", "low", "close")


#: Rows of a part file of a published table, and places of a row of its split table.
PUBLISHED = 500_000


def _published(spark, sf, most: int = PUBLISHED) -> str:
    """A walk-forward and a combinatorial backtest of a pair, as their authors' programs write them; of more than ``most`` events
    a fold's lists are several rows, in order, and tables have as many more part files."""
    path, x = new_folder(spark, "published"), _rows(spark, sf)
    n = x.count()
    files = -(-n // most)
    table = saved(a.wide_matrix(spark, sf).repartitionByRange(max(3, files), "row_idx").sortWithinPartitions("row_idx")).drop("row_idx")
    for base, scheme, (rows, uses) in (("EUR_USD_a", "WF", cv.walk_forward_kinds(x, n)), ("EUR_USD_a", "CPCV", cv.cpcv_kinds(x, n, 6, 12))):
        table.write.parquet(f"{path}/{base}_{scheme}_M.parquet")
        lists = cv.lists_of_kinds(rows, uses, most if files > 1 else None, max(1, files))
        (lists if files > 1 else lists.drop("part")).write.parquet(f"{path}/{base}_{scheme}_split.parquet")
    times = cv.counts_of_kinds(rows, uses).select("row_idx", F.col("n").alias("count"))
    times.repartitionByRange(max(2, files), "row_idx").sortWithinPartitions("row_idx").drop("row_idx").write.parquet(f"{path}/EUR_USD_a_CPCV_counts.parquet")
    return path


@query(f"with {MATRIX}, k as (select count(*) - 5 * (count(*) // 6) as k from events), r as (select 'WF' as scheme, row_idx - k as row_idx, t0, strategy, ret from m, k where row_idx >= k union all select 'CPCV', row_idx, t0, strategy, ret from m) select 'EUR_USD_a' as base, 'EUR_USD' as pair, scheme, row_idx, t0, strategy, round(ret, 8) as ret from r where strategy in ({', '.join(f"'{k}'" for k in a.STRATEGIES)})")
def published_backtests(spark, sf):
    """Return matrices that others wrote, by their place in the files."""
    return published.read_backtests(spark, _published(spark, sf))


@query(f"with {MATRIX}, {ROWS}, {COMBOS}, c as (select row_idx, count(*) as n from roles where role = 'test' group by row_idx) select 'CPCV' as scheme, row_idx, strategy, round(coalesce(ret / n, 0), 11) as ret from m left join c using (row_idx) where strategy in ({', '.join(f"'{k}'" for k in a.STRATEGIES)})", 11)
def published_means(spark, sf):
    """The same divided by the counts of tests, as published analyses do."""
    out = published.read_backtests(spark, _published(spark, sf), compat=True)
    return out.filter("scheme = 'CPCV'").select("scheme", "row_idx", "strategy", "ret")


WIDE = ", ".join(f"max(ret) filter (where strategy = '{k}') as {k}" for k in a.STRATEGIES)


@query(f"with {MATRIX} select row_idx, t0, {WIDE} from m group by row_idx, t0", None)
def wide_returns(spark, sf):
    return wide(a.return_matrix(spark, sf), ["row_idx", "t0"], "strategy", "ret", list(a.STRATEGIES))


@query(r"select event_id, substr(regexp_replace(event_type || ':/' || event_id || '?[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ']*', '[:\\/?*\[\]]', '_', 'g'), 1, 31) as sheet, round(value / 3, 6) as third from events")
def sheets(spark, sf):
    """Names of worksheets, and figures rounded as metric tables are."""
    e, ts = a.table(spark, sf, "events"), F.date_format(TS, "yyyy-MM-dd HH:mm:ss")
    name = F.concat("event_type", F.lit(":/"), "event_id", F.lit("?["), ts, F.lit("]*"))
    return rounded(e.select("event_id", sheet_name(name).alias("sheet"), (F.col("value") / 3).alias("third")), 6)


@query("select count(*) as rows, count(*) filter (where value > 60) as large from events", None)
def observed_run(spark, sf):
    """Counts that a run reports of itself."""
    df, seen = observed(a.table(spark, sf, "events"), "run", rows=F.count("*"), large=F.count_if(F.col("value") > 60))
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], seen.get["large"])], "rows long, large long")


@query("select event_id, cast(ts as timestamp) + case when event_id % 2 = 0 then interval '5 hours' else interval '0 hours' end as ts, case when event_id % 3 = 0 then null else value end as value from events", None)
def checked_times(spark, sf):
    """Times of another zone, but for those that name their own; columns without values left out, no cell filled up."""
    e = a.table(spark, sf, "events").select("event_id", F.concat(F.date_format(TS, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 2 == 0, "").otherwise("Z")).alias(TS), F.when(F.col("event_id") % 3 == 0, "none").otherwise(F.col("value").cast("string")).alias("value"), F.lit(None).cast("double").alias("empty"))
    e = clean.numeric(clean.strict_time(clean.parse_time(e, TS, "America/New_York"), TS), ["value"], None)
    return clean.without_empty_columns(e, ["value", "empty"])


def _modelled(spark, sf):
    p = stages.FeatureParams(horizon=4, minutes=60, vol=20, k=0.5, spacing_minutes=60, barrier=1.0, lookback=5)
    joined = a.quotes(spark, sf)
    labelled = stages.feature_stage(joined, p)
    x = stages.modelling_rows(labelled.withColumn("side", F.coalesce("side", F.lit(1.0))), joined)
    return saved(with_position(x.drop("row_idx"), (), "t0", "row_idx", ("pair",)))  # one model over all pairs


TRIED_ROWS = """a as (select event_id - (select min(event_id) from events) as row_idx, value / 100 as x1, (user_id % 97) / 97.0::double as x2, hour(ts) / 24.0::double as x3, 0.5 + (user_id % 5) / 4.0::double as w,
    0.3 * (value / 100) - 0.2 * ((user_id % 97) / 97.0::double) + ((event_id * 7919) % 1000) / 1000.0::double - 0.5 as r from events),
    u as (select 'WF' as scheme, fold, role, row_idx from wf union all select 'CPCV', fold, role, row_idx from cut),
    t as (select scheme, fold, role, row_idx, [x1, x2, x3, 1.0::double] as v, w, r from u join a using (row_idx))"""
NORMAL = "m0 as (select scheme, fold, i, j, sum(w * v[i] * case when j = 5 then r else v[j] end) as g from t, range(1, 5) p(i), range(1, 6) q(j) where role = 'train' group by scheme, fold, i, j)" + "".join(
    f""", m{k} as (select x.scheme, x.fold, x.i, x.j, case when x.i = {k} then x.g / p.g else x.g - y.g * z.g / p.g end as g from m{k - 1} x join m{k - 1} p on p.scheme = x.scheme and p.fold = x.fold and p.i = {k} and p.j = {k}
    join m{k - 1} y on y.scheme = x.scheme and y.fold = x.fold and y.i = x.i and y.j = {k} join m{k - 1} z on z.scheme = x.scheme and z.fold = x.fold and z.i = {k} and z.j = x.j)""" for k in range(1, 5)
)


def _trials(spark, sf):
    """Events as rows to learn from: three features, a return that two of them tell something of, a weight."""
    e, x = a.table(spark, sf, "events"), _rows(spark, sf)
    first = e.agg(F.min("event_id")).first()[0] or 0
    x1, x2 = F.col("value") / 100, (F.col("user_id") % 97) / F.lit(97.0)
    r = 0.3 * x1 - 0.2 * x2 + ((F.col("event_id") * 7919) % 1000) / F.lit(1000.0) - 0.5
    rows = e.select((F.col("event_id") - first).alias("row_idx"), x1.alias("x1"), x2.alias("x2"), (F.hour("ts") / F.lit(24.0)).alias("x3"), (0.5 + (F.col("user_id") % 5) / F.lit(4.0)).alias("weight"), r.alias("fwd_log_ret"), F.when(F.abs(r) > 0.2, F.signum(r)).otherwise(0).cast("int").alias("label"))
    return rows.join(x, "row_idx")


def _schemes(rows, n: int):
    """Both schemes of splits at the published sizes: 5 walk-forward folds, 12 of the 20 combinations of 6 blocks."""
    return (("WF", cv.walk_forward(rows, n, 5)), ("CPCV", cv.cpcv(rows, n, 6, 12, purge=300, embargo=3600)))


@query(f"with {PURGED}, {WF_SQL}, {TRIED_ROWS}, {NORMAL}, k as (select scheme, fold, {', '.join(f'max(g) filter (where i = {i}) as b{i}' for i in range(1, 5))} from m4 where j = 5 group by scheme, fold) select scheme, fold, row_idx, round(v[1] * b1 + v[2] * b2 + v[3] * b3 + b4, 6) as score from t join k using (scheme, fold) where role = 'test'", 6)
def linear_folds(spark, sf):
    """Weighted least squares of all 17 folds of both schemes: what they say of their test rows."""
    rows, out, columns = saved(_trials(spark, sf)), None, ["x1", "x2", "x3"]
    for name, splits in _schemes(rows, rows.count()):
        table, of = folds.folded(rows, splits, columns)
        part = folds.scored(table, of, len(columns), ["lin_reg"], roles=["test"]).select(F.lit(name).alias("scheme"), "fold", "row_idx", "score")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def softmax_folds(spark, sf):
    """Softmax regressions of all 17 folds: the probability of a fall for each test row."""
    rows, out, columns = saved(_trials(spark, sf)), None, ["x1", "x2", "x3"]
    for name, splits in _schemes(rows, rows.count()):
        table, of = folds.folded(rows, splits, columns)
        part = folds.scored(table, of, len(columns), ["logit_cls"], roles=["test"]).select(F.lit(name).alias("scheme"), "fold", "row_idx", "score")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def fold_scores(spark, sf):
    """Linear models over the 5 walk-forward folds: returns of the test events of each strategy."""
    x = _modelled(spark, sf)
    columns = ["ret_1", "ret_5", "vol_20", "ret_1_to_vol_20", "SP", "VBP"]
    n = x.count()
    return models.run_scheme(x, cv.walk_forward(x, n), columns).select("row_idx", "t0", "fold", "strategy", "ret", "taken")


@query()
def scheme_returns(spark, sf):
    """Both schemes of splits with all four models, thresholds, costs, means over folds and counts; all 17 folds, few trees."""
    out = backtest.run_models(_modelled(spark, sf), "ALL_x", purge=3600, least=20, columns=["ret_1", "ret_5", "vol_20", "ewma_50", "SP"], trees=3)
    return out["M"].select("scheme", "row_idx", "t0", "strategy", "ret", "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled events counted by pair and label: events to bars, both sides joined, features, CUSUM samples, triple barriers,
    weights, one aggregate."""
    return _chain(spark, sf_dir).groupBy("pair", "label").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))
