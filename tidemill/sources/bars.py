"""Readers of bar files and of backtest tables, and bars made from an event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.frames import floor_minutes
from tidemill.functions.times import utc_time

OHLC = ("open", "high", "low", "close")


def _name(path: Column) -> Column:
    """The name of a file, or of the folder whose part files a writer made, in capitals."""
    return F.upper(F.regexp_extract(path, r"([^/]+?)(?:/part-[^/]*)?$", 1))


def pair_of(path: Column) -> Column:
    """'XXX_YYY' from a path with 'XXXYYY_BID' or 'XXX_YYY_BID' (or ASK) in its name; an error if there is neither."""
    name = _name(path)
    a, b = F.regexp_extract(name, r"([A-Z]{3})_?([A-Z]{3})_(?:BID|ASK)", 1), F.regexp_extract(name, r"([A-Z]{3})_?([A-Z]{3})_(?:BID|ASK)", 2)
    return F.when(a != "", F.concat_ws("_", a, b)).otherwise(F.raise_error(F.concat(F.lit("no pair and side in "), path)).cast("string"))


def side_of(path: Column) -> Column:
    side = F.regexp_extract(_name(path), r"_(BID|ASK)(?:_|\.|$)", 1)
    return F.when(side != "", side).otherwise(F.raise_error(F.concat(F.lit("no side in "), path)).cast("string"))


def read_bars(spark: SparkSession, path: str | list[str], time: str = "timestamp", mixed: bool = False) -> DataFrame:
    """All CSV files under ``path`` (a glob) as (pair, side, ts, OHLC, ordinal). Columns are found by name and only these
    are read; a missing price is null; times become UTC (those without a zone are taken to be it); times that do not parse, and
    NaN, become null; ``ordinal`` is the source order.
    Files are taken to have one header; with ``mixed`` each row's cells are named by the header of its own file, a table of a
    row a file, and cells are taken to hold no commas."""
    if mixed:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("at"))
        names = F.transform(F.split("value", ","), lambda x: F.trim(x))
        heads = lines.filter(F.array_contains(names, time)).groupBy("at").agg(F.min(names).alias("names"))
        raw = lines.filter(~F.array_contains(names, time)).withColumn("ordinal", F.monotonically_increasing_id()).join(heads, "at")
        cells = F.split("value", ",")
        raw = raw.select("at", "ordinal", *(F.get(cells, F.array_position("names", c).cast("int") - 1).alias(c) for c in (time, *OHLC)))
    else:
        raw = spark.read.option("header", True).csv(path)
        raw = raw.select(*(F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in (time, *OHLC)), F.col("_metadata.file_path").alias("at"), F.monotonically_increasing_id().alias("ordinal"))
    price = [F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(None).cast("double")).alias(c) for c in OHLC]
    return raw.select(pair_of(F.col("at")).alias("pair"), side_of(F.col("at")).alias("side"), utc_time(raw, time).alias("ts"), *price, "ordinal")


def paired_sides(bars: DataFrame) -> DataFrame:
    """(pair, sides, complete): which pairs have both a bid and an ask side."""
    return bars.groupBy("pair").agg(F.array_sort(F.collect_set("side")).alias("sides")).withColumn("complete", F.size("sides") == 2)


def index_list(cell: Column) -> Column:
    """A list of row numbers from JSON or bracketed, comma-separated text; an empty or null cell is an empty list, and a part
    that is no number an error, as a split that loses rows would not show it."""
    text = F.trim(cell)
    parts = F.filter(F.split(F.regexp_replace(text, r"[\[\](){}\s]", ""), ","), lambda x: x != "")
    number = lambda x: F.coalesce(x.try_cast("bigint"), x.try_cast("double").cast("bigint"), F.raise_error(F.concat(F.lit("no row number: "), x)).cast("bigint"))
    return F.coalesce(F.transform(parts, number), F.array().cast("array<bigint>"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(fold, train_idx, test_idx) whatever way the lists are stored."""
    df = spark.read.parquet(path)
    kinds = dict(df.dtypes)
    lists = [(F.col(c).cast("array<bigint>") if kinds[c].startswith("array") else index_list(F.col(c))).alias(c) for c in ("train_idx", "test_idx")]
    return df.select("fold", *lists)


def pair_of_base(base: Column) -> Column:
    return F.substring_index(base, "_", 2)


def discover_backtests(files: DataFrame, path: str = "path") -> DataFrame:
    """From a table of paths: (base, pair) and the path, or null, of each artefact of a backtest that has a return matrix."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.parquet)?(?:/part-[^/]*)?/?$", 1)
    of = lambda k: F.regexp_extract(name, r"^(.*)_(WF|CPCV)_(M|split|counts|results)s?$", k)
    parts = files.select(F.col(path).alias("path"), of(1).alias("base"), of(2).alias("scheme"), F.when(of(3) == "split", "splits").otherwise(of(3)).alias("kind"))
    kinds = [F.max(F.when((F.col("scheme") == s) & (F.col("kind") == k), F.col("path"))).alias(f"{s}_{k}") for s in ("WF", "CPCV") for k in ("M", "splits", "counts", "results")]
    found = parts.filter("base <> ''").groupBy("base").agg(*kinds).filter("WF_M is not null or CPCV_M is not null")
    return found.withColumn("pair", pair_of_base(F.col("base")))


def bars_from_events(events: DataFrame, minutes: int = 60, pairs: int = 7) -> DataFrame:
    """OHLC bars of ``value`` per pair (user_id modulo ``pairs``): one shuffle with map-side combining."""
    rows = events.select(F.concat(F.lit("P"), F.col("user_id") % pairs).alias("pair"), floor_minutes(F.col("ts"), minutes).alias("bar"), "ts", "value")
    return rows.groupBy("pair", "bar").agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close")).withColumnRenamed("bar", "ts")


def quotes_from_events(events: DataFrame, minutes: int = 60, pairs: int = 7) -> DataFrame:
    """Bars of both sides: the ask side is the bid side plus a spread that depends on the pair."""
    bars = bars_from_events(events, minutes, pairs)
    spread = 0.0001 * (1 + F.substring("pair", 2, 3).cast("double"))
    ask = bars.select("pair", "ts", F.lit("ASK").alias("side"), *((F.col(c) + spread).alias(c) for c in OHLC))
    return bars.select("pair", "ts", F.lit("BID").alias("side"), *OHLC).unionByName(ask)
