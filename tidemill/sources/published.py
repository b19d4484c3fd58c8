"""Backtests as other programs publish them: a file, or a folder of part files, for each base, scheme and kind of table.

``{base}_{WF|CPCV}_M.parquet`` has a row an event and a column a strategy beside a time; rows are known by their place in
the file alone. ``_split`` tells which places a fold tests, ``_counts`` how often a place was tested. All bases are read
together: a table's file is a column, not a table of its own in the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.times import utc_time, with_nanoseconds
from tidemill.sources.bars import discover_backtests, index_list, pair_of_base

NUMBERS = ("double", "float", "bigint", "int", "smallint", "tinyint")
#: Names of columns of times, where their type doesn't tell.
TIMES = ("t0", "ts", "time", "timestamp", "datetime", "date", "event_time")
#: The artefact of a path, without its part file, and the name of that.
ARTEFACT, PART = r"^(.*?)(?:/part-[^/]*)?$", r"(?:/(part-[^/]*))?$"


def paths(spark: SparkSession, folder: str) -> DataFrame:
    """(path): every artefact below ``folder``, once however many part files it has."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return files.select(F.regexp_extract("path", ARTEFACT, 1).alias("path")).distinct()


def placed(spark: SparkSession, files: list[str]) -> DataFrame:
    """Rows of ``files`` (of any columns; what a file lacks is null) with their artefact's ``_base`` and ``_place`` in it, from 0:
    the place in its part file after the rows of the parts before, by name."""
    if not files:
        raise ValueError("no such tables")
    rows = with_nanoseconds(spark).read.option("mergeSchema", "true").parquet(*files)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    # names are read once a file, not once a row
    base = F.regexp_extract("_path", r"([^/]+)_(?:WF|CPCV)_[A-Za-z]+\.parquet(?:/part-[^/]*)?$", 1)
    sizes = rows.groupBy("_path").agg(F.count("*").alias("_n")).select("_path", "_n", base.alias("_base"), F.regexp_extract("_path", PART, 1).alias("_part"))
    before = Window.partitionBy("_base").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_path", "_base", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))  # a row a file
    # files of few bytes can hold millions of rows: without the hint Spark may broadcast these
    return rows.join(F.broadcast(sizes), "_path").withColumn("_place", F.col("_from") + F.col("_row")).drop("_path", "_row", "_from")


def _time(rows: DataFrame, time: str | None) -> str:
    """The column of the events' times: ``time``, else the first that holds times, else one whose name says so."""
    kinds = dict(rows.dtypes)
    named = [c for c in kinds if c.lower() in TIMES or c.startswith("__index_level_")]
    names = [time] if time else [c for c, k in kinds.items() if k.startswith(("timestamp", "date"))] or named
    if not names or names[0] not in kinds:
        raise ValueError("no column of times")
    return names[0]


def _matrix(spark: SparkSession, files: list[str], scheme: str, time: str | None, first: DataFrame | None = None, n: DataFrame | None = None) -> DataFrame:
    """(base, pair, scheme, row_idx, t0, strategy, ret); rows before ``first`` (base, first) are left out, unless that would leave none,
    and the others numbered anew; returns are divided by ``n`` (base, row_idx, n). Rows are joined while they are wide."""
    rows = placed(spark, files)
    time = _time(rows, time)
    at = utc_time(rows, time)
    at = F.when(at.isNull(), F.raise_error(F.lit("a row without a time")).cast("timestamp_ntz")).otherwise(at).alias("t0")
    names = [c for c, k in rows.dtypes if k in NUMBERS and c not in ("_place", time)]
    values = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in names]
    # whether a base has a strategy: other bases' columns are null in all of its rows
    own = F.array(*(F.count(F.col(f"`{c}`")) > 0 for c in names)).cast("array<boolean>")
    known = rows.groupBy("_base").agg(own.alias("_own"), F.max("_place").alias("_last")).withColumn("_pair", pair_of_base(F.col("_base")))  # a row a base
    rows = rows.select("_base", "_place", at, *(v.alias(f"_v{i}") for i, v in enumerate(values)))
    values, place = [F.coalesce(f"_v{i}", F.lit(0.0)) for i in range(len(names))], F.col("_place")
    if first is not None:
        start = F.when((F.col("first") > 0) & (F.col("first") <= F.col("_last")), F.col("first")).otherwise(0)
        known = known.join(first.withColumnRenamed("base", "_base"), "_base", "left").withColumn("_start", start).drop("first")
        place = place - F.col("_start")
    if n is not None:
        least = n.filter("n is not null").groupBy("base").agg(F.min("row_idx").alias("_least"))
        known = known.join(least.withColumnRenamed("base", "_base"), "_base", "left").withColumn("_counted", F.coalesce(F.col("_least") <= F.col("_last"), F.lit(False))).drop("_least")
    rows = rows.join(F.broadcast(known), "_base")
    rows = rows if first is None else rows.filter("_place >= _start")
    if n is not None:
        # a table of counts has few bytes, so Spark takes it for a small one
        times = n.select(F.col("base").alias("_base"), F.col("row_idx").alias("_place"), "n").hint("merge")
        rows = rows.join(times, ["_base", "_place"], "left")
        values = [F.when(~F.col("_counted"), v).when(F.col("n") > 0, v / F.col("n")).otherwise(0.0) for v in values]
    # compiled, as a filter with a function over a row's cells would not be
    cells = [F.when(F.col("_own")[i], F.struct(F.lit(c).alias("strategy"), v.alias("ret"))) for i, (c, v) in enumerate(zip(names, values, strict=True))]
    cells = F.array(*cells).cast("array<struct<strategy:string,ret:double>>")
    out = rows.select(F.col("_base").alias("base"), F.col("_pair").alias("pair"), F.lit(scheme).alias("scheme"), place.alias("row_idx"), "t0", F.explode(cells).alias("x"))
    return out.filter("x is not null").select("base", "pair", "scheme", "row_idx", "t0", "x.*")


def first_tests(spark: SparkSession, files: list[str]) -> DataFrame:
    """(base, first): the least place that each base's first fold tests; a fold may be several rows."""
    rows = placed(spark, files)
    tests = F.col("test_idx") if dict(rows.dtypes)["test_idx"].startswith("array") else index_list(F.col("test_idx"))
    fold = F.col("fold").cast("string") if "fold" in rows.columns else F.col("_place").cast("string")
    least = rows.select(F.col("_base").alias("base"), fold.alias("fold"), "_place", F.array_min(tests).alias("least"))
    by_fold = least.groupBy("base", "fold").agg(F.min("_place").alias("_place"), F.min("least").alias("least"))  # a row a fold
    return by_fold.groupBy("base").agg(F.min_by("least", "_place").alias("first"))


def counts(spark: SparkSession, files: list[str]) -> DataFrame:
    """(base, row_idx, n): how often a place was tested, by the column ``count`` or else the first of numbers."""
    rows = placed(spark, files)
    names = [c for c, k in rows.dtypes if k in NUMBERS and c != "_place"]
    first = F.col("count") if "count" in names else F.coalesce(*(F.col(f"`{c}`") for c in names))
    return rows.select(F.col("_base").alias("base"), F.col("_place").alias("row_idx"), first.cast("double").alias("n"))


def read_backtests(spark: SparkSession, folder: str, time: str | None = None, compat: bool = False) -> DataFrame:
    """(base, pair, scheme, row_idx, t0, strategy, ret) of all backtests below ``folder``; a missing return is 0.

    A walk-forward's rows before the first that it tests are left out, unless that would leave none, and its rows numbered
    anew; without its split table it is an error. With ``compat`` the returns of combinatorial schemes, which are means already, are
    divided by the counts of tests once more (0 where there were none), as published analyses do where counts are there.
    """
    found = discover_backtests(paths(spark, folder)).collect()  # a row a backtest
    of = lambda kind: sorted(r[kind] for r in found if r[kind])
    if bare := sorted(r.base for r in found if r.WF_M and not r.WF_splits):
        raise ValueError(f"no split table of {', '.join(bare[:5])}")
    out = None
    if files := of("WF_M"):
        out = _matrix(spark, files, "WF", time, first=first_tests(spark, of("WF_splits")))
    if files := of("CPCV_M"):
        n = counts(spark, of("CPCV_counts")) if compat and of("CPCV_counts") else None
        m = _matrix(spark, files, "CPCV", time, n=n)
        out = m if out is None else out.unionByName(m)
    if out is None:
        raise ValueError(f"no backtests below {folder}")
    return out
