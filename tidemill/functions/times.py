"""Times as UTC: instants as they are, wall-clock times by their zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A time of day with a zone behind it: Z, a name, or an offset.
ZONED = r"\d:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:[zZ]|UTC|GMT|[A-Za-z]+/[A-Za-z_/+-]+|[+-]\d{1,2}(?::?\d{2})?)\s*$"


def of_instant(x: Column) -> Column:
    """The UTC wall-clock time of an instant, whatever the session's zone; exact where that zone repeats an hour."""
    seconds = F.unix_micros(x).cast("decimal(20,0)") / 1_000_000
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def utc_time(df: DataFrame, column: str, tz: str = "UTC") -> Column:
    """``column`` of ``df`` as UTC: instants, and text with a zone or offset, are converted; text without one and wall-clock
    times are taken to be of ``tz``; whole numbers are nanoseconds since 1970 (see ``with_nanoseconds``). Null where nothing parses."""
    kind, x = df.schema[column].dataType.typeName(), F.col(f"`{column}`")
    if kind == "timestamp":
        return of_instant(x)
    if kind == "long":
        return of_instant(F.timestamp_micros(F.expr(f"`{column}` div 1000")))
    naive = F.expr(f"try_cast(`{column}` as timestamp_ntz)")
    naive = naive if tz == "UTC" else F.convert_timezone(F.lit(tz), F.lit("UTC"), naive)
    if kind != "string":
        return naive
    return F.when(x.rlike(ZONED), of_instant(F.expr(f"try_cast(trim(`{column}`) as timestamp)"))).otherwise(naive)


def with_nanoseconds(spark: SparkSession) -> SparkSession:
    """``spark``, reading Parquet times in nanoseconds, which pandas writes and Spark has no type for, as whole numbers."""
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    return spark
