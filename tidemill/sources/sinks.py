"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = ("pair",)) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, as metric tables are written."""
    return df.select(*(F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


def sheet_name(name: Column) -> Column:
    """A worksheet's name: no ``: \\ / ? * [ ]``, 31 characters at most."""
    return F.substring(F.regexp_replace(name, r"[:\\/?*\[\]]", "_"), 1, 31)


def wide(df: DataFrame, rows: list[str], column: str, value: str, names: list[str] | None = None) -> DataFrame:
    """A long table of returns or counts with one column for each strategy."""
    return df.groupBy(*rows).pivot(column, names).agg(F.first(value))


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` that reports ``metrics`` (row counts and the like) when it is next run, without a job of its own."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in metrics.items())), seen
