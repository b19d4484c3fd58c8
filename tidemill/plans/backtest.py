"""Backtests: models over both schemes of splits, their tables on disk, and the analysis of all that are there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import cv, report
from tidemill.operators.costs import Costs
from tidemill.plans import models, stages
from tidemill.sources.bars import pair_of_base
from tidemill.sources.published import read_backtests
from tidemill.storage import saved


def run_models(rows: DataFrame, base: str, costs: Costs = Costs(), folds: int = 5, blocks: int = 6, most: int = 12, purge: float = 300, embargo: float = 3600, least: int = 200, columns: Sequence[str] | None = None, trees: int = 300, names: Sequence[str] = ("logit_cls", "gbt_cls", "lin_reg", "gbt_reg")) -> dict[str, DataFrame]:
    """Tables of one base, each with (base, scheme): returns M and counts a row and strategy (means over the folds that test
    a row), splits, results a fold and strategy, and a status. With fewer than ``least`` rows there is only the status."""
    spark, n = rows.sparkSession, rows.count()
    status = spark.createDataFrame([(base, n, n >= least)], "base string, rows long, run boolean")
    if n < least:
        return {"status": status}
    columns = list(columns or models.feature_columns(rows))
    out: dict[str, list[DataFrame]] = {"M": [], "splits": [], "results": []}
    for scheme, splits in (("WF", cv.walk_forward(rows, n, folds)), ("CPCV", cv.cpcv(rows, n, blocks, most, purge=purge, embargo=embargo))):
        splits = saved(splits)
        returns = saved(models.run_scheme(rows, splits, columns, costs, trees, names))
        named = lambda x, s=scheme: x.select(F.lit(base).alias("base"), F.lit(s).alias("scheme"), "*")
        tested = cv.accumulate(returns, ("row_idx", "strategy")).select("row_idx", "strategy", "ret", "n")
        grid = rows.select("row_idx", "t0", F.explode(F.array(*map(F.lit, models.strategies(names)))).alias("strategy"))
        m = grid.join(tested, ["row_idx", "strategy"], "left")  # a row that no fold tests returns 0
        out["M"].append(named(m.select("row_idx", "t0", "strategy", F.coalesce("ret", F.lit(0.0)).alias("ret"), F.coalesce("n", F.lit(0)).cast("smallint").alias("n"))))
        out["splits"].append(named(cv.split_lists(splits)))
        sizes = splits.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"))
        out["results"].append(named(returns.select("fold", "strategy").distinct().join(F.broadcast(sizes), "fold")))  # a row a fold
    return {"status": status} | {k: v[0].unionByName(v[1]) for k, v in out.items()}


def write(tables: dict[str, DataFrame], path: str) -> None:
    """Each table under its name; returns and splits in folders by base and scheme, so bases are found by listing."""
    for name, df in tables.items():
        by = [c for c in ("base", "scheme") if c in df.columns]
        df.write.mode("append").partitionBy(*by).parquet(f"{path}/{name}")


def analyse(spark: SparkSession, path: str, blocks: int = 8, most: int | None = None) -> dict[str, DataFrame]:
    """Metrics of all backtests that ``write`` put under ``path``, and their summaries. Rows before a walk-forward's first test are
    not counted; rows are numbered anew within each base and scheme."""
    m, splits = spark.read.parquet(f"{path}/M"), spark.read.parquet(f"{path}/splits")
    first = splits.filter("scheme = 'WF' and fold = 1").select("base", "scheme", F.array_min("test_idx").alias("_first"))
    m = m.join(first, ["base", "scheme"], "left").filter(F.col("row_idx") >= F.coalesce("_first", F.lit(0)))
    m = m.withColumn("row_idx", F.col("row_idx") - F.coalesce("_first", F.lit(0))).withColumn("pair", pair_of_base(F.col("base")))
    return summaries(m, blocks, most)


def analyse_published(spark: SparkSession, folder: str, blocks: int = 8, most: int | None = None, time: str | None = None, compat: bool = False) -> dict[str, DataFrame]:
    """As ``analyse``, of the tables of other programs (``sources.published``)."""
    return summaries(read_backtests(spark, folder, time, compat), blocks, most)


def summaries(m: DataFrame, blocks: int = 8, most: int | None = None) -> dict[str, DataFrame]:
    keys = ("base", "pair", "scheme")
    metrics = saved(stages.analyse(m.select(*keys, "row_idx", "t0", "strategy", "ret"), keys, blocks, most))
    return {"metrics": metrics, "best_strategies": report.best_strategies(metrics), "models": report.model_summary(metrics), "best_cases": report.best_cases(metrics), "robustness": report.robustness(metrics)}
