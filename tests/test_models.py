import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import cv
from tidemill.plans import models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 2))
    y = 0.3 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(size=240) * 0.1
    w = rng.uniform(0.5, 2, 240)
    data = [(i, float(a), float(b), float(t), int(np.sign(t) if abs(t) > 0.2 else 0), float(v)) for i, ((a, b), t, v) in enumerate(zip(x, y, w))]
    df = spark.createDataFrame(data, "row_idx int, a double, b double, fwd_log_ret double, label int, weight double")
    return df.withColumn("t0", (F.timestamp_seconds(F.lit(1704700000) + F.col("row_idx") * 3600)).cast("timestamp_ntz")), x, y, w


def test_columns_leave_later_knowledge_out(rows):
    assert models.feature_columns(rows[0]) == ["a", "b"]
    assert models.feature_columns(rows[0], compat=True) == ["a", "b", "weight"]


def test_weighted_least_squares(rows):
    df, x, y, w = rows
    data, splits = models.assembled(df, ["a", "b"]), cv.walk_forward(df, 240, 2)
    got = models.score_fold(data, splits, 1, "lin_reg", models.regressors()["lin_reg"], ("row_idx",)).filter("role = 'test'").orderBy("row_idx").collect()
    z = np.c_[x, np.ones(240)]
    beta = np.linalg.solve((z[:80] * w[:80, None]).T @ z[:80], (z[:80] * w[:80, None]).T @ y[:80])
    assert [r.score for r in got] == pytest.approx((z[80:160] @ beta).tolist(), abs=1e-6)


def test_classifier_beats_the_share_of_classes(rows):
    df, *_ = rows
    data, splits = models.assembled(df, ["a", "b"]), cv.walk_forward(df, 240, 2)
    got = models.score_fold(data, splits, 2, "logit_cls", models.classifiers(weight_sum=200)["logit_cls"], ("row_idx", "y")).filter("role = 'test'").collect()
    p, hit = np.clip([r.score for r in got], 1e-6, 1 - 1e-6), np.array([r.y == 0 for r in got])
    loss = lambda q: -np.mean(np.where(hit, np.log(q), np.log(1 - q)))
    assert loss(p) < 0.7 * loss(np.full(len(p), hit.mean()))


def test_scheme_gives_a_return_for_each_test_row(rows):
    df, *_ = rows
    out = models.run_scheme(df, cv.walk_forward(df, 240, 2), ["a", "b"], trees=2, models=("logit_cls", "lin_reg", "gbt_reg")).groupBy("strategy").count().collect()
    assert {r.strategy: r["count"] for r in out} == {n: 160 for n in ("logit_cls", *(f"{m}__q{q}" for m in ("lin_reg", "gbt_reg") for q in (70, 80, 90, 95)))}


def test_backtests_are_written_found_and_analysed(spark, rows, tmp_path):
    from tidemill.operators import report
    from tidemill.plans import backtest

    df = rows[0].withColumn("t_end", F.col("t0") + F.expr("interval 30 minutes")).withColumn("side", F.when(F.col("a") > 0, 1).otherwise(-1))
    assert list(backtest.run_models(df, "EUR_USD_x", least=1000)) == ["status"]
    out = backtest.run_models(df, "EUR_USD_x", folds=2, blocks=4, most=3, columns=["a", "b"], names=("logit_cls", "lin_reg"), least=100)
    backtest.write(out, str(tmp_path))
    found = backtest.analyse(spark, str(tmp_path), blocks=4)
    metrics = found["metrics"].collect()
    assert {(r.pair, r.scheme) for r in metrics} == {("EUR_USD", "WF"), ("EUR_USD", "CPCV")} and len(metrics) == 10
    assert all((r.PBO is None) == (r.scheme == "WF") for r in metrics)  # 160 rows are too few, 240 are not
    assert found["best_strategies"].count() == 2 and found["models"].count() == 2
    text = report.backtest_report(df, F.col("a") > 0.5, cv.walk_forward(df, 240, 2)).collect()
    assert {r.section for r in text} == {"payoff", "side", "fold"}
    assert {r.value for r in text if r.metric == "shared_rows"} == {0.0}


def test_boosted_classes_score_by_probability(rows):
    """Under a tenth of the rows are of the lowest class: the threshold stays a probability, and few rows are sold."""
    df, x, y, _ = rows
    cut = float(np.quantile(y, 0.08))
    df = df.withColumn("label", F.when(F.col("fwd_log_ret") < cut, -1).when(F.col("fwd_log_ret") > 0.2, 1).otherwise(0))
    out = models.run_scheme(df, cv.walk_forward(df, 240, 1), ["a", "b"], trees=20, models=("gbt_cls",)).collect()
    taken = sum(r.taken for r in out)
    assert len(out) == 120 and 0 < taken < 40
    data = models.assembled(df, ["a", "b"])
    got = models.score_fold(data, cv.walk_forward(df, 240, 1), 1, "gbt_cls", models.classifiers(60)["gbt_cls"], ("row_idx",)).collect()
    assert len({round(r.score, 6) for r in got}) > 2 and all(0 < r.score < 1 for r in got)
