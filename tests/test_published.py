"""Backtests written by pandas in the published layout, and ranks without a single task."""

import json
import math
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill import frames
from tidemill.functions import normal
from tidemill.operators import cv
from tidemill.plans import adapters, backtest
from tidemill.sources import published
from tidemill.sources.sinks import wide


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two bases: one with both schemes and an index of times, one with text for times, lists as JSON and strategies of its own."""
    path, rng = tmp_path_factory.mktemp("tested"), np.random.default_rng(2)
    at = pd.date_range("2024-01-02", periods=240, freq="3h", tz="UTC", name="t0")
    m = {}
    for base, scheme, names, index in (("EUR_USD_a", "WF", "ab", at), ("EUR_USD_a", "CPCV", "abc", at), ("GBP_USD_b", "WF", "acd", at.strftime("%Y-%m-%dT%H:%M:%S+00:00").rename(None))):
        df = pd.DataFrame(rng.normal(size=(240, len(names))).round(4) / 100, index=index, columns=list(names))
        df.iloc[3, 0] = np.nan
        df.to_parquet(path / f"{base}_{scheme}_M.parquet")
        m[base, scheme] = df
        tests = [list(range(40, 140)), list(range(140, 240))]
        cell = (lambda x: x) if base == "EUR_USD_a" else json.dumps
        if base == "EUR_USD_a" or scheme == "WF":
            pd.DataFrame({"fold": [1, 2], "train_idx": [cell(list(range(40))), cell(list(range(140)))], "test_idx": [cell(t) for t in tests]}).to_parquet(path / f"{base}_{scheme}_split.parquet", index=False)
    pd.DataFrame({"a": [2, 0, 4] * 80, "b": [1] * 240}).to_parquet(path / "EUR_USD_a_CPCV_counts.parquet", index=False)
    return str(path), m


def test_published_matrices(spark, folder):
    path, m = folder
    got = {(r.base, r.scheme, r.row_idx, r.strategy): (r.t0, r.ret) for r in _read(spark, path).collect()}
    assert len(got) == 200 * 2 + 240 * 3 + 200 * 3
    for (base, scheme), df in m.items():
        first = 40 if scheme == "WF" else 0
        for i, c in product(range(0, 240 - first, 7), df.columns):
            at, ret = got[base, scheme, i, c]
            assert at == pd.Timestamp(df.index[i + first]).tz_localize(None) and ret == pytest.approx(np.nan_to_num(df[c].iloc[i + first]))
    twice = {(r.row_idx, r.strategy): r.ret for r in _read(spark, path, compat=True).filter("scheme = 'CPCV'").collect()}
    df = m["EUR_USD_a", "CPCV"]
    assert twice[0, "b"] == pytest.approx(df.b.iloc[0] / 2) and twice[1, "b"] == 0 and twice[2, "c"] == pytest.approx(df.c.iloc[2] / 4)


def _read(spark, path, **given):
    """Files with times of one type are read together."""
    parts = [published.read_backtests(spark, f"{path}/{base}*", **given) for base in ("EUR_USD_a", "GBP_USD_b")]
    return parts[0].unionByName(parts[1])


def test_published_backtests_are_analysed(spark, folder):
    out = backtest.analyse_published(spark, folder[0] + "/EUR*", blocks=4)
    rows = out["metrics"].collect()
    assert {(r.scheme, r.strategy) for r in rows} == {("WF", "a"), ("WF", "b"), *(("CPCV", c) for c in "abc")}
    daily = folder[1]["EUR_USD_a", "CPCV"].b.fillna(0).resample("1D").sum()
    sharpe = next(r.sharpe for r in rows if r.scheme == "CPCV" and r.strategy == "b")
    assert sharpe == pytest.approx(daily.mean() / daily.std(ddof=1) * math.sqrt(252), rel=0.02) or sharpe == pytest.approx(daily.mean() / daily.std(ddof=1), rel=1e-6)


def test_missing_split_table(spark, tmp_path):
    pd.DataFrame({"a": [0.1]}, index=pd.DatetimeIndex(["2024-01-01"], name="t0")).to_parquet(tmp_path / "EUR_USD_x_WF_M.parquet")
    with pytest.raises(ValueError, match="EUR_USD_x"):
        published.read_backtests(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no backtests"):
        published.read_backtests(spark, str(tmp_path / "*none*")) if (tmp_path / "y_none").mkdir() is None else None


def test_places_and_ranks_need_no_single_task(spark):
    rng = np.random.default_rng(1)
    rows = [(str(rng.choice(["a", "b"])) if rng.random() > 0.1 else None, float(rng.integers(0, 30)) if rng.random() > 0.05 else None, i) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, x double, i int").repartition(7)
    x = pd.DataFrame(rows, columns=["k", "x", "i"])
    got = frames.numbered(df, ["x", "i"], ["k"]).toPandas().sort_values("i").reset_index(drop=True)
    want = x.sort_values(["x", "i"], na_position="first").groupby("k", dropna=False).cumcount().sort_index()
    assert (got._n == want).all()
    ranks = frames.with_average_rank(df, "x", "r").toPandas().sort_values("i").reset_index(drop=True)
    assert np.allclose(ranks.r, x.x.fillna(-1).rank())
    plan = frames.numbered(df, ["x", "i"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1  # of a row a range


@pytest.mark.parametrize("n", [1, 2, 5])
def test_exact_two_sample_p_values(spark, n):
    """Every order of n and n values is as likely; the statistic of each is counted."""
    from itertools import combinations

    far = []
    for ups in combinations(range(2 * n), n):
        at, most = 0, 0
        for i in range(2 * n):
            at += 1 if i in ups else -1
            most = max(most, abs(at))
        far.append(most)
    df = spark.createDataFrame([(k / n, n) for k in range(n + 1)], "d double, n int")
    got = [r[0] for r in df.orderBy("d").select(normal.kolmogorov_p(F.col("d"), F.col("n"))).collect()]
    assert got == pytest.approx([sum(f >= k for f in far) / len(far) for k in range(n + 1)])
    big = spark.createDataFrame([(0.02, 10_000), (0.02, 10_001)], "d double, n int")
    p, q = (r[0] for r in big.select(normal.kolmogorov_p(F.col("d"), F.col("n"))).collect())
    assert p == pytest.approx(q, rel=0.02)


def test_counts_are_not_broadcast(spark, folder):
    """Repeated counts of millions of rows are a file of few bytes; only tables of a row a file, base or fold are broadcast."""
    plan = published.read_backtests(spark, folder[0] + "/EUR*", compat=True).filter("scheme = 'CPCV'")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_a_fold_may_be_several_rows(spark, tmp_path):
    """Lists in spans, the first of which tests nothing; part files and lists of a written backtest do not change what is read."""
    at = pd.date_range("2024-01-02", periods=60, freq="h", name="t0")
    pd.DataFrame({"a": np.arange(60.0)}, index=at).to_parquet(tmp_path / "EUR_USD_s_WF_M.parquet")
    spans = [(1, range(20), []), (1, [], range(20, 40)), (2, range(40), range(40, 60))]
    pd.DataFrame([{"fold": f, "train_idx": list(a), "test_idx": list(b)} for f, a, b in spans]).to_parquet(tmp_path / "EUR_USD_s_WF_split.parquet")
    rows = published.read_backtests(spark, str(tmp_path)).collect()
    assert sorted((r.row_idx, r.ret) for r in rows) == [(i, i + 20.0) for i in range(40)]
    from tidemill import registry

    written = [registry._published(spark, "/root/testdata/sf0.001", most) for most in (130, 10**6)]
    parts, whole = (sorted(map(tuple, published.read_backtests(spark, w, compat=True).collect())) for w in written)
    assert parts == whole and parts
    assert spark.read.parquet(f"{written[0]}/EUR_USD_a_CPCV_split.parquet").filter("size(train_idx) > 130 or size(test_idx) > 130").count() == 0


@pytest.mark.parametrize("most", [None, 7, 50])
def test_lists_of_kinds_are_those_of_splits(spark, most):
    """Lists put together by kinds of rows, purged or not, equal those of splits row by row; a place is shuffled once, by its span."""
    rows = spark.range(100).select(F.col("id").alias("row_idx"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("t0"))
    rows = rows.withColumn("t_end", F.col("t0") + F.expr("interval '0 00:01:00' day to second") * (F.col("row_idx") % 9))
    given = [((rows, 100, 5), cv.walk_forward, cv.walk_forward_kinds, {}), ((rows, 100, 6, 12), cv.cpcv, cv.cpcv_kinds, {})]
    given += [((rows, 100, 6), cv.cpcv, cv.cpcv_kinds, k) for k in ({"purge": 90, "embargo": 200}, {"purge_rows": 3, "embargo_share": 0.05})]
    for args, flat, by_kinds, more in given:
        splits, (kinds, uses) = flat(*args, **more), by_kinds(*args, **more)
        lists = cv.lists_of_kinds(kinds, uses, most, 4)
        plan = lists._jdf.queryExecution().executedPlan().toString()
        got, want = lists.collect(), cv.split_lists(splits, most or 1000).collect()
        order = [(r.part, r.fold) for r in got]
        assert order == sorted(order) and len(order) == len(set(order))
        assert {(r.part, r.fold): r.asDict() for r in got} == {(r.part, r.fold): r.asDict() for r in want}
        assert sorted(cv.counts_of_kinds(kinds, uses).collect()) == sorted(cv.test_counts(splits).collect())
        assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan and "explode" not in plan


def test_a_written_matrix_is_not_pivoted(spark, sf_dir):
    """A row an event from the start equals the pivoted matrix, without a shuffle."""
    names = list(adapters.STRATEGIES)
    got, want = adapters.wide_matrix(spark, sf_dir), wide(adapters.return_matrix(spark, sf_dir), ["row_idx", "t0"], "strategy", "ret", names)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_cells_are_read_by_compiled_code(spark, folder):
    """Neither functions over a row's cells nor the base's name are evaluated row by row."""
    plan = published.read_backtests(spark, folder[0] + "/EUR*")._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan
    tops = [line for line in plan.splitlines() if "strategy" in line and "Project" in line]
    assert tops and not any("substring_index" in line for line in tops)
