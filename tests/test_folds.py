"""Models of all folds at once against one fit a fold in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import cv
from tidemill.plans import boosting, folds, models

N = 300


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = np.c_[rng.normal(size=(N, 2)) * [1, 30] + [5, 1000], np.round(rng.normal(size=N), 1)]
    y = 0.3 * (x[:, 0] - 5) - 0.01 * (x[:, 1] - 1000) + rng.normal(size=N) * 0.2
    w = rng.uniform(0.5, 2, N)
    label = np.where(np.abs(y) > 0.25, np.sign(y), 0).astype(int)
    rows = [(i, *map(float, a), float(t), int(c), float(v)) for i, (a, t, c, v) in enumerate(zip(x, y, label, w))]
    df = spark.createDataFrame(rows, "row_idx long, a double, b double, c double, fwd_log_ret double, label int, weight double")
    t0 = F.timestamp_seconds(F.lit(1704700000) + F.col("row_idx") * 3600).cast("timestamp_ntz")
    df = df.withColumn("t0", t0).withColumn("t_end", t0 + F.expr("interval 2 hours")).repartition(3)
    splits = cv.cpcv(df, N, 4, purge=3600, embargo=7200)
    trains = {}
    for r in splits.filter("role = 'train'").collect():
        trains.setdefault(r.fold, []).append(r.row_idx)
    table, of = folds.folded(df, splits, ["a", "b", "c"])
    return df, splits, table, of, [np.array(sorted(trains[f])) for f in of], x, y, label + 1, w


def test_least_squares_of_all_folds(data):
    _, _, table, of, trains, x, y, _, w = data
    known = folds.Statistics(table, len(of), 3)
    got = folds.least_squares(known)
    a = folds.design(x, known.mean, known.scale)
    assert len(of) == 6
    for beta, rows in zip(got, trains):
        root = np.sqrt(w[rows])[:, None]
        want = np.linalg.lstsq(a[rows] * root, y[rows] * root[:, 0], rcond=None)[0]
        assert np.abs(beta - want).max() < 1e-8
    assert known.rows.tolist() == [len(t) for t in trains] and np.allclose(known.weight, [w[t].sum() for t in trains])
    assert np.allclose(known.spread * known.scale, [x[t].std(0) for t in trains])


def test_softmax_regression_of_all_folds(data):
    """At the optimum the gradient of each fold's own penalised loss is zero; the penalty is on weights of the fold's scaler."""
    _, _, table, of, trains, x, _, c, w = data
    known = folds.Statistics(table, len(of), 3)
    got = folds.softmax_regression(table, len(of), known)
    for beta, rows in zip(got, trains):
        mean, std = x[rows].mean(0), x[rows].std(0)
        own = np.c_[(x[rows] - mean) / std, np.ones(len(rows))]
        weights = beta[:, :3] / known.scale * std
        constant = beta[:, 3] + (beta[:, :3] * (mean - known.mean) / known.scale).sum(1)
        p = folds.softmax(own @ np.c_[weights, constant].T)
        grad = ((p - np.eye(3)[c[rows]]) * w[rows][:, None]).T @ own
        grad[:, :3] += weights
        assert np.abs(grad).max() < 1e-6


def test_jobs_do_not_grow_with_folds(spark, data):
    df = data[0]
    jobs = []
    for n in (1, 5):
        group = f"folds-{n}"
        splits = cv.walk_forward(df, N, n)
        spark.sparkContext.setJobGroup(group, group)
        out = models.run_scheme(df, splits, ["a", "b", "c"], trees=2, models=("logit_cls", "gbt_cls", "lin_reg", "gbt_reg"))
        assert out.count() == n * (N // (n + 1)) * 10
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 6  # a Newton step or two more


def plain_boosting(x, c, r, w, s, edges):
    """The same trees for one fold, node by node over its training rows."""
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    ids = np.arange(len(x))
    start = np.average(r[w > 0], weights=w[w > 0])
    margins = np.tile([0.0, 0.0, 0.0, start], (len(x), 1))
    for t in range(s.rounds):
        p = np.exp(margins[:, :3]) / np.exp(margins[:, :3]).sum(1, keepdims=True)
        sampled = w * (boosting.uniform(ids, s.seed + t) < s.rows)
        step = np.zeros_like(margins)
        for o in range(4):
            g = (p[:, o] - (c == o) if o < 3 else margins[:, 3] - r) * sampled
            h = (2 * p[:, o] * (1 - p[:, o]) if o < 3 else np.ones(len(x))) * sampled
            allowed = sorted(np.random.default_rng([s.seed, t, o]).permutation(x.shape[1])[: max(1, round(s.columns * x.shape[1]))])
            todo = [(np.arange(len(x)), 0)]
            while todo:
                own, depth = todo.pop()
                G, H, best = g[own].sum(), h[own].sum(), (1e-12, None)
                for j in allowed if depth < s.depth else ():
                    for b in range(s.bins - 1):
                        left = bins[own, j] <= b
                        gl, hl = g[own][left].sum(), h[own][left].sum()
                        if hl >= s.least and H - hl >= s.least:
                            gain = gl**2 / (hl + s.l2) + (G - gl) ** 2 / (H - hl + s.l2) - G**2 / (H + s.l2)
                            if gain > best[0] + 1e-9:
                                best = gain, left
                if best[1] is None:
                    step[own, o] = -s.rate * G / (H + s.l2)
                else:
                    todo += [(own[best[1]], depth + 1), (own[~best[1]], depth + 1)]
        margins += step
    return margins


def test_boosting_equals_a_plain_version(data):
    _, _, table, of, trains, x, y, c, w = data
    s = boosting.Settings(rounds=4, depth=3, rate=0.3, bins=8)
    known = folds.Statistics(table, len(of), 3)
    old, boosting.SAVE = boosting.SAVE, 2  # margins are written on the way
    try:
        forest = boosting.boosted(table, len(of), 3, known.mean_return, s)
    finally:
        boosting.SAVE = old
    margins = forest.margins(x)
    for f in (0, 3, 5):
        used = np.zeros(N)
        used[trains[f]] = w[trains[f]]
        want = plain_boosting(x, c, y, used, s, forest.edges)
        p, q = folds.softmax(margins[:, f, :3]), folds.softmax(want[:, :3])
        assert np.allclose(p.sum(1), 1)
        loss = [-np.log(z[trains[f], c[trains[f]]]).mean() for z in (p, q)]
        assert abs(loss[0] / loss[1] - 1) < 0.02 and loss[0] < 0.9 * np.log(3)
        assert np.abs(margins[:, f] - want).max() < 1e-6


def test_folds_of_odd_tables(spark, data):
    df, splits = data[:2]
    assert models.run_scheme(df, splits.filter("false"), ["a"], models=("logit_cls", "lin_reg")).count() == 0
    only = splits.filter("role = 'test' or fold > 1")  # a fold that trains on nothing has even scores
    out = models.run_scheme(df, only.filter("fold < 3"), ["a"], models=("logit_cls", "lin_reg"))
    assert {r[0] for r in out.select("fold").distinct().collect()} == {2}
    flat = df.withColumn("a", F.lit(1.0)).withColumn("weight", F.lit(None).cast("double"))
    assert models.run_scheme(flat, splits, ["a", "b"], models=("logit_cls", "lin_reg", "gbt_cls"), trees=1).filter("ret is null or isnan(ret)").count() == 0


def test_thousands_of_folds(data):
    """14 blocks have 3,432 folds; each row is in half of the tests, and what purging leaves is what its definition leaves."""
    import time

    df, began = data[0], time.time()
    splits = cv.cpcv(df, N, 14, purge=3600, embargo=7200)
    tests = splits.filter("role = 'test'").groupBy("row_idx").count().collect()
    assert len(tests) == N and {r["count"] for r in tests} == {1716} and time.time() - began < 90
    rows = {r.row_idx: (r.t0, r.t_end) for r in df.collect()}
    for fold in (1, 1000, 3432):
        own = splits.filter(F.col("fold") == fold).collect()
        test, train = ({r.row_idx for r in own if r.role == x} for x in ("test", "train"))
        runs, last = [], None
        for i in sorted(test):
            runs, last = (runs[:-1] + [(runs[-1][0], i)] if last is not None and i == last + 1 else runs + [(i, i)]), i
        hour = np.timedelta64(1, "h").astype("timedelta64[s]").item()
        want = {
            i for i in set(rows) - test
            if not any(rows[i][0] <= rows[b][1] + hour and rows[i][1] >= rows[a][0] - hour or rows[b][1] < rows[i][0] <= rows[b][1] + 2 * hour for a, b in runs)
        }
        assert train == want


def test_uses_are_bits_of_words_and_scores_of_one_role(data):
    """40 folds take more than one word; only the uses in a role that is asked for are scored."""
    df, rows = data[0], cv.walk_forward(data[0], N, 40)
    table, of = folds.folded(df, rows, ["a", "b", "c"])
    got = table.select("row_idx", "trains", "tests").collect()
    used = {(f, role, r.row_idx) for r in got for role, words in (("train", r.trains), ("test", r.tests)) for k, f in enumerate(of) if words[k // folds.WORD] >> k % folds.WORD & 1}
    want = {(r.fold, r.role, r.row_idx) for r in rows.collect()}
    assert len(of) == 40 and used == want
    scores = folds.scored(table, of, 3, ["lin_reg"], roles=["test"]).select("fold", "role", "row_idx").collect()
    assert {tuple(r) for r in scores} == {x for x in want if x[1] == "test"} and len(scores) == len(set(scores))
