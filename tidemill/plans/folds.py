"""Linear models of all folds of a backtest at once.

A fold differs from others only in which rows it trains on. So the rows are read once for all folds: each carries the folds
that use it, tasks sum up what folds need of their rows, and what reaches the driver is a few sums a fold, however many
rows there are. The number of jobs does not depend on the number of folds.

Least squares need one pass: rows with the same training folds (a block, or a piece of one that purging cuts off) share one
Gram matrix, and a fold's normal equations are the sum of its pieces'. The softmax regression takes a pass for each Newton
step, in which all folds' gradients and Hessians are summed together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.frames import ROOT
from tidemill.storage import saved

CLASSES = 3
#: What a row says in a fold.
TRAIN, TEST = 1, 2
#: Folds that a word has a bit for.
WORD = 32
#: Numbers of rows by folds by values that a task works on at once.
CELLS = 1 << 21
#: Partitions beyond which sums are taken in two steps.
WIDE = 256


def shipped(module: str, name: str, **given) -> Callable:
    """``module.name(..., **given)`` as a function that any Python worker can unpickle."""

    def run(*args, root=ROOT):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        yield from getattr(importlib.import_module(module), name)(*args, **given)

    return run


def folded(rows: DataFrame, splits: DataFrame, columns: Sequence[str], weight: str = "weight") -> tuple[DataFrame, list[int]]:
    """(table, folds): the rows of ``splits`` that are complete in ``columns``, return and label, once each: features ``x``,
    class ``y`` (label + 1), return ``r``, weight ``w`` (1 if missing), time ``t0``, and which of ``folds`` (by place) use it
    to train or test, as bits of words. The table is saved, as several passes read it."""
    folds = [r[0] for r in splits.select("fold").distinct().orderBy("fold").collect()]  # a row a fold
    at = F.element_at(F.create_map(*(F.lit(v) for k, f in enumerate(folds) for v in (f, k))), F.col("fold")) if folds else F.lit(None).cast("int")
    bits = lambda role, k: F.bit_or(F.when((F.coalesce(F.col("role") == "train", F.lit(False)) == role) & (F.floor(F.col("_f") / WORD) == k), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_f") % WORD).cast("int"))).otherwise(F.lit(0).cast("long")))
    words = range(max(1, -(-len(folds) // WORD)))
    # numbers alone, which tasks add up before rows are shuffled
    uses = splits.withColumn("_f", at).groupBy("row_idx").agg(*(bits(role, k).alias(f"_{role}{k}") for role in (True, False) for k in words))
    given = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight in rows.columns else F.lit(1.0)
    table = rows.dropna(subset=[*columns, "fwd_log_ret", "label"]).join(uses, "row_idx")
    return saved(
        table.select(
            "row_idx", F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), (F.col("label") + 1).cast("int").alias("y"), F.col("fwd_log_ret").cast("double").alias("r"),
            given.alias("w"), F.array(*(f"_{True}{k}" for k in words)).alias("trains"), F.array(*(f"_{False}{k}" for k in words)).alias("tests"), "t0",
        )
    ), folds


def moments(table: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the features over all rows, in whose terms sums lose the fewest digits."""
    row = table.agg(*(f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(d))).first()
    mean, scale = (np.array([v or 0.0 for v in part], float) for part in (row[:d], row[d:]))
    scale[scale == 0] = 1
    return mean, scale


def flags(b: pa.RecordBatch, name: str, folds: int) -> np.ndarray:
    """Rows by folds: whether the fold's bit is set in a row's words."""
    words = b.column(name).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(b.num_rows, -1)
    bits = np.unpackbits(words.view(np.uint8).reshape(*words.shape, 8), axis=2, bitorder="little")[:, :, :WORD]
    return bits.reshape(b.num_rows, words.shape[1] * WORD)[:, :folds].astype(bool)


class Rows:
    """Rows of the table as arrays: ids, features, class, return, weight, and roles (rows by folds)."""

    def __init__(self, b: pa.RecordBatch, folds: int):
        n = b.num_rows
        self.ids = b.column("row_idx").to_numpy()
        self.x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        self.y, self.r, self.w = (b.column(c).to_numpy() for c in ("y", "r", "w"))
        self.roles = np.where(flags(b, "tests", folds), np.int8(TEST), np.where(flags(b, "trains", folds), np.int8(TRAIN), np.int8(0)))

    @property
    def trains(self) -> np.ndarray:
        return self.roles == TRAIN


def chunks(batches: Iterator[pa.RecordBatch], folds: int, values: int) -> Iterator[tuple[pa.RecordBatch, Rows]]:
    """The rows of a task in pieces of at most ``CELLS`` rows by folds by values."""
    most = max(16, CELLS // max(1, folds * values))
    for b in batches:
        for lo in range(0, b.num_rows, most):
            part = b.slice(lo, most)
            yield part, Rows(part, folds)


def sums(table: DataFrame, module: str, name: str, keys: Sequence[str], kinds: str, **given) -> list[tuple[tuple, np.ndarray]]:
    """(key, summed array) of what tasks return for each key; ``name`` yields batches of (keys, v) with equally long ``v``."""
    parts = table.mapInArrow(shipped(module, name, **given), f"{kinds}, v array<double>")
    root = ROOT

    def added(group: pa.Table) -> pa.Table:
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        total = np.sum(np.stack([np.asarray(x.values) for x in group.column("v")]), axis=0)
        return group.slice(0, 1).set_column(group.schema.get_field_index("v"), "v", pa.array([total], pa.list_(pa.float64())))

    if table.rdd.getNumPartitions() > WIDE:
        parts = parts.withColumn("_part", F.spark_partition_id() % 64).groupBy(*keys, "_part").applyInArrow(added, parts.schema.simpleString().removeprefix("struct<").removesuffix(">") + ", _part int").drop("_part")
    out = parts.groupBy(*keys).applyInArrow(added, f"{kinds}, v array<double>").toArrow()
    return [(tuple(out.column(k)[i].as_py() for k in keys), np.asarray(out.column("v")[i].values)) for i in range(out.num_rows)]


def design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.c_[(x - mean) / scale, np.ones(len(x))]


def piece_batches(batches: Iterator[pa.RecordBatch], folds: int, mean: np.ndarray, scale: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each set of training folds of this task's rows: weighted Gram matrix and products with the return, then count, sums
    and sums of squares without weights."""
    found: dict[bytes, np.ndarray] = {}
    for _, rows in chunks(batches, folds, len(mean) + 1):
        a = design(rows.x, mean, scale)
        bits = np.packbits(rows.trains, axis=1)
        kinds, of = np.unique(bits, axis=0, return_inverse=True)
        for k, kind in enumerate(kinds):
            own = a[of.reshape(-1) == k]
            w, r = rows.w[of.reshape(-1) == k], rows.r[of.reshape(-1) == k]
            weighted = own * w[:, None]
            v = np.concatenate([(weighted.T @ own).ravel(), weighted.T @ r, own.sum(0), (own**2).sum(0)])
            found[kind.tobytes()] = found.get(kind.tobytes(), 0) + v
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.float64()))], ["piece", "v"])


class Statistics:
    """What folds know of their training rows, summed over pieces: normal equations, weights, spread of each feature."""

    def __init__(self, table: DataFrame, folds: int, d: int):
        self.mean, self.scale = moments(table, d)
        n = d + 1
        total = np.zeros((folds, n * n + 3 * n))
        for (piece,), v in sums(table, __name__, "piece_batches", ["piece"], "piece binary", folds=folds, mean=self.mean, scale=self.scale):
            total[np.unpackbits(np.frombuffer(piece, np.uint8), count=folds).astype(bool)] += v
        self.gram, self.product = total[:, : n * n].reshape(folds, n, n), total[:, n * n : n * n + n]
        plain, squares = total[:, n * n + n : n * n + 2 * n], total[:, n * n + 2 * n :]
        count = np.maximum(plain[:, -1:], 1)
        self.rows = plain[:, -1]
        spread = squares[:, :-1] / count - (plain[:, :-1] / count) ** 2
        self.spread = np.sqrt(np.where(spread > 1e-14, spread, 1.0))  # of the fold's own rows, as a scaler would take it
        self.weight = self.gram[:, -1, -1]
        self.mean_return = self.product[:, -1] / np.where(self.weight > 0, self.weight, 1)


def least_squares(known: Statistics) -> np.ndarray:
    """Coefficients (folds by features and a constant, in standard units) of weighted least squares; of several solutions
    the smallest."""
    return np.array([np.linalg.lstsq(g, b, rcond=1e-13)[0] for g, b in zip(known.gram, known.product, strict=True)]).reshape(known.product.shape)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def newton_batches(batches: Iterator[pa.RecordBatch], folds: int, mean: np.ndarray, scale: np.ndarray, beta: np.ndarray, live: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Loss, gradient and Hessian of each live fold's softmax regression at ``beta`` (live folds, classes, features)."""
    k, n = beta.shape[1:]
    m, (up, down) = len(live), np.triu_indices(n)
    sides = [(i, j) for i in range(k) for j in range(i, k)]
    loss, grad, curve = np.zeros(m), np.zeros((m * k, n)), np.zeros((m * len(sides), len(up)))
    for _, rows in chunks(batches, folds, 4 * k):
        a = design(rows.x, mean, scale)
        p = softmax((a @ beta.reshape(-1, n).T).reshape(len(a), m, k))
        w = rows.w[:, None] * rows.trains[:, live]
        loss -= (w * np.log(np.maximum(p[np.arange(len(a)), :, rows.y], 1e-300))).sum(0)
        error = w[:, :, None] * (p - (rows.y[:, None, None] == np.arange(k)))
        grad += error.reshape(len(a), -1).T @ a
        # products of two features once for all folds and classes
        part = np.stack([w * p[:, :, i] * ((i == j) - p[:, :, j]) for i, j in sides], 2)
        curve += part.reshape(len(a), -1).T @ (a[:, up] * a[:, down])
    hess = np.zeros((m, k, n, k, n))
    for s, (i, j) in enumerate(sides):
        block = np.zeros((m, n, n))
        block[:, up, down] = block[:, down, up] = curve.reshape(m, len(sides), -1)[:, s]
        hess[:, i, :, j, :] = hess[:, j, :, i, :] = block
    v = np.concatenate([loss[:, None], grad.reshape(len(live), -1), hess.reshape(len(live), -1)], 1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(live)), pa.int32()), pa.array(list(v), pa.list_(pa.float64()))], ["f", "v"])


def softmax_regression(table: DataFrame, folds: int, known: Statistics, penalty: float = 1.0, steps: int = 50, near: float = 1e-9) -> np.ndarray:
    """Coefficients (folds, classes, features and a constant, in standard units): for each fold the sum over its training rows of
    weight times log-loss, plus half ``penalty`` times the squared weights of its own scaled features, is least. Newton steps,
    halved while they do not lessen a fold's loss; a fold that has come to rest is left out of later passes."""
    d = len(known.mean) + 1
    beta = np.zeros((folds, CLASSES, d))
    ridge = penalty * np.concatenate([known.spread**2, np.zeros((folds, 1))], 1)
    best, step, size = np.full(folds, np.inf), np.zeros_like(beta), np.ones(folds)
    live = np.flatnonzero(known.rows > 0)
    for _ in range(steps):
        if not len(live):
            break
        found = dict((f, v) for (f,), v in sums(table, __name__, "newton_batches", ["f"], "f int", folds=folds, mean=known.mean, scale=known.scale, beta=beta[live], live=live))
        rest = []
        for at, f in enumerate(live):
            v, pull = found[at], np.tile(ridge[f], CLASSES)
            flat = beta[f].ravel()
            loss = v[0] + 0.5 * (pull * flat**2).sum()
            if not loss <= best[f] + 1e-12 * abs(best[f]):  # went too far
                size[f] /= 2
                beta[f] -= size[f] * step[f]
                rest += [f] if size[f] > 1e-4 else []
                continue
            best[f], size[f] = loss, 1.0
            n = CLASSES * d
            grad, hess = v[1 : 1 + n] + pull * flat, v[1 + n :].reshape(n, n) + np.diag(pull)
            step[f] = -np.linalg.lstsq(hess, grad, rcond=1e-12)[0].reshape(CLASSES, d)
            beta[f] += step[f]
            rest += [f] if np.abs(step[f]).max() > near else []
        live = np.array(rest, int)
    return beta


def predicted(x: np.ndarray, known_mean: np.ndarray, known_scale: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Values of linear models: rows by the leading axes of ``beta``."""
    a = design(x, known_mean, known_scale)
    return (a @ beta.reshape(-1, beta.shape[-1]).T).reshape(len(a), *beta.shape[:-1])


def score_batches(batches: Iterator[pa.RecordBatch], folds: int, mean: np.ndarray, scale: np.ndarray, linear: np.ndarray | None, logit: np.ndarray | None, forest, names: Sequence[str], roles: Sequence[str] = ("train", "test")) -> Iterator[pa.RecordBatch]:
    """(row_idx, t0, fwd_log_ret, f, role, model, score) of each use in ``roles`` of each row by each of ``names``."""
    for part, rows in chunks(batches, folds, 8):
        scores = {}
        if "lin_reg" in names:
            scores["lin_reg"] = predicted(rows.x, mean, scale, linear)
        if "logit_cls" in names:
            scores["logit_cls"] = softmax(predicted(rows.x, mean, scale, logit))[:, :, 0]
        if forest is not None:
            margins = forest.margins(rows.x)
            scores["gbt_cls"], scores["gbt_reg"] = softmax(margins[:, :, :CLASSES])[:, :, 0], margins[:, :, CLASSES]
        q, f = np.nonzero(np.isin(rows.roles, [TRAIN if r == "train" else TEST for r in roles]))
        at, role = pa.array(q), pa.array(["train", "test"]).take(pa.array(rows.roles[q, f] - TRAIN))
        for name in names:
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row_idx").take(at), part.column("t0").take(at), part.column("r").take(at), pa.array(f, pa.int32()),
                    role, pa.repeat(pa.scalar(name), len(q)), pa.array(scores[name][q, f]),
                ],
                ["row_idx", "t0", "fwd_log_ret", "f", "role", "model", "score"],
            )


def fold_of(folds: Sequence[int]) -> Column:
    """The fold whose place is ``f``."""
    return F.element_at(F.array(*map(F.lit, folds)), F.col("f") + 1)


def scored(table: DataFrame, folds: Sequence[int], d: int, names: Sequence[str], forest=None, penalty: float = 1.0, roles: Sequence[str] = ("train", "test")) -> DataFrame:
    """(row_idx, t0, fwd_log_ret, fold, role, model, score) of each use of each row in one of ``roles``: the prediction of a
    regression, the probability of the lowest class of a classifier. No folds give no rows."""
    n = len(folds)
    kinds = f"row_idx {dict(table.dtypes)['row_idx']}, t0 {dict(table.dtypes)['t0']}, fwd_log_ret double, f int, role string, model string, score double"
    if not n:
        return table.sparkSession.createDataFrame([], kinds).withColumnRenamed("f", "fold")
    known = Statistics(table, n, d)
    linear = least_squares(known) if "lin_reg" in names else None
    logit = softmax_regression(table, n, known, penalty) if "logit_cls" in names else None
    out = table.mapInArrow(shipped(__name__, "score_batches", folds=n, mean=known.mean, scale=known.scale, linear=linear, logit=logit, forest=forest, names=list(names), roles=list(roles)), kinds)
    return out.select("row_idx", "t0", "fwd_log_ret", fold_of(folds).alias("fold"), "role", "model", "score")
