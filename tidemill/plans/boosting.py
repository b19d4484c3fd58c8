"""Boosted trees of all folds of a backtest at once: three classes by softmax, and returns by squared error.

Features become bins cut at quantiles. A level of trees is grown in one aggregation: each task brings its rows down the trees
so far, and sums gradients and second derivatives by fold, output, node, feature and bin; the sums alone go to the driver,
which picks the best splits. All folds and outputs share the pass, so the number of jobs is rounds times depth whatever the
number of folds. Every ``SAVE`` rounds the rows' margins are written, so that a pass has few trees to evaluate and a lost
task little to repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.plans.folds import CLASSES, chunks, shipped, softmax, sums
from tidemill.storage import saved

OUTPUTS = CLASSES + 1
SAVE = 10


@dataclass(frozen=True)
class Settings:
    """As published models have them, but for the number of bins."""

    rounds: int = 300
    depth: int = 5
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    least: float = 1.0
    bins: int = 64
    seed: int = 42


def uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each id, the same wherever the row is."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0xBF58476D1CE4E5B9 % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(by)
    return (x >> np.uint64(11)).astype(float) / 2.0**53


@dataclass
class Forest:
    """Trees of each round: (folds, outputs, nodes) of feature (-1 for a leaf), last bin on the left, and value. The children of
    node i are 2i + 1 and 2i + 2."""

    edges: list[np.ndarray]
    base: np.ndarray
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), int)

    def nodes(self, bins: np.ndarray, tree: tuple, levels: int) -> np.ndarray:
        """Where rows are after so many levels: rows by folds by outputs; a leaf keeps its rows."""
        feature, cut, _ = tree
        f, o = np.indices(feature.shape[:2])
        at = np.zeros((len(bins), *feature.shape[:2]), np.int64)
        rows = np.arange(len(bins))[:, None, None]
        for _ in range(levels):
            j = feature[f, o, at]
            inner = j >= 0
            at = np.where(inner, 2 * at + 1 + (bins[rows, np.maximum(j, 0)] > cut[f, o, at]), at)
        return at

    def added(self, bins: np.ndarray, begin: int = 0) -> np.ndarray:
        """What the trees from round ``begin`` on add to the margins."""
        f, o = np.indices(self.base.shape)
        out = np.zeros((len(bins), *self.base.shape))
        for tree in self.trees[begin:]:
            out += tree[2][f, o, self.nodes(bins, tree, self.depth)]
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.added(self.binned(x))


def derivatives(rows, margins: np.ndarray, round_: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weighted gradients and second derivatives (rows, folds, outputs) of the rows that this round trains on; 0 for others."""
    p = softmax(margins[:, :, :CLASSES])
    g = np.concatenate([p - (rows.y[:, None, None] == np.arange(CLASSES)), margins[:, :, CLASSES:] - rows.r[:, None, None]], 2)
    h = np.concatenate([np.maximum(2 * p * (1 - p), 1e-16), np.ones_like(margins[:, :, CLASSES:])], 2)
    w = (rows.w * (uniform(rows.ids, s.seed + round_) < s.rows))[:, None] * rows.trains
    return g * w[:, :, None], h * w[:, :, None]


def level_batches(batches: Iterator[pa.RecordBatch], folds: int, forest: Forest, begin: int, tree: tuple, level: int, s: Settings) -> Iterator[pa.RecordBatch]:
    """(f, o, node, v): histograms of gradients and second derivatives (2, features, bins) of the nodes of a level."""
    d, first, n = len(forest.edges), 2**level - 1, 2**level
    total = np.zeros((folds, OUTPUTS, n, 2, d, s.bins))
    seen = np.zeros((folds, OUTPUTS, n), bool)
    for part, rows in chunks(batches, folds, OUTPUTS * (d + 4)):
        bins = forest.binned(rows.x)
        held = part.column("margin").flatten().to_numpy(zero_copy_only=False).reshape(len(bins), folds, OUTPUTS)
        g, h = derivatives(rows, held + forest.added(bins, begin), len(forest.trees), s)
        at = forest.nodes(bins, tree, level) - first
        for f in range(folds):
            used = np.flatnonzero(h[:, f, CLASSES] > 0)
            for o in range(OUTPUTS):
                own = used[at[used, f, o] >= 0]
                if not len(own):
                    continue
                seen[f, o, np.unique(at[own, f, o])] = True
                place = ((at[own, f, o][:, None] * d + np.arange(d)) * s.bins + bins[own]).ravel()
                for k, x in enumerate((g, h)):
                    total[f, o, :, k] += np.bincount(place, np.repeat(x[own, f, o], d), n * d * s.bins).reshape(n, d, s.bins)
    f, o, node = np.nonzero(seen)
    v = total[f, o, node].reshape(len(f), 2 * d * s.bins)
    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in (f, o, node)), pa.array(list(v), pa.list_(pa.float64()))], ["f", "o", "node", "v"])


def best_split(v: np.ndarray, allowed: np.ndarray, s: Settings) -> tuple[int, int, tuple, tuple, tuple]:
    """(feature or -1, last bin on the left, sums of the node, of its left, of its right) from a node's histograms."""
    g, h = v
    whole = (g[0].sum(), h[0].sum()) if len(g) else (0.0, 0.0)
    left_g, left_h = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
    right_g, right_h = whole[0] - left_g, whole[1] - left_h
    gain = left_g**2 / (left_h + s.l2) + right_g**2 / (right_h + s.l2) - whole[0] ** 2 / (whole[1] + s.l2)
    gain = np.where((left_h >= s.least) & (right_h >= s.least) & allowed[:, None], gain, 0.0)
    if not gain.size or gain.max() <= 1e-12:
        return -1, 0, whole, (0.0, 0.0), (0.0, 0.0)
    j, b = np.unravel_index(gain.argmax(), gain.shape)
    return int(j), int(b), whole, (left_g[j, b], left_h[j, b]), (right_g[j, b], right_h[j, b])


def grown(hist, folds: int, d: int, round_: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trees of a round; ``hist(tree, level)`` gives ((fold, output, node of the level), histograms) of a level."""
    n = 2 ** (s.depth + 1) - 1
    feature, cut, value = np.full((folds, OUTPUTS, n), -1), np.zeros((folds, OUTPUTS, n), np.int64), np.zeros((folds, OUTPUTS, n))
    allowed = np.zeros((OUTPUTS, d), bool)
    for o in range(OUTPUTS):
        allowed[o, np.random.default_rng([s.seed, round_, o]).permutation(d)[: max(1, round(s.columns * d))]] = True
    leaf = lambda x: -s.rate * x[0] / (x[1] + s.l2)
    for level in range(s.depth):
        split = False
        for (f, o, node), v in hist((feature, cut, value), level):
            at = 2**level - 1 + node
            if at and feature[f, o, (at - 1) // 2] < 0:
                continue
            j, b, whole, left, right = best_split(v.reshape(2, d, s.bins), allowed[o], s)
            value[f, o, at] = leaf(whole)
            if j >= 0:
                feature[f, o, at], cut[f, o, at], split = j, b, True
                value[f, o, 2 * at + 1], value[f, o, 2 * at + 2] = leaf(left), leaf(right)
        if not split:
            break
    return feature, cut, value


def cuts(table: DataFrame, d: int, bins: int) -> list[np.ndarray]:
    """Edges of at most ``bins`` bins of each feature, at quantiles of all rows (labels take no part)."""
    shares = [i / bins for i in range(1, bins)]
    row = table.agg(*(F.percentile_approx(F.col("x")[j], shares, 10_000) for j in range(d))).first()
    return [np.unique(np.array(e or [], float)) for e in row]


def with_margins(batches: Iterator[pa.RecordBatch], folds: int, forest: Forest, begin: int) -> Iterator[pa.RecordBatch]:
    for part, rows in chunks(batches, folds, OUTPUTS * 4):
        held = part.column("margin").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, *forest.base.shape) if begin else forest.base
        new = held + forest.added(forest.binned(rows.x), begin)
        names = [n for n in part.schema.names if n != "margin"]
        yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(list(new.reshape(part.num_rows, -1)), pa.list_(pa.float64()))], [*names, "margin"])


def boosted(table: DataFrame, folds: int, d: int, mean_return: np.ndarray, s: Settings = Settings()) -> Forest:
    """Trees of every fold over the table of ``folds.folded``: classes start even, returns at the fold's weighted mean."""
    base = np.zeros((folds, OUTPUTS))
    base[:, CLASSES] = mean_return
    forest = Forest(cuts(table, d, s.bins), base, s.depth)
    kinds = ", ".join(f"{c} {k}" for c, k in table.dtypes)

    def remember(data: DataFrame, begin: int) -> DataFrame:
        return saved(data.mapInArrow(shipped(__name__, "with_margins", folds=folds, forest=forest, begin=begin), f"{kinds}, margin array<double>"))

    data, begin = remember(table, 0), 0
    for round_ in range(s.rounds):
        if round_ - begin == SAVE:
            data, begin = remember(data, begin), round_
        hist = lambda tree, level, data=data, begin=begin: sums(data, __name__, "level_batches", ["f", "o", "node"], "f int, o int, node int", folds=folds, forest=forest, begin=begin, tree=tree, level=level, s=s)
        forest.trees.append(grown(hist, folds, d, round_, s))
    return forest
