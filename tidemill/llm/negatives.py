"""Hard negatives by a search over norm buckets.

Vectors are sorted into buckets by their norms, the longest first, and a bucket into blocks that a task can hold. No product
with an anchor exceeds the anchor's norm times the longest norm of a bucket (Cauchy-Schwarz), so a bucket whose bound lies
below a window's lower limit, or below the k-th score that the window already has, is not visited. A first round asks one
block of the longest vectors, and its k-th scores decide which buckets the second round visits; within a block the rows are
ordered by norm too, and slices of them are left out in the same way against the running k-th scores.

Positives are such a search with one endless window among rows of the anchor's label; negatives are one with a window for
each positive among the other labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import saved, shipped
from tidemill.llm.topk import matrix

#: Vectors in a block, most buckets, rows of a block that are scored together, and asks that come to one copy of a block.
BLOCK, BUCKETS, SLICE, ASKS = 8192, 1024, 1024, 1 << 18
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exactly; one beyond a long raises OverflowError."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return (whole(a) @ whole(b).T).astype(np.int64)


class Shelf:
    """The vectors of one block in order of their norms, longest first."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, data: np.ndarray):
        norms = np.sqrt((data**2).sum(1))
        order = np.argsort(-norms, kind="stable")
        self.ids, self.labels, self.data, self.norms = ids[order], labels[order], data[order], norms[order]
        self.scored = 0

    def search(self, asks: np.ndarray, x: np.ndarray, labels: np.ndarray, same: bool, lows: np.ndarray, highs: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(ask's place, window, id, score) of each window's ``k`` best, greatest score and then smallest id first: rows of the
        ask's label (``same``) or of others, not the ask itself, with a score from ``lows`` to ``highs`` (asks by windows)."""
        m, w = lows.shape
        worst, length = lows.copy(), np.sqrt((x**2).sum(1))
        held = [np.zeros(0, np.int64)] * 3  # window in all, id, score
        for lo in range(0, len(self.ids), SLICE):
            live = np.flatnonzero(length * self.norms[lo] * (1 + 1e-9) + 1e-6 >= worst.min(1, initial=HIGH).astype(float))
            if not len(live):
                break
            part = slice(lo, lo + SLICE)
            score = products(x[live], self.data[part])
            self.scored += score.size
            fits = ((labels[live, None] == self.labels[None, part]) == same) & (asks[live, None] != self.ids[None, part])
            new = [[], [], []]
            for j in range(w):
                mine = fits & (score >= worst[live, j, None]) & (score <= highs[live, j, None])
                if mine.sum() > k * len(live):  # all but the k best, and what equals the last of them, can go
                    s = np.where(mine, score, LOW)
                    mine &= s >= np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k), None]
                r, c = np.nonzero(mine)
                for out, found in zip(new, (live[r] * w + j, self.ids[part][c], score[r, c]), strict=True):
                    out.append(found)
            at, ids, scores = (np.concatenate([a, *b]) for a, b in zip(held, new, strict=True))
            order = np.lexsort((ids, -1 - scores, at))  # -1 - x is the reverse order without overflow
            at, ids, scores = at[order], ids[order], scores[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            held = [v[rank < k] for v in (at, ids, scores)]
            last = rank == k - 1
            worst.reshape(-1)[at[last]] = np.maximum(worst.reshape(-1)[at[last]], scores[last])
        at, ids, scores = held
        return at // max(1, w), at % max(1, w), ids, scores


def norm_batches(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """Adds the norm to rows (id, label, vec)."""
    for b in batches:
        x = matrix(b.column(2), wide)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.sqrt((x**2).sum(1)))], ["id", "label", "vec", "norm"])


def bucket_batches(batches: Iterator[pa.RecordBatch], edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds the bucket to rows (id, label, vec, norm): 0 has the longest."""
    for b in batches:
        bucket = len(edges) - np.searchsorted(edges, b.column(3).to_numpy(), "right")
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(bucket.astype(np.int32))], ["id", "label", "vec", "norm", "bucket"])


def visit_batches(batches: Iterator[pa.RecordBatch], tops: np.ndarray, parts: np.ndarray, wide: int, first: bool) -> Iterator[pa.RecordBatch]:
    """The blocks that asks (id, label, vec, lows, highs, start) go to: block ``start`` of the first bucket, or all others of
    buckets whose bound reaches the least of an ask's lower limits."""
    of = np.repeat(np.arange(len(parts)), parts)
    part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    for b in batches:
        start = b.column(5).to_numpy() % parts[0]
        length = np.sqrt((matrix(b.column(2), wide) ** 2).sum(1))
        need = np.array([min(x, default=HIGH) for x in b.column(3).to_pylist()], float)
        reach = (length[:, None] * tops[None, :] * (1 + 1e-9) + 1e-6 >= need[:, None])[:, of]
        begins = (of[None, :] == 0) & (part[None, :] == start[:, None])
        q, block = np.nonzero(reach & (begins if first else ~begins))
        for lo in range(0, len(q), 8192):
            at, now = pa.array(q[lo : lo + 8192]), block[lo : lo + 8192]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:5]), pa.array(of[now].astype(np.int32)), pa.array(part[now].astype(np.int32))], ["id", "label", "vec", "lows", "highs", "bucket", "part"])


def limits(column: pa.Array, none: int) -> np.ndarray:
    rows = column.to_pylist()
    wide = max(map(len, rows), default=0)
    return np.array([[*r, *[none] * (wide - len(r))] for r in rows], np.int64).reshape(len(rows), wide)


def search_batches(batches: Iterator[pa.RecordBatch], k: int, wide: int, same: bool) -> Iterator[pa.RecordBatch]:
    """(ask, w, id, score) from rows (bucket, part, copy, asks, id, label, vec, lows, highs) in this order: a block's vectors,
    then its asks. The vectors of one block are held, and a batch of asks."""
    now, held, shelf = None, [], None
    for b in batches:
        where = np.array([b.column(i).to_numpy() for i in range(3)]).reshape(3, len(b))
        cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(0)) + 1).tolist(), len(b)] if len(b) else [0]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key, part = tuple(where[:, lo].tolist()), b.slice(lo, hi - lo)
            if key != now:
                now, held, shelf = key, [], None
            asks = part.column(3).to_numpy(zero_copy_only=False)
            ids, labels, x = part.column(4).to_numpy(), part.column(5).to_numpy(), matrix(part.column(6), wide)
            if not asks.all():
                held.append((ids[~asks], labels[~asks], x[~asks]))
            if asks.any():
                if shelf is None:
                    held = held or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, wide)))]
                    shelf = Shelf(*map(np.concatenate, zip(*held, strict=True)))
                for at in np.array_split(np.flatnonzero(asks), -(-int(asks.sum()) // 1024)):
                    rows = pa.array(at)
                    lows, highs = limits(part.column(7).take(rows), HIGH), limits(part.column(8).take(rows), LOW)
                    q, w, found, score = shelf.search(ids[at], x[at], labels[at], same, lows, highs, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at][q]), pa.array(w.astype(np.int32)), pa.array(found), pa.array(score)], ["ask", "w", "id", "score"])


def ceil_share(percent: int, score: Column) -> Column:
    """The least whole number that is ``percent`` or more of ``score``; in decimals, as doubles aren't exact."""
    return F.ceil(score.cast("decimal(20,0)") * percent / 100).cast("long")


def hard_negatives(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives: int = 5, k: int = 5, percent: int = 80, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id is a multiple of
    ``every`` and each of its ``positives`` best rows of the same label, the ``k`` best rows of other labels that score from
    ``percent`` of the positive's score up to that score.

    Scores are inner products of floor(scale * component); equal ones go to the smaller id. Rows without an id, with a null
    (or no whole) label, a null vector, or a null or non-finite component take no part; a short vector counts as filled up with
    zeros; of rows that repeat an id the one with the least vector and label counts. Fewer than asked for: all there are; a
    positive with a negative score has an empty window. An empty table gives an empty one. Other columns are not read,
    whatever their names. A product beyond a long raises OverflowError.
    """
    x, n = F.col("vec"), max(positives, k)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = rows.select("id", "label", F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("vec"))
    if rows.groupBy("id").count().filter("count > 1").limit(1).count():
        rows = saved(rows.groupBy("id").agg(F.min(F.struct("vec", "label")).alias("r")).select("id", "r.label", "r.vec"))
    wide = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    send = lambda df, name, schema, **given: df.mapInArrow(shipped(__name__, name, **given), schema)
    # of equal vectors of a label the smallest ids: no other is an answer, as an anchor leaves out no more than itself
    same = Window.partitionBy("vec", "label").orderBy("id")
    data = rows.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= n + 1).select("id", "label", "vec")
    data = saved(send(data, "norm_batches", "id long, label long, vec array<double>, norm double", wide=wide))
    buckets = max(1, min(BUCKETS, -(-data.count() // block)))
    edges = data.agg(F.percentile_approx("norm", [i / buckets for i in range(1, buckets)] or [0.5])).first()[0] if buckets > 1 else []
    edges = np.unique(np.array(edges or [], float))
    data = saved(send(data, "bucket_batches", "id long, label long, vec array<double>, norm double, bucket int", edges=edges))
    tops, parts = np.zeros(len(edges) + 1), np.ones(len(edges) + 1, np.int64)
    for r in data.groupBy("bucket").agg(F.max("norm").alias("top"), F.count("*").alias("n")).collect():  # a row a bucket
        tops[r.bucket], parts[r.bucket] = r.top, -(-r.n // block)
    part_of = F.element_at(F.array(*map(F.lit, parts.tolist())), F.col("bucket") + 1)
    data = data.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), part_of).cast("int"))

    def searched(asks: DataFrame, same: bool, k: int, first: bool) -> DataFrame:
        asks = asks.select("id", "label", "vec", "lows", "highs", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)).alias("start"))
        asks = saved(send(asks, "visit_batches", "id long, label long, vec array<double>, lows array<long>, highs array<long>, bucket int, part int", tops=tops, parts=parts, wide=wide, first=first))
        copies = saved(asks.groupBy("bucket", "part").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("copies")))
        held = data.join(copies, ["bucket", "part"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        none = F.array().cast("array<long>")
        held = held.select("bucket", "part", "copy", F.lit(False).alias("asks"), "id", "label", "vec", none.alias("lows"), none.alias("highs"))
        told = asks.join(copies, ["bucket", "part"]).withColumn("copy", F.pmod(F.xxhash64("id", F.lit(2)), F.col("copies")).cast("int"))
        told = told.select("bucket", "part", "copy", F.lit(True).alias("asks"), "id", "label", "vec", "lows", "highs")
        dealt = held.unionByName(told).repartition("bucket", "part", "copy").sortWithinPartitions("bucket", "part", "copy", "asks")
        return saved(send(dealt, "search_batches", "ask long, w int, id long, score long", k=k, wide=wide, same=same))

    def best(asks: DataFrame, same: bool, k: int) -> DataFrame:
        """(ask, w, id, score, rank) of the ``k`` best of each window, in two rounds."""
        asks = saved(asks)
        first = searched(asks, same, k, True)
        full = first.groupBy("ask", "w").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") == k)
        full = full.groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("least"))  # a window each
        least = F.transform("lows", lambda x, i: F.coalesce(F.col("least")[i], x))
        rest = asks.join(full, asks["id"] == full["ask"], "left").select("id", "label", "vec", least.alias("lows"), "highs")
        order = Window.partitionBy("ask", "w").orderBy(F.desc("score"), "id")
        found = first.unionByName(searched(rest, same, k, False))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    anchors = rows.filter(F.col("id") % every == 0)
    good = saved(best(anchors.select("*", F.array(F.lit(LOW)).alias("lows"), F.array(F.lit(HIGH)).alias("highs")), True, positives))
    good = good.filter("score >= 0")  # else no score is between
    windows = F.sort_array(F.collect_list(F.struct("rank", "score")))  # ``positives`` of them at most
    asks = anchors.join(good.groupBy("ask").agg(windows.alias("s")), F.col("id") == F.col("ask"))
    asks = asks.select("id", "label", "vec", F.transform("s", lambda s: ceil_share(percent, s["score"])).alias("lows"), F.transform("s", lambda s: s["score"]).alias("highs"))
    bad = best(asks, False, k).select(F.col("ask").alias("anchor_id"), (F.col("w") + 1).alias("of"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    good = good.select(F.col("ask").alias("anchor_id"), F.col("rank").alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return bad.join(good, ["anchor_id", "of"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
