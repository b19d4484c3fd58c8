"""Exact top-k search by inner product with cover trees on both sides.

Vectors are dealt by locality: the upper levels of a cover tree over a bounded sample are the centres of cells, each vector
belongs to its nearest centre, and each cell's covering radius is exact. A query first searches one block of its most
promising cell; its k-th score there then rules out every cell whose centre's product, widened by the radius, is below
it. Only what is left is sent on. Within a block a cover tree over a batch of queries meets one over the data: a pair of
nodes is dropped when the centres' product, widened by both covering radii, is below every query's worst k-th score.

Vectors that are equal count as one on either side: of the data the ids that could be answers stay, and queries with one
vector are asked once. A block of data is held by one task, and queries come to it in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import saved, shipped

LEAF = 32
#: Vectors in a block; most cells; rows of the sample a cell. The sample has 20,480 rows at most.
BLOCK, CELLS, SAMPLE = 8192, 1024, 20
#: Queries that come to one copy of a block.
QUERIES = 1 << 18


def net(points: np.ndarray, most: int, reach: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(rows, owner of each point, squared distance to it): points, the next always the farthest from all before it, until all
    others are within ``reach`` of one, or there are ``most``."""
    squares = (points**2).sum(1)
    rows, owner, near = [], np.zeros(len(points), np.int64), np.full(len(points), np.inf)
    at = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    while len(rows) < most:
        gap = np.maximum(squares - 2 * (points @ points[at]) + squares[at], 0.0)
        gap[at] = 0.0
        closer = gap < near
        owner[closer], near[closer] = len(rows), gap[closer]
        rows.append(at)
        at = int(near.argmax())
        if near[at] <= reach * reach:
            break
    return rows, owner, near


class Tree:
    """A cover tree. The points of a node lie within its radius of its centre, one of them; the centres of its children are a
    net of them: more than half that radius apart, and each point within half of it of its child's centre. A node is not
    divided if it has few points, or needs a child for every fourth of them. Points of a node are rows ``lo`` to ``hi`` of
    ``order``."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple[int, int, np.ndarray, float, list[int]]] = []
        if not len(points):
            return
        first = net(points, 1)
        todo = [(0, len(points), points[first[0][0]], float(np.sqrt(first[2].max())), None)]
        while todo:
            lo, hi, centre, radius, kids = todo.pop()
            if kids is not None:
                kids.append(len(self.nodes))
            mine: list[int] = []
            self.nodes.append((lo, hi, centre, radius, mine))
            if hi - lo <= LEAF or radius == 0:
                continue
            rows = self.order[lo:hi].copy()
            most = (hi - lo) // 4
            found, owner, near = net(points[rows], most + 1, radius / 2)
            if len(found) > most:
                continue
            by = np.argsort(owner, kind="stable")
            self.order[lo:hi] = rows[by]
            cuts = lo + np.searchsorted(owner[by], np.arange(len(found) + 1))
            reach = np.sqrt(np.maximum.reduceat(near[by], cuts[:-1] - lo))
            todo += [(int(a), int(b), points[rows[c]], float(r), mine) for a, b, c, r in zip(cuts, cuts[1:], found, reach, strict=False)]


class Block:
    """Vectors of one block (whole numbers) with their ids and their tree, about the block's own middle."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        self.ids, self.data, self.most = ids, data, float(np.abs(data).max(initial=0))
        self.middle = np.rint(data.mean(0)) if len(data) else np.zeros(data.shape[1])
        self.tree = Tree(data - self.middle)
        nodes = self.tree.nodes
        self.centres = np.array([n[2] for n in nodes]).reshape(len(nodes), data.shape[1])
        self.radii, self.norms = np.array([n[3] for n in nodes]), np.sqrt((self.centres**2).sum(1))
        self.scored = 0

    def search(self, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of each query's ``k`` best here, greatest score and then smallest id first, of those at or above
        its ``least``. Rows hold whole numbers."""
        if not len(queries) or not len(self.data):
            return (np.zeros(0, np.int64),) * 3
        if queries.shape[1] * float(np.abs(queries).max()) * self.most >= 2**53:
            return self.huge(queries, least, k)  # beyond what doubles hold exactly
        none = np.iinfo(np.int64).min
        score, found = np.full((len(queries), k), none, np.int64), np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
        at, lengths = queries @ self.middle, np.sqrt((queries**2).sum(1))
        worst = least.astype(float)  # a query's k-th score, or what it came with
        a, b = Tree(queries), self.tree
        norms = [float(np.sqrt((n[2] ** 2).sum())) for n in a.nodes]

        def bound(q: int, ds: np.ndarray) -> np.ndarray:
            """What no product of a query of ``q`` and a vector of each of ``ds`` is above, less the product with the middle."""
            c, r = a.nodes[q][2], a.nodes[q][3]
            wide = norms[q] * self.radii[ds] + self.norms[ds] * r + r * self.radii[ds]
            return self.centres[ds] @ c + wide + 1e-9 * (wide + norms[q] * self.norms[ds]) + 1e-6

        def meet(rows: np.ndarray, d: int) -> None:
            cols = b.order[b.nodes[d][0] : b.nodes[d][1]]
            s = queries[rows] @ self.data[cols].T
            self.scored += s.size
            best = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(rows), -np.inf)
            take = s >= np.maximum(best, worst[rows])[:, None]
            need, use = take.any(1), take.any(0)
            if not need.any():
                return
            rows, cols, s = rows[need], cols[use], np.where(take, s, none)[need][:, use]
            all_s = np.concatenate([score[rows], np.where(s == none, none, np.rint(s)).astype(np.int64)], 1)
            all_i = np.concatenate([found[rows], np.where(s == none, np.iinfo(np.int64).max, self.ids[cols][None, :])], 1)
            top = np.lexsort((all_i, -all_s.astype(float)), axis=1)[:, :k]
            score[rows], found[rows] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
            worst[rows] = np.maximum(worst[rows], score[rows, -1])

        stack = [(0, np.array([0]))]
        while stack:
            q, ds = stack.pop()
            rows, kids = a.order[a.nodes[q][0] : a.nodes[q][1]], a.nodes[q][4]
            ds = ds[bound(q, ds) >= (worst[rows] - at[rows]).min()]
            if kids and len(ds):
                deeper = np.array([x for d in ds for x in (b.nodes[d][4] or (d,))], np.int64)
                stack += [(x, deeper) for x in kids]
                continue
            waiting: list[tuple] = []

            def open_(ds: np.ndarray, rows=rows, waiting=waiting) -> None:
                wide = lengths[rows][:, None] * self.radii[ds]
                tops = queries[rows] @ self.centres[ds].T + wide + 1e-9 * (wide + lengths[rows][:, None] * self.norms[ds]) + 1e-6
                for d, top in zip(ds.tolist(), tops.T, strict=True):  # what no product of each query with a vector of d is above
                    heappush(waiting, (-top.max(), d, top))

            open_(ds)
            while waiting:  # the most promising first
                _, d, top = heappop(waiting)
                live = top >= worst[rows] - at[rows]
                inner = b.nodes[d][4]
                if inner and live.any() and b.nodes[d][1] - b.nodes[d][0] > 4 * LEAF:
                    open_(np.array(inner))
                elif live.any():
                    meet(rows[live], d)
        real = score > none
        return np.repeat(np.arange(len(queries)), real.sum(1)), found[real], score[real]

    def huge(self, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``search`` in whole Python numbers, vector by vector."""
        out, whole = [], [[int(x) for x in row] for row in self.data]
        self.scored += len(queries) * len(whole)
        for at, (q, low) in enumerate(zip(queries, least, strict=True)):
            q = [int(x) for x in q]
            best = sorted((-sum(x * y for x, y in zip(q, row, strict=True)), int(i)) for i, row in zip(self.ids, whole, strict=True))[:k]
            out += [(at, i, -s) for s, i in best if -s >= low]
        if any(abs(s) >= 2**63 for _, _, s in out):
            raise OverflowError("an inner product does not fit a long")
        table = np.array(out, np.int64).reshape(-1, 3)
        return table[:, 0], table[:, 1], table[:, 2]


def matrix(column: pa.Array, wide: int) -> np.ndarray:
    """A column of lists of doubles as rows of ``wide`` numbers, short ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.asarray(column.offsets)
    sizes, flat = np.diff(ends), column.values.to_numpy(zero_copy_only=False)
    if (sizes == wide).all():
        return flat[ends[0] : ends[-1]].reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide))
    out[np.arange(wide)[None, :] < sizes[:, None]] = flat[ends[0] : ends[-1]]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


def cell_batches(batches: Iterator[pa.RecordBatch], centres: np.ndarray, wide: int) -> Iterator[pa.RecordBatch]:
    """Adds the nearest centre and the distance to it to rows (vec_id, vec)."""
    squares = (centres**2).sum(1)
    for b in batches:
        x = matrix(b.column(1), wide)
        cell = (squares - 2 * products(x, centres)).argmin(1) if len(x) else np.zeros(0, np.int64)
        away = np.sqrt(((x - centres[cell]) ** 2).sum(1))
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(cell.astype(np.int32)), pa.array(away)], ["vec_id", "vec", "cell", "away"])


def start_batches(batches: Iterator[pa.RecordBatch], centres: np.ndarray, wide: int) -> Iterator[pa.RecordBatch]:
    """A first block for each query (rep, vec): the first one of the cell whose centre has the greatest product."""
    for b in batches:
        cell = products(matrix(b.column(1), wide), centres).argmax(1) if len(b) else np.zeros(0, np.int64)
        n = len(cell)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(n, np.iinfo(np.int64).min)), pa.array(cell.astype(np.int32)), pa.array(np.zeros(n, np.int32))], ["vec_id", "vec", "least", "cell", "part"])


def next_batches(batches: Iterator[pa.RecordBatch], centres: np.ndarray, radii: np.ndarray, parts: np.ndarray, wide: int) -> Iterator[pa.RecordBatch]:
    """The blocks that may hold better answers for queries (rep, vec, least): those of cells that reach ``least``, but the
    block that was searched first."""
    ends = np.cumsum(parts)
    of, part = np.repeat(np.arange(len(parts)), parts), np.arange(ends[-1]) - np.repeat(ends - parts, parts)
    for b in batches:
        x, least = matrix(b.column(1), wide), b.column(2).to_numpy()
        dots = products(x, centres)
        reach = np.sqrt((x**2).sum(1))[:, None] * (radii + 1e-9 * (radii + np.sqrt((centres**2).sum(1))))[None, :]
        open_ = (dots + reach + 1e-6 >= least[:, None])[:, of]
        first = dots.argmax(1)
        open_[(of[None, :] == first[:, None]) & (part[None, :] == 0)] = False
        q, block = np.nonzero(open_)
        for lo in range(0, len(q), 8192):
            at = pa.array(q[lo : lo + 8192])
            now = block[lo : lo + 8192]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:3]), pa.array(of[now].astype(np.int32)), pa.array(part[now].astype(np.int32))], ["vec_id", "vec", "least", "cell", "part"])


def block_batches(batches: Iterator[pa.RecordBatch], k: int, wide: int) -> Iterator[pa.RecordBatch]:
    """(rep, vec_id, score) from rows (cell, part, copy, asks, vec_id, least, vec) in this order: a block's vectors, then its
    queries. The vectors of one block are held, and a batch of queries."""
    now, ids, rows, block = None, [], [], None
    for b in batches:
        where = np.array([b.column(i).to_numpy() for i in range(3)]).reshape(3, len(b))
        cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(0)) + 1).tolist(), len(b)] if len(b) else [0]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key, part = tuple(where[:, lo].tolist()), b.slice(lo, hi - lo)
            if key != now:
                now, ids, rows, block = key, [], [], None
            asks, vec_id, x = part.column(3).to_numpy(zero_copy_only=False), part.column(4).to_numpy(), matrix(part.column(6), wide)
            if not asks.all():
                ids.append(vec_id[~asks])
                rows.append(x[~asks])
            if asks.any():
                block = block or Block(np.concatenate(ids or [np.zeros(0, np.int64)]), np.concatenate(rows or [np.zeros((0, wide))]))
                q, found, score = block.search(x[asks], part.column(5).to_numpy()[asks], k)
                yield pa.RecordBatch.from_arrays([pa.array(vec_id[asks][q]), pa.array(found), pa.array(score)], ["rep", "vec_id", "score"])


FOUND = "rep long, vec_id long, score long"
ASKS = "vec_id long, vec array<double>, least long, cell int, part int"


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id is a multiple of ``every``, by the inner
    product of floor(scale * component); equal scores go to the smaller id, and a query is no answer to itself.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id; a short vector
    counts as filled up with zeros; of rows that repeat an id the one with the least vector counts. Fewer than k others: all
    of them. A product beyond a long raises OverflowError. The index is fitted on ``CELLS * SAMPLE`` rows at most, drawn by a
    hash of their ids; all rows are in it. Other columns, whatever their names, are not read; an empty table gives an empty one.
    """
    x = F.col("vec")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = rows.select("vec_id", F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("vec"))
    if rows.groupBy("vec_id").count().filter("count > 1").limit(1).count():
        rows = saved(rows.groupBy("vec_id").agg(F.min("vec").alias("vec")))
    spark, asked = rows.sparkSession, rows.filter(F.col("vec_id") % every == 0)
    reps = asked.groupBy("vec").agg(F.min("vec_id").alias("rep"))
    members = saved(asked.join(reps, "vec").select(F.col("vec_id").alias("query_id"), "rep"))
    # of equal vectors the k + 1 smallest ids: no other is an answer
    same = Window.partitionBy("vec").orderBy("vec_id")
    data = saved(rows.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).select("vec_id", "vec"))
    n, wide = data.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return members.select("query_id", F.lit(0).alias("rank"), F.col("rep").alias("vec_id"), F.col("rep").alias("score"))

    cells = max(1, min(CELLS, -(-n // block)))
    mark = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 40))
    few = data.filter(mark <= int((1 << 40) * min(1.0, 1.2 * SAMPLE * cells / n + 1e-3))).orderBy(mark, "vec_id").limit(SAMPLE * cells).collect()
    few = np.array([np.pad(r.vec, (0, wide - len(r.vec))) for r in few] or np.zeros((1, wide)), float).reshape(-1, wide)
    centres = few[net(few, cells)[0]]
    send = lambda df, name, schema, **given: df.mapInArrow(shipped(__name__, name, wide=wide, **given), schema)
    dealt = saved(send(data, "cell_batches", "vec_id long, vec array<double>, cell int, away double", centres=centres))
    radii, parts = np.zeros(len(centres)), np.ones(len(centres), np.int64)
    for r in dealt.groupBy("cell").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect():  # a row a cell
        radii[r.cell], parts[r.cell] = r.r * (1 + 1e-9), -(-r.n // block)
    part_of = F.element_at(F.array(*map(F.lit, parts.tolist())), F.col("cell") + 1)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), part_of).cast("int"))

    def searched(asks: DataFrame) -> DataFrame:
        """(rep, vec_id, score) of the blocks that queries are sent to; many queries come to copies of a block."""
        asks = saved(asks)
        copies = saved(asks.groupBy("cell", "part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("copies")))
        held = dealt.join(copies, ["cell", "part"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        told = asks.join(copies, ["cell", "part"]).withColumn("copy", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("copies")).cast("int"))
        row = lambda df, says, least: df.select("cell", "part", "copy", F.lit(says).alias("asks"), "vec_id", least.alias("least"), "vec")
        both = row(held, False, F.lit(0).cast("long")).unionByName(row(told, True, F.col("least")))
        return saved(send(both.repartition("cell", "part", "copy").sortWithinPartitions("cell", "part", "copy", "asks"), "block_batches", FOUND, k=k + 1))

    reps = saved(reps.select(F.col("rep").alias("vec_id"), "vec"))
    first = searched(send(reps, "start_batches", ASKS, centres=centres))
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    worst = first.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k + 1).select(F.col("rep").alias("vec_id"), F.col("score").alias("least"))
    rest = reps.join(worst, "vec_id", "left").select("vec_id", "vec", F.coalesce("least", F.lit(-(1 << 63))).alias("least"))
    second = searched(send(rest, "next_batches", ASKS, centres=centres, radii=radii, parts=parts))
    found = first.unionByName(second).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = members.join(found, "rep").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
