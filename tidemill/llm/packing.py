"""Best-fit packing: vectors of tokens, documents and attention cost into as few sequences as best fit finds.

A piece's demand is (length, 1, length squared), so it follows from its length alone. The driver therefore plans over
the histogram of lengths, which has no more rows than a sequence has tokens, whatever the number of pieces: longest
first, all pieces of one length at a time, each into the kind of open sequence that best fits it. Sequences with the
same residual capacities form one kind, so a plan is a short list of runs. A run says which ranks among the pieces of
its length go to which sequences, at which offset; executors number the pieces of each length and look up their run.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import Memo, map_arrow, saved
from tidemill.llm.token_counts import byte_letters, is_latin

PIECES = "id {}, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of texts by a tokenizers file whose pre-tokenizer drops white space.

    A text of Latin-1 characters alone is lower-cased and cut as the file's normalizer and pre-tokenizer would do it, and
    the library's model gives each piece's ids; they are remembered within a bound. In all other texts, those with control
    characters that only Python takes for white space, and those that may hold a special string, what stands between spaces
    goes through the whole library.
    """

    PIECES = re.compile(r"[a-zªµºß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼-¾]|[^\sa-z0-9ªµºß-öø-ÿ²³¹¼-¾]+")

    def __init__(self, path: str, most: int = 120_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.pieces = Memo(self.piece, most)
        self.words = Memo(self.word, most // 8)

    def piece(self, text: str) -> bytes:
        text = text if text.isascii() and text.isprintable() else "".join(map(self.letters.__getitem__, text.encode()))
        ids = [t.id for t in self.library.model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def latin(self, text: str) -> bool:
        return not ("<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text) and is_latin(text)

    def encode(self, text: str) -> bytes:
        if self.latin(text):
            return b"".join(map(self.pieces.__getitem__, self.PIECES.findall(text.lower())))
        return b"".join(map(self.words.__getitem__, text.split(" ")))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def piece_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    e, last = encoder(path), np.array([end], "<u4").tobytes()
    for b in batches:
        keys, at, piece, start, length, crc = b.column(0), [], [], [], [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            ids = e.encode(text or "") + last
            for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[lo : lo + 4 * capacity]
                at.append(i)
                piece.append(k)
                start.append(lo // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["id", "piece", "start", "length", "ids_crc32"])


def pieces(df: DataFrame, key: str, text: str, path: str, capacity: int, end: int = 1) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids and then ``end``, cut after every ``capacity`` ids. Null
    counts as empty: one piece of the end id."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return map_arrow(rows, __name__, "piece_batches", PIECES.format(dict(df.dtypes)[key]), path=path, capacity=capacity, end=end)


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most. The default limits on documents and cost follow from the tokens and never bind."""

    tokens: int = 4096
    documents: int = 1 << 62
    cost: int = 1 << 62


def plan(histogram: dict[int, int], capacity: Capacity, score: str = "norm", weights: tuple[float, float, float] = (1.0, 0.25, 0.25)) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, sequences, first sequence, offset): the piece of rank first + i goes to sequence first + i.

    ``score``: among the kinds of open sequence that hold a piece under all limits, 'norm' takes the one with the least
    weighted norm of what is left over, 'dot' the one with the greatest weighted dot product of demand and residual, each
    as shares of the capacities. A length above a limit raises ValueError.
    """
    full = np.array([capacity.tokens, min(capacity.documents, capacity.tokens), min(capacity.cost, capacity.tokens**2)], float)
    w = np.array(weights) / full**2
    kinds: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    runs, opened = [], 0

    def kind(tokens: int, documents: int, cost: int) -> tuple[int, int, int]:
        return tokens, min(documents, tokens), min(cost, tokens * tokens)

    def room(residual: tuple[int, int, int], length: int) -> int:
        return min(residual[0] // length, residual[1], residual[2] // (length * length))

    def put(residual: tuple[int, int, int], first: int, n: int, length: int, rank: int, each: int) -> None:
        if not n:
            return
        for j in range(each):
            runs.append((length, rank + j * n, n, first, capacity.tokens - residual[0] + j * length))
        left = kind(residual[0] - each * length, residual[1] - each, residual[2] - each * length * length)
        if left[0] and left[1] and left[2]:
            kinds.setdefault(left, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        whole = kind(capacity.tokens, capacity.documents, capacity.cost)
        if not room(whole, length):
            raise ValueError(f"a piece of {length} tokens is over a sequence's limits")
        demand = np.array([length, 1, length * length], float)
        keys = [k for k in kinds if room(k, length)]
        if keys:
            left = np.array(keys, float)
            order = np.argsort((((left - demand) ** 2) * w).sum(1) if score == "norm" else -(left * demand * w).sum(1), kind="stable")
            keys = [keys[i] for i in order]
        for k in keys:
            each, spans = room(k, length), kinds.pop(k)
            while spans and count:
                first, n = spans.pop()
                used = min(n, count // each)
                put(k, first, used, length, rank, each)
                rank, count = rank + used * each, count - used * each
                if used < n and count:  # a last sequence takes what is left of this length
                    put(k, first + used, 1, length, rank, count)
                    rank, count, used = rank + count, 0, used + 1
                if used < n:
                    spans.append((first + used, n - used))
            if spans:
                kinds[k] = spans + kinds.get(k, [])
            if not count:
                break
        each = room(whole, length)
        used = count // each
        put(whole, opened, used, length, rank, each)
        opened, rank, count = opened + used, rank + used * each, count - used * each
        if count:
            put(whole, opened, 1, length, rank, count)
            opened += 1
    return runs


def place_batches(batches: Iterator[pa.RecordBatch], runs) -> Iterator[pa.RecordBatch]:
    """Adds sequence_id and offset to rows that end with rank."""
    table = np.array(sorted(runs.value), np.int64).reshape(-1, 5)
    lengths, firsts = table[:, 0], table[:, 1]
    bounds = {int(x): (np.searchsorted(lengths, x), np.searchsorted(lengths, x, "right")) for x in np.unique(lengths)}
    for b in batches:
        length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
        at = np.empty(len(length), np.int64)
        for x in np.unique(length):
            lo, hi = bounds[int(x)]
            own = length == x
            at[own] = lo + np.searchsorted(firsts[lo:hi], rank[own], "right") - 1
        run = table[at]
        yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], [*b.schema.names[:5], "sequence_id", "offset"])


def pack(rows: DataFrame, capacity: Capacity, score: str = "norm", spread: int = 512) -> DataFrame:
    """``rows`` (from ``pieces``) with sequence_id and offset; each sequence is gapless from 0 and within all limits.

    ``spread`` is how many parts the pieces of one length are numbered in, so that a length that many pieces share is
    no one task's work; the number of parts grows with the number of pieces. Ties and repeated rows are told apart by
    their numbering; an empty table gives an empty one. ``rows`` is written to the shared folder first.
    """
    rows = saved(rows)
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # as many rows as a sequence has tokens
    runs = rows.sparkSession.sparkContext.broadcast(plan(histogram, capacity, score))
    parts = max(spread, sum(histogram.values()) // 200_000)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("length", "part").count()
    counts = saved(counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")))
    own = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    ranked = rows.withColumn("own", F.row_number().over(own)).join(counts, ["length", "part"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own") - 1).alias("rank"))
    schema = PIECES.format(dict(rows.dtypes)["id"]) + ", sequence_id long, offset long"
    return map_arrow(ranked, __name__, "place_batches", schema, runs=runs)


def pack_documents(df: DataFrame, key: str, text: str, path: str, capacity: Capacity = Capacity(), end: int = 1) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for all of ``df``; see ``pieces`` and ``pack``. Null counts as
    empty: one piece of the end id. Repeated rows are each packed; other columns, whatever their names, are not read; an
    empty table gives an empty one."""
    return pack(pieces(df, key, text, path, capacity.tokens, end), capacity).withColumnRenamed("id", key)
