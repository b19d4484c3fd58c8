"""All pairs of texts whose sets of word shingles have a Jaccard similarity of 4/5 or more, up to connection.

A set is its shingles' 64-bit hashes in rising order; equal sets are one row from the start. Of n hashes, two sets that are
alike share one at least of the first p = n - ceil(4n/5) + 1 of either, in any order that both keep (prefix filter). The
first 2p are a set's front, but no more than ``FRONT``: each of the least hashes of both sets together is in both with a
chance of 4/5 or more, so a pair is missed with a chance of 0.2 ** 48, far below that of two shingles' hashes being equal
(and below 1e-11 where as many as a sixth of them are frequent and left out, as below).

Links need only connect. So each set meets the first one of each hash first, and later only sets that are not connected to
it yet. Hashes that more than ``crowd`` fronts hold are left out there. Sets with many of them in front (over a sixth, or
any where the front is not cut) meet again by their whole sets: in an order in which what is frequent comes last, by the
first p alone. Then only sets whose rarer hashes are too few for that, which consist of frequent ones for the most part,
meet by frequent ones.

Before whole sets are read, the parities of how many hashes fall in each of about n bins are compared: no two sets differ
by fewer hashes than by odd bins, so none that is alike is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import components, map_arrow, saved, small, union

FRONT = 48
STEPS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def shingle_set(data: bytes, width: int = 5) -> np.ndarray:
    """Hashes of the different shingles of UTF-8 bytes, A-Z lower-cased, in rising order: none without a word; with fewer
    words than ``width``, one of all of them."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        h = (h ^ w[i : len(w) - width + 1 + i]) * STEPS[0]
        h = (h ^ (h >> np.uint64(29))) * STEPS[1]
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 11) - (1 << 63)


def front_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def odd_bins(s: np.ndarray) -> np.ndarray:
    """Bits that say in which of 64, 128, ... bins (as many as hashes, or up to twice that) an odd number of hashes fall."""
    bins = 64 << max(0, (len(s) - 1) // 64).bit_length()
    return np.packbits(np.bincount(s & (bins - 1), minlength=bins).astype(np.uint8) & 1).view(np.int64)


def front_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A set's key, size, the hashes in front and its odd bins."""
    for b in batches:
        sets = [shingle_set(x or b"", width) for x in b.column(1).to_pylist()]
        fronts = [x[: min(FRONT, 2 * front_size(len(x)))] for x in sets]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(set_key, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in (fronts, map(odd_bins, sets)))], ["id", "s", "n", "front", "odd"])


def set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(x or b"", width) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(map(set_key, sets), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["s", "whole"])


def folded(x: Column, y: Column) -> Column:
    """Odd bins ``x``, in as many as ``y`` has if that is half."""
    half = F.size(y)
    return F.when(F.size(x) > half, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(x)


def near(x: str, y: str) -> Column:
    """Sizes and odd bins of rows ``x`` and ``y`` allow that they are alike."""
    n, m, a, b = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.odd"), F.col(f"{y}.odd")
    differ = F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda d, k: d + k)
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * differ <= n + m)


def stars(rows: DataFrame) -> DataFrame:
    """(a, b): each set of ``rows`` (h, s, n, odd) with the first one of each of its hashes, where they are near."""
    first = rows.groupBy("h").agg(F.min_by(F.struct("s", "n", "odd"), "s").alias("f")).select("h", "f.*")
    return first.alias("x").join(rows.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.s") < F.col("y.s")) & near("x", "y")).select(F.col("x.s").alias("a"), F.col("y.s").alias("b"))


def across(rows: DataFrame) -> DataFrame:
    """(a, b): near sets of ``rows`` (h, s, n, odd, root) that share a hash and no root. The commonest root of a hash has
    most of its rows, and these don't meet each other. Where rows have all hashes of their set (f), two meet at the first
    that they share alone."""
    most = rows.groupBy("h", "root").count().groupBy("h").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count("*").alias("roots"))
    rows = rows.join(most.filter("roots > 1"), "h")
    own, other = F.col("x.root") != F.col("y.root"), (F.col("y.root") == F.col("y.most")) | (F.col("x.s") < F.col("y.s"))
    once = F.get(F.array_intersect("x.f", "y.f"), F.lit(0)) == F.col("x.h") if "f" in rows.columns else F.lit(True)
    met = rows.filter("root <> most").alias("x").join(rows.alias("y"), (F.col("x.h") == F.col("y.h")) & own & other & near("x", "y") & once)
    return met.select(F.least("x.s", "y.s").alias("a"), F.greatest("x.s", "y.s").alias("b")).distinct()


def similar(df: DataFrame, key: str, text: str, width: int = 5, crowd: int = 256, most: int = 1_000_000) -> DataFrame:
    """(src, dst): keys of rows whose texts are alike, enough of them that all pairs of 4/5 or more are connected, and none
    of less. Rows without a key or a word are left out; rows with equal sets are linked to the smallest key among them; other
    columns are not read; an empty table gives an empty one."""
    kind = dict(df.dtypes)[key]
    data = df.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("data")).filter("id is not null and data is not null")
    fronts = saved(map_arrow(data, __name__, "front_batches", f"id {kind}, s long, n int, front array<long>, odd array<long>", width=width).filter("n > 0"))
    names = saved(fronts.groupBy("s").agg(F.min("id").alias("first")))
    equal = fronts.select("id", "s").join(names, "s").filter("id <> first").select(F.col("first").alias("src"), F.col("id").alias("dst"))

    # different sets of fewer than four shingles are never that alike
    nodes = saved(fronts.filter("n > 3").dropDuplicates(["s"]).select("s", "n", "front", "odd"))
    rows = nodes.select("s", F.explode("front").alias("h"))
    often = rows.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    often = saved(rows.join(often, "h").select("h", "s", (F.col("c") > crowd).alias("hot")))

    def whole(wanted: DataFrame) -> DataFrame:
        ids = small(saved(wanted.join(names, "s").select(F.col("first").alias("id"))))
        return map_arrow(data.join(ids, "id", "left_semi"), __name__, "set_batches", "s long, whole array<long>", width=width).dropDuplicates(["s"])

    many = often.filter("hot").groupBy("s").agg(F.count("*").alias("c")).join(nodes.select("s", F.size("front").alias("e")), "s")
    again = saved(_rare_first(whole(many.filter((F.col("e") < FRONT) | (6 * F.col("c") > F.col("e"))).select("s")), crowd, most))
    end = nodes.select("s", "n", "odd")
    cold = saved(often.filter("not hot").select("h", "s").unionByName(again.filter("not hot").select("h", "s")).distinct().join(end, "s"))
    hot = again.filter("hot").groupBy("s").agg(F.sort_array(F.collect_list("h")).alias("f"))  # of one set's front
    hot = saved(hot.select("s", "f", F.explode("f").alias("h")).join(end, "s"))

    first = verified(saved(stars(cold).unionByName(stars(hot)).distinct()), whole)
    roots = saved(components(first, "a", "b"))
    rooted = lambda rows: rows.join(roots, rows["s"] == roots["node"], "left").select(*rows.columns, F.coalesce("root", "s").alias("root"))
    rest = saved(across(rooted(cold)).unionByName(across(rooted(hot))).distinct())
    links = first.unionByName(verified(rest, whole))
    links = links.join(names.select(F.col("s").alias("a"), F.col("first").alias("src")), "a").join(names.select(F.col("s").alias("b"), F.col("first").alias("dst")), "b")
    return union([equal, links.select("src", "dst")])


def rare_first_batches(batches: Iterator[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, fronts, marks = [], [], []
        for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.array(x, np.int64)
            often = np.isin(x, hot.value, assume_unique=True)
            by = np.argsort(often, kind="stable")[: front_size(len(x))]
            keys.append(np.full(len(by), s))
            fronts.append(x[by])
            marks.append(often[by])
        cols = [np.concatenate(x) if x else np.zeros(0, k) for x, k in ((fronts, np.int64), (keys, np.int64), (marks, bool))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "s", "hot"])


def _rare_first(sets: DataFrame, crowd: int, most: int = 1_000_000) -> DataFrame:
    """(h, s, hot): the hashes in front of whole ``sets`` (s, whole), those of over ``crowd`` of the sets last. Up to ``most``
    such hashes are sent to all tasks; if there are more, they are joined."""
    sets = saved(sets)
    rows = sets.select("s", F.explode("whole").alias("h"))
    counts = saved(rows.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") > crowd).select("h"))
    if counts.count() <= most:
        hot = sets.sparkSession.sparkContext.broadcast(np.array([r.h for r in counts.collect()], np.int64))
        return map_arrow(sets, __name__, "rare_first_batches", "h long, s long, hot boolean", hot=hot)
    rows = rows.join(counts.withColumn("hot", F.lit(True)), "h", "left").select("s", F.struct(F.coalesce("hot", F.lit(False)).alias("hot"), "h").alias("x"))
    fronts = rows.groupBy("s").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # a row a set
    size = F.expr("size(xs) - cast(floor((4 * size(xs) + 4) / 5) as int) + 1")
    return fronts.select("s", F.explode(F.slice("xs", F.lit(1), size)).alias("x")).select("x.h", "s", "x.hot")


def verified(pairs: DataFrame, whole) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are alike."""
    sets = saved(whole(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()))
    both = pairs.join(sets.select(F.col("s").alias("a"), F.col("whole").alias("x")), "a").join(sets.select(F.col("s").alias("b"), F.col("whole").alias("y")), "b")
    return saved(both.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"))
