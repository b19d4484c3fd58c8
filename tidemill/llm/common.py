"""What the operators of this subpackage share: Arrow maps, checkpoints, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.frames import ROOT
from tidemill.plans.adapters import table
from tidemill.storage import new_folder, saved

__all__ = ["ROOT", "TEXT_ROWS", "Memo", "components", "map_arrow", "new_folder", "saved", "shipped", "short_batches", "small", "table", "union", "written"]
#: Rows in an Arrow batch that carries texts; keeps a batch of very long texts within a worker's memory.
TEXT_ROWS = 256


def shipped(module: str, name: str, **params) -> Callable[[Iterator], Iterator]:
    """``module.name(batches, **params)`` as a function that any Python worker can unpickle."""

    def run(batches, root=ROOT):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        yield from getattr(importlib.import_module(module), name)(batches, **params)

    return run


def short_batches(df: DataFrame, rows: int = TEXT_ROWS) -> None:
    """Makes the session's Arrow batches ``rows`` rows at most."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_arrow(df: DataFrame, module: str, name: str, schema: str, rows: int = TEXT_ROWS, **params) -> DataFrame:
    """``mapInArrow`` by a function of this library; the session's batches become ``rows`` rows at most."""
    short_batches(df, rows)
    return df.mapInArrow(shipped(module, name, **params), schema)


def written(df: DataFrame) -> DataFrame:
    """As ``saved``, as a table of Parquet files: what the optimizer knew of ``df`` is forgotten, too."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 300_000) -> DataFrame:
    """``df``, a saved table of an id or two a row, marked to be broadcast if it has ``most`` rows at most, so that what it is
    joined with stays where it is."""
    return F.broadcast(df) if df.count() <= most else df


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rows_a_task: int = 50_000) -> DataFrame:
    """Connected components of an undirected graph: (node, root) with the smallest reachable node as root.

    Alternates large-star and small-star steps on a table of edges in the shared folder until nothing changes; only the
    count and a checksum of the edges reach the driver. A step's tables are written by as many tasks as the edges need,
    not as the session has shuffle partitions. Self loops and repeated edges are allowed; a node with null is dropped.
    Nodes without an edge to another node are not returned.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    e = saved(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(e)
    tasks = max(8, seen[0] // rows_a_task)
    e = e.coalesce(tasks)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks))
        large = saved(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks))
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks))
        before, seen = seen, mark(e)
        if before == seen:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Memo(dict):
    """key -> make(key) for recent keys, within twice ``most`` entries: the older half goes when the newer is full. Long
    keys are not kept."""

    LONG = 200

    def __init__(self, make: Callable, most: int = 250_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(key) > self.LONG:
            return self.make(key)
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
