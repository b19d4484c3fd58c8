"""Cross-validation splits as tables: walk-forward, combinatorial purged, and what they are made of.

A split table is normalised: one row (fold, role, row_idx) for each use of a row. Block limits, folds and combinations
follow from the number of rows. Purging asks for each row which test runs it meets: runs of neighbouring blocks, of which there are
few however many folds there are. Rows of a block that meet the same runs are used alike in all folds, so a small table of these
kinds says how, and the plan does not grow with the folds: 14 blocks have 3,432.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.frames import numbered

#: For each kind of rows, all of which are used alike: the folds that use it, with the role.
Uses = list[list[tuple[int, str]]]


def contiguous_runs(df: DataFrame, by: Sequence[str], index: str = "row_idx") -> DataFrame:
    """(by, start, stop): runs of neighbouring whole numbers; repeats count once."""
    rows = numbered(df.select(*by, index).distinct(), [index], by, "_place")
    return rows.groupBy(*by, (F.col(index) - F.col("_place")).alias("_i")).agg(F.min(index).alias("start"), F.max(index).alias("stop")).drop("_i")


def block_bounds(n: int, blocks: int, drop_remainder: bool = False) -> list[tuple[int, int]]:
    """[start, stop) of contiguous blocks; the first n % blocks have one row more, unless these rows are dropped."""
    each, over = divmod(n, blocks)
    sizes = [each + (i < over and not drop_remainder) for i in range(blocks)]
    stops = [sum(sizes[: i + 1]) for i in range(blocks)]
    return [(b - s, b) for b, s in zip(stops, sizes, strict=True)]


def block_of(index: Column, n: int | Column, blocks: int) -> Column:
    """The block of a row number by ``block_bounds``, as arithmetic; ``n`` may differ from row to row."""
    n = F.lit(n) if isinstance(n, int) else n
    each, over = F.floor(n / blocks), n % blocks
    cut = over * (each + 1)
    late = over + F.floor((index - cut) / F.greatest(each, F.lit(1)))
    return F.when(index < cut, F.floor(index / (each + 1))).otherwise(late).cast("int")


def walk_forward_bounds(n: int, folds: int = 5) -> list[tuple[int, int, int]]:
    """(fold from 1, test start, test stop): tests of n // (folds + 1) rows up to the end; training is all before."""
    size = n // (folds + 1)
    if size < 1:
        raise ValueError(f"{folds} folds need more than {n} rows")
    return [(k + 1, n - (folds - k) * size, n - (folds - k - 1) * size) for k in range(folds)]


def walk_forward(df: DataFrame, n: int, folds: int = 5, index: str = "row_idx") -> DataFrame:
    """(fold, role, row_idx) of expanding training sets and the tests after them."""
    i = F.col(index)
    use = [F.when(i < stop, F.struct(F.lit(fold).alias("fold"), F.when(i < start, "train").otherwise("test").alias("role"))) for fold, start, stop in walk_forward_bounds(n, folds)]
    return df.select(F.explode(F.filter(F.array(*use), lambda x: x.isNotNull())).alias("x"), i.alias(index)).select("x.*", index)


def walk_forward_kinds(df: DataFrame, n: int, folds: int = 5, index: str = "row_idx") -> tuple[DataFrame, Uses]:
    """``walk_forward`` by kinds of rows: (row_idx, _kind), and the uses of each kind. Kind 0 is before all tests, kind k in the k-th."""
    start, stop = walk_forward_bounds(n, folds)[0][1:]
    kind = F.least(F.greatest(F.floor((F.col(index) - start) / (stop - start)) + 1, F.lit(0)), F.lit(folds + 1)).cast("int")
    uses = [[(f, "test" if f == k else "train") for f in range(max(k, 1), folds + 1)] for k in range(folds + 2)]
    return df.select(F.col(index).alias("row_idx"), kind.alias("_kind")), uses


def cpcv(df: DataFrame, n: int, blocks: int = 6, most: int | None = None, purge: float | None = None, embargo: float = 0.0, t0: str = "t0", t_end: str = "t_end", index: str = "row_idx", end: str = "last", purge_rows: int = 0, embargo_share: float = 0.0, drop_remainder: bool = False) -> DataFrame:
    """(fold, role, row_idx): each choice of half the blocks, in order, is a training set and the rest its test.

    With ``purge`` (seconds; rows need ``t0`` and ``t_end``), training rows whose interval meets a test run widened by it
    go, as do those that start within ``embargo`` seconds after it. A run ends with the ``end`` of its events: that of the
    'last', or the 'max'. Without, ``purge_rows`` around each test block go, and ``embargo_share`` of all rows after the
    last test row. Folds without training rows are left out before the first ``most`` are taken.
    """
    out, _ = _cpcv(df, n, blocks, most, purge, embargo, t0, t_end, index, end, purge_rows, embargo_share, drop_remainder)
    return out.select(F.explode("_uses").alias("x"), "row_idx").select("x.*", "row_idx")


def cpcv_kinds(df: DataFrame, n: int, blocks: int = 6, most: int | None = None, purge: float | None = None, embargo: float = 0.0, t0: str = "t0", t_end: str = "t_end", index: str = "row_idx", end: str = "last", purge_rows: int = 0, embargo_share: float = 0.0, drop_remainder: bool = False) -> tuple[DataFrame, Uses]:
    """``cpcv`` by kinds of rows: (row_idx, _kind), and the uses of each kind."""
    out, uses = _cpcv(df, n, blocks, most, purge, embargo, t0, t_end, index, end, purge_rows, embargo_share, drop_remainder)
    return out.select("row_idx", "_kind"), uses


def _cpcv(df: DataFrame, n: int, blocks: int, most: int | None, purge: float | None, embargo: float, t0: str, t_end: str, index: str, end: str, purge_rows: int, embargo_share: float, drop_remainder: bool) -> tuple[DataFrame, Uses]:
    """(row_idx, _kind, _uses), and the uses of each kind."""
    if drop_remainder and n % blocks:
        raise ValueError("blocks do not cover all rows")
    combos = list(combinations(range(blocks), blocks // 2))
    bounds, i = block_bounds(n, blocks), F.col(index)
    tests = [[b for b in range(blocks) if b not in c and bounds[b][0] < bounds[b][1]] for c in combos]
    rows = df.withColumn("_block", block_of(i, n, blocks))
    # what a row may be lost to: (lowest, highest) of a span; a fold has some of the spans
    spans: dict[tuple, tuple] = {}
    if purge is not None:
        cut = rows.select("_block", i.alias("_i"), F.col(t0).alias("_t0"), F.col(t_end).alias("_te"))
        ends = cut.groupBy("_block").agg(F.min_by("_t0", "_i"), F.max("_te") if end == "max" else F.max_by("_te", "_i"))
        ends = {r[0]: r[1:] for r in ends.collect()}  # a row a block
        mine = [[(run[0], run[-1]) for run in _neighbours([b for b in own if b in ends])] for own in tests]
        for x, y in sorted({run for own in mine for run in own}):
            stop = max(ends[b][1] for b in range(x, y + 1)) if end == "max" else ends[y][1]
            spans[x, y] = (ends[x][0] - timedelta(seconds=purge), stop + timedelta(seconds=purge), stop, stop + timedelta(seconds=embargo))
        kind = "lo timestamp_ntz, hi timestamp_ntz, stop timestamp_ntz, rest timestamp_ntz"
        hit = lambda x: (F.col(t0) <= x["hi"]) & (F.col(t_end) >= x["lo"]) | (F.lit(embargo > 0) & (F.col(t0) > x["stop"]) & (F.col(t0) <= x["rest"]))
    else:
        mine = []
        for own in tests:
            mine.append([("near", b) for b in own if purge_rows] + ([("after", own[-1])] if embargo_share and own else []))
        for name, b in sorted({x for own in mine for x in own}):
            start = min(bounds[b][1], n - 1)
            spans[name, b] = (bounds[b][0] - purge_rows, bounds[b][1] - 1 + purge_rows) if name == "near" else (start, min(start + int(n * embargo_share), n - 1))
        kind = "lo long, hi long"
        hit = lambda x: i.between(x["lo"], x["hi"])
    names = kind.replace(",", "").split()[::2]
    cells = [F.struct(F.lit(k).alias("k"), *(F.lit(v).cast(kind.split(", ")[j].split()[1]).alias(names[j]) for j, v in enumerate(span))) for k, span in enumerate(spans.values())]
    lost = F.transform(F.filter(F.array(*cells), lambda x: F.coalesce(hit(x), F.lit(False))), lambda x: x["k"]) if cells else F.array().cast("array<int>")
    rows = rows.select(i.alias("row_idx"), "_block", F.array_join(lost, ",").alias("_lost"))
    place = {span: k for k, span in enumerate(spans)}
    # rows of one block that are lost to the same spans are used alike: a table of a row for each such kind
    found = [(r[0], r[1], {int(k) for k in r[1].split(",") if k}, r[2]) for r in rows.groupBy("_block", "_lost").count().collect()]
    dangers = [{place[x] for x in own} for own in mine]
    count = [sum(c for b, _, gone, c in found if b in own and not gone & danger) for own, danger in zip(map(set, combos), dangers, strict=True)]
    folds = [(k, set(combos[k]), dangers[k]) for k, c in enumerate(count) if c][:most]
    uses = [[(f + 1, "train" if b in own else "test") for f, (_, own, danger) in enumerate(folds) if b not in own or not gone & danger] for b, _, gone, _ in found]
    use = pa.list_(pa.struct([("fold", pa.int32()), ("role", pa.string())]))
    cells = pa.array([[{"fold": f, "role": role} for f, role in own] for own in uses], use)
    table = pa.table([pa.array([b for b, *_ in found], pa.int32()), pa.array([x for _, x, *_ in found], pa.string()), pa.array(range(len(found)), pa.int32()), cells], ["_block", "_lost", "_kind", "_uses"])
    out = rows.join(F.broadcast(df.sparkSession.createDataFrame(table)), ["_block", "_lost"])  # as many rows as kinds
    return out.select("row_idx", "_kind", "_uses"), uses


def _neighbours(numbers: list[int]) -> list[list[int]]:
    """Runs of neighbouring numbers."""
    out: list[list[int]] = []
    for x in numbers:
        if out and out[-1][-1] == x - 1:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def split_lists(splits: DataFrame, most: int | None = None) -> DataFrame:
    """(fold, train_idx, test_idx, n_train, n_test, and their first and last): one row a fold, as split files have it. With ``most`` a row
    has the places of one span of that many, ``part``, so that no row, group or task holds a whole fold of a large table."""
    of = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("row_idx"))))
    by = ["fold"] if most is None else ["fold", F.floor(F.col("row_idx") / most).cast("int").alias("part")]
    return _with_ends(splits.groupBy(*by).agg(of("train").alias("train_idx"), of("test").alias("test_idx")))


def _with_ends(lists: DataFrame) -> DataFrame:
    ends = [f(f"{r}_idx").alias(f"{r}_{n}") for r in ("train", "test") for f, n in ((F.array_min, "start"), (F.array_max, "end"))]
    return lists.select("*", *ends, F.size("train_idx").alias("n_train"), F.size("test_idx").alias("n_test"))


def lists_of_kinds(rows: DataFrame, uses: Uses, most: int | None = None, parts: int = 1) -> DataFrame:
    """``split_lists`` of rows (row_idx, _kind), always with ``part``: 0 without ``most``. Spans are dealt in order over ``parts`` partitions,
    in which rows are in the order of spans, then of folds.

    A place is shuffled and sorted once, however many folds use it: folds put the lists of kinds together where the span is.
    """
    used = [(k, fold, role) for k, own in enumerate(uses) for fold, role in own]
    table = rows.sparkSession.createDataFrame(used, "_kind int, fold int, role string")
    part = F.floor(F.col("row_idx") / (most or 1 << 62)).cast("int").alias("part")
    ids = rows.select(part, "_kind", "row_idx").repartitionByRange(parts, "part").groupBy("part", "_kind").agg(F.sort_array(F.collect_list("row_idx")).alias("_ids"))
    used = ids.join(F.broadcast(table), "_kind")  # a row a kind and fold
    of = lambda role: F.sort_array(F.flatten(F.collect_list(F.when(F.col("role") == role, F.col("_ids")))))
    lists = used.groupBy("part", "fold").agg(of("train").alias("train_idx"), of("test").alias("test_idx"))
    return _with_ends(lists).sortWithinPartitions("part", "fold")


def counts_of_kinds(rows: DataFrame, uses: Uses) -> DataFrame:
    """``test_counts`` of rows (row_idx, _kind), each of another place."""
    tests = F.lit([sum(role == "test" for _, role in own) for own in uses]).cast("array<bigint>")
    return rows.select("row_idx", F.get(tests, F.col("_kind")).alias("n")).filter("n > 0")


def test_counts(splits: DataFrame) -> DataFrame:
    """(row_idx, n): in how many tests each row is."""
    return splits.filter("role = 'test'").groupBy("row_idx").agg(F.count("*").alias("n"))


def first_train_size(splits: DataFrame) -> DataFrame:
    """The least test row of the first fold."""
    return splits.filter("role = 'test' and fold = 1").agg(F.min("row_idx").alias("first_train_size"))


def gather(df: DataFrame, splits: DataFrame, index: str = "row_idx") -> DataFrame:
    """Each use of each row of ``df``: its columns with (fold, role)."""
    return splits.join(df, index)


def accumulate(returns: DataFrame, by: Sequence[str] = ("row_idx", "strategy"), compat: bool = False) -> DataFrame:
    """Returns of all folds of a row, summed, counted and averaged; ``compat`` divides by the count twice."""
    out = returns.groupBy(*by).agg(F.sum("ret").alias("total"), F.count("*").alias("n"))
    mean = F.col("total") / F.col("n")
    return out.withColumn("ret", mean / F.col("n") if compat else mean)


def overlaps(df: DataFrame, splits: DataFrame, t0: str = "t0", t_end: str = "t_end", index: str = "row_idx") -> DataFrame:
    """(fold, shared_rows, overlapping): rows in both roles, and pairs of a training interval and a test run that meet."""
    x = df.select(F.col(index).alias("row_idx"), F.col(t0).alias("_t0"), F.col(t_end).alias("_te"))
    runs = contiguous_runs(splits.filter("role = 'test'"), ["fold"])
    at = lambda c, **k: x.select(F.col("row_idx").alias(c), *(F.col(v).alias(n) for n, v in k.items()))
    runs = runs.join(at("start", _from="_t0"), "start").join(at("stop", _to="_te"), "stop").select("fold", "_from", "_to")
    train = splits.filter("role = 'train'").join(x, "row_idx")
    met = train.join(runs, "fold").filter("_t0 <= _to and _te >= _from").groupBy("fold").agg(F.count("*").alias("overlapping"))
    both = splits.groupBy("fold", "row_idx").agg(F.count_distinct("role").alias("_r")).groupBy("fold").agg(F.count_if(F.col("_r") > 1).alias("shared_rows"))
    return both.join(met, "fold", "left").withColumn("overlapping", F.coalesce("overlapping", F.lit(0)))
