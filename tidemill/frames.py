"""Ordered frames: positions, windows with bounded look-back, spans of time."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemill.storage import saved

KEYS, TS = ("pair",), "ts"
#: Rows of one key that a task has of a long history; operators that look back take it unless told otherwise.
BLOCK = 100_000
#: The folder above the package, for Python workers that were started without it on their path.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ordered(keys: Sequence[str] = KEYS, ts: str = TS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ts)


def seconds(a: Column, b: Column) -> Column:
    """Whole seconds from ``a`` to ``b``."""
    return F.timestamp_diff("SECOND", a, b)


def floor_minutes(ts: Column, minutes: int) -> Column:
    """``ts`` rounded down to a multiple of ``minutes`` within its day."""
    at = F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes) * minutes
    return F.date_trunc("day", ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), at.cast("int"))


def minutes_after(ts: Column, n: Column | int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n) if isinstance(n, int) else n.cast("int"))


def longest(df: DataFrame, keys: Sequence[str] = KEYS) -> int:
    """The most rows that a key of ``df`` has; counted once, and remembered for frames that ``alike`` makes of it."""
    known = getattr(df, "_longest", {})
    if tuple(keys) not in known:
        known[tuple(keys)] = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        df._longest = known
    return known[tuple(keys)]


def alike(out: DataFrame, df: DataFrame) -> DataFrame:
    """``out``, which has no more rows of any key than ``df``: what is known of the lengths of keys holds for it, too."""
    out._longest = dict(getattr(df, "_longest", {}))
    return out


def _days(df: DataFrame, keys: Sequence[str], ts: str, total: Column, before: str) -> DataFrame:
    """(keys, _day, before): what ``total`` is over a key's earlier days."""
    days = df.groupBy(*keys, F.to_date(F.col(ts)).alias("_day")).agg(total.alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    return days.select(*keys, "_day", "_n", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias(before))


def with_position(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, name: str = "pos", ties: Sequence[str] = (), block: int | None = BLOCK) -> DataFrame:
    """``df`` with each row's place (from 0) within its key by ``ts``.

    Where a key has more than ``block`` rows they are numbered within (key, day) and shifted by the counts of the days
    before, so that a key with most of the rows is many tasks' work. Ties in ``ts`` within a key are numbered by ``ties``, else
    in any order.
    """
    if not keys:
        return numbered(df, [ts, *ties], (), name)
    if block is None or longest(df, keys) <= block:
        return alike(df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(ts, *ties)) - 1), df)
    base = _days(df, keys, ts, F.count("*"), "_base").drop("_n")
    own = F.row_number().over(Window.partitionBy(*keys, "_day").orderBy(ts, *ties)) - 1
    out = df.withColumn("_day", F.to_date(F.col(ts))).withColumn("_own", own).join(base, [*keys, "_day"])
    return alike(out.withColumn(name, F.col("_base") + F.col("_own")).drop("_day", "_own", "_base"), df)


def running_sum(df: DataFrame, x: Column, name: str, keys: Sequence[str] = KEYS, ts: str = TS, block: int | None = BLOCK, ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with the sum of ``x`` over a key's rows up to each by ``ts`` (and ``ties``); where a key has more than ``block`` rows within
    (key, day), on top of the sums of the days before. Nulls count as zero."""
    if block is None or longest(df, keys) <= block:
        return alike(df.withColumn(name, F.sum(F.coalesce(x, F.lit(0))).over(Window.partitionBy(*keys).orderBy(ts, *ties).rowsBetween(Window.unboundedPreceding, 0))), df)
    rows = df.withColumns({"_day": F.to_date(F.col(ts)), "_x": F.coalesce(x, F.lit(0))})
    base = _days(rows, keys, ts, F.sum("_x"), "_base").drop("_n")
    own = F.sum("_x").over(Window.partitionBy(*keys, "_day").orderBy(ts, *ties).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_own", own).join(base, [*keys, "_day"])
    return alike(out.withColumn(name, F.col("_base") + F.col("_own")).drop("_day", "_x", "_own", "_base"), df)


def look_back(df: DataFrame, back: int, build: Callable[[WindowSpec], dict[str, Column] | tuple[dict[str, Column], ...]], keys: Sequence[str] = KEYS, ts: str = TS, block: int | None = BLOCK, strict: bool = False) -> DataFrame:
    """``df`` with the columns that ``build`` makes from a window that reads at most ``back`` rows before a row; of several
    sets of columns the later may use the earlier.

    Where a key has more than ``block`` rows, its days are dealt in blocks of about that many rows, each after copies of the
    days that hold the ``back`` rows before it. Where days go is a table of a row a key and day; rows are shuffled once by
    their blocks. With ``strict`` a block has no more than ``block`` rows, and the ``back`` before it, so rows are numbered first;
    ``build`` may use a row's place ``_pos`` then. Same values either way.
    """
    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("_pos", F.row_number().over(w)) if strict else rows
        made = build(w)
        for columns in made if isinstance(made, tuple) else (made,):
            rows = rows.withColumns(columns)
        return rows.drop("_pos") if strict else rows

    if block is None or longest(df, keys) <= block:
        return alike(add(df, ordered(keys, ts)), df)
    if strict:
        if back > block:
            raise ValueError("a block must hold the rows that a window looks back")
        rows = with_position(df, keys, ts, "_at").withColumn("_b", F.floor(F.col("_at") / block))
        also = F.when(F.col("_at") % block >= block - back, F.array(F.col("_b"), F.col("_b") + 1)).otherwise(F.array("_b"))
        out = add(rows.withColumn("_in", F.explode(also)), Window.partitionBy(*keys, "_in").orderBy("_at")).filter("_in = _b")
        return alike(out.drop("_at", "_b", "_in"), df)
    order = Window.partitionBy(*keys).orderBy("_day")
    days = _days(df, keys, ts, F.count("*"), "_before").withColumns({"_b": F.floor(F.col("_before") / block).cast("int"), "_end": F.col("_before") + F.col("_n")})
    days = days.withColumn("_next", F.lead("_b").over(order)).withColumn("_next", F.when(F.col("_next") != F.col("_b"), F.col("_next")))
    near = Window.partitionBy(*keys).orderBy("_end").rangeBetween(0, back - 1)  # blocks that begin within ``back`` rows of a day's end
    days = days.select(*keys, "_day", "_b", F.concat(F.array("_b"), F.collect_list("_next").over(near)).alias("_ins"))
    dealt = df.withColumn("_day", F.to_date(F.col(ts))).join(days, [*keys, "_day"]).withColumn("_in", F.explode("_ins"))
    out = add(dealt, Window.partitionBy(*keys, "_in").orderBy(ts)).filter("_in = _b")
    return alike(out.drop("_day", "_b", "_ins", "_in"), df)


def same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    """That the columns ``names`` of ``a`` equal those of ``b`` with an underscore behind; nulls equal each other."""
    fits = F.lit(True)
    for n in names:
        fits = fits & a[n].eqNullSafe(b[f"{n}_"])
    return fits


def numbered(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "_n") -> DataFrame:
    """``df``, saved, with each row's place (from 0) within its key by ``order``; neither a key nor the whole is one task's.

    Rows are sorted by ranges over all tasks. A range's rows are counted by key, and what earlier ranges have is added: a
    table of a row a range and key. Rows that ``order`` does not tell apart are numbered in any order.
    """
    at = F.shiftright("_m", 33)  # the range, as Spark numbers rows
    rows = saved(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_m", F.monotonically_increasing_id()))
    pieces = rows.groupBy(*keys, at.alias("_range")).agg(F.count("*").alias("_c"), F.min("_m").alias("_lo"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*(F.col(k).alias(f"{k}_") for k in keys), "_range", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_lo")).alias("_shift"))
    out = rows.join(pieces, same(rows, pieces, keys) & (F.shiftright(rows["_m"], 33) == pieces["_range"]))
    return out.withColumn(name, F.col("_m") + F.col("_shift")).drop("_m", "_range", "_shift", *(f"{k}_" for k in keys))


def with_average_rank(df: DataFrame, column: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with the rank (from 1) of ``column`` within its key; equal values share their average rank, nulls come first."""
    rows = saved(numbered(df, [column], keys, name))
    ties = rows.groupBy(*keys, column).agg((F.min(name) + 1 + (F.count("*") - 1) / 2).alias("_rank"))
    ties = ties.select(*(F.col(c).alias(f"{c}_") for c in (*keys, column)), "_rank")
    out = rows.join(ties, same(rows, ties, (*keys, column)))
    return out.withColumn(name, F.col("_rank")).drop("_rank", *(f"{c}_" for c in (*keys, column)))


def with_block(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, block: int = BLOCK, name: str = "_b") -> DataFrame:
    """``df`` with the number, from 0 and rising with ``ts``, of the block of its row: whole days of its key, the next block
    beginning with the first day after every ``block`` rows. Days are counted first; what is joined is a row a key and day."""
    day = F.to_date(F.col(ts))
    days = df.groupBy(*keys, day.alias("_day")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "_day", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / block).cast("int").alias(name))
    return df.withColumn("_day", day).join(days, [*keys, "_day"]).drop("_day")


def _machine(name: str, given: dict, root: str):
    import importlib
    import sys

    if root not in sys.path:
        sys.path.insert(0, root)
    module, _, kind = name.rpartition(".")
    return getattr(importlib.import_module(module), kind)(**given)


def in_blocks(df: DataFrame, machine: str, out: dict[str, str], keys: Sequence[str] = KEYS, ts: str = TS, block: int = BLOCK, **given) -> DataFrame:
    """(keys, ts, out): what a state machine ('module.Class') makes of each key's rows in the order of ``ts``, the blocks of a
    key at once.

    ``Class(**given)`` has a state to begin with, ``start`` (a tuple of numbers), and ``walk(rows, state)``, which yields the
    state after each row of a pandas frame and its output (a tuple, or None). Every block is walked from ``start`` first. What
    a block ends with is what the next should have begun with, so blocks that began with something else are walked anew
    beside their first walk, up to the row where both states are equal: from there on the first walk was right. Blocks whose
    end changes by that pass it on, until none does. A machine that forgets (as one that resets does) meets its first walk
    soon; one that never does costs as many rounds as it has blocks. Results are those of one walk over all rows.
    """
    root, kinds, columns = ROOT, dict(df.dtypes), list(keys)
    head = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", _b int"
    schema = f"{head}, _i long, {ts} {kinds[ts]}, {', '.join(f'{c} {k}' for c, k in out.items())}, _state array<double>, _met boolean"
    names = [*columns, "_b", "_i", ts, *out, "_state", "_met"]

    def made(key: tuple, found: list, end: tuple, size: int, met: bool) -> pd.DataFrame:
        """Outputs, and a last row without a time that tells the state at the end, and where the walks met if they did."""
        rows = [(*key, i, at, *o, None, None) for i, at, o in found]
        rows.append((*key, size, None, *(None for _ in out), list(map(float, end)), met))
        return pd.DataFrame(rows, columns=names)

    def first(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m, rows = _machine(machine, given, root), rows.sort_values(ts, kind="stable")
        found, state, times = [], m.start, rows[ts].tolist()
        for i, (state, o) in enumerate(m.walk(rows, m.start)):  # noqa: B007
            if o is not None:
                found.append((i, times[i], o))
        return made(key, found, state, len(rows), False)

    def again(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m, rows = _machine(machine, given, root), rows.sort_values(ts, kind="stable")
        state, times, found = tuple(rows["_carry"].iloc[0]), rows[ts].tolist(), []
        for i, ((state, o), (other, _)) in enumerate(zip(m.walk(rows, state), m.walk(rows, m.start), strict=True)):
            if o is not None:
                found.append((i, times[i], o))
            if state == other:
                return made(key, found, state, i, True)
        return made(key, found, state, len(rows), False)

    if longest(df, keys) <= block:
        found = df.withColumn("_b", F.lit(0)).groupBy(*keys, "_b").applyInPandas(first, schema)
        return alike(found.filter("_state is null").select(*keys, ts, *out), df)
    start = F.array(*map(F.lit, map(float, _machine(machine, given, root).start)))
    rows = saved(with_block(df, keys, ts, block))
    walked = saved(rows.groupBy(*keys, "_b").applyInPandas(first, schema))
    ends = walked.filter("_state is not null").select(*keys, "_b", F.col("_state").alias("_end"))
    ends = saved(ends.withColumns({"_first": F.col("_end"), "_begun": start, "_round": F.lit(0)}))
    order, corrected, round_ = Window.partitionBy(*keys).orderBy("_b"), None, 0
    while True:
        due = ends.withColumn("_carry", F.coalesce(F.lag("_end").over(order), start)).filter(F.col("_carry") != F.col("_begun"))
        due = saved(due.select(*keys, "_b", "_carry"))
        if not due.limit(1).count():
            break
        round_ += 1
        redone = saved(rows.join(due, [*keys, "_b"]).groupBy(*keys, "_b").applyInPandas(again, schema).withColumn("_round", F.lit(round_)))
        corrected = redone if corrected is None else corrected.unionByName(redone)
        told = redone.filter("_state is not null").select(*keys, "_b", F.col("_state").alias("_new"), F.col("_met").alias("_as_first")).join(due, [*keys, "_b"])
        now = F.when(F.col("_new").isNull(), F.col("_end")).when(F.col("_as_first"), F.col("_first")).otherwise(F.col("_new"))
        ends = saved(
            ends.join(told, [*keys, "_b"], "left").select(*keys, "_b", now.alias("_end"), "_first", F.coalesce("_carry", "_begun").alias("_begun"), F.when(F.col("_new").isNotNull(), round_).otherwise(F.col("_round")).alias("_round"))
        )
    found = walked.filter("_state is null")
    if corrected is not None:
        last = corrected.join(ends.select(*keys, "_b", "_round"), [*keys, "_b", "_round"])  # of each block the last walk
        upto = last.filter("_state is not null").select(*keys, "_b", F.when(F.col("_met"), F.col("_i")).otherwise(F.lit(1 << 62)).alias("_upto"))
        kept = found.join(upto, [*keys, "_b"], "left").filter(F.col("_upto").isNull() | (F.col("_i") > F.col("_upto")))
        found = kept.select(*keys, ts, *out).unionByName(last.filter("_state is null").select(*keys, ts, *out))
    return alike(found.select(*keys, ts, *out), df)


def exact_quantiles(df: DataFrame, x: Column, shares: Sequence[float], keys: Sequence[str] = KEYS, accuracy: int = 10_000, most: int = 1_000_000) -> DataFrame:
    """(key, _q): the exact quantiles of ``x`` at ``shares``, between neighbours in proportion, for each key with a value; all of
    all keys in one selection.

    Where no key has more than ``most`` rows one aggregation holds its values. Else a sketch of bounded size says between
    which values each quantile lies; what is below is only counted, and of what is between, a small share of the rows, different
    values are counted and put in order. So what a task holds of a key does not grow with the key's rows.
    """
    shares = [float(s) for s in shares]
    rows = alike(df.select(*keys, x.cast("double").alias("_x")).filter("_x is not null"), df)
    if longest(rows, keys) <= most:
        return rows.groupBy(*keys).agg(F.percentile("_x", F.array(*map(F.lit, shares))).alias("_q"))
    edge, k = 4 / accuracy, len(shares)  # the sketch is right to 1 / accuracy, and ranks among accuracy values or more to as much again
    ends = [max(0.0, s - edge) for s in shares] + [min(1.0, s + edge) for s in shares]
    near = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_x", ends, accuracy).alias("_e"), F.min("_x").alias("_a"), F.max("_x").alias("_z"))
    low = [F.when((F.col("_n") <= accuracy) | F.lit(s <= edge), F.col("_a")).otherwise(F.col("_e")[i]) for i, s in enumerate(shares)]
    high = [F.when((F.col("_n") <= accuracy) | F.lit(s >= 1 - edge), F.col("_z")).otherwise(F.col("_e")[k + i]) for i, s in enumerate(shares)]
    near = near.select(*(F.col(c).alias(f"{c}_") for c in keys), "_n", F.array(*low).alias("_low"), F.array(*high).alias("_high"))
    joined = rows.join(near, same(rows, near, keys)) if keys else rows.join(F.broadcast(near), F.lit(True))  # a row a key
    below = joined.groupBy(*keys, "_n").agg(F.array(*(F.count_if(F.col("_x") < F.col("_low")[i]) for i in range(k))).alias("_below"))
    inside = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.col("_x") >= F.get("_low", i)) & (F.col("_x") <= F.get("_high", i)))
    some = joined.withColumn("_s", F.explode(inside)).groupBy(*keys, "_s", "_x").agg(F.count("*").alias("_c"))
    below = below.select(*(F.col(c).alias(f"{c}_") for c in keys), "_n", "_below")
    some = some.join(below, same(some, below, keys)) if keys else some.join(F.broadcast(below), F.lit(True))
    some = some.withColumn("_upto", F.get("_below", F.col("_s")) + F.sum("_c").over(Window.partitionBy(*keys, "_s").orderBy("_x")))
    at = (F.col("_n") - 1) * F.element_at(F.array(*map(F.lit, shares)), F.col("_s") + 1)
    a, b = (F.min(F.when(F.col("_upto") > f(at), F.col("_x"))) for f in (F.floor, F.ceil))
    found = some.groupBy(*keys, "_s", "_n").agg(a.alias("_a"), b.alias("_b")).select(*keys, F.struct("_s", (F.col("_a") + (at - F.floor(at)) * (F.col("_b") - F.col("_a"))).alias("_v")).alias("_p"))
    return found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["_v"]).alias("_q"))  # a value a share


def exact_quantile(df: DataFrame, x: str, share: float, keys: Sequence[str] = KEYS, accuracy: int = 10_000, most: int = 1_000_000) -> DataFrame:
    """(key, _q): one of ``exact_quantiles``."""
    out = exact_quantiles(df, F.col(x), [share], keys, accuracy, most)
    return out.select(*keys, F.col("_q")[0].alias("_q"))


def full(value: Callable, x: Column, w: WindowSpec, size: int, least: int | None = None) -> Column:
    """An aggregate over the last ``size`` rows, null unless ``least`` (default all) of them have a value."""
    rows = w.rowsBetween(-(size - 1), 0)
    return F.when(F.count(x).over(rows) >= (least or size), value(x).over(rows))
