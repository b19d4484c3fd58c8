"""Combinatorially symmetric cross-validation and the probability of backtest overfitting.

Means over a choice of blocks follow from each block's sum and count, so the return matrix is aggregated once, to blocks
times strategies, and the combinations work on that.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.frames import numbered, same, with_average_rank
from tidemill.functions import normal
from tidemill.operators.cv import block_of
from tidemill.storage import saved

EPS = 1e-8


def combos_table(spark, blocks: int, most: int | None = None) -> DataFrame:
    """(combo, name, block, train): a row for each block of each choice of half the blocks."""
    rows = [(k, str(c), b, b in c) for k, c in enumerate(islice(combinations(range(blocks), blocks // 2), most)) for b in range(blocks)]
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.bool_())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return spark.createDataFrame(pa.table(columns, ["combo", "name", "block", "train"]))


def cscv(m: DataFrame, n: int | None = None, blocks: int = 8, drop_remainder: bool = False, most: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(key, combo, name, best_IS, perf_IS, perf_OOS, relative_rank_OOS, logit) from (key, row_idx, strategy, ret) with
    ``n`` rows a key (else counted for each): per combination the best strategy by mean in its training blocks (the first by name of equals) and
    how its mean in the others ranks (descending, equals share their average)."""
    if n is None:
        size = m.groupBy(*keys).agg((F.max("row_idx") + 1).alias("_rows"))
        m, rows = (m.join(size, [*keys]) if keys else m.join(F.broadcast(size), F.lit(True))), F.col("_rows")  # one row without keys
    else:
        rows = F.lit(n)
    used = rows - rows % blocks if drop_remainder else rows
    parts = m.filter(F.col("row_idx") < used).withColumn("block", block_of(F.col("row_idx"), used, blocks))
    parts = parts.groupBy(*keys, "strategy", "block").agg(F.sum("ret").alias("_s"), F.count("ret").alias("_n"))
    x = parts.join(F.broadcast(combos_table(m.sparkSession, blocks, most)), "block")  # combinations x blocks rows
    of = lambda c, side: F.sum(F.when(F.col("train") == side, F.col(c)))
    x = x.groupBy(*keys, "combo", "name", "strategy").agg((of("_s", True) / of("_n", True)).alias("perf_IS"), (of("_s", False) / of("_n", False)).alias("perf_OOS"))
    w = Window.partitionBy(*keys, "combo")
    down = w.orderBy(F.desc("perf_OOS"))
    same = F.count("*").over(Window.partitionBy(*keys, "combo", "perf_OOS"))
    x = x.withColumns({"_rank": F.rank().over(down) + (same - 1) / 2, "_k": F.count("*").over(w), "_first": F.row_number().over(w.orderBy(F.desc("perf_IS"), "strategy"))})
    x = x.filter("_first = 1").withColumn("relative_rank_OOS", F.least(F.greatest(F.col("_rank") / (F.col("_k") + 1), F.lit(EPS)), F.lit(1 - EPS)))
    logit = F.ln(F.col("relative_rank_OOS") / (1 - F.col("relative_rank_OOS")))
    return x.select(*keys, "combo", "name", F.col("strategy").alias("best_IS"), "perf_IS", "perf_OOS", "relative_rank_OOS", logit.alias("logit"))


def overfitting(results: DataFrame, keys: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """(key, PBO, perf_degradation, prob_loss, ks_stat, ks_pval): the share of relative ranks above one half, the rank
    correlation of performance in and out of sample, the share of losses, and the distance of the relative ranks from a
    seeded uniform sample of as many, drawn by a hash of the seed and the combination.

    Ranks come from rows sorted by ranges, so that no key is one task's work."""
    results = saved(results)
    x = with_average_rank(with_average_rank(results, "perf_IS", "_a", keys), "perf_OOS", "_b", keys)
    share = lambda c: F.avg(c.cast("double"))
    out = x.groupBy(*keys).agg(share(F.col("relative_rank_OOS") > 0.5).alias("PBO"), F.corr("_a", "_b").alias("perf_degradation"), share(F.col("perf_OOS") < 0).alias("prob_loss"), F.count("*").alias("_n"))
    # a number in [0, 1) from the first 52 bits of a hash, the same however the rows are dealt
    uniform = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "combo")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    both = results.select(*keys, F.explode(F.array(F.struct(F.col("relative_rank_OOS").alias("v"), F.lit(1).alias("own")), F.struct(uniform.alias("v"), F.lit(0).alias("own")))).alias("x")).select(*keys, "x.*")
    # the distance is greatest at a rank, or right before one: how many of either sample are below it, and up to it
    place = lambda rows, below, upto: numbered(rows, ["v"], keys).groupBy(*keys, "v").agg(F.min("_n").alias(below), (F.max("_n") + 1).alias(upto))
    own = place(both.filter("own = 1").select(*keys, "v"), "_below", "_upto")
    own = own.select(*(F.col(c).alias(f"{c}_") for c in (*keys, "v")), "_below", "_upto")
    merged = place(both.select(*keys, "v"), "_all_below", "_all_upto")
    met = merged.join(own, same(merged, own, (*keys, "v")))
    far = F.greatest(2 * F.col("_upto") - F.col("_all_upto"), F.col("_all_below") - 2 * F.col("_below"), F.lit(0))
    ks = met.groupBy(*keys).agg(F.max(far).alias("_far"))
    ks = ks.select(*(F.col(k).alias(f"{k}_") for k in keys), "_far")
    out = out.join(ks, same(out, ks, keys)) if keys else out.join(F.broadcast(ks), F.lit(True))  # a row each
    stat = F.col("_far") / F.col("_n")
    return out.withColumns({"ks_stat": stat, "ks_pval": normal.kolmogorov_p(stat, F.col("_n"))}).drop("_n", "_far", *(f"{k}_" for k in keys))
