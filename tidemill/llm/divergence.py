"""Source divergence audit: how the term frequencies of the sources of a language differ, in whole numbers.

The distance of two groups sums f over all kept terms, most of which either group lacks. A term that many groups have is
heavy: its counts form a dense tile of groups by terms. A rare one is a list of postings: all pairs of groups start from the
value of a term that neither has, a posting corrects its group's pairs, and two postings of one term correct their pair.
Both sums are whole numbers, so they add up exactly whatever their order. A task holds one tile: two blocks of groups and
one bucket of terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import ROOT, map_arrow, saved, small, written

#: Groups in a block and terms in a bucket: what a tile holds of either.
GROUPS, TERMS = 64, 1024
#: A term is heavy if at least one in so many groups of its language has it.
HEAVY = 3
#: Counts that a task gathers before it passes them on.
ENTRIES = 400_000
UNIT = 1_000_000_000
#: Bytes of terms to themselves (A-Z in lower case), all others to a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) from (lang, source, text), summed over as many rows as fit ``ENTRIES``; a row with a null
    term tells of a group."""
    names = ["lang", "source", "term", "n", "docs"]
    found: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms = [None, *n]
            columns = (pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns), names)

    for b in batches:
        texts = b.column(2).cast(pa.binary())
        for lang, source, text in zip(*(c.to_pylist() for c in (*b.columns[:2], texts)), strict=True):
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            terms, before = text.translate(LETTERS).split(), len(n)
            n.update(terms)
            docs.update(set(terms))
            size += len(n) - before
            if size >= ENTRIES:
                yield from out()
                found, size = {}, 0
    yield from out()


def share(count: np.ndarray, of: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * count / of), digit group by digit group, so that no product leaves 64 bits below counts of 9e15."""
    whole, rest = np.zeros_like(count), count
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // of, rest % of
    return whole + 1


def share_sql(count: str, of: str) -> Column:
    """As ``share``, of columns."""
    whole, rest = "0L", count
    for _ in range(3):
        whole, rest = f"({whole} * 1000 + ({rest} * 1000) div {of})", f"(({rest} * 1000) % {of})"
    return F.expr(f"{whole} + 1")


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def tile(groups: pd.DataFrame, rows: pd.DataFrame, i: int, j: int, block: int) -> pd.DataFrame:
    """(a, b, value) for each group of block ``i`` against each of block ``j``: what the terms of ``rows`` (g, term, n, heavy) add
    to the value that all terms would have if no group had any. ``groups`` are (g, n, terms) of both blocks."""
    sides, p0, at = [], [], []
    for k in (i, j):
        own = groups[groups.g // block == k].sort_values("g")
        sides.append(own)
        p0.append(share(np.full(len(own), 2), own.size_.to_numpy()))
        at.append({g: x for x, g in enumerate(own.g)})
    base = f(p0[0][:, None], p0[1][None, :])
    out = np.zeros_like(base)
    code = pd.factorize(rows.term)[0]
    post = []
    for k, own in enumerate((i, j)):
        mine = (rows.g // block == own).to_numpy()
        g = rows.g[mine].map(at[k]).to_numpy(np.int64)
        post.append((g, code[mine], rows.n[mine].to_numpy(np.int64), rows.heavy[mine].to_numpy(bool)))
    # heavy terms: dense tiles, one group of the first block against all of the second
    heavy = np.unique(np.concatenate([t[h] for _, t, _, h in post]))
    if len(heavy):
        dense = []
        for (g, t, n, h), own in zip(post, sides, strict=True):
            counts = np.full((len(own), len(heavy)), 2)
            counts[g[h], np.searchsorted(heavy, t[h])] += n[h]
            dense.append(share(counts, own.size_.to_numpy()[:, None]))
        for x, p in enumerate(dense[0]):
            out[x] += f(p[None, :], dense[1]).sum(1) - len(heavy) * base[x]
    # rare terms: a posting against all groups as if they lacked the term, then each two postings of one term
    light = []
    for (g, t, n, h), own in zip(post, sides, strict=True):
        g, t, n = g[~h], t[~h], n[~h]
        order = np.argsort(t, kind="stable")
        light.append((g[order], t[order], share(n[order] + 2, own.size_.to_numpy()[g[order]])))
    for k, (g, _, p) in enumerate(light):
        (gs, ps), times = np.unique(np.stack([g, p]), axis=1, return_counts=True) if len(g) else ((g, p), g)
        for lo in range(0, len(gs), 8192):
            x, y, n = gs[lo : lo + 8192], ps[lo : lo + 8192], times[lo : lo + 8192, None]
            if k:
                np.add.at(out.T, x, n * (f(y[:, None], p0[0][None, :]) - base.T[x]))
            else:
                np.add.at(out, x, n * (f(y[:, None], p0[1][None, :]) - base[x]))
    (ga, ta, pa_), (gb, tb, pb) = light
    first, last = np.searchsorted(tb, ta, "left"), np.searchsorted(tb, ta, "right")
    for lo in range(0, len(ta), 8192):
        width = (last - first)[lo : lo + 8192]
        x = np.repeat(np.arange(lo, lo + len(width)), width)
        y = np.arange(len(x)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[lo : lo + 8192], width)
        g, h = ga[x], gb[y]
        np.add.at(out, (g, h), f(pa_[x], pb[y]) - f(pa_[x], p0[1][h]) - f(p0[0][g], pb[y]) + base[g, h])
    a, b = np.meshgrid(sides[0].g, sides[1].g, indexing="ij")
    return pd.DataFrame({"a": a.ravel(), "b": b.ravel(), "value": out.ravel(), "base": base.ravel()})


def _tiles(block: int):
    root = ROOT

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        from tidemill.llm.divergence import tile

        lang, i, j, k = key
        told = rows.term.isna()
        out = tile(rows[told], rows[~told], i, j, block)
        if k == 0:  # what all terms have in common is added once a pair of blocks
            out.value += int(rows.terms.iloc[0]) * out.base
        return out[out.a < out.b].assign(lang=lang)[["lang", "a", "b", "value"]]

    return run


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10, top: int = 10, block: int = GROUPS, bucket: int = TERMS, heavy: int = HEAVY) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each group (lang, source) is from the other sources of its language
    (part ``pair``, all of them), and the ``top`` terms that it has oftener than its language (part ``term``).

    Terms are runs of letters and of characters beyond ASCII, A-Z in lower case; a language keeps those of at least ``least``
    of its documents. Shares of terms are whole billionths, smoothed by two. Null texts, languages and sources count as empty
    ones; an empty text makes its group occur, and a row is a document, repeated or not. A language that keeps no term has
    pairs of value zero and no terms; equal values go by the bytes of the item. Other columns are not read, whatever their
    names. An empty table gives an empty one. Counts must stay below 9e15. A tile holds ``block`` by ``block`` groups and about
    ``bucket`` terms, of which those are heavy that at least one in ``heavy`` groups has; none of these changes a result.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    counts = map_arrow(rows, __name__, "count_batches", "lang string, source string, term string, n long, docs long")
    counts = written(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), F.count("*").alias("spread"))
    terms = saved(terms.filter(F.col("docs") >= least).drop("docs"))
    kept = saved(counts.select("lang", "source", "term", "n").join(small(terms), ["lang", "term"]))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.filter("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("group_n", "terms", "lang_n")))
    groups = groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    last = F.max("g").over(Window.partitionBy("lang"))
    groups = saved(groups.withColumns({"groups": last + 1, "blocks": F.floor(last / block).cast("int") + 1, "size_": F.col("group_n") + 2 * F.col("terms"), "lang_size": F.col("lang_n") + 2 * F.col("terms")}))
    few = small(groups)

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = kept.join(few, ["lang", "source"]).withColumns({"p": share_sql("(n + 2)", "size_"), "q": share_sql("(all_n + 2)", "lang_size")}).filter("p > q")
    told = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    told = told.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)

    dense = F.col("spread") * heavy >= F.col("groups")
    many = few.withColumn("buckets", F.ceil(F.greatest("terms", F.lit(1)) / bucket).cast("int"))
    posts = kept.join(many, ["lang", "source"]).select("lang", "g", "blocks", "size_", "terms", "term", "n", dense.alias("heavy"), F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("k"))
    named = many.filter("terms > 0").select("lang", "g", "blocks", "size_", "terms", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("heavy"), F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("k"))
    dealt = posts.unionByName(named).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("y", F.floor(F.col("g") / block).cast("int"))
    dealt = dealt.select("lang", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "k", "g", "size_", "terms", "term", "n", "heavy")
    found = dealt.groupBy("lang", "i", "j", "k").applyInPandas(_tiles(block), "lang string, a long, b long, value long")
    found = saved(found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    # a language without terms has tiles without rows: its pairs are zero
    bare = few.filter("terms = 0").select("lang", F.col("g").cast("long").alias("a"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("b"), F.lit(0).cast("long").alias("value"))
    bare = bare.select("lang", "a", F.col("b").cast("long"), "value").filter("a < b")
    found = found.unionByName(bare)
    found = found.unionByName(found.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda side, alias: small(groups).select("lang", F.col("g").cast("long").alias(side), F.col("source").alias(alias))
    pairs = found.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(told)
