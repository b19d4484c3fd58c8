"""Line dedup by pairwise alignment.

Documents overlap where they share a run of lines with enough words for a block (mostly a single line; short lines need
their neighbours). Each such run is known by its hash, and a document's partners are the first documents that have its
shared runs, as often as it has them, so a line in a million documents makes a million pairs, not a million squared.
Partners are met in the order of the rarest run that led to them, and one whose runs have all gone by then is not met.

A document and its partner are aligned whole, by patience diff over all lines of the runs that both have, whoever else has
them: lines that occur once in either anchor the longest increasing chain (rare ones first), what is equal before and
behind an anchor follows, and gaps between anchors are aligned in the same way; in a gap without such lines the
occurrences of a line count one by one. What this order leaves out (blocks that were moved) is aligned in further orders.
Aligned lines that go on in both documents are a block, and blocks of enough words are deleted from the later document.
Nothing else is.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import ROOT, map_arrow, saved


#: A line that isn't blank as Python's strip() sees it.
FILLED = r"(?U)[^\s\x1c-\x1f]"


def line_hash(line: str, seed: int = 7) -> int:
    return xxhash.xxh64_intdigest(line.encode(), seed) - (1 << 63)


def run_hash(hashes: list[int]) -> int:
    """Of several lines, from theirs; of one its own."""
    return hashes[0] if len(hashes) == 1 else xxhash.xxh64_intdigest(struct.pack(f"<{len(hashes)}q", *hashes), 7) - (1 << 63)


def windows(words: list[int], least: int) -> set[tuple[int, int]]:
    """(first, last) of the shortest runs of lines of ``least`` words or more from each line on and up to each line, and
    of all lines. Every line of a block of so many words is in one that lies within the block."""
    out, first, total = set(), 0, 0
    for last, n in enumerate(words):
        total += n
        while total - words[first] >= least:
            total -= words[first]
            first += 1
        if total >= least:
            out.add((first, last))
    last, total = len(words) - 1, 0
    for first in range(len(words) - 1, -1, -1):
        total += words[first]
        while total - words[last] >= least:
            total -= words[last]
            last -= 1
        if total >= least:
            out.add((first, last))
    if sum(words) >= least:
        out.add((0, len(words) - 1))
    return out


def line_batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """A row for each window of each text, blank lines aside: its hashes (two, 128 bits in all), how often it occurred before, its
    place, and its lines' words and, if several, hashes."""
    for b in batches:
        rows, hashes, checks, before, places, words, inner = [], [], [], [], [], [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            lines = [x for x in map(str.strip, (text or "").split("\n")) if x]
            hs, gs, ws, seen = [line_hash(x) for x in lines], [line_hash(x, 8) for x in lines], [len(x.split()) for x in lines], Counter()
            for x, y in sorted(windows(ws, least)):
                h, g = run_hash(hs[x : y + 1]), run_hash(gs[x : y + 1])
                rows.append(i)
                hashes.append(h)
                checks.append(g)
                before.append(seen[h, g])
                places.append(x)
                words.append(ws[x : y + 1])
                inner.append(hs[x : y + 1] if y > x else None)
                seen[h, g] += 1
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, (hashes, checks, before, places, words, inner), kinds)], ["id", "h", "g", "k", "at", "words", "inner"])


def chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of ``pairs``, in order of the first, that also rises in the second."""
    tops, ends, before = [], [], []
    for k, (_, y) in enumerate(pairs):
        i = bisect_left(tops, y)
        before.append(ends[i - 1] if i else -1)
        if i == len(tops):
            tops.append(y)
            ends.append(k)
        else:
            tops[i], ends[i] = y, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def numbered(lines: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """(line, how often it occurred before) -> place in the list."""
    seen: Counter = Counter()
    out = {}
    for p, (_, x) in enumerate(lines):
        out[x, seen[x]] = p
        seen[x] += 1
    return out


def patience(a: list[tuple[int, int]], b: list[tuple[int, int]], rare: frozenset | set = frozenset()) -> list[tuple[int, int]]:
    """Places aligned between two lists of (place, line), rising in both. Anchors among ``rare`` lines are tried first."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, n = todo.pop()
        while i < j and k < n and a[i][1] == b[k][1]:
            out.append((a[i][0], b[k][0]))
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1][1] == b[n - 1][1]:
            j, n = j - 1, n - 1
            out.append((a[j][0], b[n][0]))
        if i == j or k == n:
            continue
        ca, cb = Counter(x for _, x in a[i:j]), Counter(x for _, x in b[k:n])
        once = {x for x, c in ca.items() if c == 1 and cb.get(x) == 1}
        once = once & rare or once
        if once:
            where = {x: p for p, (_, x) in enumerate(b[k:n], k) if x in once}
            anchors = chain([(p, where[x]) for p, (_, x) in enumerate(a[i:j], i) if x in once])
        else:
            there = numbered(b[k:n])
            anchors = chain(sorted((i + p, k + there[x]) for x, p in numbered(a[i:j]).items() if x in there))
        if not anchors:
            continue
        for (p, q), (r, s) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, n)], strict=True):
            if r < j:
                out.append((a[r][0], b[s][0]))
            todo.append((p + 1, r, q + 1, s))
    return sorted(out)


def runs(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, last) place of each run of ``pairs`` that goes on by one line in both."""
    out: list[tuple[int, int]] = []
    for k, (p, q) in enumerate(pairs):
        if k and (p, q) == (pairs[k - 1][0] + 1, pairs[k - 1][1] + 1):
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


def aligned(a: list[tuple[int, int]], b: list[tuple[int, int]], rare: frozenset | set = frozenset()) -> list[tuple[int, int]]:
    """Runs (first, last) of places of ``a`` that go on in ``b`` too: of the patience diff of both, and of what it leaves out.
    The rest is paired by line and occurrence; in how many further rising orders such pairs fit makes no difference to their
    runs, as each order of all keeps a run together. A place counts once on either side."""
    first = patience(a, b, rare)
    gone, there = {p for p, _ in first}, {q for _, q in first}
    left, right = [x for x in a if x[0] not in gone], [x for x in b if x[0] not in there]
    at = numbered(right)
    rest = sorted((left[p][0], right[at[x]][0]) for x, p in numbered(left).items() if x in at)
    return runs(first) + runs(rest)


def pair_blocks(rows: list[tuple[int, list[int], list[int], int, int]], least: int, few: int) -> list[tuple[int, int]]:
    """The blocks (first, last) of ``least`` words or more that a document has in common with a partner, from the runs of lines
    that both have: (place, words of the lines, hashes of the lines, place in the partner, documents that have it)."""
    a, b, words, shared = {}, {}, {}, {}
    for at, ws, hs, there, n in rows:
        for k, (w, h) in enumerate(zip(ws, hs, strict=True)):
            a[at + k], words[at + k], b[there + k] = h, w, h
            shared[h] = min(n, shared.get(h, n))
    rare = {h for h, n in shared.items() if n <= few}
    return [(x, y) for x, y in aligned(sorted(a.items()), sorted(b.items()), rare) if sum(words[p] for p in range(x, y + 1)) >= least]


def document_blocks(rows: list[tuple[int, int, int, list[int], list[int], int, int]], least: int, few: int) -> list[tuple[int, int, int]]:
    """(first, last, partner) of the blocks to delete, each line in one at most, from (partner, first document of the run, *as
    for pair_blocks*) of all partners."""
    of, found, gone = defaultdict(list), [], set()
    for partner, owner, *row in rows:
        of[partner].append((owner, *row))
    for partner, own in sorted(of.items(), key=lambda x: (min(r[-1] for r in x[1] if r[0] == x[0]), x[0])):
        led = (range(at, at + len(ws)) for owner, at, ws, *_ in own if owner == partner)
        if not all(gone.issuperset(places) for places in led):
            for x, y in pair_blocks([r[1:] for r in own], least, few):
                found.append((x, y, partner))
                gone.update(range(x, y + 1))
    out, end = [], -1
    for x, y, partner in sorted(found, key=lambda c: (c[0], -c[1], c[2])):
        if y > end:
            out.append((max(x, end + 1), y, partner))
            end = y
    return out


def block_batches(batches: Iterator[pa.RecordBatch], least: int, few: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [document_blocks([(x["partner"], x["owner"], x["at"], x["words"], x["inner"] or [x["h"]], x["there"], x["n"]) for x in row], least, few) for row in b.column(1).to_pylist()]
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("owner", b.column(1).type.value_type.field("owner").type)]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[dict(zip(("first", "last", "owner"), x, strict=True)) for x in r] for r in out], kind)], ["id", "cuts"])


def cut(text: str | None, cuts: list[tuple[int, int]]) -> str | None:
    """``text`` without the lines at those places, counted without blank lines; blank lines within a block go too."""
    if text is None or not len(cuts):
        return text
    out, k, c, pending = [], 0, 0, []
    for line in text.split("\n"):
        if not line.strip():
            if not (c < len(cuts) and cuts[c][0] < k <= cuts[c][1]):
                out.append(line)
            continue
        while c < len(cuts) and cuts[c][1] < k:
            c += 1
        if not (c < len(cuts) and cuts[c][0] <= k <= cuts[c][1]):
            out.append(line)
        k += 1
    return "\n".join(out)


def _cut_udf():
    root = ROOT

    def run(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        from tidemill.llm.line_dedup import cut

        return pd.Series([cut(t, [] if c is None else [(x["first"], x["last"]) for x in c]) for t, c in zip(texts, cuts, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")


def find_blocks(df: DataFrame, key: str, text: str, least: int = 5, few: int = 8) -> DataFrame:
    """(id, cuts): for each document with something to delete, the blocks (first, last, owner) of its lines, counted
    without blank ones, and the earlier document that it was aligned with. A block needs ``least`` words in all; lines that
    ``few`` documents or fewer share are rare.

    Rows without a key or a text take no part. Rows that repeat a key are one document to each other and give a row each.
    Documents without a shared run give none, so an empty table gives an empty one. Other columns are not read.
    """
    kind = dict(df.dtypes)[key]
    lines = df.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    lines = saved(map_arrow(lines, __name__, "line_batches", f"id {kind}, h long, g long, k int, at int, words array<int>, inner array<long>", least=least))
    run = ["h", "g", "k"]
    shared = saved(lines.groupBy(run).agg(F.count("*").alias("n"), F.min("id").alias("owner")).filter("n > 1"))
    met = saved(lines.join(shared, run))
    pairs = met.filter("id <> owner").select("id", F.col("owner").alias("partner")).distinct()
    # all runs of a document that a partner may have: none that it would have been the first to have, had it any
    asked = met.join(pairs, "id").filter("owner <= partner")
    held = saved(met.groupBy("id", *run).agg(F.min("at").alias("there"))).withColumnRenamed("id", "partner")  # a join of saved tables can be split where a key is hot
    both = asked.join(held, ["partner", *run])
    per = both.groupBy("id").agg(F.collect_list(F.struct("partner", "owner", "h", "at", "words", "inner", "there", "n")).alias("lines"))
    cuts = map_arrow(per, __name__, "block_batches", f"id {kind}, cuts array<struct<first: int, last: int, owner: {kind}>>", least=least, few=few)
    return cuts.filter(F.size("cuts") > 0)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df``."""
    while name.lower() in map(str.lower, df.columns):
        name = "_" + name
    return name


def dedup(df: DataFrame, key: str, text: str, least: int = 5, few: int = 8, names: Sequence[str] = ("n_lines", "n_removed", "blocks")) -> DataFrame:
    """``df`` with its text cut, and three columns of ``names`` besides: lines that aren't blank, how many of them went, and in
    how many blocks. Columns of ``df`` that have these names are replaced.

    The first document by key keeps a line; later ones lose it where it aligns. Null texts stay null, and a document all
    of whose lines went has an empty text; rows without a key stay as they are, as do lines that a document has oftener than
    the earlier one, and runs of short lines that the alignment breaks up into less than ``least`` words.
    Rows that repeat a key are one document to each other: they lose nothing to each other. An empty table stays empty.
    """
    cuts = find_blocks(df, key, text, least, few)
    own, found = (fresh(df, x) for x in ("cut_id", "cuts"))
    cuts = cuts.select(F.col("id").alias(own), F.col("cuts").alias(found))
    out = df.join(cuts, F.col(key) == F.col(own), "left")
    filled = F.size(F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(FILLED)))
    out = out.withColumn(names[0], F.coalesce(filled, F.lit(0)).cast("long"))
    gone = F.aggregate(F.coalesce(found, F.array()), F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    out = out.withColumn(names[1], gone).withColumn(names[2], F.coalesce(F.size(found), F.lit(0)).cast("long"))
    return out.withColumn(text, _cut_udf()(F.col(text), F.col(found))).drop(own, found)
