"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has bit i set if over half of its shingles' hashes have. Two fingerprints at 3 or fewer differing
bits differ by at most one bit in one of their two halves. So each half is a table; a fingerprint looks up its half and
all halves one bit away (from the one whose bit is 0, so each pair meets once), and the whole distance is verified.

Equal fingerprints are one row from the start, so copies cost nothing. A half that more than ``crowd`` different
fingerprints share is not paired off: its members are dealt anew by every choice of 5 of the other half's 8 nibbles, of
which a pair within 3 bits shares at least one; such a group has at most 4096 different fingerprints in the table, and it
returns a spanning forest of its links. Components over all links are then found in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import components, map_arrow, saved

CHUNK = 1 << 16
MASKS = [sum(15 << 4 * n for n in c) for c in combinations(range(8), 5)]


def fingerprint(data: bytes, width: int = 3) -> int:
    """The fingerprint of UTF-8 bytes, A-Z lower-cased: 0 without a word; with fewer words than ``width``, of all of them."""
    words = data.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    total = np.zeros(64, np.int64)
    for lo in range(0, n, CHUNK):
        part = words[lo : lo + CHUNK + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def print_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = np.array([fingerprint(x or b"", width) for x in b.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["id", "fp"])


def fingerprints(df: DataFrame, key: str, text: str, width: int = 3) -> DataFrame:
    """(id, fp) of every row, fp as a signed long. A null text counts as one without words."""
    rows = df.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("data"))
    return map_arrow(rows, __name__, "print_batches", f"id {dict(df.dtypes)[key]}, fp long", width=width)


def half(fp: Column, seg: int) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF)) if seg else F.shiftrightunsigned(fp, 32)


def forest_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links of crowded groups: of all pairs within ``bits`` of which one at least is in the table, a spanning forest."""
    for b in batches:
        us, vs = [], []
        for fps, flips in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            f = np.array(fps, np.int64).view(np.uint64)
            own = ~np.array(flips, bool)
            nodes, at = np.unique(f, return_inverse=True)
            root = list(range(len(nodes)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for t in np.unique(at[own]):
                for o in np.nonzero(np.bitwise_count(nodes ^ nodes[t]) <= bits)[0]:
                    x, y = find(int(t)), find(int(o))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        us.append(nodes[t])
                        vs.append(nodes[o])
        pair = (np.array(x, np.uint64).view(np.int64) for x in (us, vs))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], ["src", "dst"])


def links(prints: DataFrame, bits: int = 3, crowd: int = 64) -> DataFrame:
    """(src, dst): links between the different fingerprints of ``prints`` (column fp, each once) that connect whatever is
    within ``bits`` (3 at most) of each other."""
    if bits > 3:
        raise ValueError("two halves with balls of radius 1 find 3 differing bits at most")
    fp, sides = F.col("fp"), (0, 1)
    table = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), half(fp, s).alias("key")) for s in sides))).alias("x")).select("x.*", "fp")
    hot = saved(table.groupBy("seg", "key").count().filter(F.col("count") > crowd).select("seg", "key", F.lit(True).alias("hot")))
    cold = table.join(hot, ["seg", "key"], "left").filter("hot is null").select("seg", "key", F.col("fp").alias("other"), F.lit(False).alias("hot"))
    index = cold.unionByName(hot.select("seg", "key", F.lit(None).cast("long").alias("other"), "hot"))
    ball = lambda s: F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: half(fp, s).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))), lambda k: k != half(fp, s))
    probe = lambda s, keys, flip: F.transform(keys, lambda k: F.struct(F.lit(s).alias("seg"), k.alias("key"), F.lit(flip).alias("flip")))
    probes = F.concat(*(p for s in sides for p in (probe(s, F.array(half(fp, s)), False), probe(s, ball(s), True))))
    probes = prints.select("fp", F.explode(probes).alias("x")).select("x.*", "fp")
    near = F.col("hot") | (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= bits) & (F.col("flip") | (F.col("fp") < F.col("other")))
    p, i = probes.alias("p"), index.alias("i")
    met = p.join(i, (F.col("p.seg") == F.col("i.seg")) & (F.col("p.key") == F.col("i.key")) & near)
    met = saved(met.select("p.seg", "p.key", "fp", "flip", "other", "hot"))
    plain = met.filter("not hot").select(F.col("fp").alias("src"), F.col("other").alias("dst"))

    rest = F.when(F.col("seg") == 0, half(fp, 1)).otherwise(half(fp, 0))
    keys = F.array(*(F.struct(F.lit(m).alias("mask"), rest.bitwiseAND(F.lit(m)).alias("part")) for m in MASKS))
    dealt = met.filter("hot").select("seg", "key", "fp", "flip", F.explode(keys).alias("k"))
    groups = dealt.groupBy("seg", "key", "k").agg(F.collect_list("fp").alias("fps"), F.collect_list("flip").alias("flips"))
    groups = groups.filter((F.size("fps") > 1) & ~F.forall("flips", lambda x: x)).select("fps", "flips")
    crowded = map_arrow(groups, __name__, "forest_batches", "src long, dst long", bits=bits)
    return plain.unionByName(crowded)


def near_duplicates(df: DataFrame, key: str, text: str, width: int = 3, bits: int = 3) -> DataFrame:
    """(key, fingerprint, component_id) of every row: 16 lowercase hex digits, and the smallest key reachable by links.

    Null and empty texts, and those of white space, have fingerprint zero and are linked like any other; rows with equal
    texts, and repeated rows, share a component; a null key is never a component's id unless it has no other. Texts are
    hashed whole. An empty table gives an empty one; other columns are not read.
    """
    prints = saved(fingerprints(df, key, text, width))
    groups = saved(prints.groupBy("fp").agg(F.min("id").alias("first")))
    found = saved(components(links(groups.select("fp"), bits)))
    named = groups.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = saved(named)
    least = saved(named.groupBy("root").agg(F.min("first").alias("component_id")))
    named = saved(named.join(least, "root").select("fp", "component_id"))
    out = prints.join(named, "fp")
    return out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
