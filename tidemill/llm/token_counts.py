"""Token counts: byte-pair merging with a heap and a linked list, without building identifiers.

The lowest-ranked adjacent pair is popped again and again (the leftmost of equals); the count of tokens of a piece is
its bytes less its merges. A stale heap entry is known by the ranks of its two symbols having changed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Memo, map_arrow


def byte_letters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies: itself if it prints, else from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in own else next(spare)) for b in range(256)}


#: What Latin-1 has of the classes that patterns of tokenizers name, as parts of a bracket.
LATIN = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9²³¹¼-¾", r"\s": r"\t-\r \x85\xa0"}


def latin_pattern(pattern: str) -> re.Pattern | None:
    """``pattern`` for texts of Latin-1 characters alone, for the standard library, which is faster; None if it has more than
    these classes, ``\\S``, brackets and plain syntax without groups that capture."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        name = next((n for n in LATIN if pattern.startswith(n, i)), None)
        if name:
            out.append(LATIN[name] if inside else f"[{LATIN[name]}]")
            i += len(name)
            continue
        if pattern.startswith(r"\S", i) and not inside:
            out.append(f"[^{LATIN[chr(92) + 's']}]")
            i += 2
            continue
        c = pattern[i]
        if c == "\\" or c == "(" and not pattern.startswith(("(?!", "(?=", "(?:"), i):
            return None
        inside = c == "[" or inside and c != "]"
        out.append(c)
        i += 1
    return re.compile("".join(out))


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Counter:
    """Counts tokens as the tokenizers library does for a byte-level BPE file, its special strings found in texts."""

    def __init__(self, path: str, pattern: str, most: int = 330_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.start = [vocab[letters[b]] for b in range(256)]
        pairs = (x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"])
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        special = sorted((x["content"] for x in spec.get("added_tokens", []) if x["special"]), key=len, reverse=True)
        self.special = special and regex.compile("|".join(map(regex.escape, special)))
        self.pattern, self.latin = regex.compile(pattern), latin_pattern(pattern)
        self.pieces = Memo(self.piece, most)
        self.words = Memo(self.word, most // 8)
        self.heads = Memo(self.split, most // 32)

    def piece(self, text: str) -> int:
        symbols = [self.start[b] for b in text.encode()]
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1])))]
        heapify(heap)
        count = n
        while heap:
            _, made, i, left, right = heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            count -= 1
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get((made, symbols[k])):
                    heappush(heap, (*r, i, made, symbols[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbols[h], made))):
                heappush(heap, (*r, h, symbols[h], made))
        return count

    def split(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def word(self, word: str) -> int:
        """Of what stands between two spaces, with the space before it. A cut before a space is a cut of the pattern only
        if no white space is beside it: else KeyError."""
        if not word or word[0].isspace() or word[-1].isspace():
            raise KeyError(word)
        return self.split(" " + word)

    def plain(self, text: str) -> int:
        if self.latin and is_latin(text):
            return sum(map(self.pieces.__getitem__, self.latin.findall(text)))
        head, *words = text.split(" ")
        if head and not head[-1].isspace():
            try:
                return self.heads[head] + sum(map(self.words.__getitem__, words))
            except KeyError:
                pass
        return self.split(text)

    def count(self, text: str) -> int:
        if not self.special or not (found := self.special.findall(text)):
            return self.plain(text)
        return len(found) + sum(map(self.plain, filter(None, self.special.split(text))))


@lru_cache(2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def count_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, limit: int) -> Iterator[pa.RecordBatch]:
    c = counter(path, pattern)
    for b in batches:
        texts = [x or "" for x in b.column(1).to_pylist()]
        n = [c.count(x) for x in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(df: DataFrame, key: str, text: str, path: str, pattern: str, limit: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row. Null counts as empty, with no tokens; repeated rows are each
    counted; other columns, whatever their names, are not read; an empty table gives an empty one. Whole texts, of any
    length: a piece of n bytes takes O(n log n)."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return map_arrow(rows, __name__, "count_batches", f"id {dict(df.dtypes)[key]}, n_bytes long, n_tokens long, over_limit boolean", path=path, pattern=pattern, limit=limit).withColumnRenamed("id", key)
