"""Byte-level BPE encoding and decoding by the tokenizers library, from a file of ranks.

A rank file tells which byte strings are tokens, not which pairs made them, so every cut of a token into two tokens
becomes a merge, ordered by the token's rank. Bytes go through the byte-to-character table on the way in; decoding joins
the tokens' characters and takes them back through the reversed table, so characters split between tokens come out whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Memo, map_arrow
from tidemill.llm.token_counts import byte_letters, is_latin, latin_pattern


class Codec:
    """Text to ids and back, as tiktoken's ``encode_ordinary`` and ``decode_bytes`` have them."""

    def __init__(self, path: str, pattern: str, most: int = 330_000):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        letters = byte_letters()
        name = lambda t: "".join(map(letters.__getitem__, t))
        self.names = [""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.names[rank] = name(token)
        self.lengths, self.back = np.array([len(x) for x in self.names], np.int64), {ord(c): b for b, c in letters.items()}
        merges = [(name(t[:i]), name(t[i:])) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.library = Tokenizer(models.BPE({name(t): r for t, r in ranks.items()}, merges))
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.letters, self.latin = letters, latin_pattern(pattern)
        self.pieces = Memo(self.piece, most)
        self.words = Memo(self.word, most // 8)

    def piece(self, text: str) -> bytes:
        """Ids of one match of the pattern: its bytes as characters, through the library's model."""
        ids = [t.id for t in self.library.model.tokenize("".join(map(self.letters.__getitem__, text.encode())))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """As in token_counts: a cut before a space holds only if no other white space is beside it."""
        if not word or word[0].isspace() or word[-1].isspace():
            raise KeyError(word)
        return self.whole(" " + word)

    def encode(self, text: str) -> bytes:
        if self.latin and is_latin(text):
            return b"".join(map(self.pieces.__getitem__, self.latin.findall(text)))
        head, *words = text.split(" ")
        if words and head and not head[-1].isspace():
            try:
                return self.whole(head) + b"".join(map(self.words.__getitem__, words))
            except KeyError:
                pass
        return self.whole(text)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of tokens: their characters, through the reversed byte table."""
        return "".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist())).translate(self.back).encode("latin-1")

    def offsets(self, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The first character of each token of a text's UTF-8 ``data``, and the one after its last; a character split between
        tokens belongs to each of them."""
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        at = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # which character a byte belongs to, from 1
        return at[np.r_[0, ends[:-1]].astype(np.int64)[: len(ends)]] - 1, at[ends - 1]


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def digest_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    c, sha = codec(path, pattern), lambda x: hashlib.sha256(x).hexdigest()
    for b in batches:
        n, made, back, spans = [], [], [], []
        for text in b.column(1).to_pylist():
            ids = c.encode(text or "")
            data = c.decode(ids)
            n.append(len(ids) // 4)
            made.append(sha(ids))
            back.append(sha(data))
            spans.append(sha(np.array(c.offsets(ids, data), "<i8").tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in (made, back, spans))], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256"])


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    c = codec(path, pattern)
    for b in batches:
        texts = [x or "" for x in b.column(1).to_pylist()]
        ids = [c.encode(x) for x in texts]
        spans = [c.offsets(i, x.encode()) for i, x in zip(ids, texts, strict=True)]
        cols = [pa.array(x, pa.list_(pa.int64())) for x in ([np.frombuffer(i, "<u4").astype(np.int64) for i in ids], [s[0] for s in spans], [s[1] for s in spans])]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", "ids", "starts", "ends"])


def decode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    c = codec(path, pattern)
    for b in batches:
        back = [c.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(back, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in back], pa.string())], ["id", "data", "text"])


def _map(df: DataFrame, key: str, column: str, name: str, schema: str, path: str, pattern: str) -> DataFrame:
    rows = df.select(F.col(key).alias("id"), F.col(column).alias("x"))
    return map_arrow(rows, __name__, name, f"id {dict(df.dtypes)[key]}, {schema}", path=path, pattern=pattern).withColumnRenamed("id", key)


def encode(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """(key, ids, starts, ends) of every row: token ids with the characters they cover. Null counts as empty; repeated rows
    are each encoded; other columns, whatever their names, are not read; an empty table gives an empty one."""
    return _map(df, key, text, "encode_batches", "ids array<long>, starts array<long>, ends array<long>", path, pattern)


def decode(df: DataFrame, key: str, ids: str, path: str, pattern: str) -> DataFrame:
    """(key, data, text) of every row of ids: the bytes, and as text with U+FFFD where they are no UTF-8. Null counts as
    empty; repeated rows are each decoded; other columns, whatever their names, are not read; an empty table gives an empty one."""
    return _map(df, key, ids, "decode_batches", "data binary, text string", path, pattern)


def round_trip(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, offsets_sha256) of every row: digests of its ids, of what they decode to, and
    of the tokens' first characters and those after their last (all of either, as little-endian 64-bit integers). Null counts
    as empty; repeated rows are each encoded; other columns, whatever their names, are not read; an empty table gives an
    empty one."""
    return _map(df, key, text, "digest_batches", "n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string", path, pattern)
