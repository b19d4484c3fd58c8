"""Language identification by a string kernel.

Two texts are alike by the n-grams of one to three bytes that both have (presence, not counts; a blended spectrum), divided
by the root of how many each has. Landmarks, a few texts of each language, span the space (Nyström): a text is what its
kernel values with them say. One ridge regression for each language against the rest is fitted in that space. Texts are
scored in batches: presence by landmarks' n-grams, times the landmarks' presence, times the weights, as matrix products.

Both samples are bounded and drawn by a hash of the ids, in equal shares of each language, so a language with most rows
doesn't crowd out the others. Only n-gram sets and kernel values of sampled texts reach the driver, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import map_arrow

#: Landmarks and texts of the fit, of all languages together, at most (at least one of each language); n-grams of the
#: landmarks that count, those that most of them have first; the ridge.
LANDMARKS, FIT_ROWS, GRAMS, RIDGE = 192, 6_000, 1 << 16, 1e-2
#: Where the n-grams of each length begin among all.
BEGIN = (0, 256, 256 + 65536)
SLOTS = 256 + 65536 + (1 << 24)
#: Bytes of a text that are read at once, and cells of a batch's presence matrix.
PIECE, CELLS = 1 << 21, 1 << 23
UNKNOWN = "und"
#: ASCII beyond letters becomes a space.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(text: str) -> Iterator[np.ndarray]:
    """The numbers of a text's n-grams, piece by piece, with repeats. Words stand between single spaces; case and other ASCII
    than letters don't count."""
    data = b" " + b" ".join(text.lower().encode().translate(LETTERS).split()) + b" "
    for lo in range(0, len(data), PIECE):
        a = np.frombuffer(data[lo : lo + PIECE + 2], np.uint8).astype(np.int32)
        two = a[:-1] * 256 + a[1:]
        yield from (a[:PIECE], BEGIN[1] + two[:PIECE], BEGIN[2] + two[:-1] * 256 + a[2:])


def gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, grams) of rows (lang, text): the numbers of a text's n-grams, each once, in order."""
    for b in batches:
        sets = [np.unique(np.concatenate([np.unique(x) for x in grams(t)])) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int32()))], ["lang", "grams"])


class Landmarks:
    """n-gram sets of texts as a matrix of presence over the ``most`` n-grams that most of them have."""

    def __init__(self, sets: list[np.ndarray], most: int = GRAMS):
        found, times = np.unique(np.concatenate(sets), return_counts=True)
        self.vocabulary = np.sort(found[np.lexsort((found, -times))[:most]])
        self.presence = np.zeros((len(sets), len(self.vocabulary)), np.float32)
        for row, codes in zip(self.presence, sets, strict=True):
            row[np.searchsorted(self.vocabulary, np.intersect1d(codes, self.vocabulary))] = 1
        self.roots = np.sqrt(np.maximum(1, self.presence.sum(1, dtype=np.float64)))
        self.slots: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"vocabulary": self.vocabulary, "bits": np.packbits(self.presence.astype(bool), axis=1), "roots": self.roots}

    def __setstate__(self, state: dict) -> None:
        self.vocabulary, self.roots, self.slots = state["vocabulary"], state["roots"], None
        self.presence = np.unpackbits(state["bits"], axis=1, count=len(self.vocabulary)).astype(np.float32)

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values of texts with the landmarks."""
        if self.slots is None:
            self.slots = np.full(SLOTS, len(self.vocabulary), np.int32)
            self.slots[self.vocabulary] = np.arange(len(self.vocabulary))
        out = np.zeros((len(texts), len(self.roots)))
        step = max(1, CELLS // (len(self.vocabulary) + 1))
        for lo in range(0, len(texts), step):
            part = texts[lo : lo + step]
            x = np.zeros((len(part), len(self.vocabulary) + 1), np.float32)  # the last column takes what no landmark has
            for row, text in zip(x, part, strict=True):
                for codes in grams(text):
                    row[self.slots[codes]] = 1
            x = x[:, :-1]
            out[lo : lo + step] = (x @ self.presence.T) / (np.sqrt(np.maximum(1, x.sum(1, dtype=np.float64)))[:, None] * self.roots)
        return out


def kernel_batches(batches: Iterator[pa.RecordBatch], landmarks: Landmarks) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = landmarks.kernel(b.column(1).to_pylist()).astype(np.float32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["lang", "k"])


def fit(landmarks: Landmarks, k: np.ndarray, of: np.ndarray, classes: int, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the kernel values, a column for each class and the constant in the last row: each class against the rest by
    ridge regression on the Nyström features, targets 1 and -1."""
    own = (landmarks.presence @ landmarks.presence.T) / (landmarks.roots[:, None] * landmarks.roots)
    values, vectors = np.linalg.eigh(own.astype(float))
    real = values > 1e-8 * values[-1]
    to = vectors[:, real] / np.sqrt(values[real])
    z = np.c_[k @ to, np.ones(len(k))]
    y = np.where(of[:, None] == np.arange(classes), 1.0, -1.0)
    penalty = np.diag(np.r_[np.full(z.shape[1] - 1, ridge * len(k)), 1e-9])
    weights = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    return np.r_[to @ weights[:-1], weights[-1:]]


def score_batches(batches: Iterator[pa.RecordBatch], landmarks: Landmarks | None, weights: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(row, lang_pred, score) of rows (row, text, known): ``known`` is false where nothing can be said."""
    for b in batches:
        texts, known = b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
        said, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = np.flatnonzero(known)
        if len(at) and landmarks is not None:
            s = landmarks.kernel([texts[i] for i in at]) @ weights[:-1] + weights[-1]
            score[at] = np.clip((s.max(1) + 1) / 2, 0, 1)
            for i, c in zip(at, s.argmax(1), strict=True):
                said[i] = names[c]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])


def drawn(rows: DataFrame, quota: int, seed: int) -> DataFrame:
    """The ``quota`` rows of each language with the least hashes of their ids; most others are left out before any are sorted."""
    sizes = rows.groupBy("lang").agg(F.count("*").alias("size"))
    mark = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40))
    some = rows.withColumn("mark", mark).join(F.broadcast(sizes), "lang")
    some = some.filter(F.col("mark") <= F.least(F.lit(1.0), 1.5 * quota / F.col("size") + 16 / F.col("size")) * float(1 << 40))
    return some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("mark", "id"))).filter(F.col("n") <= quota).select("lang", "text")


def model(train: DataFrame) -> tuple[Landmarks | None, np.ndarray, list[str]]:
    """(landmarks, weights, names of the languages in order) from rows (id, lang, text)."""
    names = sorted(r[0] for r in train.select("lang").distinct().collect())  # a row a language
    if not names:
        return None, np.zeros((1, 0)), names
    chosen = drawn(train, max(1, LANDMARKS // len(names)), 5)
    sets = map_arrow(chosen, __name__, "gram_batches", "lang string, grams array<int>").orderBy("lang", "grams").collect()
    landmarks = Landmarks([np.array(r.grams, np.int32) for r in sets])
    sample = drawn(train, max(1, FIT_ROWS // len(names)), 6)
    rows = map_arrow(sample, __name__, "kernel_batches", "lang string, k binary", landmarks=landmarks).orderBy("lang", "k").collect()
    k = np.array([np.frombuffer(bytes(r.k), np.float32) for r in rows], float)
    at = {name: i for i, name in enumerate(names)}
    return landmarks, fit(landmarks, k, np.array([at[r.lang] for r in rows]), len(names)), names


def held_out(key: str) -> Column:
    """Whether a document is kept from learning: the CRC-32 of its id as text leaves 1 by three."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) of every row: the language whose regression says most, and half of one plus that.

    Learned from whole texts with a letter and a language of rows that aren't held out, ``LANDMARKS`` and ``FIT_ROWS`` of
    them at most; a row without an id is neither held out nor learned from. A null text or one without a letter is
    ``und`` with score 0, and so is everything if nothing can be learned. Equal scores go to the first language by name;
    equal texts get equal answers, repeated rows one each. Other columns are not read, whatever their names. An empty table
    gives an empty one. Languages are few: their names are held by the driver.
    """
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    train = docs.filter(F.col(key).isNotNull() & F.col(lang).isNotNull() & letter & ~held_out(key))
    train = train.select(F.col(key).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    landmarks, weights, names = model(train)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), letter.alias("known"))
    out = map_arrow(rows, __name__, "score_batches", f"id {dict(docs.dtypes)[key]}, lang_pred string, score double", landmarks=landmarks, weights=weights, names=names)
    return out.select(F.col("id").alias(key), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
