"""Quality classifier by hierarchical empirical Bayes.

A logistic model over surface features gives each document its own evidence. Labels, and for unlabelled documents that
evidence, are counted per host and per path of a host; a host's share of good documents is shrunk towards the global
share, a path's towards its host's, by prior weights estimated from how much hosts (paths) differ. What a document itself
adds to its path's and host's counts is taken out before its path's posterior is formed, so that no document testifies
twice. Its verdict adds its own log odds and what that posterior's log odds differ from the global ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import ROOT, saved, short_batches, small

#: Most labelled rows that the document model is fitted on; they are drawn by a hash of their ids.
FIT_ROWS = 20_000
#: Most rows (of a host, a path and a number) that a site table may have to be broadcast.
SITES = 50_000
SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~!", np.uint8)


def features(text: str | None) -> list[float]:
    """Shares of bytes and words that tell prose from tables, shouting, symbol noise and repetition. Null counts as empty."""
    data = (text or "").encode()
    n = max(1, len(data))
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    w = max(1, len(words))
    again = sum(map(bytes.__eq__, words, words[1:])) / w
    return [
        c[SYMBOLS].sum() / n, c[124] / w, c[33] / w, c[65:91].sum() / n, c[48:58].sum() / n, (c[44] + c[46]) / w, again, math.sqrt(again),
        len(set(words)) / w, math.log1p(w) / 10, len(data) / w / 20, float(not words), min(1.0, c[SYMBOLS].sum() / w), c[10] / w,
    ]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> dict:
    """A logistic model by Newton's method over standardised features. Labels of one kind, or none, give a constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return {"mean": [0.0], "scale": [1.0], "weights": [0.0], "bias": float(np.log(share / (1 - share)))}
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    beta, ridge = np.r_[np.zeros(x.shape[1]), np.log(share / (1 - share))], np.r_[np.full(x.shape[1], penalty), 1e-9]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean.tolist(), "scale": scale.tolist(), "weights": beta[:-1].tolist(), "bias": float(beta[-1])}


def score(texts: pd.Series, model: dict) -> pd.Series:
    if len(model["weights"]) == 1:
        return pd.Series(np.full(len(texts), 1 / (1 + math.exp(-model["bias"]))))
    x = np.array([features(t) for t in texts], float).reshape(len(texts), len(model["mean"]))
    odds = (np.clip((x - model["mean"]) / model["scale"], -10, 10)) @ np.array(model["weights"]) + model["bias"]
    return pd.Series(1 / (1 + np.exp(-np.clip(odds, -12, 12))))


def _udf(name: str, kind: str, **params):
    root = ROOT

    def run(texts: pd.Series) -> pd.Series:
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        from tidemill.llm import quality

        return getattr(quality, name)(texts, **params)

    return F.pandas_udf(run, kind)


def feature_series(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


def document_model(docs: DataFrame, labels: DataFrame, key: str, text: str, most: int = FIT_ROWS) -> dict:
    """The logistic model from ``most`` labelled documents at most; repeated labels count once, null ones not at all."""
    short_batches(docs)
    known = labels.filter("quality is not null").groupBy(key).agg(F.max("quality").alias("quality"))
    n = known.count()
    if n > most:  # by a hash of the id, so the draw is the same whatever the order of rows
        draw = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 40))
        known = known.filter(draw < int((1 << 40) * min(1.0, 1.1 * most / n + 1e-3))).orderBy(draw, key).limit(most)
    rows = docs.select(key, text).join(F.broadcast(known), key).select(key, _udf("feature_series", "array<double>")(F.col(text)).alias("x"), "quality")
    rows = rows.groupBy(key).agg(F.min("x").alias("x"), F.max("quality").alias("quality")).orderBy(key).select("x", "quality").collect()  # ``most`` at most
    return fit(np.array([r[0] for r in rows] or np.zeros((0, 1)), float), np.array([r[1] for r in rows], float))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def weight(groups: DataFrame, share: str, around: Column | float) -> float:
    """How many observations a prior counts for: by the method of moments from how far group shares lie from ``around``,
    beyond what their sizes explain. Groups that do not differ give the most, 1000."""
    d = F.col(share) - around
    row = groups.filter("n > 0").agg(F.sum(F.col("n") * d * d), F.sum(F.col("n") * around * (1 - around) if isinstance(around, float) else F.col("n") * F.col("m") * (1 - F.col("m"))), F.count("*"), F.sum("n")).first()
    if not row[2]:
        return 1000.0
    spread, inside = row[0] - row[1] / row[3] * row[2], row[1]
    return float(min(1000.0, max(2.0, inside / spread))) if spread > 0 else 1000.0


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0.001)), F.lit(0.999))


def judged(docs: DataFrame, labels: DataFrame, model: dict, key: str, text: str, host: str, path: str) -> DataFrame:
    """(id, host, path, p_doc, p_site, p) of each row of ``docs``."""
    scored = docs.select(F.col(key).alias("id"), F.col(host).alias("host"), F.col(path).alias("path"), _udf("score", "double", model=model)(F.col(text)).alias("p_doc"))
    known = labels.filter("quality is not null").groupBy(F.col(key).alias("id")).agg(F.max("quality").cast("double").alias("quality"))
    seen = saved(scored.join(small(saved(known)), "id", "left").withColumn("e", F.coalesce("quality", "p_doc")))
    paths = saved(seen.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("e").alias("good")))
    n, good = paths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0.0))).first()
    m = float(min(0.999, max(0.001, (good + 1) / (n + 2))))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("share", F.col("good") / F.col("n"))
    a = weight(hosts, "share", m)
    hosts = hosts.select(F.col("host").alias("host_"), F.col("n").alias("n_host"), F.col("good").alias("good_host"))
    both = saved(paths.join(hosts, F.col("host").eqNullSafe(F.col("host_"))).drop("host_"))
    b = weight(both.withColumns({"share": F.col("good") / F.col("n"), "m": (F.col("good_host") + a * m) / (F.col("n_host") + a)}), "share", F.col("m"))
    site = both.select(F.col("host").alias("host_"), F.col("path").alias("path_"), "n", "good", "n_host", "good_host")
    if both.count() <= SITES:  # so few rows go to every task, and documents stay where they are
        site = F.broadcast(site)
    out = seen.join(site, F.col("host").eqNullSafe(F.col("host_")) & F.col("path").eqNullSafe(F.col("path_")))
    of_host = (F.col("good_host") - F.col("e") + a * m) / (F.col("n_host") - 1 + a)
    out = out.withColumn("p_site", clipped((F.col("good") - F.col("e") + b * of_host) / (F.col("n") - 1 + b)))
    return out.select("id", "host", "path", "p_doc", "p_site", verdict(F.col("p_doc"), F.col("p_site"), m).alias("p"))


def verdict(p_doc: Column, p_site: Column, m: float) -> Column:
    return 1 / (1 + F.exp(-(logit(p_doc) + logit(p_site) - math.log(m / (1 - m)))))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", keep_at: float = 0.5, most: int = FIT_ROWS) -> DataFrame:
    """(key, p_doc, p_site, p, keep) of every row of ``docs``: its own evidence, its path's posterior, both combined.

    ``labels`` has (key, quality). Null texts count as empty; a null host or path is a site like any other; equal texts of a
    path with equal labels get equal verdicts, repeated rows one each. Without labels the evidence is even, and all is kept;
    an empty table gives an empty one; other columns are not read.
    """
    out = judged(docs, labels, document_model(docs, labels, key, text, most), key, text, host, path)
    return out.select(F.col("id").alias(key), "p_doc", "p_site", "p", (F.col("p") >= keep_at).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", keep_at: float = 0.5, most: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns. Texts are scored once; then rows are told apart by
    key, host and path, and among repeated ones of these by their own score: a key goes with a site if all its rows do."""
    out = judged(docs, labels, document_model(docs, labels, key, text, most), key, text, host, path)
    gone = out.groupBy("id", "host", "path").agg(F.max("p").alias("p")).filter(F.col("p") < keep_at)
    gone = small(saved(gone.select(F.col("id").alias("_id"), F.col("host").alias("_host"), F.col("path").alias("_path"))), 100_000)
    same = docs[key].eqNullSafe(gone["_id"]) & docs[host].eqNullSafe(gone["_host"]) & docs[path].eqNullSafe(gone["_path"])
    return docs.join(gone, same, "left_anti")
