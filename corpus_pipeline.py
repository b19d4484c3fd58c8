"""The corpus pipeline: quality classifier, line dedup, near-duplicates, packing."""

from __future__ import annotations

import public_tokenizers as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import components, new_folder, saved, small, table
from tidemill.llm.line_dedup import dedup, fresh
from tidemill.llm.packing import pack_documents
from tidemill.llm.quality import keep_good
from tidemill.llm.similar import similar
from tidemill.llm.simhash import near_duplicates
from tidemill.storage import removed


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with all their columns. Null texts count as empty ones; a null source or language
    is a site like any other; equal texts of a site go together, and repeated rows. An empty table stays empty."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines of earlier ones; those that had nothing else go. Null texts and rows without an id stay as
    they are; of ties the smallest id keeps a line; repeated rows lose nothing to each other. An empty table stays empty."""
    lines, gone, blocks = (fresh(docs, n) for n in ("_lines", "_gone", "_blocks"))
    out = dedup(docs, "doc_id", "text", names=(lines, gone, blocks)).filter((F.col(gone) == 0) | (F.col(gone) < F.col(lines)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; rows without an id stay. Links are those of op5, and all pairs
    of similarity 0.8 or more on five words, which fingerprints miss. Null and empty texts are one component; repeated rows stay
    or go together. An empty table stays empty."""
    found = saved(near_duplicates(docs, "doc_id", "text").select("doc_id", "component_id"))
    root, name = F.col("component_id"), found.filter("doc_id is not null")
    alike = similar(docs, "doc_id", "text")
    ends = alike.join(name.select(F.col("doc_id").alias("src"), root.alias("u")).distinct(), "src").join(name.select(F.col("doc_id").alias("dst"), root.alias("v")).distinct(), "dst")
    joined = components(ends.select("u", "v"), "u", "v")
    found = found.join(joined, root == F.col("node"), "left").select("doc_id", F.coalesce("root", root).alias("component_id"))
    gone = found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first")).filter("not first").select("doc_id")
    gone = small(saved(gone.withColumnRenamed("doc_id", "_gone")))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens. A null text is a piece of the end token alone; ties and repeated
    rows each have their place. An empty table gives an empty one."""
    return pack_documents(docs, "doc_id", "text", files.path("word_bpe_49k.json"))


STAGES = [(f.__name__, f) for f in (quality_classifier, line_dedup, simhash_near_dedup, best_fit_packing)]
#: No stage but the last could be SQL (a fitted model, patience diff, components), so tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again, and those of the stage
    before are deleted."""
    docs, out, before = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        if before:
            removed(spark, before)
        before = f"{out}/{name}"
    return docs
