"""Corpus pipeline: toxicity, exact dedup, MinHash near-dedup, benchmark decontamination, mixing.

Every stage takes (spark, docs, sf_dir), works on all of docs, and returns what it keeps with the columns of
documents, whatever their names; the last one returns the mix. run() writes each stage as Parquet below the shared
checkpoint folder, reads it again for the next, and removes what is no longer read. A null text counts as empty. Rows
with a null id pass toxicity, exact dedup and decontamination like others, and near dedup untouched. Repeated rows are
one after exact dedup. Very long texts go through every stage whole. Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import exact_dedup, leaks, mixing, near_dedup, toxicity
from quern.llm.common import ensure_checkpoint_dir, read_table, remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model, carry=docs.columns).filter("predicted = 0").select("carry.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; of its repeated rows one."""
    return exact_dedup.exact_groups(docs, carry=docs.columns).filter("kept").select("carry.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, and all rows with a null id, which are linked with nothing."""
    kept = near_dedup.near_groups(docs).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.col("doc_id").alias("row_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("carry"))
    without_id = rows.filter("row_id IS NULL").select("carry.*")  # stay where they are: they would meet under one key
    return rows.join(kept, F.col("row_id") == F.col("kept_id"), "left_semi").select("carry.*").unionByName(without_id)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return leaks.leak_hits(docs, read_table(spark, sf_dir, "benchmark"), carry=docs.columns).filter("n_hit = 0").select("carry.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of what is left."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: The toxicity model and the near-duplicate search have no SQL form; a test holds run() to plain Python stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # nothing reads it any more
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
