"""Corpus pipeline: quality rules, near duplicates, repeated passages, contamination, mix.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns a DataFrame; the driver of the stages writes it as Parquet and
reads it again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.llm import decontam, jaccard, mixing, quality, substrings  # noqa: E402
from tessera.llm.common import table  # noqa: E402
from tessera.llm.substrings import PASSAGE_BYTES, PASSAGE_WORDS  # noqa: E402
from tessera.session import checkpoint_dir, cut_lineage, remove_folder, ship_package  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject; the trusted texts are the labelled ones of ``docs``.

    A null or empty text has no words, fails the base rule and goes; equal rows are judged alike; rows without
    doc_id are judged, but never trusted; without labels only the base rules decide; an empty table stays empty.
    """
    ship_package(spark)
    judged = quality.judge_quality(docs, table(spark, sf_dir, "labels"))
    return judged.filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the one with the least doc_id, then the first row.

    Texts without words belong to no group and all stay; a null doc_id comes after all others.
    """
    ship_package(spark)
    found = jaccard.near_duplicates(docs.select("doc_id", "text"))
    best = (found.withColumn("own", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("row")))
            .groupBy((F.col("n_shingles") > 0).alias("some"), "own")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
            .select(F.col("first.row").alias("row")))
    kept = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")).join(best, "row")
    return kept.select("doc.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of over 50 words that occur more than once out of the texts, all their copies.

    A character cut in half at an edge goes too; a null text becomes '' and stays a row, as does a text that
    is nothing but repeated passages; matches never cross documents.
    """
    ship_package(spark)
    out = substrings.remove_repeats(docs, PASSAGE_BYTES, characters=True, words=PASSAGE_WORDS)
    text = F.col("kept").cast("string")
    spark_cols = [text.alias("text") if c == "text" else F.col(f"keep.`{c}`").alias(c) for c in docs.columns]
    return out.select(*spark_cols)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark contaminates.

    Texts without words are clean; without benchmark items everything stays; equal rows go or stay together.
    """
    ship_package(spark)
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left; an empty text takes part with size 0."""
    ship_package(spark)
    return mixing.mix_sources(docs.select("doc_id", "source", "text"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates),
          ("repeated_passages", repeated_passages), ("benchmark_decontamination", benchmark_decontamination),
          ("source_mix", source_mix)]
#: Suffix arrays, shingle components and language models have no SQL twin; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, keep: bool = False) -> DataFrame:
    """All stages over ``documents``.

    Each result lies as a table in the shared checkpoint folder until the next one is written, the last
    as a checkpoint that Spark removes with its DataFrame; a run that fails, or ``keep``, leaves the tables.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
        if i and not keep:
            remove_folder(spark, f"{base}/{i - 1}-{STAGES[i - 1][0]}")
    out = cut_lineage(STAGES[-1][1](spark, docs, sf_dir))
    if not keep:
        remove_folder(spark, base)
    return out
