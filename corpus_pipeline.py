"""A training corpus from raw documents: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
kept; ``run`` writes each result as a Parquet table in the shared folder, reads it
again and deletes the tables that the stage made on the way. All but the last stage return the columns of ``documents``.

In every stage: a null ``doc_id`` is larger than any other; a null or empty text has no words, which the first stage
rejects; texts of any length are read whole; a repeated row is one more copy, of which near duplicates keep one; extra
columns keep their values whatever their names; an empty table gives no rows, and without labels or benchmark items
only the fixed rules reject and nothing is cut.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from evq.llm import decontaminate, near_duplicates, packing, quality, repeats
from evq.llm.tasks import finished


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the fixed rules nor the language-model score reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    return near_duplicates.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that a document with a smaller id has too."""
    return repeats.remove_repeats(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality", keep_good), ("near-duplicates", one_of_each), ("repeats", cut_repeats), ("benchmark", cut_benchmark), ("packing", pack)]
#: No SQL: hashed n-gram scores, passages of near copies and token ids are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = finished(partial(stage, spark, docs, sf_dir), spark, f"pipeline-{name}")
    return docs
