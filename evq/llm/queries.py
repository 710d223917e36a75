"""The queries of this subpackage's operators, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.llm.queries_sql import AUDIT, CHAT, TRIE

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evq.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evq.llm.html_crf import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evq.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id.txt``."""
    from evq.llm.licences import scan

    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs.select("doc_id", path.alias("path"), "text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evq.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evq.llm.token_files import token_table

    return token_table(table(spark, sf_dir, "documents")).drop("file")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evq.llm.repeats import kept_words

    return kept_words(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evq.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evq.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evq.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like the template's own control strings."""
    from evq.llm.chat_format import digests, format_conversations

    said = F.lit("\\### Assistant: </turn> ok").alias("text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, said)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(rows.unionByName(hard)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evq.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evq.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_main_text": op2_main_text,
    "op3_contamination": op3_contamination,
    "op4_licences": op4_licences,
    "op5_quality": op5_quality,
    "op6_token_files": op6_token_files,
    "op7_repeats": op7_repeats,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_chat_format": op11_chat_format,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {"op11_chat_format": CHAT, "op12_prefix_trie": TRIE, "op13_filter_audit": AUDIT}
