"""Queries of the training-data operators, with production parameters.

``QUERIES`` maps a name to a function of (spark, folder of tables); ``ORACLES``
holds DuckDB SQL for those that SQL can express on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklex.llm import chat, decontam, language_id, licenses, line_dedup, near_dup, neighbours, packing, shared, substring_dedup, token_store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.fresh_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_store.read_tokens(spark, path)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, batches=2)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify_languages(docs).select("doc_id", "language.*")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 50; they are searched among all rows."""
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), asked=F.col("vec_id") % 50 == 0)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_packing": op6_packing,
    "op7_decontamination": op7_decontamination,
    "op8_license_scan": op8_license_scan,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_chat_format": op10_chat_format,
}

ORACLES: dict[str, str] = {"op2_line_dedup": line_dedup.ORACLE, "op10_chat_format": chat.ORACLE}
