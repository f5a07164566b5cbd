"""Corpus cleaning from raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of ``documents``.  ``run`` writes every stage's result as Parquet
to the shared folder and rereads it, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklex.llm import decontam, language_id, line_dedup, near_dup, packing, shared


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the classifier rejects."""
    name = shared.free_name(docs, "language")
    judged = language_id.identify_languages(docs, output=name)
    return judged.where(F.col(f"{name}.accepted")).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first occurrence of every line, however short, that isn't blank; a document left without text goes."""
    lines, dropped = (shared.free_name(docs, c) for c in ("n_lines", "n_dropped"))
    cut = line_dedup.dedup_lines(docs, n_lines=lines, n_dropped=dropped)
    left = cut.where((F.col(dropped) == 0) | (F.trim(F.replace("text", F.lit("\n"), F.lit(""))) != ""))
    return left.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each near-duplicate group."""
    copies = near_dup.near_duplicates(docs).where("doc_id != class_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontam.contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]

#: Clustering, sketches and differencing are beyond SQL; tests/llm holds each stage
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
