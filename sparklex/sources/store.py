"""Saved indexes: Parquet tables clustered by term, their statistics, and a JSON description.

Postings are range-partitioned and sorted by term: a query's ``term IN (...)`` reaches
the scan and skips files and row groups by their statistics.  Popular terms, whose
postings fill many partitions, are split by document id as well.
"""

from __future__ import annotations

import io
import json
import tarfile
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sparklex.operators.index import Index

FORMAT = 2
POSTINGS = "term string, doc_id bigint, tf {tf}, dl bigint"
LENGTHS = "doc_id bigint, dl bigint"


def save_index(index: Index, path: str, description: dict[str, Any] | None = None, docs: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """Writes postings, lengths, statistics, the description and, if given, the documents.

    Statistics are summed up from what was written, so texts are not tokenized for them.
    The description comes last: a folder without it is not an index.  An id that was
    given twice is refused (ValueError).
    """
    spark = index.postings.sparkSession
    made = None
    if index.forward is not None:  # tokenize once for all tables, and for the sampling of the sort
        made = f"{path}/forward"
        index.forward.write.mode(mode).parquet(made)
        index = replace(Index.of_forward(spark.read.schema(index.forward.schema).parquet(made)), dense=index.dense)
    index.doc_stats.select("doc_id", "dl").write.mode(mode).parquet(f"{path}/doc_stats")
    lengths = spark.read.schema(LENGTHS).parquet(f"{path}/doc_stats")
    Index(index.postings, lengths).checked()
    postings = index.postings.select("term", "doc_id", "tf", "dl").repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    postings.write.mode(mode).option("compression", "zstd").parquet(f"{path}/postings")
    tf = dict(index.postings.dtypes)["tf"]
    written = Index(spark.read.schema(POSTINGS.format(tf=tf)).parquet(f"{path}/postings"), lengths, dense=index.dense)
    written.term_stats().sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/term_stats")
    n_docs, total = written.corpus_stats().first()
    if made is not None:
        fs, at, _ = _files(spark, made)
        fs.delete(at, True)
    if docs is not None:
        docs.write.mode(mode).option("compression", "zstd").parquet(f"{path}/docs")
    about = {"format": FORMAT, "tf": tf, "docs": docs is not None, "n_docs": n_docs, "total_len": total, "dense": index.dense, **(description or {})}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/about")


def read_description(spark: SparkSession, path: str) -> dict[str, Any]:
    rows = spark.read.text(f"{path}/about").collect()
    about = json.loads(rows[0]["value"]) if len(rows) == 1 else {}
    if about.get("format") != FORMAT:
        raise ValueError(f"{path} is not an index of format {FORMAT}")
    return about


def load_index(spark: SparkSession, path: str) -> Index:
    """The saved index; nothing is read before a query asks for it."""
    about = read_description(spark, path)
    tf = about["tf"]
    postings = spark.read.schema(POSTINGS.format(tf=tf)).parquet(f"{path}/postings")
    terms = spark.read.schema(f"term string, df bigint, cf {tf}").parquet(f"{path}/term_stats")
    corpus = spark.createDataFrame([(about["n_docs"], about["total_len"])], "n_docs bigint, total_len bigint")
    return Index(postings, spark.read.schema(LENGTHS).parquet(f"{path}/doc_stats"), terms, corpus, about["dense"])


def load_docs(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(f"{path}/docs") if read_description(spark, path)["docs"] else None


def folder_bytes(spark: SparkSession, path: str) -> bytes:
    """All files below a folder as one archive, on the driver: for indexes that fit there."""
    fs, at, jvm = _files(spark, path)
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        found = fs.listFiles(at, True)
        while found.hasNext():
            name = found.next().getPath()
            stream = fs.open(name)
            data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            stream.close()
            entry = tarfile.TarInfo(name.toUri().getPath().split(at.toUri().getPath() + "/", 1)[1])
            entry.size = len(data)
            tar.addfile(entry, io.BytesIO(data))
    return out.getvalue()


def folder_of_bytes(spark: SparkSession, data: bytes, path: str) -> None:
    """Inverse of ``folder_bytes``."""
    fs, at, jvm = _files(spark, path)
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        for entry in tar:
            if not entry.isfile() or entry.name.startswith("/") or ".." in entry.name.split("/"):
                raise ValueError("not a saved index")
            stream = fs.create(jvm.org.apache.hadoop.fs.Path(at, entry.name), False)
            stream.write(bytearray(tar.extractfile(entry).read()))
            stream.close()


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, spark._jvm
