"""Token ids as ORC: stripes with run-length encoded integers, row indexes, Bloom filters.

Documents are range-partitioned and sorted by id before they are tokenized, so every
stripe and row group covers a narrow range of ids: a look-up by id prunes stripes and
row groups by their minimum and maximum, and by the Bloom filter inside a range.
Spark splits the files at stripes, so reads are parallel by stripe.

Defined results: a null text has null token ids, an empty text has none; rows with a
null id are kept (they sort first); repeated rows are all kept; extra columns are not
stored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklex.llm.packing import BYTE_BPE, encoder, sent_ranks

FILE_BYTES = 256 << 20
OPTIONS = {
    "orc.compress": "ZSTD",
    "orc.stripe.size": str(32 << 20),
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def token_ids(path: str):
    """Column function: the token ids of a text."""
    sent = sent_ranks(path)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encode = encoder(path, sent).encode_ordinary
        out = [np.array(encode(t.as_py()), np.int32) if t.is_valid else None for t in texts]
        offsets = np.cumsum([0, *(0 if x is None else len(x) for x in out)]).astype(np.int32)
        flat = np.concatenate([x for x in out if x is not None] or [np.zeros(0, np.int32)])
        null = pa.array([x is None for x in out], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=null)

    return ids.asNondeterministic()


def detokenized(path: str):
    """Column function: the text that token ids stand for."""
    sent = sent_ranks(path)

    @F.arrow_udf("string")
    def texts(ids: pa.Array) -> pa.Array:
        decode = encoder(path, sent).decode
        return pa.array([decode(x.as_py()) if x.is_valid else None for x in ids], pa.string())

    return texts


def write_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE, file_bytes: int = FILE_BYTES) -> None:
    """Writes (doc_id, tokens) to ``path``; the number of files follows the text's size."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # at least a task for each core; a file otherwise holds about file_bytes of text
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // file_bytes))
    # the row's own number parts rows of one id, or of none, that are too many for a file
    own = own.withColumn("row", F.monotonically_increasing_id())
    ranged = own.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    ranged.select("doc_id", token_ids(tokenizer)("text").alias("tokens")).write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, tokens); for some ids, only the stripes and row groups that may hold them."""
    table = spark.read.schema("doc_id bigint, tokens array<int>").orc(path)
    return table if doc_ids is None else table.where(F.col("doc_id").isin(doc_ids))
