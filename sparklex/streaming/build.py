"""Indexes built batch by batch, and by Structured Streaming.

Every micro-batch writes its own postings and lengths to ``batch=<id>``, overwriting
what a failed attempt left, so batches can be repeated after failures.  Statistics are
sums over all batches and need no state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklex.functions.tokenize import core_tokens
from sparklex.operators.index import Index, dense_gaps, index_tokens
from sparklex.sources.store import save_index


class StreamingIndexBuilder:
    """Appends chunks of (doc_id, tokens) or (doc_id, text) below ``staging``; ``build`` compacts them.

    Ids that were added twice are refused when the index is built.
    """

    def __init__(self, spark: SparkSession, path: str, staging: str | None = None, tokenize: Callable[[Column], Column] | None = None, chunk_size: int = 100_000):
        self.spark, self.path, self.staging = spark, path, staging or f"{path}-staging"
        self.tokenize, self.chunk_size = tokenize, chunk_size
        self.num_shards = 0
        self._held: list[tuple[int, list[str] | None, str | None]] = []

    def add_tokens(self, doc_id: int, tokens: list[str]) -> None:
        self._hold(doc_id, list(tokens), None)

    def add_text(self, doc_id: int, text: str) -> None:
        if self.tokenize is None:
            raise RuntimeError("the builder has no tokenizer")
        self._hold(doc_id, None, text)

    def add_batch(self, items: Iterable[str | list[str]], start_id: int = 0) -> int:
        """Adds texts and token lists under ids from start_id on; returns the next id."""
        for item in items:
            (self.add_text if isinstance(item, str) else self.add_tokens)(start_id, item)
            start_id += 1
        return start_id

    def _hold(self, *row) -> None:
        self._held.append(row)
        if len(self._held) >= self.chunk_size:
            self.flush()

    def flush(self) -> None:
        """Writes what is held as a shard."""
        if not self._held:
            return
        rows = self.spark.createDataFrame(self._held, "doc_id bigint, tokens array<string>, text string")
        tokens = F.col("tokens") if self.tokenize is None else F.when(F.col("tokens").isNull(), self.tokenize(F.col("text"))).otherwise(F.col("tokens"))
        self._held = []
        self.add_shard(rows.select("doc_id", tokens.alias("tokens")), self.num_shards)

    def add_shard(self, docs: DataFrame, number: int | None = None, text: str | None = None) -> None:
        """Adds a whole DataFrame of (doc_id, tokens), or of (doc_id, ``text``)."""
        number = self.num_shards if number is None else number
        if text is not None:
            docs = docs.select("doc_id", (self.tokenize or core_tokens)(F.col(text)).alias("tokens"))
        made = index_tokens(docs)
        made.postings.write.mode("overwrite").parquet(f"{self.staging}/postings/batch={number}")
        made.doc_stats.write.mode("overwrite").parquet(f"{self.staging}/doc_stats/batch={number}")
        self.num_shards = max(self.num_shards, number + 1)

    def consume(self, stream: DataFrame, checkpoint: str, text: str = "text") -> None:
        """Reads a streaming DataFrame (doc_id, text) until it is caught up."""

        def each(batch: DataFrame, number: int) -> None:
            self.add_shard(batch, number, text)

        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def staged(self) -> Index:
        """All shards as one index, without compaction; missing ids are empty documents."""
        self.flush()
        if not self.num_shards:
            return index_tokens(self.spark.createDataFrame([], "doc_id bigint, tokens array<string>"))
        postings = self.spark.read.parquet(f"{self.staging}/postings").drop("batch")
        lengths = self.spark.read.parquet(f"{self.staging}/doc_stats").drop("batch")
        return dense_gaps(Index(postings, lengths).checked())

    def build(self, description: dict | None = None, mode: str = "errorifexists") -> None:
        """Writes the compacted index to ``path`` and deletes the shards."""
        save_index(self.staged(), self.path, description, mode=mode)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.staging)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
