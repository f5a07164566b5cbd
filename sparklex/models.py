"""Ranking models over lists of texts or DataFrames; results are DataFrames."""

from __future__ import annotations

import asyncio
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklex.functions import codec
from sparklex.functions.scoring import ALIASES, Scoring
from sparklex.functions.tokenize import Analyzer
from sparklex.operators import index as ix
from sparklex.operators.search import Searcher
from sparklex.sources.scratch import scratch_path, written
from sparklex.sources.store import folder_bytes, folder_of_bytes, load_docs, load_index, read_description, save_index
from sparklex.streaming.build import StreamingIndexBuilder

SPARSE_CELLS = 10_000_000


def text_frame(corpus: Any, spark: SparkSession | None = None, start: int = 0, nulls: str = "empty") -> DataFrame:
    """(doc_id, text) of a DataFrame that has both, or of a list of texts, numbered in order.

    A DataFrame's null texts are empty documents, or with ``nulls="refuse"`` a TypeError.
    """
    if nulls not in ("empty", "refuse"):
        raise ValueError("nulls is 'empty' or 'refuse'")
    if isinstance(corpus, DataFrame):
        if dict(corpus.dtypes).get("text") != "string" or "doc_id" not in corpus.columns:
            raise TypeError("a corpus has doc_id and a string column text")
        if nulls == "refuse" and not corpus.where("text is null").isEmpty():
            raise TypeError("a text of the corpus is null")
        return corpus.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if isinstance(corpus, (str, bytes)):
        raise TypeError("a corpus is a sequence of texts, not one text")
    rows = list(corpus)
    if not all(isinstance(t, str) for t in rows):
        raise TypeError("every text of a corpus is a string")
    spark = spark or SparkSession.active()
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")


def check_jobs(n_jobs: int | None) -> None:
    """Spark schedules queries itself; the number is only checked."""
    if n_jobs is not None and (n_jobs < -1 or n_jobs == 0):
        raise ValueError("n_jobs is -1 or 1 and more")


def query_frame(queries: Any, spark: SparkSession) -> DataFrame:
    if isinstance(queries, DataFrame):
        return queries.select("query_id", "text")
    if isinstance(queries, str):
        raise TypeError("queries are a sequence of texts, not one text")
    rows = list(queries)
    if not rows:
        raise ValueError("no queries")
    return spark.createDataFrame(list(enumerate(rows)), "query_id bigint, text string")


def _dumped(model: Any) -> bytes:
    spark = SparkSession.active()
    path = scratch_path(spark, "dumped")
    model.save(path)
    return folder_bytes(spark, path)


def _unpacked(spark: SparkSession, data: bytes) -> str:
    path = scratch_path(spark, "loaded")
    folder_of_bytes(spark, data, path)
    return path


class AsyncBatchMixin:
    """Batches and coroutines for models that have ``searcher``."""

    searcher: Searcher

    @property
    def index(self) -> ix.Index:
        return self.searcher.index

    @property
    def corpus_size(self) -> int:
        return self.index.corpus_stats().first()["n_docs"]

    def get_scores_batch(self, queries: Any, *, n_jobs: int | None = 1, sparse: bool | None = None, sparse_threshold: int = SPARSE_CELLS) -> DataFrame:
        """(query_id, doc_id, score); sparse results leave zeros out, which large ones do by themselves."""
        check_jobs(n_jobs)
        if sparse_threshold < 0:
            raise ValueError("sparse_threshold is 0 at least")
        asked = query_frame(queries, self.searcher.spark)
        if sparse is None:
            sparse = asked.count() * self.corpus_size >= sparse_threshold
        return self.searcher.batch(asked) if sparse else self.searcher.batch_dense(asked)

    def get_scores_matrix(self, queries: Any) -> np.ndarray:
        """Queries x documents, in the order of their ids, as 32-bit floats on the driver: for what fits there."""
        data, columns, ends = self.get_scores_csr(queries)
        dense = np.zeros((len(ends) - 1, self.corpus_size), np.float32)
        dense[np.repeat(np.arange(len(ends) - 1), np.diff(ends)), columns] = data
        return dense

    def get_scores_csr(self, queries: Any) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(data, indices, indptr) of the sparse matrix on the driver; a document's column is its place among the ids."""
        asked = query_frame(queries, self.searcher.spark)
        rows = self.searcher.batch(asked).orderBy("query_id", "doc_id").toArrow()
        order = np.sort(asked.select("query_id").toArrow().column("query_id").to_numpy())
        ids = np.sort(self.index.doc_ids().toArrow().column("doc_id").to_numpy())
        ends = np.append(0, np.searchsorted(rows.column("query_id").to_numpy(), order, "right"))
        return rows.column("score").to_numpy().astype(np.float32), np.searchsorted(ids, rows.column("doc_id").to_numpy()), ends

    def get_top_n_batch(self, queries: Any, n: int = 5, *, n_jobs: int | None = 1) -> DataFrame:
        """(query_id, rank, doc_id, score)."""
        check_jobs(n_jobs)
        return self.searcher.batch_top_n(query_frame(queries, self.searcher.spark), n)

    async def aget_scores(self, query: str) -> list:
        return await asyncio.to_thread(lambda: self.get_scores(query).collect())

    async def aget_top_n(self, query: str, n: int = 5) -> list:
        return await asyncio.to_thread(lambda: self.get_top_n(query, n).collect())

    async def aget_scores_batch(self, queries: Any, *, n_jobs: int | None = -1, sparse: bool | None = None, sparse_threshold: int = SPARSE_CELLS) -> list:
        return await asyncio.to_thread(lambda: self.get_scores_batch(queries, n_jobs=n_jobs, sparse=sparse, sparse_threshold=sparse_threshold).collect())


class _Model(AsyncBatchMixin):
    variant = "okapi"

    def __init__(self, index: ix.Index, scoring: Scoring, analyzer: Analyzer):
        self.searcher = Searcher(index, scoring, analyzer)
        self.analyzer = analyzer

    k1 = property(lambda self: self.searcher.scoring.k1)
    b = property(lambda self: self.searcher.scoring.b)
    epsilon = property(lambda self: self.searcher.scoring.epsilon)
    delta = property(lambda self: self.searcher.scoring.delta)

    @property
    def avg_doc_length(self) -> float:
        row = self.index.corpus_stats().first()
        return row["total_len"] / row["n_docs"] if row["n_docs"] else 0.0

    def get_scores(self, query: str) -> DataFrame:
        """(doc_id, score float) of every document."""
        return self.searcher.scores(query).withColumn("score", F.col("score").cast("float"))

    def get_top_n(self, query: str, n: int = 5) -> DataFrame:
        """(score float, doc_id), best first; documents that don't match fill places that are left."""
        return self.searcher.top_n(query, n).select(F.col("score").cast("float"), "doc_id")

    def __repr__(self) -> str:
        return f"{type(self).__name__}(k1={self.k1:g}, b={self.b:g}, epsilon={self.epsilon:g}, corpus_size={self.corpus_size})"


class _TextModel(_Model):
    def __init__(self, corpus: Any, k1: float = 1.5, b: float = 0.75, delta: float | None = None, epsilon: float = 0.25, lowercase: bool = True, tokenizer: Any = None, stopwords: Any = None, extra_stopwords: Sequence[str] | None = None, stemmer: Any = None, nulls: str = "empty"):
        self.docs = text_frame(corpus, nulls=nulls)
        self.numbered = not isinstance(corpus, DataFrame)
        if self.docs.isEmpty():
            raise ValueError("the corpus is empty")
        analyzer = Analyzer.of(tokenizer, lowercase, stopwords, extra_stopwords, stemmer)
        super().__init__(ix.index_text(self.docs, analyzer).persist().checked(), Scoring(self.variant, k1, b, epsilon, delta), analyzer)

    def get_top_n_docs(self, query: str, n: int = 5) -> DataFrame:
        """(rank, doc_id, text)."""
        return self.searcher.top_n_docs(query, self.docs, n)


class BM25Plus(_TextModel):
    variant = "plus"


class BM25L(_TextModel):
    variant = "l"


class BM25Adpt(_TextModel):
    variant = "adpt"


class BM25(_TextModel):
    """Okapi; with ``variant``, the model of that name.  Only this model is saved and changed."""

    def __new__(cls, *args, variant: str | None = None, **options):
        name = ALIASES.get((variant or "okapi").lower())
        if name is None:
            raise ValueError(f"unknown variant {variant!r}; known: {', '.join(ALIASES)}")
        other = {"plus": BM25Plus, "l": BM25L, "adpt": BM25Adpt}.get(name)
        return other(*args, **options) if other else super().__new__(cls)

    def __init__(self, corpus: Any, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, lowercase: bool = True, variant: str | None = None, delta: float | None = None, **options):
        super().__init__(corpus, k1, b, None, epsilon, lowercase, **options)

    def _replace(self, index: ix.Index, docs: DataFrame) -> None:
        """Goes on with tables that are written, so that changes don't pile up in the lineage."""
        index = index.checked()
        made = ix.Index(written(index.postings, "postings"), written(index.doc_stats, "lengths")).persist()
        self.index.unpersist()
        self.searcher = Searcher(made, self.searcher.scoring, self.analyzer)
        self.docs = docs

    def add_documents(self, new_docs: Any) -> None:
        """Appends texts under the ids that follow, or a DataFrame's under its own new ids; only they are tokenized."""
        if not isinstance(new_docs, DataFrame):
            last = self.index.doc_ids().agg(F.max("doc_id")).first()[0]
            new_docs = text_frame(new_docs, self.searcher.spark, 0 if last is None else last + 1)
        if new_docs.isEmpty():
            return
        new_docs = text_frame(new_docs)
        self._replace(ix.add_documents(self.index, ix.index_text(new_docs, self.analyzer)), self.docs.unionByName(new_docs))

    def remove_document(self, doc_id: int) -> None:
        """Takes a document out.  Of documents given as a list, later ids move down by one; a DataFrame's stay."""
        if self.index.doc_ids().where(F.col("doc_id") == doc_id).isEmpty():
            raise IndexError(f"no document {doc_id}")
        docs = ix.without(self.docs, doc_id, self.numbered)
        self._replace(ix.remove_document(self.index, doc_id, self.numbered), docs)

    def save(self, path: str) -> None:
        s = self.searcher.scoring
        about = {"variant": s.variant, "k1": s.k1, "b": s.b, "epsilon": s.epsilon, "numbered": self.numbered, "analyzer": self.analyzer.to_state()}
        save_index(self.index, path, about, self.docs)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> BM25:
        spark = spark or SparkSession.active()
        about = read_description(spark, path)
        if about.get("variant") != "okapi":
            raise ValueError(f"only okapi models are loaded, not {about.get('variant')!r}")
        model = object.__new__(cls)
        model.docs, model.numbered = load_docs(spark, path), about["numbered"]
        _Model.__init__(model, load_index(spark, path), Scoring("okapi", about["k1"], about["b"], about["epsilon"]), Analyzer.from_state(about["analyzer"]))
        return model

    def dumps(self) -> bytes:
        """The saved model as bytes on the driver: for models that fit there."""
        return _dumped(self)

    @classmethod
    def loads(cls, data: bytes, spark: SparkSession | None = None) -> BM25:
        spark = spark or SparkSession.active()
        return cls.load(_unpacked(spark, data), spark)


class BM25F(_Model):
    """Weighted fields of documents given as dicts, or as a DataFrame (doc_id, fields map).

    As in the published behaviour that this follows, the per-field ``b`` is kept but
    has no effect on scores.
    """

    variant = "field"

    def __init__(self, corpus: Any, field_weights: dict[str, float], k1: float = 1.5, epsilon: float = 0.25, lowercase: bool = True, tokenizer: Any = None, stopwords: Any = None, extra_stopwords: Sequence[str] | None = None, stemmer: Any = None):
        if not isinstance(corpus, DataFrame):
            rows = [(i, dict(d)) for i, d in enumerate(corpus)]
            corpus = SparkSession.active().createDataFrame(rows, "doc_id bigint, fields map<string,string>")
        if corpus.isEmpty():
            raise ValueError("the corpus is empty")
        analyzer = Analyzer.of(tokenizer, lowercase, stopwords, extra_stopwords, stemmer)
        self.field_weights, self.field_b = dict(field_weights), {f: 0.75 for f in field_weights}
        super().__init__(ix.index_fields(corpus, self.field_weights, analyzer).persist().checked(), Scoring("field", k1, 0.0, epsilon), analyzer)

    def set_field_b(self, field: str, b: float) -> None:
        if field in self.field_b:
            self.field_b[field] = float(b)


class CompressedBM25:
    """Okapi over token lists, without a floor of IDF; queries are token lists too."""

    def __init__(self, corpus: Any = None, *, k1: float = 1.5, b: float = 0.75, index: ix.Index | None = None):
        if index is None:
            if not isinstance(corpus, DataFrame):
                rows = [(i, list(t)) for i, t in enumerate(corpus or [])]
                corpus = SparkSession.active().createDataFrame(rows, "doc_id bigint, tokens array<string>")
            index = ix.index_tokens(corpus).persist().checked()
        self.searcher = Searcher(index, Scoring("compact", k1, b))

    def get_scores(self, query_tokens: list[str]) -> DataFrame:
        return self.searcher.scores(list(query_tokens))

    def get_top_n(self, query_tokens: list[str], n: int = 5) -> DataFrame:
        return self.searcher.top_n(list(query_tokens), n)

    @property
    def num_docs(self) -> int:
        return self.searcher.index.corpus_stats().first()["n_docs"]

    @property
    def num_terms(self) -> int:
        return self.searcher.index.term_stats().count()

    @property
    def compressed_bytes(self) -> int:
        return codec.compressed_bytes(self.searcher.index.postings).first()["compressed_bytes"]

    def save(self, path: str) -> None:
        save_index(self.searcher.index, path, {"variant": "compact"})

    def dumps(self) -> bytes:
        return _dumped(self)

    @classmethod
    def loads(cls, data: bytes, *, k1: float = 1.5, b: float = 0.75) -> CompressedBM25:
        return cls.load(_unpacked(SparkSession.active(), data), k1=k1, b=b)

    @classmethod
    def load(cls, path: str, *, k1: float = 1.5, b: float = 0.75) -> CompressedBM25:
        return cls(k1=k1, b=b, index=load_index(SparkSession.active(), path))

    def __repr__(self) -> str:
        return f"{type(self).__name__}(num_docs={self.num_docs}, num_terms={self.num_terms})"


class MmapBM25(CompressedBM25):
    """A saved index that is scanned where it lies, for the terms that a query asks for."""

    def __init__(self, path: str, *, k1: float = 1.5, b: float = 0.75):
        super().__init__(k1=k1, b=b, index=load_index(SparkSession.active(), path))
        self.path = path

    def close(self) -> None:
        self.searcher.index.unpersist()

    @property
    def file_size(self) -> int:
        spark = self.searcher.spark
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


class StreamingBM25Builder(StreamingIndexBuilder):
    """Chunked building of a saved index; ``build`` returns the model over it."""

    def __init__(self, output_path: str, *, chunk_size: int = 100_000, tmp_dir: str | None = None, tokenizer: Any = None, spark: SparkSession | None = None):
        analyzer = None if tokenizer is None else Analyzer(tokenizer)
        super().__init__(spark or SparkSession.active(), output_path, tmp_dir and f"{tmp_dir}/shards", analyzer, chunk_size)

    def build(self, *, k1: float = 1.5, b: float = 0.75) -> CompressedBM25:
        super().build({"variant": "compact"})
        return CompressedBM25.load(self.path, k1=k1, b=b)


class InvertedIndex:
    """Postings under explicit ids; ids in between that were never added are empty documents."""

    def __init__(self, index: ix.Index | None = None):
        self._rows: list[tuple[int, list[str]]] = []
        self._index = index

    def add_document(self, doc_id: int, tokens: list[str]) -> None:
        self._rows.append((doc_id, list(tokens)))
        self._index = None

    def finalize(self) -> ix.Index:
        if self._index is None:
            rows = SparkSession.active().createDataFrame(self._rows, "doc_id bigint, tokens array<string>")
            self._index = ix.dense_gaps(ix.index_tokens(rows))
        return self._index

    def lookup(self, term: str) -> DataFrame:
        return self.finalize().lookup(term)

    def save(self, path: str) -> None:
        save_index(self.finalize(), path, {"variant": "postings"})

    @classmethod
    def load(cls, path: str) -> InvertedIndex:
        return cls(load_index(SparkSession.active(), path))


class SortedPostings:
    """Postings lists sorted by document, filled entry by entry or from an index."""

    def __init__(self, index: ix.Index | None = None):
        self._rows: list[tuple[str, int, float]] = []
        self._index = index
        self._sizes: tuple[int, int] | None = None

    def insert(self, term: str, doc_id: int, tf: float) -> None:
        """Entries of one term and document add up."""
        self._rows.append((term, int(doc_id), float(tf)))
        self._sizes = None

    def _entries(self) -> DataFrame:
        """(term, doc_id, tf), in no order."""
        rows = SparkSession.active().createDataFrame(self._rows, "term string, doc_id bigint, tf double")
        if self._index is not None:
            rows = rows.unionByName(self._index.postings.select("term", "doc_id", F.col("tf").cast("double").alias("tf")))
        return rows.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))

    def finalize(self) -> DataFrame:
        """(term, doc_id, tf) in order."""
        return self._entries().repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")

    def lookup(self, term: str) -> DataFrame:
        """(doc_id, tf) of one term, by document."""
        return self._entries().where(F.col("term") == term).select("doc_id", "tf").orderBy("doc_id")

    def terms(self) -> DataFrame:
        return self._entries().select("term").distinct().orderBy("term")

    def sizes(self) -> tuple[int, int]:
        """(number of terms, bytes of all terms and entries), counted in one pass and kept.

        An index of distinct ids has its document frequencies without a shuffle of its entries.
        """
        if self._sizes is None:
            if self._index is not None and not self._rows and self._index.repeated_ids().isEmpty():
                lists = self._index.term_stats()
            else:
                lists = self._entries().groupBy("term").agg(F.count("*").alias("df"))
            n = F.coalesce(F.sum(F.col("df") * 8 + F.octet_length("term")), F.lit(0)).cast("bigint")
            self._sizes = tuple(lists.agg(F.count("*"), n).first())
        return self._sizes

    @property
    def num_terms(self) -> int:
        return self.sizes()[0]

    def empty(self) -> bool:
        return self._entries().isEmpty()

    def memory_bytes(self) -> int:
        """Bytes of all terms and entries: 4 an id and 4 a frequency."""
        return self.sizes()[1]
