"""Scores and rankings of queries over an index; one plan answers all queries at once.

Scores are rounded to six decimals before they are ranked, so equal documents rank
alike however their sums were ordered; ties go to the lower document id.  The terms of
queries are broadcast where they are counted to be few; postings never are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparklex.functions.scoring import Scoring
from sparklex.functions.tokenize import core_tokens, host_tokens, slices
from sparklex.operators.index import Index

ROUND = 6
#: Up to so many (query, term) rows are broadcast to the postings; a saved index can look
#: smaller than it is, and more rows than these are joined by a shuffle.
BROADCAST_TERMS = 1_000_000
#: An index that is not stored is made for the terms of a batch alone, if they are no more than these.
FOCUS_TERMS = 10_000
#: Up to so many queries and (query, term) rows go to every task, where documents are scored in their own rows; so many scores are held at once.
HELD_TERMS, CELLS = 200_000, 1 << 20
PLAIN_IDS = ("bigint", "int", "smallint", "tinyint", "string")


def one_query(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "query_id bigint, text string")


def query_terms(queries: DataFrame, tokenize: Callable[[Column], Column] = core_tokens) -> DataFrame:
    """(query_id, term, qtf): how often each term stands in each query of (query_id, text)."""
    return queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def focused(index: Index, terms: DataFrame, only: list[str] | None = None) -> Index:
    """The index for query terms; of one that isn't stored, what they need is made in one pass."""
    if index.tokens is None or index.terms is not None:
        return index
    found = [r["term"] for r in terms.select("term").distinct().limit(FOCUS_TERMS + 1).collect()] if only is None else only
    return index.focus(found if len(found) <= FOCUS_TERMS else None)


def weighted_terms(index: Index, terms: DataFrame, scoring: Scoring, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Query terms with statistics and weights, and the postings that they are to be joined with."""
    postings, stats = index.postings, index.terms
    if only is not None:
        postings = postings.where(F.col("term").isin(only))
        stats = stats.where(F.col("term").isin(only)) if stats is not None else None
    elif stats is None:
        postings = postings.join(terms.select("term").distinct(), "term", "left_semi")
    if stats is None:
        stats = Index(postings, index.doc_stats).term_stats()
    weighted = terms.join(stats, "term").crossJoin(F.broadcast(index.corpus_stats()))
    return weighted.withColumns({"idf": scoring.idf(), "term_k1": scoring.term_k1()}), postings


def matches(index: Index, terms: DataFrame, scoring: Scoring = Scoring(), only: list[str] | None = None) -> DataFrame:
    """(query_id, doc_id, score) of documents that hold a query term.

    ``only``: the terms, where the caller knows them; the filter then reaches the scan.
    """
    index = focused(index, terms, only)
    weighted, postings = weighted_terms(index, terms, scoring, only)
    few = len(only) if only is not None else terms.count()
    parts = postings.join(F.broadcast(weighted) if few <= BROADCAST_TERMS else weighted, "term").select("query_id", "doc_id", scoring.contribution().alias("score"))
    return parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), ROUND).alias("score"))


def rounded(x: np.ndarray) -> np.ndarray:
    """Halves go away from zero; numbers too large to have so many decimals stay."""
    y = np.abs(x) * 10.0**ROUND
    return np.where(y < 2.0**52, np.copysign(np.floor(y + 0.5) / 10.0**ROUND, x), x)


def scored_rows(index: Index, terms: DataFrame, scoring: Scoring, every: pa.Array | None = None, counted: bool = False) -> DataFrame:
    """(query_id, doc_id, score) from the rows that an index is made from, whose ids must be distinct.

    A row holds all of its document's terms, so its scores for all queries are summed up where
    it lies: neither postings nor scores are shuffled.  ``terms`` are few enough for every task
    to hold.  Scores of 0 are left out, or with ``every`` (ids of queries) all are returned.
    ``counted``: instead (query_id, n), how many other scores a query has in each run of documents.
    """
    weighted = weighted_terms(index, terms, scoring)[0].withColumn("avgdl", scoring.avgdl())
    held = weighted.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), F.col("term_k1").cast("double").alias("k1"), "avgdl").toArrow().sort_by("term").combine_chunks()
    kind = terms.schema["query_id"].dataType.simpleString()
    names = pc.unique(held.column("term"))
    code = pc.index_in(held.column("term"), value_set=names).to_numpy()
    from_, upto = np.searchsorted(code, np.arange(len(names))), np.searchsorted(code, np.arange(len(names)), "right")
    ids = held.column("query_id").combine_chunks().dictionary_encode("encode")
    of_query, known = ids.indices.to_numpy().astype(np.int64), ids.dictionary
    weight, k1 = held.column("weight").to_numpy(), held.column("k1").to_numpy()[from_]
    avgdl = float(held.column("avgdl")[0].as_py()) if held.num_rows else 1.0
    n, most = max(1, len(known)), CELLS
    if every is not None:
        column = pc.index_in(every, value_set=known, skip_nulls=True).fill_null(len(known)).to_numpy()  # of queries that match nothing: zeros

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Ids of some documents, and their scores by query."""
        for batch in batches:
            doc_id, dl, lists = batch.columns
            flat = lists.flatten()
            codes = pc.index_in(flat.field("term"), value_set=names)
            asked = codes.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())[asked]
            codes = codes.drop_null().to_numpy()
            lengths = dl.to_numpy().astype(np.float64)
            part = scoring.part(flat.field("tf").to_numpy()[asked].astype(np.float64), lengths[row], k1[codes], avgdl)
            times = upto[codes] - from_[codes]
            cells = np.maximum(np.bincount(row, times, batch.num_rows).astype(np.int64), max(n, 0 if every is None else len(every)))
            for rows in slices(pa.array(cells), most):
                here = slice(*np.searchsorted(row, [rows.start, rows.stop]))
                t = times[here]
                # the places of each posting's term among the query terms, one after another
                pairs = np.repeat(from_[codes[here]] - np.append(0, np.cumsum(t)[:-1])[: len(t)], t) + np.arange(t.sum())
                cell = np.repeat(row[here] - rows.start, t) * n + of_query[pairs]
                size = rows.stop - rows.start
                yield doc_id[rows], rounded(np.bincount(cell, weight[pairs] * np.repeat(part[here], t), size * n)).reshape(size, n)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, sums in summed(batches):
            if every is None:
                there = np.flatnonzero(sums != 0)
                yield pa.record_batch([known.take(pa.array(there % n)), docs.take(pa.array(there // n)), pa.array(sums.ravel()[there])], ["query_id", "doc_id", "score"])
            else:
                wide = np.hstack([sums[:, : len(known)], np.zeros((len(docs), 1))])[:, column]
                ids = every.take(pa.array(np.tile(np.arange(len(every)), len(docs))))
                yield pa.record_batch([ids, docs.take(pa.array(np.repeat(np.arange(len(docs)), len(every)))), pa.array(wide.ravel())], ["query_id", "doc_id", "score"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(n, np.int64)
        for _, sums in summed(batches):
            found += np.count_nonzero(sums, axis=0)
        there = np.flatnonzero(found)
        yield pa.record_batch([known.take(pa.array(there)), pa.array(found[there])], ["query_id", "n"])

    rows = index.forward.select("doc_id", "dl", "terms")
    if counted:
        return rows.mapInArrow(count, f"query_id {kind}, n bigint")
    return rows.mapInArrow(score, f"query_id {kind}, doc_id bigint, score double")


def filled(found: DataFrame, index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of every query and document, zeros included."""
    every = queries.select("query_id").crossJoin(index.doc_ids())
    return every.join(found, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def ranked(found: DataFrame, index: Index, queries: DataFrame, n: int, pad: bool = True) -> DataFrame:
    """(query_id, rank, doc_id, score) of the best n; with fewer matches, the lowest ids follow with score 0.

    The padding joins n documents to each query, never all of them.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    top = found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= n)
    if not pad:
        return top.select("query_id", "rank", "doc_id", "score")
    lowest = index.lowest(n)
    zero = queries.select("query_id").crossJoin(F.broadcast(lowest)).join(top, ["query_id", "doc_id"], "left_anti")
    both = top.drop("rank").unionByName(zero.withColumn("score", F.lit(0.0)))
    return both.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= n).select("query_id", "rank", "doc_id", "score")


class Searcher:
    """An index, its tokenizer and a scoring function."""

    def __init__(self, index: Index, scoring: Scoring = Scoring(), tokenize: Callable[[Column], Column] = core_tokens):
        self.index, self.scoring, self.tokenize = index, scoring, tokenize
        self.spark = index.postings.sparkSession

    def _one(self, query: str | list[str]) -> tuple[DataFrame, DataFrame]:
        """A query is a text, or the list of its terms."""
        asked = one_query(self.spark, query if isinstance(query, str) else None)
        known = host_tokens(self.tokenize, query) if isinstance(query, str) else list(query)
        if known is None:  # only Spark can tell
            known = asked.select(self.tokenize(F.col("text")).alias("t")).first()["t"]
        counts = Counter(known)
        terms = self.spark.createDataFrame([(0, t, n) for t, n in counts.items()], "query_id bigint, term string, qtf bigint")
        return asked, matches(self.index, terms, self.scoring, sorted(counts))

    def matching(self, query: str) -> DataFrame:
        """(doc_id, score) of documents that hold a term of the query."""
        return self._one(query)[1].select("doc_id", "score")

    def scores(self, query: str) -> DataFrame:
        """(doc_id, score) of every document."""
        found = self._one(query)[1].select("doc_id", "score")
        return self.index.doc_ids().join(found, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def top_n(self, query: str, n: int = 5, pad: bool = True) -> DataFrame:
        """(doc_id, score), best first."""
        if n < 0:
            raise ValueError("n is 0 at least")
        order = [F.desc("score"), "doc_id"]
        top = self._one(query)[1].select("doc_id", "score").orderBy(*order).limit(n)
        if pad:
            # among the n lowest ids, as many don't match as places can be left
            zero = self.index.lowest(n).join(top, "doc_id", "left_anti").withColumn("score", F.lit(0.0))
            top = top.unionByName(zero).orderBy(*order).limit(n)
        return top

    def top_n_docs(self, query: str, docs: DataFrame, n: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(rank, doc_id, text), best first."""
        ranks = self.top_n(query, n).groupBy().agg(F.collect_list(F.struct("score", "doc_id")).alias("l"))
        ranks = ranks.select(F.posexplode(F.array_sort("l", lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).otherwise(F.when(a["doc_id"] < b["doc_id"], -1).otherwise(1)))).alias("pos", "x"))
        ranks = ranks.select((F.col("pos") + 1).cast("bigint").alias("rank"), F.col("x.doc_id").alias("doc_id"))
        return ranks.join(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id").select("rank", "doc_id", "text").orderBy("rank")

    def _by_rows(self, queries: DataFrame) -> tuple[Index, DataFrame, bool]:
        """What a batch reads, its terms, and whether documents are scored in their own rows.

        They are if the index is made from rows of distinct ids and every task can hold the queries.
        """
        terms = query_terms(queries, self.tokenize)
        index = focused(self.index, terms)
        fine = index.forward is not None and index.terms is None and terms.schema["query_id"].dataType.simpleString() in PLAIN_IDS
        fine = fine and terms.count() <= HELD_TERMS and index.repeated_ids().isEmpty()
        return index, terms, fine

    def batch(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of queries (query_id, text): the sparse matrix, without zeros."""
        index, terms, by_rows = self._by_rows(queries)
        if by_rows:
            return scored_rows(index, terms, self.scoring)
        return matches(index, terms, self.scoring).where("score != 0")

    def batch_counts(self, queries: DataFrame) -> DataFrame:
        """(query_id, n): entries of each query in the sparse matrix, which is not made for it; queries without entries have no row."""
        index, terms, by_rows = self._by_rows(queries)
        if by_rows:
            return scored_rows(index, terms, self.scoring, counted=True).groupBy("query_id").agg(F.sum("n").alias("n"))
        return matches(index, terms, self.scoring).where("score != 0").groupBy("query_id").agg(F.count("*").alias("n"))

    def batch_dense(self, queries: DataFrame) -> DataFrame:
        index, terms, by_rows = self._by_rows(queries)
        if by_rows and index.dense is None and queries.count() <= HELD_TERMS:
            return scored_rows(index, terms, self.scoring, queries.select("query_id").toArrow().column("query_id").combine_chunks())
        return filled(matches(index, terms, self.scoring), index, queries)

    def batch_top_n(self, queries: DataFrame, n: int = 5, pad: bool = True) -> DataFrame:
        return ranked(self.batch(queries), self.index, queries, n, pad)
