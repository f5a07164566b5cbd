"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RRFScorer:
    """Adds 1 / (k + rank) over rankings; only ranks count, scores don't.

    A ranking is a DataFrame (rank, doc_id), ranks from 1 on, or a list of
    (score, doc_id) pairs in order.  A document twice in a ranking counts twice.
    """

    def __init__(self, k: float = 60.0):
        self.k = float(k)
        self._rankings: list[DataFrame] = []

    def add_ranking(self, ranking) -> None:
        if not isinstance(ranking, DataFrame):
            from pyspark.sql import SparkSession

            pairs = [(i + 1, int(pair[1])) for i, pair in enumerate(ranking)]
            ranking = SparkSession.active().createDataFrame(pairs, "rank bigint, doc_id bigint")
        self._rankings.append(ranking.select(F.col("rank").cast("bigint"), F.col("doc_id").cast("bigint")))

    def fused(self) -> DataFrame:
        """(doc_id, score) of every document of any ranking, rounded to nine decimals."""
        if not self._rankings:
            raise ValueError("no ranking was added")
        rows = self._rankings[0]
        for other in self._rankings[1:]:
            rows = rows.unionByName(other)
        return rows.groupBy("doc_id").agg(F.round(F.sum(1.0 / (F.lit(self.k) + F.col("rank"))), 9).alias("score"))

    def fuse(self, top_n: int = 10) -> DataFrame:
        """(doc_id, score), best first; ties go to the lower id."""
        return self.fused().orderBy(F.desc("score"), "doc_id").limit(top_n)

    def reset(self) -> None:
        self._rankings = []

    def __repr__(self) -> str:
        return f"RRFScorer(k={self.k:g}, rankings={len(self._rankings)})"
