"""Index tables: postings and document lengths; all statistics follow by plain sums.

``postings(term, doc_id, tf, dl)`` carries the document length, so that scoring joins
postings with a few query terms and nothing else.  ``doc_stats(doc_id, dl)`` has a row
for every document, empty ones included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklex.functions.codec import blocked
from sparklex.functions.tokenize import core_case, core_tokens, core_words, slices
from sparklex.sources.scratch import written


@dataclass(frozen=True)
class Index:
    """Tables of an index.

    ``terms`` and ``corpus`` hold statistics that were stored; without them they are
    summed up when asked for.  ``dense``: the documents are 0 to dense - 1, those
    without a row in doc_stats being empty.  ``forward`` holds what the tables are made
    from, a row (doc_id, dl, terms) for each document, so that a saved index needs to
    tokenize only once, and ``tokens`` (doc_id, tokens) what those rows are made from.
    ``texts`` (doc_id, text) are there if the tokens are those of core_words, ``lowercase`` or not.
    """

    postings: DataFrame
    doc_stats: DataFrame
    terms: DataFrame | None = None
    corpus: DataFrame | None = None
    dense: int | None = None
    forward: DataFrame | None = None
    tokens: DataFrame | None = None
    texts: DataFrame | None = None
    lowercase: bool = True

    @classmethod
    def of_forward(cls, rows: DataFrame) -> Index:
        postings = rows.select("doc_id", "dl", F.inline("terms"))
        return cls(postings.select("term", "doc_id", "tf", "dl"), rows.select("doc_id", "dl"), forward=rows)

    def term_stats(self) -> DataFrame:
        """(term, df, cf)."""
        if self.terms is not None:
            return self.terms
        if self.tokens is not None:
            return token_stats(self.tokens)
        return self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def focus(self, terms: list[str] | None) -> Index:
        """The index as far as a search for these terms (None: for any) needs it.

        An index that is not stored is made in one pass over its texts and written, as a search
        reads postings, their statistics and those of the corpus.
        """
        if self.tokens is None or self.terms is not None:
            return self
        if self.texts is None or terms is None:
            rows = forward_rows(self.tokens, terms)
        else:
            rows = forward_words(self.texts, terms, self.lowercase)
        return replace(Index.of_forward(written(rows, "focused")), dense=self.dense)

    def corpus_stats(self) -> DataFrame:
        """One row (n_docs, total_len)."""
        if self.corpus is not None:
            return self.corpus
        n = F.count("*") if self.dense is None else F.lit(self.dense).cast("bigint")
        return self.doc_stats.agg(n.alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("total_len"))

    def lookup(self, term: str) -> DataFrame:
        """Postings of one term."""
        return self.postings.where(F.col("term") == term)

    def doc_ids(self) -> DataFrame:
        """(doc_id) of every document."""
        if self.dense is None:
            return self.doc_stats.select("doc_id")
        return self.postings.sparkSession.range(self.dense).withColumnRenamed("id", "doc_id")

    def lowest(self, n: int) -> DataFrame:
        """(doc_id) of the n lowest ids."""
        if self.dense is None:
            return self.doc_stats.select("doc_id").orderBy("doc_id").limit(n)
        return self.postings.sparkSession.range(min(n, self.dense)).withColumnRenamed("id", "doc_id")

    def explicit(self) -> Index:
        """The index with a row of doc_stats for every document."""
        if self.dense is None:
            return self
        rows = self.doc_ids().join(self.doc_stats, "doc_id", "left")
        return Index(self.postings, rows.select("doc_id", F.coalesce("dl", F.lit(0)).cast("bigint").alias("dl")))

    def repeated_ids(self) -> DataFrame:
        """(doc_id) of ids that two documents have; texts are not tokenized for it."""
        return self.doc_stats.groupBy("doc_id").count().where("count > 1").select("doc_id")

    def checked(self) -> Index:
        """Raises ValueError where two documents have one id."""
        if not self.repeated_ids().isEmpty():
            raise ValueError("a document id was given twice")
        return self

    def persist(self) -> Index:
        """Keeps what searches read: the rows that all tables are made from, or else the tables."""
        if self.forward is not None:
            return replace(Index.of_forward(self.forward.persist()), terms=self.terms, corpus=self.corpus, dense=self.dense)
        kept = replace(self, postings=self.postings.persist(), doc_stats=self.doc_stats.persist(), tokens=None, texts=None)
        return replace(kept, terms=kept.term_stats().persist(), corpus=kept.corpus_stats().persist())

    def unpersist(self) -> None:
        for table in (self.forward, self.postings, self.doc_stats, self.terms, self.corpus):
            if table is not None:
                table.unpersist()


def index_tokens(docs: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens") -> Index:
    """Index of (doc_id, array of tokens); a null array is empty, rows with a null id are left out.

    Ids must be distinct, as models and saved indexes check (``Index.checked``).
    """
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias("tokens")).where("doc_id is not null")
    return replace(Index.of_forward(forward_rows(own)), tokens=own)


def forward_rows(docs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(doc_id, dl, terms) of (doc_id, tokens): lengths of documents, and their counts of all terms or of some only."""
    counted = F.col("tokens") if only is None else F.filter("tokens", lambda t: t.isin(only))
    return docs.select("doc_id", F.size("tokens").cast("bigint").alias("dl"), term_counts(counted).alias("terms"))


def forward_words(docs: DataFrame, only: list[str], lowercase: bool = True) -> DataFrame:
    """``forward_rows`` of the core tokens of (doc_id, text), which are counted where the texts lie and never become rows."""
    terms = pa.array(sorted(set(only)), pa.large_string())
    names = terms.cast(pa.string())
    n = max(1, len(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dl = np.zeros(batch.num_rows, np.int64)
            keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for tokens, bounds in core_words(batch.column(1), lowercase):
                dl += np.diff(bounds)
                codes = pc.index_in(tokens, value_set=terms)
                hits = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
                row = np.searchsorted(bounds, hits, "right") - 1
                found = np.unique(row * n + codes.drop_null().to_numpy(), return_counts=True)
                keys.append(found[0])
                times.append(found[1])
            pairs, place = np.unique(np.concatenate(keys), return_inverse=True)
            tf = np.zeros(len(pairs), np.int64)
            np.add.at(tf, place, np.concatenate(times))
            ends = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * n).astype(np.int32)
            counts = pa.StructArray.from_arrays([names.take(pa.array(pairs % n)), pa.array(tf)], ["term", "tf"])
            yield pa.record_batch([batch.column(0), pa.array(dl), pa.ListArray.from_arrays(pa.array(ends), counts)], ["doc_id", "dl", "terms"])

    return docs.mapInArrow(count, "doc_id bigint, dl bigint, terms array<struct<term:string,tf:bigint>>")


#: Tokens that ``token_stats`` counts at once.
COUNTED = 1 << 20


def token_stats(docs: DataFrame) -> DataFrame:
    """(term, df, cf) of (doc_id, tokens).

    Tokens are counted by runs of documents, so that only distinct terms of a run are aggregated.
    """
    most = COUNTED

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = pc.list_value_length(lists)
            for rows in slices(sizes, most):
                flat = lists[rows].flatten().dictionary_encode()
                there = flat.indices.is_valid().to_numpy(zero_copy_only=False)
                codes = flat.indices.fill_null(0).to_numpy().astype(np.int64)[there]
                doc = np.repeat(np.arange(rows.stop - rows.start), sizes[rows].to_numpy())[there]
                n = len(flat.dictionary)
                pairs = np.sort(doc * n + codes)
                df = np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] % max(1, n), minlength=n)
                yield pa.record_batch([flat.dictionary, pa.array(df), pa.array(np.bincount(codes, minlength=n))], ["term", "df", "cf"])

    parts = docs.select("tokens").mapInArrow(count, "term string, df bigint, cf bigint")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def term_counts(tokens: Column) -> Column:
    """array<struct<term, tf>> of an array of tokens: lengths of the runs of the sorted array.

    A document's terms are counted in its own row, so postings need no shuffle to be counted.
    """

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        # a lambda's variable holds the array, which is then made once
        return F.transform(F.array(starts), lambda at: F.transform(at, lambda v, j: F.struct(F.element_at(s, v).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s) + 1) - v).cast("bigint").alias("tf"))))[0]

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.transform(F.array(F.sort_array(F.filter(tokens, lambda t: t.isNotNull()))), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(none))[0]


def index_text(docs: DataFrame, tokenize: Callable[[Column], Column] = core_tokens, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Index of (doc_id, text); a null text is an empty document."""
    made = index_tokens(docs.select(F.col(doc_id).alias("doc_id"), tokenize(F.col(text)).alias("tokens")))
    lowercase = core_case(tokenize)
    if lowercase is None:
        return made
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return replace(made, texts=texts.where("doc_id is not null"), lowercase=lowercase)


def index_fields(docs: DataFrame, weights: dict[str, float], tokenize: Callable[[Column], Column] = core_tokens, doc_id: str = "doc_id", fields: str = "fields") -> Index:
    """Index of (doc_id, map field -> text): tf is the weighted sum over fields, a double.

    Fields without a weight are ignored; a field of weight 0 still counts for df.
    """
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(fields).alias("f")).where("doc_id is not null")

    def weighted(field: str, weight: float) -> Column:
        return F.transform(tokenize(F.col("f").getItem(field)), lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("w")))

    parts = [weighted(*x) for x in weights.items()]
    whole = F.concat(*parts) if parts else F.array().cast("array<struct<term:string,w:double>>")
    own = own.select("doc_id", F.coalesce(whole, F.array().cast("array<struct<term:string,w:double>>")).alias("t"))
    own = own.withColumn("dl", F.size("t").cast("bigint"))
    rows = own.select("doc_id", "dl", F.explode("t").alias("x")).select("doc_id", "dl", "x.*")
    postings = rows.groupBy("term", "doc_id", "dl").agg(F.sum("w").alias("tf"))
    return Index(postings.select("term", "doc_id", "tf", "dl"), own.select("doc_id", "dl"))


def field_stats(docs: DataFrame, tokenize: Callable[[Column], Column] = core_tokens, doc_id: str = "doc_id", fields: str = "fields") -> DataFrame:
    """(field, total_len, avgdl): lengths by field, averaged over all documents."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(fields).alias("f"))
    n = own.agg(F.count("*").alias("n"))
    each = own.select(F.explode("f").alias("field", "text")).select("field", F.size(tokenize(F.col("text"))).cast("bigint").alias("l"))
    return each.groupBy("field").agg(F.sum("l").alias("total_len")).crossJoin(n).select("field", "total_len", (F.col("total_len") / F.col("n")).alias("avgdl"))


def focused(docs: DataFrame, terms: list[str], tokenize: Callable[[Column], Column] = core_tokens, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, dl, terms): the length of every document, and its counts of some terms only.

    One pass over the texts that gives all that searches for those terms need: the index
    ``Index.of_forward`` of these rows is that of the corpus, less postings of other terms.
    """
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), tokenize(F.col(text)).alias("tokens")).where("doc_id is not null")
    return forward_rows(own, terms)


def merge(*indexes: Index) -> Index:
    """Union of indexes over distinct documents; equals an index of all the documents."""
    out = indexes[0].explicit()
    for other in map(Index.explicit, indexes[1:]):
        out = Index(out.postings.unionByName(other.postings), out.doc_stats.unionByName(other.doc_stats))
    return out


def shift_ids(table: DataFrame, by: int) -> DataFrame:
    return table.withColumn("doc_id", F.col("doc_id") + F.lit(by).cast("bigint"))


def without(table: DataFrame, doc_id: int, renumber: bool = True) -> DataFrame:
    """A table by doc_id less one document; with ``renumber`` later ids move down by one."""
    rest = table.where(F.col("doc_id") != F.lit(doc_id))
    return rest.withColumn("doc_id", F.col("doc_id") - (F.col("doc_id") > F.lit(doc_id)).cast("bigint")) if renumber else rest


def add_documents(index: Index, docs: Index) -> Index:
    """Appends documents whose ids go on after the index's; only their own text is read."""
    return merge(index, docs)


def remove_document(index: Index, doc_id: int, renumber: bool = True) -> Index:
    index = index.explicit()
    return Index(without(index.postings, doc_id, renumber), without(index.doc_stats, doc_id, renumber))


def dense_gaps(index: Index) -> Index:
    """Index in which every id missing from 0 to the largest is an empty document; no row is made for them."""
    last = index.doc_stats.agg(F.max("doc_id")).first()[0]
    return replace(index, terms=None, corpus=None, dense=0 if last is None else last + 1)


def sorted_postings(index: Index) -> DataFrame:
    """(term, block, entries): postings as arrays sorted by document, one for each range of BLOCK_IDS ids, which bounds them."""
    entries = F.sort_array(F.collect_list(F.struct("doc_id", "tf")))
    return blocked(index.postings).groupBy("term", "block").agg(entries.alias("entries"))
