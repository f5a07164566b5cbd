"""Registered queries of the search engine, each over whole tables, with DuckDB SQL.

``QUERIES``: name -> function of (spark, folder of tables); ``ORACLES``: name -> SQL
for the same rows over views named like the tables.
"""

from __future__ import annotations

import asyncio
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklex.functions import codec
from sparklex.functions.porter import is_stopword, simple_tokens, stem
from sparklex.functions.scoring import Scoring
from sparklex.functions.tokenize import CORE_PATTERN, ENGLISH_STOPWORDS, SPACE_PATTERN, WORD_PATTERN, Analyzer, Tokenizer, core_tokens, host_tokens, stemmed
from sparklex.models import BM25, BM25F, AsyncBatchMixin, CompressedBM25, InvertedIndex, MmapBM25, SortedPostings, StreamingBM25Builder, check_jobs, query_frame, text_frame
from sparklex.operators import index as ix
from sparklex.operators.fusion import RRFScorer
from sparklex.operators.search import Searcher
from sparklex.sources.scratch import scratch_path
from sparklex.sources.store import load_index, save_index
from sparklex.streaming.build import StreamingIndexBuilder

QUERY = "the onenth edonre and with the ring"
FIELD_QUERY = "small ring brand economy"
WEIGHTS = {"p_name": 2.0, "p_brand": 1.0, "p_type": 1.0}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            ORACLES[key] = sql
        return function

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items as queries."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select(F.col("p_partkey").alias("doc_id"), F.create_map(*[x for f in WEIGHTS for x in (F.lit(f), F.col(f))]).alias("fields"))


def document_index(spark: SparkSession, sf_dir: str, tokenize=core_tokens) -> ix.Index:
    return ix.index_text(documents(spark, sf_dir), tokenize)


def appended(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """documents, and the benchmark's texts under the ids that follow."""
    docs = documents(spark, sf_dir)
    last = docs.agg(F.max("doc_id").alias("last"))
    new = spark.read.parquet(f"{sf_dir}/benchmark.parquet").crossJoin(last).select((F.col("item_id") + F.col("last") + 1).alias("doc_id"), "text")
    return docs.select("doc_id", "text"), new


# ---------------------------------------------------------------- SQL of the oracles


def token_sql(pattern: str = CORE_PATTERN, each: str = "lower(x)", keep: str = "true", text: str = "text") -> str:
    pattern = pattern.replace("'", "''")
    return f"list_filter(list_transform(regexp_extract_all(coalesce({text}, ''), '{pattern}'), lambda x: {each}), lambda x: {keep})"


CORE = token_sql()
DOCS = "select doc_id, text from documents where doc_id is not null"
BOTH = f"{DOCS} union all select item_id + 1 + (select max(doc_id) from documents), text from benchmark"
WITHOUT_17 = "select doc_id - (doc_id > 17)::int as doc_id, text from documents where doc_id != 17"


def index_sql(tokens: str = CORE, docs: str = DOCS) -> str:
    return f"""
with toks as (select doc_id, {tokens} as t from ({docs})),
lens as (select doc_id, len(t)::bigint as dl from toks),
postings as (select term, doc_id, count(*)::bigint as tf from (select doc_id, unnest(t) as term from toks) group by term, doc_id),
stats as (select term, count(*)::bigint as df, sum(tf)::bigint as cf from postings group by term),
corpus as (select count(*)::double as n, sum(dl)::double as total from lens)
"""


def field_index_sql(weights: dict[str, float]) -> str:
    each = " union all ".join(f"select p_partkey as doc_id, unnest({token_sql(text=f)}) as term, {w!r}::double as w from part" for f, w in weights.items())
    return f"""
with lens as (select p_partkey as doc_id, 0::bigint as dl from part),
postings as (select term, doc_id, sum(w) as tf from ({each}) group by term, doc_id),
stats as (select term, count(*)::bigint as df, sum(tf) as cf from postings group by term),
corpus as (select count(*)::double as n, 1.0::double as total from lens)
"""


def literal(text: str) -> str:
    return f"select 0::bigint as query_id, '{text}' as text"


def scored_sql(scoring: Scoring, queries: str, tokens: str = CORE, base: str | None = None) -> str:
    """CTEs up to ``found``(query_id, doc_id, score) and ``every``, which has zeros too."""
    k1, b, d = f"{scoring.k1!r}::double", f"{scoring.b!r}::double", f"{scoring.delta!r}::double"
    idf = "ln((n - df + 0.5::double) / (df + 0.5::double) + 1.0::double)"
    if scoring.variant != "compact":
        idf = f"greatest({scoring.epsilon!r}::double, {idf})"
    k = f"({k1} * ln(1.0::double + cf / df::double))" if scoring.variant == "adpt" else k1
    avgdl = "greatest(1.0::double, total / n)" if scoring.variant == "compact" else "(total / n)"
    norm = f"(1.0::double - {b} + {b} / {avgdl} * dl)"
    core = f"tf * ({k} + 1.0::double) / (tf + {k} * {norm})"
    part = {
        "plus": f"({core} + {d})",
        "l": f"(({k} + 1.0::double) * (tf / {norm}) / ({k} + tf / {norm}) + {d})",
        "field": f"tf * ({k} + 1.0::double) / (tf + {k})",
    }.get(scoring.variant, core)
    return f"""{base or index_sql(tokens)},
queries as ({queries}),
terms as (select query_id, term, count(*) as qtf from (select query_id, unnest({tokens}) as term from queries) group by query_id, term),
found as (
    select query_id, doc_id, round(sum(qtf * {idf} * {part}), 6) as score
    from terms join stats using (term) join postings using (term) join lens using (doc_id) cross join corpus
    group by query_id, doc_id
),
every as (select q.query_id, l.doc_id, coalesce(f.score, 0.0) as score from queries q cross join lens l left join found f on f.query_id = q.query_id and f.doc_id = l.doc_id)
"""


def top_sql(n: int, scored: str, columns: str = "doc_id, score") -> str:
    return f"{scored} select {columns} from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from every) where rank <= {n}"


ALL_TERMS = " select term, df, cf from stats"

# ---------------------------------------------------------------- tokens and statistics

TOKENIZERS = {
    "tokenize_default": (core_tokens, CORE),
    "tokenize_cased": (Analyzer.of(lowercase=False), token_sql(each="x")),
    "tokenize_unicode_word": (Tokenizer("unicode_word"), token_sql(WORD_PATTERN, "replace(lower(x), 'ß', 'ss')")),
    "tokenize_whitespace": (Tokenizer("whitespace"), token_sql(SPACE_PATTERN, "replace(lower(x), 'ß', 'ss')")),
    "tokenize_regex_custom": (Tokenizer("regex", pattern="[A-Za-z]+"), token_sql("[A-Za-z]+")),
    "tokenize_stopwords": (Analyzer.of(stopwords="english", extra_stopwords=["tion"]), token_sql(keep="x not in (" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({*ENGLISH_STOPWORDS, "tion"})) + ")")),
    "tokenize_min_len": (Tokenizer("unicode_word", min_token_len=3), token_sql(WORD_PATTERN, "replace(lower(x), 'ß', 'ss')", "length(x) >= 3")),
    "tokenize_composed": (Analyzer.of("whitespace", stopwords=["and", "the"]), token_sql(SPACE_PATTERN, "replace(lower(x), 'ß', 'ss')", "x not in ('and', 'the')")),
}
for _name, (_tokenize, _sql) in TOKENIZERS.items():
    query(index_sql(_sql) + ALL_TERMS, _name)(lambda spark, sf_dir, t=_tokenize: document_index(spark, sf_dir, t).term_stats())


@query()
def tokenize_porter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir, Analyzer.of(stemmer=stem)).term_stats()


@query(index_sql() + " select doc_id, dl from lens")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).doc_stats


@query(index_sql() + " select n::bigint as n_docs, total::bigint as total_len, round(total / n, 6) as avgdl from corpus")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).corpus_stats().withColumn("avgdl", F.round(F.col("total_len") / F.col("n_docs"), 6))


@query(index_sql() + " select term, df, cf, round(greatest(0.25::double, ln((n - df + 0.5::double) / (df + 0.5::double) + 1.0::double)), 6) as idf from stats cross join corpus")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = document_index(spark, sf_dir)
    rows = index.term_stats().crossJoin(F.broadcast(index.corpus_stats()))
    return rows.select("term", "df", "cf", F.round(Scoring().idf(), 6).alias("idf"))


@query(index_sql() + " select term, round(1.5::double * ln(1.0::double + cf / df::double), 6) as term_k1 from stats")
def adaptive_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).term_stats().select("term", F.round(Scoring("adpt").term_k1(), 6).alias("term_k1"))


@query(index_sql() + " select term, doc_id, tf from postings")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).postings.select("term", "doc_id", "tf")


@query(index_sql() + " select term, doc_id // 65536 as block, string_agg(doc_id::varchar || ':' || tf::varchar, ' ' order by doc_id) as entries from postings group by term, doc_id // 65536")
def sorted_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ix.sorted_postings(document_index(spark, sf_dir))
    return lists.select("term", "block", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["doc_id"].cast("string"), e["tf"].cast("string"))), " ").alias("entries"))


@query(index_sql() + " select term, doc_id, tf from postings where term = 'the'")
def postings_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).lookup("the").select("term", "doc_id", "tf")


@query(index_sql() + " select term from stats")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).term_stats().select("term")


@query("select f as field, sum(l)::bigint as total_len, round(sum(l) / (select count(*) from part), 6) as avgdl from (" + " union all ".join(f"select '{f}' as f, len({token_sql(text=f)}) as l from part" for f in WEIGHTS) + ") group by f")
def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.field_stats(parts(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


# ---------------------------------------------------------------- scores and rankings

ONE = literal(QUERY)
MANY = "select item_id as query_id, text from benchmark"
SCORINGS = {
    "okapi": Scoring(),
    "plus": Scoring("plus"),
    "l": Scoring("l"),
    "adpt": Scoring("adpt"),
    "compressed_okapi": Scoring("compact"),
    "okapi_custom_params": Scoring(k1=1.2, b=0.5, epsilon=0.1),
    "okapi_epsilon_floor": Scoring(epsilon=2.0),
}
for _name, _scoring in SCORINGS.items():
    query(scored_sql(_scoring, ONE) + " select doc_id, score from every", f"{_name}_scores")(lambda spark, sf_dir, s=_scoring: Searcher(document_index(spark, sf_dir), s).scores(QUERY))
    query(top_sql(10, scored_sql(_scoring, ONE)), f"{_name}_top10")(lambda spark, sf_dir, s=_scoring: Searcher(document_index(spark, sf_dir), s).top_n(QUERY, 10))
    if _name in ("okapi", "plus", "l", "adpt"):
        query(top_sql(10, scored_sql(_scoring, MANY), "query_id, rank, doc_id, score"), f"{_name}_batch_top10")(lambda spark, sf_dir, s=_scoring: Searcher(document_index(spark, sf_dir), s).batch_top_n(asked(spark, sf_dir), 10))


@query(scored_sql(Scoring(), ONE) + " select doc_id, score from found")
def okapi_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(document_index(spark, sf_dir)).matching(QUERY)


@query(f"select rank, doc_id, text from ({top_sql(10, scored_sql(Scoring(), ONE), 'rank, doc_id')}) join documents using (doc_id)")
def okapi_top10_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(document_index(spark, sf_dir)).top_n_docs(QUERY, documents(spark, sf_dir), 10)


@query(scored_sql(Scoring(), MANY) + " select query_id, doc_id, score from every")
def okapi_batch_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(document_index(spark, sf_dir)).batch_dense(asked(spark, sf_dir))


@query(scored_sql(Scoring(), MANY) + " select query_id, doc_id, score from found where score != 0")
def okapi_batch_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(document_index(spark, sf_dir)).batch(asked(spark, sf_dir))


@query(scored_sql(Scoring(), MANY) + " select query_id, sum(n) over (order by query_id)::bigint as indptr from (select q.query_id, count(f.doc_id) as n from queries q left join found f on f.query_id = q.query_id and f.score != 0 group by q.query_id)")
def okapi_batch_indptr(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = asked(spark, sf_dir)
    return codec.row_ends(Searcher(document_index(spark, sf_dir)).batch_counts(queries), queries)


FIELD = scored_sql(Scoring("field"), literal(FIELD_QUERY), base=field_index_sql(WEIGHTS))
NO_TYPE = {**WEIGHTS, "p_type": 0.0}


@query(FIELD + " select doc_id, score from every")
def bm25f_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(ix.index_fields(parts(spark, sf_dir), WEIGHTS), Scoring("field")).scores(FIELD_QUERY)


@query(top_sql(10, FIELD))
def bm25f_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(ix.index_fields(parts(spark, sf_dir), WEIGHTS), Scoring("field")).top_n(FIELD_QUERY, 10)


@query(scored_sql(Scoring("field"), literal(FIELD_QUERY), base=field_index_sql(NO_TYPE)) + " select doc_id, score from every")
def bm25f_zero_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(ix.index_fields(parts(spark, sf_dir), NO_TYPE), Scoring("field")).scores(FIELD_QUERY)


_fused = " union all ".join(f"(select doc_id, rank from ({top_sql(100, scored_sql(Scoring(v), ONE), 'doc_id, rank')}))" for v in ("okapi", "plus"))


@query(f"select doc_id, round(sum(1.0::double / (60.0::double + rank)), 9) as score from ({_fused}) group by doc_id order by score desc, doc_id limit 10")
def rrf_okapi_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one pass over the texts serves both variants
    terms = sorted(set(host_tokens(core_tokens, QUERY)))
    index = document_index(spark, sf_dir).focus(terms)
    one = spark.createDataFrame([(0, QUERY)], "query_id bigint, text string")
    fusion = RRFScorer(60.0)
    for variant in ("okapi", "plus"):
        fusion.add_ranking(Searcher(index, Scoring(variant)).batch_top_n(one, 100))
    return fusion.fuse(10)


# ---------------------------------------------------------------- encodings


@query(index_sql() + " select term, doc_id, doc_id - lag(doc_id, 1, 0) over (partition by term order by doc_id) as gap from postings")
def postings_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.gaps(document_index(spark, sf_dir).postings).select("term", "doc_id", "gap")


@query(index_sql() + " select term, doc_id, tf from postings")
def postings_delta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    gapped = codec.gaps(document_index(spark, sf_dir).postings).withColumnRenamed("doc_id", "at")
    return codec.ids_of_gaps(gapped, "at").select("term", "doc_id", "tf")


@query(index_sql() + " select term, doc_id, tf::double as tf from postings")
def postings_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.decoded_postings(codec.encoded_postings(document_index(spark, sf_dir).postings))


def _bytes_sql(x: str) -> str:
    return "(1 + " + " + ".join(f"({x} >= {1 << bits})::int" for bits in range(7, 63, 7)) + ")"


@query(index_sql() + f", gaps as (select term, doc_id - lag(doc_id, 1, 0) over (partition by term order by doc_id) as gap from postings) select count(distinct term)::bigint as n_terms, (sum({_bytes_sql('gap')} + 5) + (select sum({_bytes_sql('df')}) from stats))::bigint as compressed_bytes from gaps")
def compressed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.compressed_bytes(document_index(spark, sf_dir).postings)


# ---------------------------------------------------------------- changes and storage


@query(scored_sql(Scoring(), ONE, base=index_sql(docs=BOTH)) + " select doc_id, score from every")
def add_documents_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, new = appended(spark, sf_dir)
    return Searcher(ix.add_documents(ix.index_text(docs), ix.index_text(new))).scores(QUERY)


@query(scored_sql(Scoring(), ONE, base=index_sql(docs=WITHOUT_17)) + " select doc_id, score from every")
def remove_document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(ix.remove_document(document_index(spark, sf_dir), 17)).scores(QUERY)


@query(index_sql(docs=BOTH) + ALL_TERMS)
def shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.merge(*map(ix.index_text, appended(spark, sf_dir))).term_stats()


@query(top_sql(10, scored_sql(Scoring(), ONE)))
def save_load_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "index")
    save_index(document_index(spark, sf_dir), path)
    return Searcher(load_index(spark, path)).top_n(QUERY, 10)


@query(top_sql(10, scored_sql(Scoring("compact"), ONE)))
def streaming_build_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "streamed")
    docs = documents(spark, sf_dir)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/documents.parquet*")  # a file or a folder
    builder = StreamingIndexBuilder(spark, path, tokenize=core_tokens)
    builder.consume(stream, f"{path}-progress")
    builder.build()
    return Searcher(load_index(spark, path), Scoring("compact")).top_n(QUERY, 10)


SPLIT = "list_filter(string_split(lower(coalesce(text, '')), ' '), lambda x: x != '')"


def split_at_blanks(text: str) -> list[str]:
    return [t for t in text.lower().split(" ") if t]


@query(top_sql(10, scored_sql(Scoring(), ONE, SPLIT)))
def udf_tokenizer_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzer = Analyzer(split_at_blanks)
    return Searcher(document_index(spark, sf_dir, analyzer), Scoring(), analyzer).top_n(QUERY, 10)


# ---------------------------------------------------------------- models, states and callables

STOPWORDS_SQL = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(ENGLISH_STOPWORDS)) + ")"
ITEMS = "select (row_number() over (order by item_id) - 1)::bigint as doc_id, text from benchmark"
FLOAT = "doc_id, score::float as score"
PORTER = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky rational ration digitizer digit conformabli conform operator oper feudalism feudal hopefulness hope formaliti formal triplicate triplic formative form electriciti electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust replacement replac adoption adopt communism commun activate activ effective effect rate rate cease ceas controll control roll roll".split()


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of the benchmark's texts, numbered from 0: the corpus of what works on the driver."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").select("text").collect()
    return spark.createDataFrame([(i, r["text"]) for i, r in enumerate(rows)], "doc_id bigint, text string")


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens) of texts cut at blanks."""
    tokens = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), lambda x: x != "")
    return documents(spark, sf_dir).select("doc_id", tokens.alias("tokens"))


@query(index_sql(SPLIT) + ALL_TERMS)
def pretokenised_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.index_tokens(split_documents(spark, sf_dir)).term_stats()


SPLIT_TOP = top_sql(10, scored_sql(Scoring("compact"), ONE, SPLIT))


@query(SPLIT_TOP)
def compressed_tokens_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CompressedBM25(split_documents(spark, sf_dir)).get_top_n(QUERY.split(), 10)


@query(SPLIT_TOP)
def compressed_save_load_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "compressed")
    CompressedBM25(split_documents(spark, sf_dir)).save(path)
    return CompressedBM25.load(path).get_top_n(QUERY.split(), 10)


@query(SPLIT_TOP)
def mmap_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "mapped")
    save_index(ix.index_tokens(split_documents(spark, sf_dir)), path, {"variant": "compact"})
    return MmapBM25(path).get_top_n(QUERY.split(), 10)


@query(index_sql() + " select term, doc_id, tf from postings where term = 'the'")
def inverted_index_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "inverted")
    InvertedIndex(ix.dense_gaps(document_index(spark, sf_dir))).save(path)
    return InvertedIndex.load(path).lookup("the").select("term", "doc_id", "tf")


@query(index_sql(docs=DOCS + " and doc_id % 3 != 1") + ", all_docs as (select unnest(generate_series(0, (select max(doc_id) from lens))) as doc_id) select (select count(*) from all_docs)::bigint as n_docs, total::bigint as total_len from corpus")
def dense_gaps_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids left out on purpose count as empty documents."""
    return ix.dense_gaps(ix.index_text(documents(spark, sf_dir).where("doc_id % 3 != 1"))).corpus_stats()


@query(top_sql(10, scored_sql(Scoring("compact"), ONE, SPLIT, index_sql(SPLIT, ITEMS))))
def builder_batches_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and token lists, added one by one and in batches."""
    texts = [r["text"] for r in items(spark, sf_dir).orderBy("doc_id").collect()]
    builder = StreamingBM25Builder(scratch_path(spark, "built"), chunk_size=7, tokenizer=split_at_blanks, spark=spark)
    builder.add_text(0, texts[0])
    builder.add_tokens(1, split_at_blanks(texts[1]))
    builder.add_batch([t if i % 2 else split_at_blanks(t) for i, t in enumerate(texts[2:])], start_id=2)
    return builder.build().get_top_n(QUERY.split(), 10)


@query(top_sql(10, scored_sql(Scoring(), ONE, base=index_sql(docs=ITEMS)), FLOAT))
def dumps_loads_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BM25.loads(BM25(items(spark, sf_dir)).dumps(), spark).get_top_n(QUERY, 10)


@query(scored_sql(Scoring(), ONE) + f" select {FLOAT} from every")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BM25(documents(spark, sf_dir)).get_scores(QUERY)


@query(top_sql(10, scored_sql(Scoring("plus"), ONE), FLOAT))
def variant_factory_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BM25(documents(spark, sf_dir), variant="bm25+").get_top_n(QUERY, 10)


@query(index_sql() + " select 1.5::double as k1, 0.75::double as b, 0.25::double as epsilon, n::bigint as corpus_size, round(total / n, 6) as avg_doc_length, 'BM25(k1=1.5, b=0.75, epsilon=0.25, corpus_size=' || n::bigint || ')' as shown from corpus")
def model_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = BM25(documents(spark, sf_dir))
    return spark.createDataFrame([(m.k1, m.b, m.epsilon, m.corpus_size, round(m.avg_doc_length, 6), repr(m))], "k1 double, b double, epsilon double, corpus_size bigint, avg_doc_length double, shown string")


@query(FIELD + f" select {FLOAT} from every")
def bm25f_field_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = BM25F(parts(spark, sf_dir), WEIGHTS)
    model.set_field_b("p_name", 0.1)
    return model.get_scores(FIELD_QUERY)


@query(scored_sql(Scoring(), MANY) + " select query_id, doc_id, score from found where score != 0")
def sparse_auto_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BM25(documents(spark, sf_dir)).get_scores_batch(asked(spark, sf_dir), sparse_threshold=0)


ITEM_SCORES = scored_sql(Scoring(), ITEMS.replace("doc_id", "query_id"), base=index_sql(docs=ITEMS))


@query(ITEM_SCORES + " select query_id, doc_id, score::float as score from found where score != 0")
def batch_csr(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = items(spark, sf_dir)
    data, columns, ends = BM25(corpus).get_scores_csr(corpus.withColumnRenamed("doc_id", "query_id"))
    rows = [(q, int(columns[i]), float(data[i])) for q in range(len(ends) - 1) for i in range(ends[q], ends[q + 1])]
    return spark.createDataFrame(rows, "query_id bigint, doc_id bigint, score float")


@query(ITEM_SCORES + " select query_id, doc_id, score::float as score from every")
def batch_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = items(spark, sf_dir)
    dense = BM25(corpus).get_scores_matrix(corpus.withColumnRenamed("doc_id", "query_id"))
    return spark.createDataFrame([(q, d, float(x)) for q, row in enumerate(dense) for d, x in enumerate(row)], "query_id bigint, doc_id bigint, score float")


@query(top_sql(10, scored_sql(Scoring(), ONE), FLOAT))
def async_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asyncio.run(BM25(documents(spark, sf_dir)).aget_top_n(QUERY, 10))
    return spark.createDataFrame([(r["doc_id"], r["score"]) for r in rows], "doc_id bigint, score float")


@query(scored_sql(Scoring(), ONE, base=index_sql(docs=ITEMS)) + f" select {FLOAT} from every")
def async_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asyncio.run(BM25(items(spark, sf_dir)).aget_scores(QUERY))
    return spark.createDataFrame([(r["doc_id"], r["score"]) for r in rows], "doc_id bigint, score float")


@query(ITEM_SCORES + " select query_id, doc_id, score from every")
def async_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = items(spark, sf_dir)
    rows = asyncio.run(BM25(corpus).aget_scores_batch(corpus.withColumnRenamed("doc_id", "query_id")))
    return spark.createDataFrame([(r["query_id"], r["doc_id"], r["score"]) for r in rows], "query_id bigint, doc_id bigint, score double")


class _OwnModel(AsyncBatchMixin):
    """A user's model that gets its batches from the mixin."""

    def __init__(self, index: ix.Index):
        self.searcher = Searcher(index, Scoring("l"))


@query(top_sql(10, scored_sql(Scoring("l"), MANY), "query_id, rank, doc_id, score"))
def mixin_batch_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _OwnModel(document_index(spark, sf_dir)).get_top_n_batch(asked(spark, sf_dir), 10, n_jobs=-1)


RANKINGS = [[(9.0, 7), (8.0, 3), (7.5, 12)], [(1.0, 3), (0.5, 4), (0.1, 4)]]


@query("select doc_id, round(sum(1.0::double / (10.0::double + rank)), 9) as score from (values " + ", ".join(f"({d}::bigint, {i + 1})" for ranking in RANKINGS for i, (_, d) in enumerate(ranking)) + ") t(doc_id, rank) group by doc_id order by score desc, doc_id limit 3")
def rrf_python_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    fusion = RRFScorer(k=10)
    fusion.add_ranking(RANKINGS[1])
    fusion.reset()
    for ranking in RANKINGS:
        fusion.add_ranking(ranking)
    return fusion.fuse(3)


@query(index_sql() + " select doc_id, tf::double as tf from postings where term = 'the'")
def sorted_postings_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SortedPostings(document_index(spark, sf_dir)).lookup("the")


@query(index_sql() + " select count(*)::bigint as num_terms, sum(8 * df + strlen(term))::bigint as memory_bytes from stats")
def sorted_postings_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = SortedPostings(document_index(spark, sf_dir))
    return spark.createDataFrame([(made.num_terms, made.memory_bytes())], "num_terms bigint, memory_bytes bigint")


FOLDED = "replace(lower(x), 'ß', 'ss')"


def first_four(token: str) -> str:
    return token[:4]


def tokens_one_by_one(text: str):
    yield from split_at_blanks(text)


def restored(analyzer: Analyzer) -> Analyzer:
    return Analyzer.from_state(json.loads(json.dumps(analyzer.to_state())))


STATED = restored(Analyzer.of("whitespace", stopwords=["and", "the"]))
for _name, (_tokenize, _sql) in {
    "tokenize_exact_folding": (Tokenizer("unicode_word", exact_folding=True), token_sql(WORD_PATTERN, FOLDED)),
    "tokenize_host": (Analyzer(Tokenizer("unicode_word").tokenize), token_sql(WORD_PATTERN, FOLDED)),
    "tokenize_from_state": (STATED, token_sql(SPACE_PATTERN, FOLDED, "x not in ('and', 'the')")),
    "tokenize_stemmer_callable": (Analyzer.of(stemmer=first_four), token_sql(each="left(lower(x), 4)")),
    "tokenize_coerced": (Analyzer(tokens_one_by_one), SPLIT),
    "tokenize_simple_options": (Analyzer(lambda text: simple_tokens(text, remove_stopwords=True, min_token_len=3)), token_sql(keep=f"length(x) >= 3 and x not in {STOPWORDS_SQL}")),
}.items():
    query(index_sql(_sql) + ALL_TERMS, _name)(lambda spark, sf_dir, t=_tokenize: document_index(spark, sf_dir, t).term_stats())


@query(index_sql() + f" select term, term in {STOPWORDS_SQL} as is_stopword from stats")
def stopword_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = document_index(spark, sf_dir).term_stats().select("term")
    return terms.select("term", F.udf(is_stopword, "boolean", useArrow=True)("term").alias("is_stopword"))


@query("select * from (values " + ", ".join(f"('{w}', '{s}')" for w, s in zip(PORTER[::2], PORTER[1::2])) + ") t(word, stem)")
def porter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published examples of the algorithm."""
    words = spark.createDataFrame([(w,) for w in PORTER[::2]], "word string")
    return words.select("word", stemmed(stem)(F.array("word"))[0].alias("stem"))


def _error(call: Callable) -> str:
    try:
        call()
    except (TypeError, ValueError, IndexError) as e:
        return type(e).__name__
    return "none"


REFUSALS = {
    "one text as a corpus": ("TypeError", lambda spark: text_frame("text", spark)),
    "a number as a text": ("TypeError", lambda spark: text_frame([1], spark)),
    "a null text in a list": ("TypeError", lambda spark: text_frame([None], spark)),
    "a null text in a table": ("TypeError", lambda spark: text_frame(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), nulls="refuse")),
    "texts": ("none", lambda spark: text_frame(["a"], spark)),
    "no queries": ("ValueError", lambda spark: query_frame([], spark)),
    "0 jobs": ("ValueError", lambda spark: check_jobs(0)),
    "-2 jobs": ("ValueError", lambda spark: check_jobs(-2)),
    "-1 jobs": ("none", lambda spark: check_jobs(-1)),
    "two groups in a pattern": ("TypeError", lambda spark: Tokenizer(pattern="(a)(b)").tokenize("ab")),
    "an id given twice": ("ValueError", lambda spark: BM25(spark.createDataFrame([(1, "a"), (1, "b")], "doc_id bigint, text string"))),
}


@query("select * from (values " + ", ".join(f"('{k}', '{v[0]}')" for k, v in REFUSALS.items()) + ") t(given, error)")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What arguments are refused, and how."""
    return spark.createDataFrame([(k, _error(lambda c=call: c(spark))) for k, (_, call) in REFUSALS.items()], "given string, error string")
