"""Models and functions against a small brute-force version."""

import asyncio
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparklex import BM25, BM25F, BM25L, BM25Adpt, BM25Plus, CompressedBM25, InvertedIndex, MmapBM25, RRFScorer, SortedPostings, StreamingBM25Builder, Tokenizer
from sparklex.functions import codec, porter
from sparklex.functions.scoring import Scoring
from sparklex.functions.tokenize import ENGLISH_STOPWORDS, Analyzer, exact_casefold, stopword_set

CORPUS = ["Red kites hunt over moor and field", "the moor, THE MOOR the moor", "", "A kite is flown on a string; string theory", "field field field notes", "No match here"]
ASK = "moor field moor kites unknownword"


def brute(corpus, query, variant, k1=1.5, b=0.75, eps=0.25):
    import re

    docs = [re.findall("[0-9A-Za-z_]+", t.lower()) for t in corpus]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    out = [0.0] * n
    for term in re.findall("[0-9A-Za-z_]+", query.lower()):
        tfs = [d.count(term) for d in docs]
        df = sum(t > 0 for t in tfs)
        if not df:
            continue
        plain = math.log((n - df + 0.5) / (df + 0.5) + 1)
        idf = plain if variant == "compact" else max(eps, plain)
        for i, tf in enumerate(tfs):
            if tf:
                norm = 1 - b + b / avg * len(docs[i])
                k = k1 * math.log(1 + sum(tfs) / df) if variant == "adpt" else k1
                part = tf * (k + 1) / (tf + k * norm)
                if variant == "plus":
                    part += 1
                if variant == "l":
                    c = tf / norm
                    part = (k1 + 1) * c / (k1 + c) + 0.5
                out[i] += idf * part
    return out


def scores(df):
    return [r["score"] for r in sorted(df.collect(), key=lambda r: r["doc_id"])]


@pytest.mark.parametrize("variant,kind", [("okapi", BM25), ("plus", BM25Plus), ("l", BM25L), ("adpt", BM25Adpt)])
def test_scores(spark, variant, kind):
    model = BM25(CORPUS, variant=variant)
    assert type(model) is kind
    expected = brute(CORPUS, ASK, variant)
    assert scores(model.get_scores(ASK)) == pytest.approx(expected, abs=1e-5)
    order = sorted(range(len(CORPUS)), key=lambda i: (-round(expected[i], 6), i))
    assert [r["doc_id"] for r in model.get_top_n(ASK, 99).collect()] == order
    assert [r["doc_id"] for r in model.get_top_n("nothing", 2).collect()] == [0, 1]
    assert [r["text"] for r in model.get_top_n_docs(ASK, 2).collect()] == [CORPUS[i] for i in order[:2]]


def test_batch_and_async(spark):
    model = BM25(CORPUS)
    asked = [ASK, "string", "nothing", ""]
    dense = {(r["query_id"], r["doc_id"]): r["score"] for r in model.get_scores_batch(asked, n_jobs=-1).collect()}
    assert len(dense) == 4 * len(CORPUS)
    for q, text in enumerate(asked):
        assert [dense[q, d] for d in range(len(CORPUS))] == pytest.approx(brute(CORPUS, text, "okapi"), abs=1e-5)
    sparse = {(r["query_id"], r["doc_id"]): r["score"] for r in model.get_scores_batch(asked, sparse_threshold=0).collect()}
    assert sparse == {k: v for k, v in dense.items() if v}
    top = model.get_top_n_batch(asked, 3).collect()
    assert sorted((r["query_id"], r["rank"]) for r in top) == [(q, r) for q in range(4) for r in (1, 2, 3)]
    assert [r["doc_id"] for r in sorted((r for r in top if r["query_id"] == 2), key=lambda r: r["rank"])] == [0, 1, 2]
    assert [r["score"] for r in asyncio.run(model.aget_top_n(ASK, 2))] == [r["score"] for r in model.get_top_n(ASK, 2).collect()]
    for bad, error in (("text", TypeError), ([], ValueError)):
        with pytest.raises(error):
            model.get_scores_batch(bad)
    with pytest.raises(ValueError):
        model.get_top_n_batch(asked, n_jobs=-2)
    with pytest.raises(ValueError):
        model.get_scores_batch(asked, sparse_threshold=-1)


def test_changes_and_storage(spark, tmp_path):
    model = BM25(CORPUS[:3], k1=1.2)
    model.add_documents(CORPUS[3:])
    model.add_documents([])
    assert scores(model.get_scores(ASK)) == pytest.approx(brute(CORPUS, ASK, "okapi", k1=1.2), abs=1e-5)
    model.remove_document(1)
    rest = CORPUS[:1] + CORPUS[2:]
    assert scores(model.get_scores(ASK)) == pytest.approx(brute(rest, ASK, "okapi", k1=1.2), abs=1e-5)
    for bad in (-1, 5):
        with pytest.raises(IndexError):
            model.remove_document(bad)
    model.save(str(tmp_path / "m"))
    again = BM25.load(str(tmp_path / "m"))
    assert scores(again.get_scores(ASK)) == scores(model.get_scores(ASK))
    assert again.corpus_size == 5 and again.avg_doc_length == pytest.approx(model.avg_doc_length)
    plan = again.searcher.matching("moor")._jdf.queryExecution().toString()
    assert "PushedFilters: [EqualTo(term,moor)]" in plan or "In(term" in plan or "IsNotNull(term), EqualTo(term,moor)" in plan
    with pytest.raises(ValueError):
        CompressedBM25([["a"]]).save(str(tmp_path / "c")) or BM25.load(str(tmp_path / "c"))


def test_validation(spark):
    for bad, error in (("one text", TypeError), ([1], TypeError), ([], ValueError)):
        with pytest.raises(error):
            BM25(bad)
    with pytest.raises(ValueError):
        BM25(CORPUS, variant="other")
    with pytest.raises(ValueError):
        Scoring("other")


def test_nulls_and_extra_columns(spark):
    docs = spark.createDataFrame([(0, None, 1, "x"), (None, "moor", 2, "y"), (2, "moor " * 50_000, 3, "z"), (3, "", 4, "w")], "doc_id bigint, text string, dl int, term string")
    assert scores(BM25(docs).get_scores("moor"))[0] == 0.0
    assert BM25(docs).corpus_size == 3
    empty = docs.where("false")
    from sparklex.operators.index import index_text
    from sparklex.operators.search import Searcher

    assert Searcher(index_text(empty)).top_n("moor", 5).collect() == []


def test_fields(spark):
    docs = [{"title": "red moor", "body": "moor moor", "other": "moor"}, {"body": "field"}, {}]
    model = BM25F(docs, {"title": 2.0, "body": 1.0})
    idf = max(0.25, math.log(2.5 / 1.5 + 1))
    assert scores(model.get_scores("moor")) == pytest.approx([idf * 4 * 2.5 / (4 + 1.5), 0, 0], abs=1e-5)
    model.set_field_b("title", 0.1)
    assert scores(model.get_scores("moor moor"))[0] == pytest.approx(2 * idf * 4 * 2.5 / 5.5, abs=1e-5)


def test_compressed_streaming_mmap(spark, tmp_path):
    tokens = [t.lower().split() for t in CORPUS]
    model = CompressedBM25(tokens)
    joined = [" ".join(t) for t in (["".join(c for c in w if c.isalnum()) for w in d] for d in tokens)]
    blobs = {}
    for i, d in enumerate(tokens):
        for t, c in Counter(d).items():
            blobs.setdefault(t, []).append((i, float(c)))
    assert model.num_terms == len(blobs) and model.num_docs == 6
    assert model.compressed_bytes == sum(len(codec.encode_postings(e)) for e in blobs.values())
    builder = StreamingBM25Builder(str(tmp_path / "s"), chunk_size=2, tokenizer=lambda t: t.lower().split())
    assert builder.add_batch(CORPUS) == 6
    built = builder.build()
    assert scores(built.get_scores(["moor", "field"])) == scores(model.get_scores(["moor", "field"]))
    lazy = MmapBM25(str(tmp_path / "s"))
    assert scores(lazy.get_scores(["string"])) == scores(model.get_scores(["string"])) and lazy.file_size > 0
    lazy.close()
    with pytest.raises(RuntimeError):
        StreamingBM25Builder(str(tmp_path / "t")).add_text(0, "x")
    twice = StreamingBM25Builder(str(tmp_path / "u"))
    twice.add_tokens(0, ["a"])
    twice.add_tokens(0, ["b"])
    with pytest.raises(ValueError):
        twice.build()
    assert joined


def test_inverted_index(spark, tmp_path):
    index = InvertedIndex()
    index.add_document(3, ["a", "b", "a"])
    index.add_document(0, ["a"])
    assert sorted((r["doc_id"], r["tf"]) for r in index.lookup("a").collect()) == [(0, 1), (3, 2)]
    assert index.finalize().corpus_stats().first()["n_docs"] == 4
    index.save(str(tmp_path / "i"))
    assert InvertedIndex.load(str(tmp_path / "i")).lookup("b").count() == 1


def test_fusion(spark):
    fusion = RRFScorer(k=60)
    fusion.add_ranking([(9.0, 7), (8.0, 3)])
    fusion.add_ranking([(1.0, 3), (0.5, 4), (0.1, 4)])
    got = [(r["doc_id"], r["score"]) for r in fusion.fuse(2).collect()]
    assert got == [(3, round(1 / 62 + 1 / 61, 9)), (4, round(1 / 62 + 1 / 63, 9))]
    fusion.reset()
    with pytest.raises(ValueError):
        fusion.fuse()


def tokens_of(spark, analyzer, text):
    from pyspark.sql import functions as F

    return spark.createDataFrame([(text,)], "t string").select(analyzer(F.col("t")).alias("x")).first()["x"]


def test_tokenizers(spark):
    assert tokens_of(spark, Analyzer.of(), "Don't_stop Naïve-2") == ["don", "t_stop", "na", "ve", "2"]
    assert tokens_of(spark, Analyzer.of(), None) == []
    assert tokens_of(spark, Tokenizer("whitespace"), " Keep, it! Straße　x") == ["keep,", "it!", "strasse", "x"]
    assert tokens_of(spark, Tokenizer("unicode_word"), "Ünïcode 東京_1!") == ["ünïcode", "東京_1"]
    assert tokens_of(spark, Tokenizer(pattern="([a-z]+)[0-9]"), "ab1 cd e2") == ["ab", "e"]
    assert tokens_of(spark, Tokenizer(stopwords=True, extra_stopwords=["zz"], min_token_len=2), "The zz quick x fox") == ["quick", "fox"]
    assert tokens_of(spark, Tokenizer(stemmer=porter.stem), "running ponies relational") == ["run", "poni", "relat"]
    assert tokens_of(spark, Analyzer.of(str.split, stopwords=["b"]), "A b C") == ["a", "c"]
    assert tokens_of(spark, Analyzer.of(Tokenizer(lowercase=False)), "AB") == ["ab"]
    assert tokens_of(spark, lambda t: exact_casefold(Tokenizer("whitespace", lowercase=False)(t)), "ΣΑΣ ﬁn") == ["σασ", "fin"]
    assert len(ENGLISH_STOPWORDS) == 177
    state = Tokenizer("whitespace", stopwords=["a"]).to_state()
    assert Tokenizer.from_state(state) == Tokenizer("whitespace", stopwords=["a"])
    analyzer = Analyzer.of("whitespace", stopwords=["a"])
    assert Analyzer.from_state(analyzer.to_state()) == analyzer
    for make, error in ((lambda: Tokenizer("x"), ValueError), (lambda: Tokenizer("whitespace", pattern="x"), ValueError), (lambda: Tokenizer(min_token_len=0), ValueError), (lambda: Tokenizer(stemmer=3), TypeError), (lambda: stopword_set("german"), ValueError), (lambda: Analyzer.of(5), TypeError), (lambda: Tokenizer(stemmer=str.upper).to_state(), TypeError), (lambda: Analyzer.of(str.split).to_state(), TypeError)):
        with pytest.raises(error):
            make()


def test_porter():
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky rational ration digitizer digit conformabli conform operator oper feudalism feudal hopefulness hope formaliti formal triplicate triplic formative form electriciti electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust replacement replac adoption adopt communism commun activate activ effective effect rate rate cease ceas controll control roll roll archaeologi archaeolog ies i ion ion is is".split()
    for word, expected in zip(pairs[::2], pairs[1::2]):
        assert porter.stem(word) == expected, word
    assert porter.simple_tokens("The Running\0dog", remove_stopwords=True, stemming=True) == ["run"]
    assert porter.is_stopword("the") and not porter.is_stopword("moor")


@given(st.lists(st.tuples(st.integers(0, 2**50), st.integers(1, 2**20)), unique_by=lambda x: x[0]))
def test_codec_round_trip(entries):
    entries = sorted((d, float(t)) for d, t in entries)
    data = codec.encode_postings(entries)
    assert codec.decode_postings(data) == (entries, len(data))


@given(st.integers(0, 2**63 - 1))
def test_varint(value):
    data = codec.encode_varint(value)
    assert codec.decode_varint(data) == (value, len(data)) and len(data) == max(1, -(-value.bit_length() // 7))
    with pytest.raises(ValueError):
        codec.decode_varint(data[:-1])


def test_varint_overflow():
    with pytest.raises(OverflowError):
        codec.decode_varint(b"\xff" * 12)


def test_driver_side_forms(spark, tmp_path):
    model = BM25(CORPUS)
    asked = [ASK, "string", "nothing"]
    expected = np.array([brute(CORPUS, q, "okapi") for q in asked])
    assert np.allclose(model.get_scores_matrix(asked), expected, atol=1e-5)
    data, columns, ends = model.get_scores_csr(asked)
    assert ends.tolist() == np.append(0, np.cumsum((expected > 0).sum(1))).tolist() and ends[-1] == len(data) == len(columns)
    again = BM25.loads(model.dumps())
    assert scores(again.get_scores(ASK)) == scores(model.get_scores(ASK)) and again.get_top_n_docs(ASK, 1).first()["text"] == model.get_top_n_docs(ASK, 1).first()["text"]
    tokens = CompressedBM25([["a", "b"], ["b"]])
    assert scores(CompressedBM25.loads(tokens.dumps()).get_scores(["a"])) == scores(tokens.get_scores(["a"]))
    assert scores(tokens.get_scores([])) == [0.0, 0.0]


def test_sparse_ids(spark):
    docs = spark.createDataFrame([(10, "moor"), (2**40, "field moor"), (7, "kite")], "doc_id bigint, text string")
    model = BM25(docs)
    with pytest.raises(IndexError):
        model.remove_document(0)
    model.remove_document(10)
    assert sorted(r["doc_id"] for r in model.get_scores("moor").collect()) == [7, 2**40]
    with pytest.raises(ValueError):
        model.add_documents(spark.createDataFrame([(7, "again")], "doc_id bigint, text string"))
    model.add_documents(["field"])
    assert [r["doc_id"] for r in model.get_top_n("field", 1).collect()] == [2**40 + 1]
    for nulls, bad in (("refuse", TypeError), ("other", ValueError)):
        with pytest.raises(bad):
            BM25(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), nulls=nulls)
    with pytest.raises(ValueError):
        BM25(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id bigint, text string"))


def test_dense_ids(spark, tmp_path):
    from sparklex.operators import index as ix
    from sparklex.operators.search import Searcher
    from sparklex.sources.store import load_index, save_index

    docs = spark.createDataFrame([(4, ["b"]), (2, ["a", "b"])], "doc_id bigint, tokens array<string>")
    index = ix.dense_gaps(ix.index_tokens(docs))
    save_index(index, str(tmp_path / "d"))
    for made in (index, load_index(spark, str(tmp_path / "d"))):
        assert made.corpus_stats().first()["n_docs"] == 5
        assert sorted(r["doc_id"] for r in Searcher(made).scores(["a"]).collect()) == [0, 1, 2, 3, 4]
        assert [r["doc_id"] for r in Searcher(made).top_n(["b"], 4).collect()] == [4, 2, 0, 1]
        assert ix.remove_document(made, 0).doc_stats.count() == 4
        assert ix.merge(made, ix.index_tokens(docs.where("false"))).doc_stats.count() == 5
    assert ix.dense_gaps(ix.index_tokens(docs.where("false"))).corpus_stats().first()["n_docs"] == 0


def test_saved_statistics_are_read(spark, tmp_path):
    model = BM25(CORPUS)
    model.save(str(tmp_path / "m"))
    read = " ".join(BM25.load(str(tmp_path / "m")).searcher.matching("moor field").inputFiles())
    assert "/term_stats/" in read and "/postings/" in read and "/doc_stats/" not in read


def test_sorted_postings(spark):
    made = SortedPostings()
    for term, doc, tf in (("b", 3, 1), ("a", 5, 2), ("b", 1, 4), ("b", 3, 2)):
        made.insert(term, doc, tf)
    assert [tuple(r) for r in made.lookup("b").collect()] == [(1, 4.0), (3, 3.0)]
    assert [r["term"] for r in made.terms().collect()] == ["a", "b"] and made.num_terms == 2
    assert made.memory_bytes() == 3 * 8 + 2 and not made.empty() and SortedPostings().empty()


def test_host_tokenizer():
    assert Tokenizer("whitespace").tokenize("Keep punctuation, please!") == ["keep", "punctuation,", "please!"]
    assert Tokenizer(pattern="[A-Za-z]+")("Token-123 split!") == ["token", "split"]
    assert Tokenizer("unicode_word").tokenize("naïve café 東京_1!") == ["naïve", "café", "東京_1"]
    assert Tokenizer(stopwords="english", extra_stopwords=["engine"], stemmer=porter.stem).tokenize("The engine jumps") == ["jump"]
    assert Tokenizer("whitespace", exact_folding=True).tokenize("ΣΑΣ ﬁn") == ["σασ", "fin"]
    for bad in (lambda: Tokenizer(pattern="(a)(b)").tokenize("ab"), lambda: Tokenizer(stemmer=len).tokenize("a"), lambda: Tokenizer().tokenize(None)):
        with pytest.raises(TypeError):
            bad()


def test_exact_folding_column(spark):
    assert tokens_of(spark, Tokenizer("whitespace", exact_folding=True, stopwords=["fin"]), "ΣΑΣ ﬁn") == ["σασ"]
    with pytest.raises(TypeError):
        tokens_of(spark, Tokenizer(pattern="(a)(b)"), "ab")


@given(st.lists(st.integers(0, 2**64 - 1)))
def test_varint_arrays(values):
    data, lengths = codec.encode_varints(np.array(values, np.uint64))
    assert data.tobytes() == b"".join(codec.encode_varint(v) for v in values) and lengths.sum() == len(data)
    assert codec.decode_varints(data).tolist() == values


def test_varint_arrays_refuse():
    with pytest.raises(ValueError):
        codec.decode_varints(np.array([0x80], np.uint8))
    with pytest.raises(OverflowError):
        codec.decode_varints(np.frombuffer(b"\xff" * 12 + b"\x01", np.uint8))


# ------------------------------------------------------------ properties and judged rankings


def ladder(tfs, length=24):
    """Documents of one length that hold a word so often, with padding that no other has."""
    return [" ".join(["signal"] * tf + [f"pad{i}x{j}" for j in range(length - tf)]) for i, tf in enumerate(tfs)]


@pytest.mark.parametrize("variant", ["okapi", "plus", "l", "adpt"])
def test_more_occurrences_score_higher(spark, variant):
    got = scores(BM25(ladder([0, 1, 2, 3, 5, 8]), variant=variant).get_scores("signal"))
    assert got[0] == 0 and all(a < b for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("variant,delta", [("okapi", 0.0), ("plus", 1.0), ("l", 0.5)])
def test_closed_form(spark, variant, delta):
    """Of equal lengths and single occurrences, a score is the IDF and a constant."""
    for df in (1, 3):
        got = scores(BM25(ladder([1] * df + [0] * (6 - df)), variant=variant).get_scores("signal"))
        assert got[:df] == pytest.approx([max(0.25, math.log((6 - df + 0.5) / (df + 0.5) + 1)) * (1 + delta)] * df, abs=1e-5)


def test_shorter_and_rarer_score_higher(spark):
    short, long = scores(BM25(["signal a", "signal " + "b " * 30, "c", "d"]).get_scores("signal"))[:2]
    assert short > long
    corpus = ["rare common", "common x", "common y", "z"]
    model = BM25(corpus)
    assert scores(model.get_scores("rare"))[0] > scores(model.get_scores("common"))[0]
    twice = scores(model.get_scores("rare rare"))
    assert twice[0] == pytest.approx(2 * scores(model.get_scores("rare"))[0], abs=1e-5)


JUDGED = [
    ("how do glaciers carve valleys", ["Tax returns are due in spring.", "Glaciers carve valleys by plucking rock and grinding it as the ice moves.", "Valleys near the coast flood often.", "Ice cream melts."], {1}),
    ("symptoms of iron deficiency", ["Iron bridges rust.", "A deficiency of funds delayed the bridge.", "Symptoms of iron deficiency include fatigue and pale skin.", "Skin care in winter."], {2}),
]


@pytest.mark.parametrize("variant", ["okapi", "plus", "l", "adpt"])
def test_judged_rankings(spark, variant):
    for query, docs, relevant in JUDGED:
        top = [r["doc_id"] for r in BM25(docs, variant=variant).get_top_n(query, len(relevant)).collect()]
        assert set(top) == relevant


def test_blocks_of_postings(spark, monkeypatch):
    """Lists that go over several blocks of ids, against one list."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(codec, "BLOCK_IDS", 4)
    lists = {"a": [0, 1, 3, 4, 9, 30], "b": [7], "c": [3, 4, 5, 6, 7, 8, 100]}
    postings = spark.createDataFrame([(t, d, 1 + d % 3) for t, ids in lists.items() for d in ids], "term string, doc_id bigint, tf bigint")
    got = sorted((r["term"], r["doc_id"], r["gap"]) for r in codec.gaps(postings).collect())
    assert got == [(t, d, d - p) for t, ids in lists.items() for p, d in zip([0, *ids], ids)]
    back = codec.ids_of_gaps(codec.gaps(postings).withColumnRenamed("doc_id", "at"), "at")
    assert back.where(F.col("doc_id") == F.col("at")).count() == 14
    assert sorted(map(tuple, codec.decoded_postings(codec.encoded_postings(postings)).collect())) == [(t, d, 1.0 + d % 3) for t, ids in lists.items() for d in ids]
    size = sum(len(codec.encode_postings([(d, 1.0 + d % 3) for d in ids])) for ids in lists.values())
    assert codec.compressed_bytes(postings).first()["compressed_bytes"] == size


def jobs_of(spark, call):
    """(what call returns, number of Spark jobs that it ran)."""
    context = spark.sparkContext
    context.setJobGroup(f"counted-{id(call)}", "")
    try:
        got = call()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return got, len(context.statusTracker().getJobIdsForGroup(f"counted-{id(call)}"))


def test_sizes_of_sorted_postings_count_once(spark):
    """One pass gives both sizes, without a sort; ids given twice and entries put in later still add up."""
    from sparklex.operators import index as ix

    docs = spark.createDataFrame([(1, "b a b é"), (2, "a")], "doc_id bigint, text string")
    made = SortedPostings(ix.index_text(docs, Tokenizer("unicode_word")))
    assert (made.num_terms, made.memory_bytes()) == (3, 4 * 8 + 1 + 1 + 2)
    assert jobs_of(spark, lambda: (made.num_terms, made.memory_bytes()))[1] == 0
    made.insert("zz", 1, 1)
    made.insert("a", 2, 1)
    assert (made.num_terms, made.memory_bytes()) == (4, 5 * 8 + 1 + 1 + 2 + 2)
    twice = SortedPostings(ix.index_text(docs.unionAll(docs)))
    assert (twice.num_terms, twice.memory_bytes()) == (2, 3 * 8 + 2)


def peak_mb(call):
    """(what call returns, MB of Python objects that it held at most)."""
    import tracemalloc

    tracemalloc.start()
    try:
        return call(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_python_tokenizers_hold_few_objects():
    """An Arrow batch of long texts isn't turned into Python tokens as a whole."""
    import pyarrow as pa

    from sparklex.functions.tokenize import each_distinct, slices, tokenized

    words = " ".join(f"word{i}" for i in range(5000))
    texts = pa.array([words, None, ""] * 60)
    got, mb = peak_mb(lambda: tokenized(texts, str.split))
    assert got.slice(0, 3).to_pylist() == [words.split(), [], []] and len(got.flatten()) == 300_000 and mb < 15
    seen = []
    lists = pa.concat_arrays([pa.array([["never"], None, ["A", "B", "A"]]), got])[1:]
    new, mb = peak_mb(lambda: each_distinct(lists, lambda t: seen.append(t) or t.upper()))
    assert new.slice(0, 4).to_pylist() == [None, ["A", "B", "A"], words.upper().split(), []] and len(seen) == 5002 and mb < 10
    assert list(slices(pa.array([3, 4, None, 9, 1, 1]), 7)) == [slice(0, 3), slice(3, 4), slice(4, 6)] and not list(slices(pa.array([], pa.int32()), 7))
    assert tokenized(pa.array([], pa.string()), str.split).to_pylist() == []


def test_spaces_and_words_of_all_code_points(spark):
    """The forms of the patterns that are faster split at the same characters."""
    import sys
    import unicodedata

    from pyspark.sql import functions as F

    every = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    text = "a".join(every)
    assert tokens_of(spark, Tokenizer("whitespace", lowercase=False), text) == text.split()
    assert "[[!-~]" in str(Tokenizer("whitespace")(F.col("t")))
    kept = "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in text)
    assert Tokenizer("unicode_word", lowercase=False).tokenize(text) == [t for t in kept.split(" ") if t]


def test_token_statistics(spark, monkeypatch):
    """Statistics that are counted by runs of documents, against postings."""
    from sparklex.operators import index as ix

    monkeypatch.setattr(ix, "COUNTED", 4)
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["a", None, "é"]), (4, None), (5, [None]), (None, ["z"]), (6, list("aabbccab"))], "doc_id bigint, tokens array<string>").coalesce(1)
    index = ix.index_tokens(docs)
    rows = sorted(map(tuple, index.term_stats().collect()))
    assert rows == sorted(map(tuple, ix.Index(index.postings, index.doc_stats).term_stats().collect())) == [("a", 3, 5), ("b", 2, 5), ("c", 1, 2), ("é", 1, 1)]
    assert index.term_stats().dtypes == [("term", "string"), ("df", "bigint"), ("cf", "bigint")]
    assert ix.index_tokens(docs.where("false")).term_stats().isEmpty()


def test_a_search_reads_texts_once(spark, tmp_path, monkeypatch):
    """Postings, statistics and lengths that a search needs come from one pass; results equal those of all tables."""
    from sparklex.operators import index as ix
    from sparklex.operators import search

    spark.createDataFrame(list(enumerate(CORPUS)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/docs")
    index = ix.index_text(spark.read.parquet(f"{tmp_path}/docs"))
    tables = ix.Index(index.postings, index.doc_stats)
    asked = spark.createDataFrame([(0, ASK), (1, "kite on a string"), (2, "absent"), (3, "")], "query_id bigint, text string")
    for focus in (10_000, 3):
        monkeypatch.setattr(search, "FOCUS_TERMS", focus)
        for found in (search.Searcher(index).matching(ASK), search.Searcher(index).batch(asked)):
            assert not any("/docs/" in f for f in found.inputFiles())
        for query in (lambda s: s.batch_top_n(asked, 4), lambda s: s.top_n(ASK, 5), lambda s: s.batch_dense(asked), lambda s: s.top_n("absent", 2)):
            assert sorted(map(tuple, query(search.Searcher(index)).collect())) == sorted(map(tuple, query(search.Searcher(tables)).collect()))


def test_batches_score_documents_in_their_rows(spark, monkeypatch):
    """Neither postings nor scores of a batch are shuffled; ids given twice, null ids and queries without a match keep their results."""
    from sparklex.operators import index as ix
    from sparklex.operators import search

    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate([*CORPUS, None, "moor " * 300])], "doc_id bigint, text string").coalesce(1)
    rows = [(7, ASK), (1, "kite on a string"), (7, "field"), (2, "absent"), (9, ""), (4, None), (None, "moor")]

    def results(index, asked, query, scoring=Scoring()):
        found = query(search.Searcher(index, scoring), asked)
        return found.dtypes, sorted(map(repr, found.select("query_id", "doc_id", "score").collect()))

    dense, sparse = (lambda s, a: s.batch_dense(a)), (lambda s, a: s.batch(a))
    cases = [("bigint", rows, docs, q, v, 1 << 20) for q, v in ((dense, "okapi"), (sparse, "plus"), (sparse, "l"), (sparse, "adpt"), (dense, "compact"))]
    cases += [("bigint", rows, docs, dense, "okapi", 5), ("bigint", rows, docs, sparse, "okapi", 5)]
    cases += [("string", [(q and f"q{q}", t) for q, t in rows], docs, dense, "okapi", 5), ("double", [(q and float(q), t) for q, t in rows], docs, sparse, "okapi", 5)]
    cases += [("int", rows[3:6], docs, dense, "okapi", 5), ("int", rows[3:6], docs, sparse, "okapi", 5), ("bigint", rows, docs.unionAll(docs.limit(2)), dense, "okapi", 5)]
    for kind, given, corpus, query, variant, cells in cases:
        monkeypatch.setattr(search, "CELLS", cells)
        asked = spark.createDataFrame(given, f"query_id {kind}, text string").coalesce(1)
        index = ix.index_text(corpus)
        tables = ix.Index(index.postings, index.doc_stats)
        assert results(index, asked, query, Scoring(variant)) == results(tables, asked, query, Scoring(variant)), (kind, variant, cells)
    asked = spark.createDataFrame(rows, "query_id bigint, text string")
    for query in (dense, sparse):
        plan = query(search.Searcher(ix.index_text(docs)), asked)._jdf.queryExecution().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_rounding_as_in_sql():
    from sparklex.operators.search import rounded

    given = np.array([0.0000005, -0.0000005, 1.2345674, 1.2345676, 0.0, 5e9 + 0.1, 1e300])
    assert rounded(given).tolist() == [0.000001, -0.000001, 1.234567, 1.234568, 0.0, 5e9 + 0.1, 1e300]


def test_words_are_cut_in_bytes():
    """Words of a batch of texts, whatever the pieces they are cut in."""
    import random
    import re

    import pyarrow as pa

    from sparklex.functions.tokenize import core_words

    chance = random.Random(1)
    for _ in range(2000):
        texts = [chance.choice([None, "", "".join(chance.choice("aB9_ .é東K\0") for _ in range(chance.randint(0, 12)))]) for _ in range(chance.randint(0, 6))]
        skipped = chance.randint(0, len(texts))
        for lowercase in (True, False):
            expected = [[t.lower() if lowercase else t for t in re.findall("[0-9A-Za-z_]+", x or "")] for x in texts[skipped:]]
            for most in (1, 3, 7, 1 << 22):
                got = [[] for _ in expected]
                for tokens, bounds in core_words(pa.array(texts, pa.string())[skipped:], lowercase, most):
                    words = tokens.to_pylist()
                    for i, own in enumerate(got):
                        own += words[bounds[i] : bounds[i + 1]]
                assert got == expected


@pytest.mark.parametrize("variant", ["compact", "adpt", "l", "okapi"])
def test_a_search_makes_no_rows_of_tokens(spark, monkeypatch, variant):
    """Texts that are cut by the core tokenizer are counted in their bytes; other tokenizers go on as before."""
    from sparklex.functions.tokenize import cased_tokens, core_tokens
    from sparklex.operators import index as ix
    from sparklex.operators.search import Searcher

    docs = spark.createDataFrame([*enumerate(CORPUS), (6, None), (None, "moor"), (7, "éMoor_x moorMOOR 東moor Field"), (8, "MOOR " * 70)], "doc_id bigint, text string")
    plain = {}
    for tokenize in (core_tokens, cased_tokens, Analyzer.of(lowercase=False), Tokenizer("whitespace")):
        index = ix.index_text(docs, tokenize)
        tables = ix.Index(index.postings, index.doc_stats)
        plain[tokenize] = index, [tuple(r) for r in Searcher(tables, Scoring(variant, epsilon=2.0), tokenize).top_n(ASK + " MOOR", 7).collect()]
    *core, (other, _) = plain.items()
    monkeypatch.setattr(ix, "forward_rows", lambda *a: pytest.fail("tokens became rows"))
    for tokenize, (index, expected) in core:
        assert [tuple(r) for r in Searcher(index, Scoring(variant, epsilon=2.0), tokenize).top_n(ASK + " MOOR", 7).collect()] == expected
    with pytest.raises(pytest.fail.Exception):
        Searcher(plain[other][0], Scoring(variant, epsilon=2.0), other).top_n(ASK, 7)


def test_row_pointers_shuffle_counts_only(spark):
    """Ends of the rows of a sparse matrix are counted without a shuffle of its entries; queries without a match have a row."""
    import re

    from sparklex.operators import index as ix
    from sparklex.operators.search import Searcher

    index = ix.index_text(spark.createDataFrame(list(enumerate(CORPUS)), "doc_id bigint, text string").coalesce(1))
    asked = spark.createDataFrame([(0, ASK), (1, "absent"), (2, "kite string")], "query_id bigint, text string").coalesce(1)
    ends = codec.row_pointers(Searcher(index).batch(asked), asked)
    assert sorted(map(tuple, ends.collect())) == [(0, 3), (1, 3), (2, 4)]
    assert not re.search(r"hashpartitioning\([^)]*doc_id", ends._jdf.queryExecution().toString())


def test_row_pointers_make_no_matrix(spark, monkeypatch):
    """Entries are counted where documents are scored: no row of the sparse matrix leaves a task only to be counted."""
    from sparklex.operators import index as ix
    from sparklex.operators import search
    from sparklex.plans.queries import QUERIES

    plan = QUERIES["okapi_batch_indptr"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "score#" not in plan
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate([*CORPUS, None, "moor " * 300])], "doc_id bigint, text string").coalesce(1)
    rows = [(7, ASK), (1, "kite on a string"), (7, "field"), (2, "absent"), (9, ""), (4, None), (None, "moor")]
    monkeypatch.setattr(search, "CELLS", 5)
    for kind, given, corpus in (("bigint", rows, docs), ("double", [(q and float(q), t) for q, t in rows], docs), ("int", rows[3:6], docs), ("bigint", rows, docs.unionAll(docs.limit(2)))):
        asked = spark.createDataFrame(given, f"query_id {kind}, text string").coalesce(1)
        searcher = search.Searcher(ix.index_text(corpus))
        ends = codec.row_ends(searcher.batch_counts(asked), asked)
        expected = codec.row_pointers(searcher.batch(asked), asked)
        assert ends.dtypes == expected.dtypes and sorted(map(repr, ends.collect())) == sorted(map(repr, expected.collect())), kind
