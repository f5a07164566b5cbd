"""Neighbours, chats, components and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparklex.llm import chat, neighbours
from sparklex.llm.graph import connected_components


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (5, 5), (None, 1), (10, 9), *[(i, i + 1) for i in range(100, 160)]], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8, **{i: 100 for i in range(100, 161)}}
    assert connected_components(edges.where("false")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32))
    x = (centres[rng.integers(0, 40, 1500)] + 0.3 * rng.standard_normal((1500, 32))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(9001, None, 0), (9002, [], 0), (9003, [0.0] * 32, 0), (9004, [float("nan")] * 32, 0), (None, [1.0] * 32, 0), (9005, [1.0, 2.0], 0), rows[7]]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, rank int").withColumn("v", F.lit(1))
    got = {}
    for r in neighbours.nearest_neighbours(table).collect():
        got.setdefault(r["vec_id"], set()).add(r["neighbour"])
    assert set(got) == set(range(1500)) and all(len(v) == 10 and i not in v for i, v in got.items())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T
    np.fill_diagonal(near, -2)
    true = np.argsort(-near, axis=1)[:, :10]
    assert np.mean([len(got[i] & set(true[i].tolist())) / 10 for i in range(1500)]) >= 0.9
    assert neighbours.nearest_neighbours(table.where("false")).count() == 0
    few = neighbours.nearest_neighbours(table.where("vec_id < 3"))
    assert sorted((r["vec_id"], r["neighbour"]) for r in few.collect()) == [(a, b) for a in range(3) for b in range(3) if a != b]


def recalls(spark, x, asked, **options):
    """Share of the true ten that each asked row got, and all rows of the result."""
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<float>")
    rows = neighbours.nearest_neighbours(table, asked=F.col("vec_id").isin(asked), **options).collect()
    got = {i: [] for i in asked}
    for r in sorted(rows, key=lambda r: (r["vec_id"], r["rank"])):
        got[r["vec_id"]].append(r["neighbour"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -2
    true = np.argsort(-near, axis=1)[:, :10].tolist()
    return np.array([len(set(got[i]) & set(t)) / 10 for i, t in zip(asked, true)]), got


def test_neighbours_follow_the_curves(spark, monkeypatch):
    """Many partitions of narrow windows: the curves' order decides, and flat keys fail."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((200, 64))
    bulk = centres[rng.integers(0, 200, 22_000)] + 0.5 * rng.standard_normal((22_000, 64))
    rare = 2 * rng.standard_normal(64) + rng.standard_normal((30, 64))  # near one another, far from all
    x = np.concatenate([bulk, rare]).astype(np.float32)
    asked = [*range(0, 22_000, 50), *range(22_000, 22_030)]
    windows, fit = [], neighbours.fitted_window
    monkeypatch.setattr(neighbours, "fitted_window", lambda *a: windows.append(fit(*a)) or windows[-1])
    monkeypatch.setattr(neighbours, "PART_ROWS", 4000)
    found, got = recalls(spark, x, asked)
    assert all(len(v) == len(set(v)) == 10 and i not in v for i, v in got.items())
    assert found[:440].mean() >= 0.9 and found[440:].mean() >= 0.9 and windows[0] < 3000
    bases = neighbours.curve_bases
    monkeypatch.setattr(neighbours, "curve_bases", lambda *a: [(0 * axes, corner, scale) for axes, corner, scale in bases(*a)])
    flat, _ = recalls(spark, x, asked)
    assert flat[:440].mean() < 0.5


def test_neighbours_of_copies(spark):
    """A third of the rows share a vector; equal similarities go to the lower ids."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[::3] = x[0]
    table = spark.createDataFrame(list(enumerate(x.tolist())) + [(0, x[0].tolist())], "vec_id bigint, embedding array<float>")
    got = {}
    for r in neighbours.nearest_neighbours(table, asked=F.col("vec_id") % 50 == 0).orderBy("rank").collect():
        got.setdefault(r["vec_id"], []).append((r["neighbour"], r["similarity"]))
    assert set(got) == set(range(0, 3000, 50))
    for i in range(0, 3000, 150):
        assert [n for n, _ in got[i]] == [n for n in range(0, 33, 3) if n != i][:10] and {s for _, s in got[i]} == {1.0}


def test_neighbours_of_an_id_with_many_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16))
    many = x[0] + 0.01 * rng.standard_normal((25, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, v.tolist()) for v in many]
    got = {}
    for r in neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).where("vec_id in (0, 7)").collect():
        got.setdefault(r["vec_id"], []).append(r["neighbour"])
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    near = unit(np.concatenate([x, many])) @ unit(x).T
    item = near[:3000].copy()
    item[7] = np.maximum(near[7], near[3000:].max(0))
    item[:, 7] = item[7]
    for i in (0, 7):
        item[i, i] = -2
        assert sorted(got[i]) == sorted(np.argsort(-item[i])[:10].tolist())


def test_chats(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 0, 1, 2]), rng.choice([None, "user", "assistant"]), rng.choice([None, "", "hé\n<|im_end|>", "東京", "x" * 300_000]), "t") for _ in range(60)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, n string")
    key = lambda r: tuple((x is not None, x or 0 if isinstance(x, int) or x is None else x) for x in r[1:4])
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:4]))
        want[c] = (len(own), "".join(f"<|im_start|>{'unknown' if r[2] is None else r[2]}\n{r[3] or ''}<|im_end|>\n" for r in own))
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.format_chats(turns).collect()}
    assert got == want and key
    assert chat.format_chats(turns.where("false")).count() == 0


def test_chats_in_several_buffers(spark, monkeypatch):
    """Small Arrow batches, and buffers of a few conversations, give the same strings."""
    rng = random.Random(2)
    rows = [(rng.randint(0, 40), i, rng.choice(["user", "assistant"]), "é" * rng.choice([0, 3, 900, 40_000])) for i in range(300)]
    rows += [(99, i, "user", "x" * 100_000) for i in range(30)]
    want = {c: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for k, _, r, t in rows if k == c) for c in {r[0] for r in rows}}
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        monkeypatch.setattr(chat, "PART_BYTES", 50_000)
        assert {r["conv_id"]: r["text"] for r in chat.format_chats(turns).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 300 and 3000").orderBy("doc_id").limit(40).collect()
    words = [w for r in source for w in r["text"].split()]
    rng = random.Random(6)
    item = " ".join(rng.choice(words) for _ in range(30))
    fresh = lambda: " ".join(rng.choice(words) for _ in range(120))
    one = fresh()
    rows = [(i, fresh(), "en", "s", 1) for i in range(20)]
    rows += [(20, one, "en", "s", 1), (21, one.replace(one.split()[60], "altered"), "en", "s", 1), (22, fresh() + " " + item, "en", "s", 1), (23, rows[0][1] + "\nand a line of its own for this one", "en", "s", 1), (24, None, None, None, None), (25, "", "en", "s", 0), (None, fresh(), "en", "s", 1)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_pipeline_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus)
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {24, 25} & set(kept["language_id"]) == set() and set(range(24)) <= set(kept["language_id"])
    assert kept["line_dedup"][23] == "and a line of its own for this one"
    assert {20, 22} <= set(kept["near_duplicates"]) and 21 not in kept["near_duplicates"]
    assert 22 not in kept["decontamination"] and set(range(21)) <= set(kept["decontamination"])
    packed = corpus_pipeline.run(spark, corpus).collect()
    assert {i for r in packed for i in r["doc_ids"]} == set(kept["decontamination"]) - {None}
    empty = spark.read.parquet(f"{corpus}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, corpus).count() == 0


def test_pipeline_drops_short_lines(spark):
    rows = [(1, "Read more\n\t\r\n\n}\nfirst"), (2, "second\n \n\t\r\n\n Read more "), (3, "Les.\nLes.\nthird"), (4, "Les."), (5, "\n\t")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    want = {1: rows[0][1], 2: "second\n \n\t\r\n", 3: "Les.\nthird", 5: "\n\t"}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_pipeline_clashing_columns(spark, corpus):
    """Extra columns of names that stages use themselves, repeated rows, an id with two texts and a very long text."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    long = " ".join(r["text"] for r in docs.where("doc_id < 20").collect())
    more = spark.createDataFrame([(3, "another text\nof that id", "en", "s", 1), (90, long * 40, "en", "s", 1)], COLUMNS)
    names = ["language", "n_lines", "n_dropped", "__kept", "__done", "__id", "__th", "class_id", "n_links", "item_id", "distance", "n", "th", "component"]
    docs = docs.union(docs.where("doc_id = 5")).union(more).withColumns({c: F.lit("mine") for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, corpus).toArrow())
        assert docs.columns == [*[c.split()[0] for c in COLUMNS.split(", ")], *names]
        assert docs.where(" or ".join(f"{c} != 'mine'" for c in names)).count() == 0
    assert docs.where("doc_id = 5").count() == 2
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, corpus)
    assert rows.columns == ["window", "tokens", "doc_ids", "starts", "lengths"] and rows.count() > 0
