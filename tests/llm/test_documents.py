"""Operators over documents: brute force on small fixtures, and odd rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import orc
from pyspark.sql import functions as F

from sparklex.llm import decontam, language_id, licenses, line_dedup, near_dup, packing, substring_dedup, token_store

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ["a", "n", "s", "w", "h1", "th", "rank", "kept", "rep", "m", "t", "component", "language", "band", "block", "tokens", "__kept", "__done", "__id"]
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def frame(spark, rows):
    """documents with extra columns of names that the operators use themselves."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).withColumns({c: F.lit("x") for c in CLASH})


def prose(rng, n, words=None):
    words = words or [f"w{i:x}" for i in range(4000)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = prose(random.Random(1), 150_000)
    rows = [(None, "a text without an id " * 5), (1, None), (2, ""), (3, " \n\n"), (4, long), (5, "twice the same row of text"), (5, "twice the same row of text"), (6, "one"), (None, None), (7, "ß é 東京 ,,, !!")]
    return frame(spark, rows)


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# ------------------------------------------------------------ 1 token store


def test_token_round_trip(spark, odd, tmp_path):
    path = str(tmp_path / "orc")
    token_store.write_tokens(odd, path)
    table = token_store.read_tokens(spark, path)
    back = table.select("doc_id", token_store.detokenized(packing.BYTE_BPE)("tokens").alias("text"))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, back.collect()), key=key) == sorted(map(tuple, odd.select("doc_id", "text").collect()), key=key)
    assert token_store.read_tokens(spark, path, [4]).count() == 1
    token_store.write_tokens(odd.where("false"), path + "0")
    assert token_store.read_tokens(spark, path + "0").count() == 0


def scanned(df):
    """Rows of df, and how many the scan gave."""
    rows = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return rows, leaf.metrics().get("numOutputRows").get().value()


def test_token_store_prunes(spark, tmp_path):
    """Integers by stripes of row groups, of which look-ups read one, or none where Bloom filters know better."""
    path = str(tmp_path / "orc")
    docs = spark.range(0, 70_000 * 7, 7).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), "id").alias("text"))
    token_store.write_tokens(docs, path)
    files = [orc.ORCFile(str(f)) for f in (tmp_path / "orc").glob("*.orc")]
    assert sum(f.nrows for f in files) == 70_000
    assert all(f.nstripes >= 1 and f.row_index_stride == 2000 and f.compression == "ZSTD" for f in files)
    rows, n = scanned(token_store.read_tokens(spark, path, [7 * 12_345]))
    assert [r["doc_id"] for r in rows] == [7 * 12_345] and n <= 2000
    for missing in range(7 * 5000 + 1, 7 * 5000 + 7):  # inside the range of a row group
        rows, n = scanned(token_store.read_tokens(spark, path, [missing]))
        assert rows == [] and n == 0
    assert "doc_id" in token_store.read_tokens(spark, path, [7])._jdf.queryExecution().toString().split("PushedFilters")[1]


# ------------------------------------------------------------ 2 line dedup


def kept_lines(batches, least=1):
    """Brute force: text of every document after line dedup over batches of (id, text)."""
    seen, out = set(), {}
    for batch in batches:
        for i, text in sorted(batch):
            lines = []
            for line in text.split("\n"):
                key = line.strip(" ")
                if len(key) < least or not line.strip() or key not in seen:
                    lines.append(line)
                if len(key) >= least:
                    seen.add(key)
            out[i] = "\n".join(lines)
    return out


def cleaned(index, spark, rows):
    return dict(pairs(index.apply(frame(spark, rows)), "doc_id", "text"))


@pytest.mark.parametrize("least", [1, 20])
def test_line_index_is_reversible(spark, tmp_path, least):
    rng = random.Random(3)
    lines = [prose(rng, 6) for _ in range(40)] + ["short", "", " \t"]
    text = lambda: "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8)))
    one, two = ([(i, text()) for i in ids] for ids in (range(20), range(20, 40)))
    path = str(tmp_path / "lines")
    index = line_dedup.LineIndex(spark, path, shards=3, min_chars=least)
    index.insert(frame(spark, one))
    assert cleaned(index, spark, one) == kept_lines([one], least)
    index.insert(frame(spark, two))
    assert cleaned(index, spark, one + two) == kept_lines([one, two], least)
    gone = {0, 1, 2, 5, 21, 30}
    index.delete(spark.createDataFrame([(i,) for i in gone | {999}], "x bigint"))
    left = [[d for d in b if d[0] not in gone] for b in (one, two)]
    assert cleaned(index, spark, left[0] + left[1]) == kept_lines(left, least)
    # the folder holds all of it: another object goes on where this one stopped
    index = line_dedup.LineIndex(spark, path)
    assert index.min_chars == least and cleaned(index, spark, left[0] + left[1]) == kept_lines(left, least)
    three = [(50, one[0][1]), (1, one[1][1]), (2, two[3][1])]  # 1 and 2 come back
    index.insert(frame(spark, three))
    assert cleaned(index, spark, left[0] + left[1] + three) == kept_lines([*left, three], least)
    want = {}
    for _, t in left[0] + left[1] + three:
        for line in t.split("\n"):
            if line.strip() and len(line.strip(" ")) >= least:
                want[line.strip(" ")] = want.get(line.strip(" "), 0) + 1
    assert sorted(r["refs"] for r in index.counts().collect()) == sorted(want.values())
    with pytest.raises(ValueError):
        index.insert(frame(spark, [(50, "again")]))
    stale = line_dedup.LineIndex(spark, path)
    index.insert(frame(spark, [(60, "a line that only this document has")]))
    with pytest.raises(RuntimeError):
        stale.insert(frame(spark, [(61, "x")]))


def test_line_filters_decide(spark, monkeypatch, tmp_path):
    """What filters and counts answer is what is kept: with broken filters the result is wrong."""
    one, two = [(1, "a line that comes twice")], [(2, "a line that comes twice\na new line")]
    for broken in (False, True):
        index = line_dedup.LineIndex(spark, str(tmp_path / str(broken)))
        index.insert(frame(spark, one))
        if broken:  # a filter that has lost its lines
            monkeypatch.setattr(index, "_filters", lambda shards: spark.createDataFrame([], "shard int, filter binary"))
        index.insert(frame(spark, two))
        assert (cleaned(index, spark, one + two) == kept_lines([one, two])) != broken


def test_line_index_grows(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 1)
    rows = [[(100 * b + i, f"line {b} {i}\nline {b} {i + 1}\nshared {i % 7}") for i in range((10, 60, 60)[b])] for b in range(3)]
    index = line_dedup.LineIndex(spark)
    for batch in rows:
        index.insert(frame(spark, batch))
    assert len(index.changes) > 3 and index.shards > 50
    assert cleaned(index, spark, sum(rows, [])) == kept_lines(rows)
    index.delete(spark.createDataFrame([(i,) for i in range(0, 300, 3)], "x bigint"))
    left = [[d for d in b if d[0] % 3] for b in rows]
    assert cleaned(index, spark, sum(left, [])) == kept_lines(left)


def test_line_dedup_odd_rows(spark, odd):
    got = line_dedup.dedup_lines(odd, n_lines="n", n_dropped="m")
    assert sorted(str(r["text"]) for r in got.collect()) == sorted(str(r["text"]) for r in odd.collect())
    assert got.where("m > 0").count() == 0
    assert line_dedup.dedup_lines(odd.where("false")).count() == 0
    assert line_dedup.dedup_lines(odd.where("false"), batches=2).count() == 0
    same = [(1, "x\ny"), (1, "x\ny"), (1, "y\nz"), (2, "z"), (None, "x")]  # an id with two texts, a repeated row
    got = pairs(line_dedup.dedup_lines(frame(spark, same), batches=2).withColumn("i", F.coalesce("doc_id", F.lit(0))), "i", "text")
    texts = [t for i, t in got if i == 1]
    assert [t for i, t in got if i != 1] == ["x", ""] and sorted(texts) in (["x\ny", "x\ny", "z"], ["x", "x", "y\nz"])
    many = [(i, "the same line everywhere\nand one of its own %d" % i) for i in range(300)]
    assert dict(pairs(line_dedup.dedup_lines(frame(spark, many), batches=3), "doc_id", "text")) == kept_lines([many])


def test_cuckoo_filter():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 200_000, dtype=np.uint64))
    chain = line_dedup.FilterChain([])
    parts = np.concatenate([np.full(len(part), chain.insert(part)) for part in np.array_split(keys, 7)])
    assert chain.contains(keys).all() and len(chain.parts) > 2
    gone = np.random.default_rng(1).random(len(keys)) < 0.5
    chain.delete(keys[gone], parts[gone])
    chain = line_dedup.FilterChain.from_bytes(chain.to_bytes())
    assert chain.contains(keys[~gone]).all()
    assert chain.contains(keys[gone]).mean() < 0.01
    twice = np.repeat(keys[:3], 2)
    part = chain.insert(twice)
    chain.delete(keys[:3], np.full(3, part))
    assert chain.contains(keys[:3]).all()
    chain.delete(keys[:3], np.full(3, part))
    assert not line_dedup.FilterChain(chain.parts[part:part + 1]).contains(keys[:3]).all()


# ------------------------------------------------------------ 3 language


def test_language_held_out(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit_on(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1 and length(text) > 200 and lang in ('en', 'fr', 'de', 'es')")
    got = language_id.identify_languages(held, model=model).select("lang", "language.*").toPandas()
    got.columns = ["truth", "lang", "similarity", "accepted"]
    assert len(got) > 100 and got.accepted.mean() > 0.95
    assert (got.lang == got.truth)[got.accepted].mean() > 0.95
    # another script entirely is too far from every centroid
    foreign = frame(spark, [(1, "東京都は日本の首都であり世界最大の都市の一つである" * 5)])
    assert not language_id.identify_languages(foreign, model=model).first()["language"]["accepted"]
    rows = language_id.identify_languages(odd, model=model).select("text", "language.*").collect()
    assert all(not r["accepted"] and r["similarity"] == 0 for r in rows if not (r["text"] or "").strip())
    assert len(rows) == 10
    assert language_id.identify_languages(odd.where("false"), output="l").count() == 0


def test_language_rejects_other_languages(spark):
    """Fitted on enough short texts to know how near these are."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.fit_on(docs)
    other = [
        "De kat slaapt op de bank terwijl de regen langzaam op straat valt en niemand vanavond het huis wil verlaten omdat het erg koud is",
        "Kot spi na kanapie podczas gdy deszcz powoli pada na ulice i nikt nie chce dzis wieczorem wychodzic z domu bo jest bardzo zimno",
        "Kissa nukkuu sohvalla kun sade lankeaa hitaasti kadulle eika kukaan halua lahtea kotoa tana iltana koska on hyvin kylma",
        "xq zzkw vbnq wrtp lkjh gfds mnbv cxzq wwqp rrtk zzxv qqwp lmnb vckx jjhg ffds zxcq",
    ]
    assert not model.predict(pa.array(other))[2].any()
    assert model.predict(pa.array(["the"]))[2].all()


def test_language_is_the_nearest_centroid():
    """Against cosines of one text at a time; ties and repeated rows."""
    rng = random.Random(12)
    kinds = {"a": "aeiou bcd", "b": "xyzuv wkl", "c": "mnopq rst"}
    texts, labels = zip(*[("".join(rng.choice(kinds[k]) for _ in range(rng.randint(20, 400))), k) for k in "abc" * 40])
    model = language_id.LanguageModel.fit(list(texts), list(labels))
    best, cosine, kept = model.predict(pa.array([*texts, *texts[:3], None, ""]))
    for i, text in enumerate(texts):
        (_, counts), = language_id.term_counts(pa.array([text]))
        v = [float(np.log1p(np.float32(c)) * w) for c, w in zip(counts[0], model.idf)]
        norm = sum(x * x for x in v) ** 0.5
        near = [sum(x * float(y) for x, y in zip(v, c)) / norm for c in model.centroids]
        assert abs(max(near) - cosine[i]) < 1e-4 and near[best[i]] > max(near) - 1e-4
    assert [model.labels[b] for b in best[:120]] == list(labels) and kept[:120].mean() > 0.97
    assert best[120:123].tolist() == best[:3].tolist() and not kept[123:].any()
    twice = language_id.LanguageModel.fit(["same words here"] * 4, ["b", "a", "b", "a"])
    assert twice.labels[twice.predict(pa.array(["same words here"]))[0][0]] == "a"
    assert not language_id.LanguageModel.fit([], []).predict(pa.array(["x y z"]))[2].any()


# ------------------------------------------------------------ 4 near duplicates


def groups(rows, k=3, threshold=0.5):
    """Brute force: (doc_id, class_id, n_links, n_copies)."""
    ids = {}
    for i, t in rows:
        words = WORD.findall((t or "").lower())
        if i is not None and words:
            n = min(k, len(words))
            ids.setdefault(frozenset(tuple(words[j : j + n]) for j in range(len(words) - n + 1)), set()).add(i)
    root = {i: i for own in ids.values() for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets, links = list(ids), {}
    for x, a in enumerate(sets):
        for b in sets[x:]:
            if a == b or len(a & b) >= threshold * len(a | b):
                if a != b:
                    links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                for i in ids[a]:
                    for j in ids[b]:
                        lo, hi = sorted((find(i), find(j)))
                        root[hi] = lo
    size = {}
    for i in root:
        size[find(i)] = size.get(find(i), 0) + 1
    own = {i: [s for s in sets if i in ids[s]] for i in root}
    return sorted((i, find(i), sum(links.get(s, 0) for s in own[i]), max(len(ids[s]) for s in own[i])) for i in root if size[find(i)] > 1)


@pytest.mark.parametrize("split", [False, True])
def test_near_duplicates(spark, odd, monkeypatch, split):
    if split:  # buckets and components in blocks
        monkeypatch.setattr(near_dup, "BUCKET", 3)
        monkeypatch.setattr(near_dup, "COMPONENT", 4)
    rng = random.Random(5)
    rows = []
    for i in range(25):
        base = prose(rng, rng.randint(30, 200)).split()
        rows.append((len(rows), " ".join(base)))
        for _ in range(14 if i == 7 else i % 4):
            copy = list(base)
            for _ in range(len(copy) // 40):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + j, rows[0][1]) for j in range(30)]
    x, y, z = (prose(rng, 40) for _ in range(3))
    rows += [(900, x), (905, x), (905, y), (903, y), (906, z), (906, z + " more"), (907, z), (908, prose(rng, 9)), (908, prose(rng, 9))]
    rows += [(900, x)] * 3
    rng.shuffle(rows)
    got = near_dup.near_duplicates(frame(spark, rows))
    want = groups(rows)
    assert {(903, 900), (905, 900)} <= {w[:2] for w in want} and 908 not in {w[0] for w in want}
    assert pairs(got, "doc_id", "class_id", "n_links", "n_copies") == want
    assert pairs(near_dup.near_duplicates(odd), "doc_id") == []
    assert near_dup.near_duplicates(odd.where("false")).count() == 0


def test_setsketch_estimates():
    sketch = near_dup.SetSketch()
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        x = rng.integers(0, 2**63, 6000, dtype=np.uint64)
        n = int(4000 * 2 * share / (1 + share))
        one, two = x[:4000], np.concatenate([x[:n], x[4000 : 8000 - n]])
        a, b = sketch.of(one), sketch.of(two)
        true = n / len(np.union1d(one, two))
        assert abs(sketch.jaccard(a, len(one), b[None], np.array([len(two)]))[0] - true) < 0.12
        assert (sketch.merge(a, b) == sketch.of(np.union1d(one, two))).all()


# ------------------------------------------------------------ 5 repeated passages


def spans(rows, least=50):
    docs, where = {}, {}
    for i, t in rows:
        words = WORD.findall((t or "").lower())
        docs[i] = words
        for j in range(len(words) - least + 1):
            where.setdefault(tuple(words[j : j + least]), set()).add(i)
    out = []
    for i, words in docs.items():
        own = []
        for j in range(len(words) - least + 1):
            if len(where[tuple(words[j : j + least])]) > 1:
                if own and j <= own[-1][1]:
                    own[-1][1] = j + least
                else:
                    own.append([j, j + least])
        out += [(i, a, b) for a, b in own]
    return sorted(out)


@pytest.fixture(scope="module")
def repeating():
    rng = random.Random(7)
    shared = [prose(rng, n) for n in (49, 50, 51, 80, 140, 300)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 90))]
        for _ in range(i % 4):
            parts += [rng.choice(shared), prose(rng, rng.randint(0, 60))]
        rows.append((i, " ".join(parts)))
    # a left and a right part that recur in different documents
    long = prose(rng, 90).split()
    rows += [(70, " ".join(long)), (71, " ".join(long[:60])), (72, " ".join(long[35:]))]
    return rows + [(60, rows[3][1]), (61, shared[4]), (62, "same " * 200), (63, "same " * 120)]


@pytest.mark.parametrize("hot", [None, 5, 0])
def test_repeated_passages(spark, odd, repeating, monkeypatch, hot):
    """With a low bound, anchors that many documents have, or all, take the salted way."""
    if hot is not None:
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        monkeypatch.setattr(substring_dedup, "SHARD", 20)
    got = substring_dedup.repeated_passages(frame(spark, repeating))
    assert pairs(got, "doc_id", "first_word", "end_word") == spans(repeating)
    assert pairs(substring_dedup.repeated_passages(odd), "doc_id") == []
    assert substring_dedup.repeated_passages(odd.where("false")).count() == 0


def test_passage_of_very_many_documents(spark):
    rng = random.Random(17)
    notice = prose(rng, 70)
    rows = [(i, f"{prose(rng, rng.randint(0, 12))} {notice} {prose(rng, 5)}") for i in range(2600)]
    got = pairs(substring_dedup.repeated_passages(frame(spark, rows)), "doc_id", "first_word", "end_word")
    at = [len(t.split()) - 75 for _, t in rows]
    assert [g[0] for g in got] == list(range(2600)) and all(a <= n and e >= n + 70 for (_, a, e), n in zip(got, at))


def test_automata_locate(spark, repeating, monkeypatch):
    """Without their words the automata find nothing, so nothing else can tell where passages are."""
    monkeypatch.setattr(substring_dedup, "compiled", lambda passages: substring_dedup.ahocorasick.Automaton())
    assert substring_dedup.repeated_passages(frame(spark, repeating)).count() == 0


# ------------------------------------------------------------ 6 packing


def test_differencing_of_two():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randint(1, 1000) for _ in range(rng.randint(2, 30))]
        left = sorted(sizes)
        while len(left) > 1:
            left.append(left.pop() - left.pop())
            left.sort()
        sums = np.bincount(packing.difference(np.array(sizes), 2), sizes, 2)
        assert abs(sums[0] - sums[1]) == left[0]


def test_differencing_of_several():
    """Against lists of sums, merged largest onto smallest."""
    rng = random.Random(22)
    for n in (2, 3, 5, 8):
        sizes = [rng.randint(1, 500) for _ in range(rng.randint(n, 60))]
        heap = [(-s, i, [s] + [0] * (n - 1)) for i, s in enumerate(sizes)]
        while len(heap) > 1:
            heap.sort()
            (_, _, a), (_, _, b), *heap = heap
            c = sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)
            heap.append((c[-1] - c[0], len(sizes) + 1000 - len(heap), [x - c[-1] for x in c]))
        sums = sorted(np.bincount(packing.difference(np.array(sizes), n), sizes, n), reverse=True)
        assert [x - sums[-1] for x in sums] == heap[0][2]


def test_windows_are_near_equal_and_rise():
    rng = np.random.default_rng(23)
    sizes = rng.integers(1, 900, 600)
    loads = np.bincount(packing.pack(sizes, 4096), sizes)
    assert loads.max() <= 4096 and loads.max() - loads.min() <= 0.02 * 4096
    assert len(loads) <= -(-sizes.sum() // 4096) + 2
    assert np.bincount(packing.pack(np.full(5, 4), 10), np.full(5, 4)).tolist() in ([8, 8, 4], [8, 4, 8], [4, 8, 8])  # 20 don't fit in 2 of 10
    assert len(np.bincount(packing.pack(np.full(7, 6), 10))) == 7


def test_packing(spark, odd):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([1, 5, 40, 200, 3000]))) for i in range(120)]
    rows += [(7, "another text of an id"), (8, rows[8][1])]
    docs = frame(spark, rows).union(odd)
    capacity = 1000
    got = packing.pack_documents(docs, capacity=capacity, block_tokens=60_000).collect()
    held = {}
    for r in got:
        assert sum(r["lengths"]) == r["tokens"] <= capacity
        for i, a, n in zip(r["doc_ids"], r["starts"], r["lengths"]):
            held.setdefault(i, []).append((a, n))
    encode = packing.encoder(packing.BYTE_BPE).encode_ordinary
    want = {}
    for i, t in docs.select("doc_id", "text").collect():
        if i is not None and t:
            want.setdefault(i, []).append(len(encode(t)))
    assert set(held) == set(want)
    for i, chunks in held.items():
        assert sum(n for _, n in chunks) == sum(want[i])
        if len(want[i]) == 1:
            end = 0
            for a, n in sorted(chunks):
                assert a == end
                end += n
    assert len({r["window"] for r in got}) == len(got)
    assert packing.pack_documents(odd.where("false")).count() == 0


# ------------------------------------------------------------ 7 decontamination


def least_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, odd):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(6, 25))) for i in range(8)] + [(8, "one"), (9, None), (10, "?!"), (None, "two"), (11, "red fox"), (11, "red fox")]
    rows = []
    for i in range(40):
        text = prose(rng, 30)
        if i % 2:
            own = list(items[i % 8][1])
            for _ in range(rng.randint(0, len(own) // 10)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice(["", "q", own[at] + "z"])
            text += " " + "".join(own).upper() + ", " + prose(rng, 20)
        rows.append((i, text))
    rows += [(50, "someone and onerous"), (51, "No, ONE!"), (52, "a bored fox, a red foxglove"), (53, "a Red  Fox"), (53, "no fox")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    want = []
    for i, t in rows:
        for k, item in items:
            norm, budget = decontam.normalise(item), int(len(decontam.normalise(item)) * 0.08)
            if k is not None and norm and not budget and f" {norm} " in f" {decontam.normalise(t)} ":
                want.append((i, k, 0))
            elif k is not None and budget and (d := least_distance(norm, decontam.normalise(t))) <= budget:
                want.append((i, k, d))
    want = sorted(set(want))
    assert len(want) > 10 and {w[:2] for w in want if w[0] > 49} == {(51, 8), (53, 11)}
    got = decontam.contaminated(frame(spark, rows), bench)
    assert pairs(got, "doc_id", "item_id", "distance") == sorted(want)
    several = decontam.contaminated(frame(spark, rows), bench, automaton_chars=100)
    assert pairs(several, "doc_id", "item_id", "distance") == sorted(want)
    assert pairs(decontam.contaminated(odd, bench), "doc_id", "item_id") == [(6, 8)]
    assert decontam.contaminated(odd, bench.where("false")).count() == 0
    assert decontam.contaminated(odd.where("false"), bench).count() == 0


# ------------------------------------------------------------ 8 licences


def test_licences(spark, odd):
    rng = random.Random(9)
    rows = []
    names = sorted(licenses.TEMPLATES)
    for i in range(60):
        notice = licenses.TEMPLATES[rng.choice(names)][0].split()
        if i % 3 == 0:
            notice.insert(rng.randrange(len(notice)), "indeed")
        if i % 5 == 0:
            del notice[rng.randrange(len(notice))]
        rows.append((i, prose(rng, rng.randint(0, 30)) + " " + (" ".join(notice).upper() if i % 2 else " ".join(notice)) + "\n" + prose(rng, 10)))
    want = []
    for i, t in rows:
        words = WORD.findall(t.lower())
        for name, (notice, phrases) in licenses.TEMPLATES.items():
            whole = WORD.findall(notice.lower())
            placed = []
            for p in phrases:
                own = WORD.findall(p.lower())
                placed.append((next(j for j in range(len(whole)) if whole[j : j + len(own)] == own), own))
            spots = [[j - p for j in range(len(words)) if words[j : j + len(own)] == own] for p, own in placed]
            offset = next((o for o in range(-len(whole), len(words)) if all(any(abs(x - o) <= 4 for x in s) for s in spots)), None)
            if offset is not None:
                want.append((i, name, offset))
    assert len(want) > 40
    got = licenses.scan_licenses(frame(spark, rows))
    assert pairs(got, "doc_id", "license", "first_word") == sorted(want)
    assert licenses.scan_licenses(odd).count() == 0
    assert licenses.scan_licenses(odd.where("false")).count() == 0
    assert licenses.scan_licenses(odd, templates={}).count() == 0
    table = spark.createDataFrame([("own", "Use it freely but kindly", ["freely but kindly"]), ("own", None, ["x"]), (None, "a", ["a"]), ("none", "b", [])], "name string, notice string, phrases array<string>")
    got = licenses.scan_licenses(frame(spark, [(1, "you may use it freely, but kindly."), (1, "more"), (2, "freely")]), templates=table)
    assert pairs(got, "doc_id", "license") == [(1, "own")]


def test_licence_texts(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
    of this software and associated documentation files (the "Software"), to deal
    in the Software without restriction, including without limitation the rights to use"""
    rows = [(1, mit), (2, "// SPDX-License-Identifier: MPL-2.0\nint x;"), (3, "# SPDX-License-Identifier: GPL-2.0-only"), (4, "Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software"), (5, "License-Identifier: MIT")]
    got = pairs(licenses.scan_licenses(frame(spark, rows)), "doc_id", "license")
    assert got == [(1, "MIT"), (2, "SPDX-MPL-2.0"), (3, "SPDX-GPL-2.0"), (4, "BSD-3-Clause-end")]


def test_common_notices(spark):
    """Notices as they are found in the wild, not made from TEMPLATES."""
    notices = [
        ("Copyright (c) 2019 Someone. ALL RIGHTS RESERVED", {"All-rights-reserved"}),
        ("it under the terms of the GNU Lesser General Public License as published by", {"LGPL-notice"}),
        ("under the terms of the GNU Library General Public License, version 2", {"LGPL-2.0-notice"}),
        ("You should have received a copy of the GNU Affero General Public License along with it", {"AGPL-notice"}),
        ("This is free and unencumbered software released into the public domain.", {"Unlicense"}),
        ("made available under the terms of the Eclipse Public License v2.0", {"EPL-notice"}),
        ("Data is dedicated under CC0 by its authors", {"CC0-notice"}),
        ("CC0 1.0 Universal (CC0 1.0) Public Domain Dedication", {"CC0"}),
        ("a Creative Commons Zero dedication", {"CC0-long"}),
        ("Text is available under CC BY-SA 3.0", {"CC-BY-SA-notice"}),
        ("Shared under CC-BY-ND-4.0", {"CC-BY-ND-notice"}),
        ("Shared under CC BY-NC-SA 4.0", {"CC-BY-NC-notice", "CC-BY-NC-SA-notice"}),
        ("Shared under CC BY-NC-ND 2.0", {"CC-BY-NC-notice", "CC-BY-NC-ND-notice"}),
        ("Images are under CC BY 3.0", {"CC-BY-3.0-notice"}),
        ("Images are under CC BY 2.5", {"CC-BY-2.5-notice"}),
        ("a Creative Commons Attribution 4.0 International License", {"CC-BY-4.0-long"}),
        ("the Creative Commons Attribution-ShareAlike 4.0 licence", {"CC-BY-SA-long"}),
        ("the Creative Commons Attribution-Share Alike 3.0 licence", {"CC-BY-SA-spaced"}),
        ("the Creative Commons Attribution-NonCommercial 4.0 licence", {"CC-BY-NC-long"}),
        ("the Creative Commons Attribution-NoDerivatives 4.0 licence", {"CC-BY-ND-long"}),
        ("all of the rights are reserved under a public license by 4 lawyers", set()),
    ]
    got = {}
    for i, name in pairs(licenses.scan_licenses(frame(spark, [(i, f"words before.\n{t}\nand after") for i, (t, _) in enumerate(notices)])), "doc_id", "license"):
        got.setdefault(i, set()).add(name)
    assert [got.get(i, set()) for i in range(len(notices))] == [want for _, want in notices]


def test_word_hashes_equal_words():
    from sparklex.llm.text import word_hashes

    texts = ["A b, c", None, "", "b A", "é_É"]
    (_, words, offsets), = word_hashes(pa.array(texts))
    got = [words[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert [len(x) for x in got] == [3, 0, 0, 2, 2]
    assert got[0][:2] == got[3][::-1] and got[4][0] == got[4][1]
