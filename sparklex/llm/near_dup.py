"""Near-duplicate groups with SetSketch registers.

A document is the set of its k-word shingles.  Its sketch has m registers
``K_i = floor(1 - log_b h_i)`` for the least of exponential variates h_i over the
set: exponentially spaced truncated minima, merged by a register-wise maximum.
With b near 1 equal registers are as likely as the Jaccard similarity.

1. Texts of the same set collapse into one.
2. Bands of register values are hashed; sets that share a band meet.
3. In each bucket the similarity is estimated jointly, by likelihood, from the
   registers that are larger, smaller and equal and from the set sizes; sets that
   may reach the threshold are connected, by as few pairs as it takes.
4. The texts of each connected component gather and all its pairs are compared by
   their exact shingle sets, through an inverted list of the component's shingles.
   The links found are counted; they make up the groups.

No bucket or component is cut: large ones are split into blocks, and every pair of
blocks meets in a task of its own.

Defined results: null ids, null texts and texts without words have no duplicates;
rows that share an id are one document, near to another if any of its texts is, and
in one group with all that any of its texts is near to; repeated rows count once; texts
of fewer than k words are one shingle; a group is named by its least id; an empty table
gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.llm.graph import connected_components
from sparklex.llm.shared import stored
from sparklex.llm.text import binary_array, mix64, shingles, word_hashes


#: Up to so many linked sets (six longs each) the list is broadcast, so that only
#: their texts are shuffled; a longer list is joined by shuffling both sides.
BROADCAST_ROWS = 1_000_000
BUCKET = 10_000  # sets of a bucket beyond which it is split
COMPONENT = 2_000  # texts of a component beyond which it is split


@dataclass(frozen=True)
class SetSketch:
    """m registers in 0..2^16-1 for base b and rate a, grouped in bands of ``rows``."""

    registers: int = 256
    rows: int = 4
    base: float = 1.001
    rate: float = 20.0

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(20211)
        return rng.integers(0, 2**32, self.registers, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, self.registers, dtype=np.uint32)

    def of(self, items: np.ndarray) -> np.ndarray:
        """Sketch of a non-empty array of 64-bit hashes."""
        mul, add = self.keys()
        least = np.full(self.registers, 0xFFFFFFFF, np.uint32)
        x = (items >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 256):
            part = x[at : at + 256, None] * mul
            part += add
            np.minimum(least, part.min(0), out=least)
        # a uniform variate's least value gives the least exponential variate
        h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / self.rate
        return np.clip(np.floor(1 - np.log(h) / np.log(self.base)) + 20_000, 0, 65_535).astype(np.uint16)

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sketch of the union of two sets."""
        return np.maximum(a, b)

    def bands(self, sketches: np.ndarray) -> np.ndarray:
        """Hash of each band of each sketch."""
        n = self.registers // self.rows
        parts = sketches[:, : n * self.rows].reshape(len(sketches), n, self.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), parts.shape[:2]).copy()
        for j in range(self.rows):
            key = mix64(key * np.uint64(0x100000001B3) + parts[:, :, j])
        return key.view(np.int64)

    def jaccard(self, one: np.ndarray, n_one: float, many: np.ndarray, n_many: np.ndarray) -> np.ndarray:
        """Maximum-likelihood Jaccard of one sketch with each of many, given set sizes."""
        up = (one > many).sum(1, dtype=np.int64)
        down = (one < many).sum(1, dtype=np.int64)
        u = n_one / (n_one + n_many)
        v = 1 - u
        lo, hi = np.zeros(len(many)), np.minimum(u / v, v / u)
        b, m = self.base, self.registers
        log_b = np.log(b)

        def slope(j):  # of the log-likelihood in j; it falls
            x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
            px, py = -np.log1p(-x * (b - 1) / b) / log_b, -np.log1p(-y * (b - 1) / b) / log_b
            dx, dy = -v * (b - 1) / b / (1 - x * (b - 1) / b) / log_b, -u * (b - 1) / b / (1 - y * (b - 1) / b) / log_b
            rest = np.maximum(1 - px - py, 1e-12)
            return up * dx / np.maximum(px, 1e-12) + down * dy / np.maximum(py, 1e-12) - (m - up - down) * (dx + dy) / rest

        for _ in range(25):
            mid = (lo + hi) / 2
            rising = slope(mid) > 0
            lo, hi = np.where(rising, mid, lo), np.where(rising, hi, mid)
        return (lo + hi) / 2


def _sketch_udf(sketch: SetSketch, k: int):
    kind = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("registers", pa.binary())])

    @F.arrow_udf("struct<h1:bigint,h2:bigint,n:bigint,registers:binary>")
    def sketch_of(texts: pa.Array) -> pa.Array:
        rows = np.zeros((len(texts), sketch.registers), np.uint16)
        facts = np.zeros((3, len(texts)), np.int64)
        for lo, words, offsets in word_hashes(texts):
            for i in range(len(offsets) - 1):
                items = np.unique(shingles(words[offsets[i] : offsets[i + 1]], k))
                if len(items):
                    rows[lo + i] = sketch.of(items)
                    sums = np.array([items.sum(dtype=np.uint64), mix64(items).sum(dtype=np.uint64)])
                    facts[:, lo + i] = *sums.view(np.int64), len(items)
        arrays = [pa.array(x) for x in facts] + [binary_array(rows)]
        return pa.StructArray.from_arrays(arrays, fields=list(kind), mask=pa.array(facts[2] == 0))

    return sketch_of.asNondeterministic()


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, sketch: SetSketch = SetSketch()) -> DataFrame:
    """(doc_id, th, h1, h2, n, registers) of every text that has words, th its hash; (h1, h2) identify its set."""
    own = _texts(docs, doc_id, text)
    return own.select("doc_id", F.xxhash64("text").alias("th"), _sketch_udf(sketch, k)("text").alias("s")).where("s is not null").select("doc_id", "th", "s.*")


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition of (band, node): the distinct groups of two or more nodes that share a band."""
    got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not got:
        return
    band, ids = (np.concatenate(x) for x in zip(*got))
    order = np.lexsort((ids, band))
    band, ids = band[order], ids[order]
    cuts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
    sizes = np.diff(cuts, append=len(band))
    seen = set()
    for at, size in zip(cuts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        members = np.unique(ids[at : at + size])
        if len(members) > 1 and (key := members.tobytes()) not in seen:
            seen.add(key)
    out = [np.frombuffer(x, np.int64) for x in seen]
    for at in range(0, len(out), 1000):
        part = out[at : at + 1000]
        offsets = np.cumsum([0, *map(len, part)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part)))], ["members"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, of a partition sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi in _runs(keys):
            if held and held[-1].column(0)[0].as_py() != keys[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _spread(n: int, near) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the graph in which ``near(i, others)`` tells the neighbours of i."""
    rest = np.arange(n)
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            found = near(i, rest)
            for j in rest[found].tolist():
                queue.append(j)
                yield i, j
            rest = rest[~found]


def _linker(sketch: SetSketch, least: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            nodes = table.column("node").to_numpy()
            sizes = table.column("n").to_numpy().astype(float)
            rows = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(len(nodes), sketch.registers)
            edges = [(nodes[i], nodes[j]) for i, j in _spread(len(nodes), lambda i, o: sketch.jaccard(rows[i], sizes[i], rows[o], sizes[o]) >= least)]
            if edges:
                a, b = np.array(edges, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return link


def _first_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's text once a task: repeated rows stop here."""
    seen: set[int] = set()
    for batch in batches:
        nodes = batch.column("node").to_pylist()
        new = [i for i, n in enumerate(nodes) if n not in seen and not seen.add(n)]
        yield batch.take(pa.array(new, pa.int64()))


def _shared(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, how many items set i shares with each set) of sets of distinct items."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    first = np.concatenate([[True], np.diff(flat[order]) != 0])
    begin = np.flatnonzero(first)
    item = np.empty(len(flat), np.int64)
    item[order] = np.cumsum(first) - 1
    count = np.diff(begin, append=len(flat))
    posted = owner[order]  # sets that have each item
    ends = np.cumsum(sizes)
    for i in range(len(sets)):
        own = item[ends[i] - sizes[i] : ends[i]]
        own = own[count[own] > 1]
        n = count[own]
        at = np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(posted[at], minlength=len(sets))
        both[i] = sizes[i]
        yield i, both


def _verifier(k: int, threshold: float):
    """Links of the pairs within a block, or between two, of a component."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
            table = table.take(pa.array(first))
            block = table.column("block").to_numpy()
            sets = []
            for _, words, offsets in word_hashes(table.column("text").combine_chunks()):
                sets += [np.unique(shingles(words[offsets[i] : offsets[i + 1]], k)) for i in range(len(offsets) - 1)]
            sizes = np.array([len(s) for s in sets])
            within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
            root, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
            for i, both in _shared(sets):
                near = (both >= threshold * (sizes + sizes[i] - both)) & (both > 0)
                near[i] = False
                if not within:
                    near &= block != block[i]
                links[i] = near.sum()
                met = np.unique(np.append(root[near], root[i]))
                if len(met) > 1:
                    root[np.isin(root, met)] = met[0]
            some = links > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]]), pa.array(links[some])], ["node", "root", "links"])

    return verify


def _block_pairs(rows: DataFrame, size: str, limit: int) -> DataFrame:
    """rows with their ``block`` of a group of that size, once for each pair (i, j) of blocks that it is in."""
    blocks = F.ceil(F.col(size) / limit).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    return rows.select("*", F.explode(pair).alias("pair")).select("*", "pair.*").drop("pair")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, k: int = 3, sketch: SetSketch = SetSketch(), slack: float = 0.12) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies): a row for every document that has copies or near ones.

    Texts are near when the exact Jaccard similarity of their k-word shingle sets is at
    least ``threshold``; groups are the connected components, and ``class_id`` is the
    group's least id.  ``n_links`` counts the different texts (shingle sets) that the
    document's text is near to, ``n_copies`` the documents of the very same set, itself
    included.  A document without a row is a group of its own.  ``slack`` is how far below
    the threshold an estimate may lie and still be verified (four standard errors at
    256 registers).
    """
    all_sketches = stored(sketches(docs, doc_id, text, k, sketch).withColumn("node", F.xxhash64("h1", "h2")), "sketches")
    members = stored(all_sketches.select("doc_id", "node").distinct(), "same-set")
    chosen = all_sketches.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("rep")).select("node", "rep.*")
    reps = stored(all_sketches.join(chosen, ["node", "doc_id", "th"], "left_semi").dropDuplicates(["node"]).select("node", "doc_id", "th", "n", "registers"), "different-sets")

    @F.arrow_udf("array<bigint>")
    def bands(registers: pa.Array) -> pa.Array:
        rows = np.frombuffer(b"".join(registers.to_pylist()), np.uint16).reshape(len(registers), sketch.registers)
        keys = sketch.bands(rows)
        offsets = pa.array((np.arange(len(rows) + 1) * keys.shape[1]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))

    banded = reps.select(F.explode(bands("registers")).alias("band"), "node")
    # bands of very many sets are few: at most so many as BUCKET goes into all of them
    hot = stored(banded.groupBy("band").agg(F.count("*").alias("size")).where(F.col("size") > BUCKET), "hot-bands")
    members_of = banded.join(hot, "band", "left_anti") if not hot.isEmpty() else banded
    groups = members_of.repartition("band").mapInArrow(_buckets, "members array<bigint>").distinct()
    met = groups.select(F.xxhash64("members").alias("bucket"), F.explode("members").alias("node"))
    if not hot.isEmpty():
        met = met.unionByName(_block_pairs(banded.join(hot, "band"), "size", BUCKET).select(F.xxhash64("band", "i", "j").alias("bucket"), "node"))
    gathered = met.join(reps, "node").select("bucket", "node", "n", "registers").repartition("bucket").sortWithinPartitions("bucket")
    links = gathered.mapInArrow(_linker(sketch, threshold - slack), "a bigint, b bigint")
    clusters = connected_components(links)
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    asked = clusters.join(sizes, "component").join(reps.select("node", "doc_id", "th"), "node")
    asked = stored(asked.select("node", "component", "size", F.col("doc_id").alias("id"), "th"), "clusters")

    own = _texts(docs, doc_id, text)
    listed = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    texts = own.join(listed, (own["doc_id"] == listed["id"]) & (F.xxhash64(own["text"]) == listed["th"]))
    texts = texts.select("component", "size", "node", "text").mapInArrow(_first_texts, "component bigint, size bigint, node bigint, text string")
    texts = _block_pairs(texts, "size", COMPONENT).select(F.xxhash64("component", "i", "j").alias("task"), "i", "j", "block", "node", "text")
    checked = stored(texts.repartition("task").sortWithinPartitions("task").mapInArrow(_verifier(k, threshold), "node bigint, root bigint, links bigint"), "verified")

    edges = checked.select(F.col("node").alias("a"), F.col("root").alias("b"))
    several = members.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("a")).where("a != b").select("doc_id", "b")
    more = stored(members.join(several, "doc_id").select(F.col("node").alias("a"), "b").where("a != b"), "texts-of-an-id")
    if asked.where(F.col("size") > COMPONENT).isEmpty() and more.isEmpty():
        roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        roots = connected_components(edges.unionByName(more)).withColumnRenamed("component", "root")
    linked = checked.groupBy("node").agg(F.sum("links").alias("links"))
    each = members.groupBy("node").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("copies"))
    each = each.join(roots, "node", "left").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = each.groupBy("root").agg(F.min("lo").alias("class_id"), F.max("hi").alias("last")).where("class_id < last")
    facts = each.join(classes, "root").select("node", "class_id", F.coalesce("links", F.lit(0)).alias("links"), "copies")
    found = members.join(facts, "node")
    return found.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("n_links"), F.max("copies").alias("n_copies"))
