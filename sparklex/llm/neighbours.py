"""Nearest neighbours over several shifted space-filling curves.

Unit vectors are projected to a few dimensions and ordered along ``curves`` Hilbert
curves, each with its own rotation of the projection and its own shift, so that a border
between cells of one curve falls elsewhere on the others.  Spark range-partitions and
sorts all curves at once.  Of each queried row, the ``window`` rows before and after it
on every curve are its candidates; they are compared by exact cosine, windows that cross
the end of a partition go on in the next, and the best k of all curves stay.

The projection holds the directions of most variance of a bounded sample (``FIT`` rows,
chosen by a hash of their ids).  The window is fitted too: for ``PROBES`` queries chosen
by a hash and as many of the least usual ones (of all queries, those least similar to
any of some reference rows, so that rare clusters count), the true neighbours are found
by brute force and their distances along the curves counted; the window is the least
that holds ``recall`` of them, on some curve, of either kind.  Every row is indexed and
every query gets that window.  On vectors that have structure windows stay narrow; on
random ones they grow with the table, as for any such index.

Of rows with the same vector the k + 1 lowest ids are indexed: no other can be among the
first k of any row, so a vector that very many rows share costs no more than k + 1 rows.

Defined results: null ids, null, empty, zero and non-finite vectors, and vectors of
another length than the table's most common one, neither get nor are neighbours; rows
that share an id are one item, which its best vector speaks for, and not their own
neighbour; equal similarities go to the lower id; with fewer than k other rows all of
them are neighbours; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklex.llm.shared import stored

DIMS, BITS = 10, 6
FIT = 10_000
PROBES = 100
PART_ROWS = 50_000


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points below 2^bits (Skilling's transform)."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            flip = np.where(high, p, 0)
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= flip | swap if i else flip
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(points.shape[0], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def curve_bases(sample: np.ndarray, curves: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(projection, lower corner, cells a unit) of each curve, from sampled unit vectors."""
    out = []
    dims = sample.shape[1] if sample.size else 0
    if not dims:
        return out
    _, weights, axes = np.linalg.svd(sample - sample.mean(0), full_matrices=False)
    axes = axes * (weights / max(weights[0], 1e-12))[:, None]  # what varies most counts most
    rng = np.random.default_rng(900)
    for _ in range(curves):
        turn, _ = np.linalg.qr(rng.standard_normal((len(axes), len(axes))))
        base = (turn[:DIMS] @ axes).T
        low = sample @ base
        lo, hi = low.min(0), low.max(0)
        size = np.maximum(hi - lo, 1e-9) * 2  # half of the cube is room for the shift
        out.append((base, lo - size * rng.uniform(0, 0.5, len(lo)), (1 << BITS) / size))
    return out


def curve_keys(vectors: np.ndarray, base: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Keys of unit vectors on one curve."""
    axes, corner, scale = base
    return hilbert_keys(np.clip((vectors @ axes - corner) * scale, 0, (1 << BITS) - 1).astype(np.int64))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dims)


def _top(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k (scores, ids) of each row of scores, each id once, without its own; missing ones are -inf."""
    order = np.argsort(ids, kind="stable")
    once, first = np.unique(ids[order], return_index=True)
    if len(once) < len(ids):  # vectors that share an id are one item: its best counts
        scores, ids = np.maximum.reduceat(scores[:, order], first, axis=1), once
    scores = np.where(ids[None, :] == own[:, None], -np.inf, scores) if len(ids) else scores
    if scores.shape[1] > 4 * k:
        # everything that ties with the k-th best stays in the running
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        wide = int((scores >= least[:, None]).sum(1).max())
        at = np.argpartition(-scores, min(wide, scores.shape[1]) - 1, axis=1)[:, :wide]
        scores, near = np.take_along_axis(scores, at, 1), ids[at]
    else:
        near = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((near, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(near, order, 1)


def unit_vectors(table: DataFrame, vec_id: str, embedding: str, asked: Column) -> tuple[DataFrame, int]:
    """(vec_id, v, asked): distinct usable vectors as unit float32 bytes, and their length."""
    own = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<float>").alias("e"), F.coalesce(asked, F.lit(False)).alias("asked")).where("vec_id is not null and size(e) > 0")
    common = own.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = common["n"] if common else 0

    @F.arrow_udf("binary")
    def unit(vectors: pa.Array) -> pa.Array:
        x = np.array([v.as_py() for v in vectors], np.float64).reshape(len(vectors), dims)
        norm = np.linalg.norm(x, axis=1)
        good = np.isfinite(norm) & (norm > 0)
        y = (x / np.where(good, norm, 1)[:, None]).astype(np.float32)
        return pa.array([r.tobytes() if g else None for r, g in zip(y, good)], pa.binary())

    good = own.where((F.size("e") == dims) & ~F.exists("e", lambda x: x.isNull())).select("vec_id", unit("e").alias("v"), "asked").where("v is not null")
    return good.groupBy("vec_id", "v").agg(F.max("asked").alias("asked")), dims


def fitted_window(rows: DataFrame, reference: np.ndarray, curves: int, k: int, recall: float) -> int:
    """The window that holds enough of the true neighbours of probed queries; see the top."""
    dims = reference.shape[1]
    asked = rows.where("query")

    @F.arrow_udf("double")
    def usual(v: pa.Array) -> pa.Array:
        return pa.array((_matrix(v, dims) @ reference[:256].T.astype(np.float32)).max(1, initial=-1).astype(np.float64))

    columns = [F.xxhash64("vec_id").alias("order"), "vec_id", "v", "keys"]
    probes = [asked.select(first, *columns).orderBy("first", "order", "vec_id", "v").limit(PROBES).toArrow() for first in (F.lit(0).alias("first"), usual("v").alias("first"))]
    counts = [t.num_rows for t in probes]
    if not sum(counts):
        return 1
    ids = np.concatenate([t.column("vec_id").to_numpy() for t in probes])
    q = np.frombuffer(b"".join(x for t in probes for x in t.column("v").to_pylist()), np.float32).reshape(-1, dims)
    keys = np.array([x for t in probes for x in t.column("keys").to_pylist()], np.int64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, places = np.full((len(q), 0), -np.inf, np.float32), np.zeros((len(q), 0, curves), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            near = q @ _matrix(b.column("v"), dims).T
            near[b.column("vec_id").to_numpy()[None, :] == ids[:, None]] = -np.inf
            own = b.column("keys").flatten().to_numpy().reshape(-1, curves)
            top = np.argpartition(-near, min(k, near.shape[1]) - 1, axis=1)[:, :k]
            best = np.concatenate([best, np.take_along_axis(near, top, 1)], axis=1)
            places = np.concatenate([places, own[top]], axis=1)
            top = np.argsort(-best, axis=1, kind="stable")[:, :k]
            best, places = np.take_along_axis(best, top, 1), np.take_along_axis(places, top[:, :, None], 1)
        some = np.isfinite(best)
        flat = places[some]
        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(flat) + 1) * curves).astype(np.int32)), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(some)[0]), pa.array(best[some].astype(np.float64)), lists], ["probe", "similarity", "keys"])

    found = rows.where("not query").select("vec_id", "v", "keys").mapInArrow(nearest, "probe bigint, similarity double, keys array<bigint>")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("similarity"), "keys"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k).select("probe", "keys").toArrow()
    probe = found.column("probe").to_numpy()
    true = np.array(found.column("keys").to_pylist(), np.int64).reshape(-1, curves)
    if not len(probe):
        return 1
    marks = [np.unique(np.concatenate([keys[:, c], true[:, c]])) for c in range(curves)]

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(len(m) + 1, np.int64) for m in marks]
        for b in batches:
            own = b.column("keys").flatten().to_numpy().reshape(-1, curves)
            for c, m in enumerate(marks):
                sums[c] += np.bincount(np.searchsorted(m, own[:, c], "left"), minlength=len(m) + 1)
        for c, n in enumerate(sums):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), c, np.int32)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], ["curve", "slot", "n"])

    counted = rows.where("not query").select("keys").mapInArrow(between, "curve int, slot int, n bigint").groupBy("curve", "slot").agg(F.sum("n").alias("n")).toArrow()
    apart = np.full(len(probe), np.iinfo(np.int64).max)
    for c, m in enumerate(marks):
        own = counted.column("curve").to_numpy() == c
        n = np.zeros(len(m) + 1, np.int64)
        n[counted.column("slot").to_numpy()[own]] = counted.column("n").to_numpy()[own]
        ranks = np.cumsum(n)  # rows up to each mark
        at = ranks[np.searchsorted(m, keys[:, c])][probe]
        apart = np.minimum(apart, np.abs(ranks[np.searchsorted(m, true[:, c])] - at))
    kinds = probe >= counts[0]
    return max(1, *(int(np.quantile(apart[kinds == kind], recall, method="higher")) + 1 for kind in set(kinds.tolist())))


_ROW = pa.schema([("boundary", pa.int32()), ("curve", pa.int32()), ("left", pa.bool_()), ("query", pa.bool_()), ("vec_id", pa.int64()), ("v", pa.binary()), ("neighbour", pa.int64()), ("similarity", pa.float64())])
_KIND = "boundary int, curve int, left boolean, query boolean, vec_id bigint, v binary, neighbour bigint, similarity double"
_STEP = 64  # queries that are compared with their common windows at once


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ROW], schema=_ROW)


def _best(queries: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> pa.RecordBatch:
    """The best k of x of each query."""
    scores, near = _top(queries @ x.T, ids, own, k)
    some = np.isfinite(scores).ravel()
    return _rows(int(some.sum()), vec_id=pa.array(np.repeat(own, scores.shape[1])[some]), neighbour=pa.array(near.ravel()[some]), similarity=pa.array(scores.ravel()[some].astype(np.float64)))


def _windows(dims: int, k: int, window: int):
    """Of a partition in the order of the curves: neighbours in it, and the rows at its ends."""

    def curve(c: int, part: int, rows: pa.Table, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        query = rows.column("query").to_numpy()
        ids, blobs = rows.column("vec_id").to_numpy(), rows.column("v")
        v = np.frombuffer(b"".join(blobs.to_pylist()), np.float32).reshape(-1, dims)
        x, x_ids = v[~query], ids[~query]
        at = np.cumsum(~query)[query]  # indexed rows before each query
        q, q_ids = v[query], ids[query]
        for lo in range(0, len(q), _STEP):
            span = slice(max(0, int(at[lo]) - window), int(at[min(lo + _STEP, len(q)) - 1]) + window)
            if len(x[span]):
                yield _best(q[lo : lo + _STEP], q_ids[lo : lo + _STEP], x[span], x_ids[span], k)
        before, after = np.cumsum(~query), np.cumsum(~query[::-1])[::-1]
        for wanted, close, boundary, left in ((first, before, part, False), (last, after, part + 1, True)):
            if wanted and (pick := np.flatnonzero(close <= window)).size:
                n = len(pick)
                yield _rows(n, boundary=pa.array(np.full(n, boundary)), curve=pa.array(np.full(n, c)), left=pa.array(np.full(n, left)), query=pa.array(query[pick]), vec_id=pa.array(ids[pick]), v=blobs.combine_chunks().take(pa.array(pick)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        curves = rows.column("curve").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(curves)) + 1).tolist(), len(curves)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield from curve(int(curves[lo]), TaskContext.get().partitionId(), rows.slice(lo, hi - lo), lo == 0, hi == len(curves))

    return scan


def _across(dims: int, k: int):
    """Of the rows at both sides of each boundary: queries of one with rows of the other."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        boundary, curve, left, query, ids = (rows.column(c).to_numpy() for c in ("boundary", "curve", "left", "query", "vec_id"))
        v = np.frombuffer(b"".join(rows.column("v").to_pylist()), np.float32).reshape(-1, dims)
        cuts = [0, *(np.flatnonzero((np.diff(boundary) != 0) | (np.diff(curve) != 0)) + 1).tolist(), len(boundary)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            own = np.arange(len(boundary))[lo:hi]
            for side in (True, False):
                asked, there = own[query[own] & (left[own] == side)], own[~query[own] & (left[own] != side)]
                for i in range(0, len(asked), _STEP) if len(there) else ():
                    part = asked[i : i + _STEP]
                    yield _best(v[part], ids[part], v[there], ids[there], k)

    return meet


def nearest_neighbours(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, asked: Column | None = None, curves: int = 12, recall: float = 0.95) -> DataFrame:
    """(vec_id, rank, neighbour, similarity): the k nearest of every row by cosine.

    ``asked``: the rows that are queries, all by default; all rows are searched.
    ``recall``: the share of true neighbours that the probed queries' windows hold.
    """
    vectors, dims = unit_vectors(table, vec_id, embedding, F.lit(True) if asked is None else asked)
    vectors = stored(vectors, "unit-vectors")
    copies = Window.partitionBy("v").orderBy("vec_id")
    indexed = vectors.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("vec_id", "v", F.lit(False).alias("query"))
    rows = indexed.unionByName(vectors.where("asked").select("vec_id", "v", F.lit(True).alias("query")))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(FIT).select("v").toArrow().column("v").to_pylist()
    sample = np.frombuffer(b"".join(sample), np.float32).reshape(len(sample), dims)
    if not len(sample):
        return table.sparkSession.createDataFrame([], "vec_id bigint, rank int, neighbour bigint, similarity double")
    bases = curve_bases(sample.astype(np.float64), curves)

    @F.arrow_udf("array<bigint>")
    def keys(v: pa.Array) -> pa.Array:
        made = np.stack([curve_keys(_matrix(v, dims), b) for b in bases], axis=1)
        return pa.ListArray.from_arrays(pa.array((np.arange(len(v) + 1) * curves).astype(np.int32)), pa.array(made.ravel()))

    rows = stored(rows.withColumn("keys", keys("v")), "vectors-with-keys")
    window = fitted_window(rows, sample, curves, k, recall)
    parts = max(1, -(-rows.count() * curves // max(PART_ROWS, 4 * window)))
    placed = rows.select("vec_id", "v", "query", F.posexplode("keys").alias("curve", "key"))
    ordered = placed.repartitionByRange(parts, "curve", "key", "vec_id", "query").sortWithinPartitions("curve", "key", "vec_id", "query")
    found = stored(ordered.select("curve", "query", "vec_id", "v").mapInArrow(_windows(dims, k, window), _KIND), "curve-windows")
    ends = found.where("boundary is not null").repartition("boundary", "curve").sortWithinPartitions("boundary", "curve")
    pairs = found.where("boundary is null").unionByName(ends.mapInArrow(_across(dims, k), _KIND))
    pairs = pairs.groupBy("vec_id", "neighbour").agg(F.round(F.max("similarity"), 6).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour", "similarity")
