"""Packing token sequences into training windows by Karmarkar-Karp differencing.

A document is tokenized and cut into chunks of at most the window's capacity.
Documents are spread over blocks by a hash; in each block all chunks that don't fill
a window are partitioned into n windows by multiway differencing: the two partial
partitions with the largest imbalance are merged, largest window of one onto the
smallest of the other, until one partition is left.  That makes windows nearly equal.
If one exceeds the capacity, n rises by one and the block is partitioned again.

Defined results: null ids, null texts and texts without tokens take no place; rows
that share an id and a text are separate sequences; a document longer than the
capacity fills windows of its own and its rest is packed; an empty table gives an
empty result; extra columns don't matter.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklex.llm.shared import stored

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, object] = {}
_sent: dict[tuple[str, str], object] = {}


def encoder(path: str, sent=None):
    """The byte-level BPE whose ranks ``path`` holds; built once in a worker, of what the driver ``sent`` it."""
    if path not in _encoders:
        import tiktoken

        data = sent.value if sent else _read(path)
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
        _encoders[path] = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def sent_ranks(path: str):
    """The tokenizer's file (some megabytes) as a broadcast, so that only the driver needs to have it."""
    context = SparkSession.active().sparkContext
    key = context.applicationId, path
    if key not in _sent:
        _sent[key] = context.broadcast(_read(path))
    return _sent[key]


def token_count(path: str):
    """Column function: how many tokens a text has; null texts have none."""
    sent = sent_ranks(path)

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        encode = encoder(path, sent).encode_ordinary
        return pa.array([len(encode(t.as_py())) if t.is_valid else 0 for t in texts], pa.int32())

    return count.asNondeterministic()


def difference(sizes: np.ndarray, n: int) -> np.ndarray:
    """The part, 0 to n - 1, of each size: n-way Karmarkar-Karp differencing.

    A partial partition is its n sums, falling, less the least of them; how parts
    were joined is kept as a tree and unrolled at the end.  Ties go to the earlier
    partition.
    """
    if n == 1 or len(sizes) <= 1:
        return np.zeros(len(sizes), np.int64)
    heap, joins = [], []
    for i, size in enumerate(sizes.tolist()):
        sums = np.zeros(n, np.int64)
        sums[0] = size
        heap.append((-size, i, sums))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        sums = x + y[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        joins.append((a, b, order))
        heapq.heappush(heap, (-int(sums[0]), made, sums))
        made += 1
    # slot[p][k]: the final part of the k-th window of partial partition p
    slot = {made - 1: np.arange(n)}
    out = np.zeros(len(sizes), np.int64)
    for node in range(made - 1, len(sizes) - 1, -1):
        a, b, order = joins[node - len(sizes)]
        own = slot.pop(node)
        before = np.empty(n, np.int64)
        before[order] = own  # window k of the sum before sorting
        for child, parts in ((a, before), (b, before[::-1])):
            if child < len(sizes):
                out[child] = parts[0]
            else:
                slot[child] = parts
    return out


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each chunk; no window exceeds the capacity, which no chunk does."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    n = max(1, -(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))
    while True:
        parts = difference(sizes, n)
        if np.bincount(parts, sizes, n).max() <= capacity:
            return parts
        n += 1


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, block_tokens: int = 2_000_000, tokenizer: str = BYTE_BPE) -> DataFrame:
    """One row a window: (window, tokens, doc_ids, starts, lengths).

    ``starts`` and ``lengths`` tell which tokens of each document the window holds.
    Windows are numbered block by block.  Blocks hold about ``block_tokens`` tokens
    (the count covers all documents), so memory and time per block stay the same at
    any scale; only ids and lengths are shuffled.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), token_count(tokenizer)(F.col(text)).alias("n")).where("doc_id is not null and n > 0")
    own = stored(own, "token-counts")
    total = own.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, round(total / block_tokens))
    # the stored row's own number spreads rows that share an id and a length
    own = own.withColumn("row", F.monotonically_increasing_id())
    rows = own.select(F.pmod(F.xxhash64("doc_id", "n", "row"), F.lit(blocks)).alias("block"), "doc_id", "n")
    rows = rows.repartition("block").sortWithinPartitions("block", "doc_id", "n")
    return rows.mapInArrow(_packer(capacity), "window bigint, tokens bigint, doc_ids array<bigint>, starts array<bigint>, lengths array<bigint>")


def _packer(capacity: int):
    def windows(block: int, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        full, rest = sizes // capacity, sizes % capacity
        parts = [np.zeros(0, np.int64)] * 4
        doc = np.repeat(np.arange(len(ids)), full)
        first = np.cumsum(full) - full
        start = (np.arange(len(doc)) - np.repeat(first, full)) * capacity
        some = np.flatnonzero(rest)
        window = np.concatenate([np.arange(len(doc)), len(doc) + pack(rest[some], capacity)])
        doc = np.concatenate([doc, some])
        start = np.concatenate([start, (full * capacity)[some]])
        length = np.concatenate([np.full(len(start) - len(some), capacity), rest[some]])
        order = np.lexsort((start, doc, window))
        parts = [x[order] for x in (window, ids[doc], start, length)]
        numbers, first = np.unique(parts[0], return_index=True)
        offsets = pa.array(np.append(first, len(doc)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in parts[1:]]
        tokens = np.add.reduceat(parts[3], first)
        number = (np.int64(block) << np.int64(32)) + np.arange(len(numbers))
        return pa.RecordBatch.from_arrays([pa.array(number), pa.array(tokens.astype(np.int64)), *lists], ["window", "tokens", "doc_ids", "starts", "lengths"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], np.int64)
            if not rows.shape[1]:
                continue
            for part in np.split(rows, np.flatnonzero(np.diff(rows[0])) + 1, axis=1):
                if held and held[-1][0, 0] != part[0, 0]:
                    whole = np.concatenate(held, axis=1)
                    yield windows(whole[0, 0], whole[1], whole[2])
                    held = []
                held.append(part)
        if held:
            whole = np.concatenate(held, axis=1)
            yield windows(whole[0, 0], whole[1], whole[2])

    return packed
