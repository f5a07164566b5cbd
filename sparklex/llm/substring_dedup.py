"""Passages that repeat across documents, located with Aho-Corasick automata.

A passage is a run of words whose every window of ``min_words`` words also occurs in
another document.  All of it works on word hashes:

1. Winnowing: of every window of ``min_words`` words the k-word anchor with the least
   hash is selected, the leftmost on ties, so equal windows select equal anchors and
   text without an anchor that another document has can't hold a passage.
2. Anchors that only one document has are dropped, by a bit table sized from the number
   of the others (beyond 128 MB, by a join).
3. The surroundings of the others (every window that selects the anchor) are the stretches
   of a document.  They go to the shard of their anchor, where windows found in two
   documents are confirmed; runs of confirmed windows are the shard's passages.
4. The distinct passages are compiled into the shard's automaton over 32-bit word codes,
   and all stretches of all documents that were sent to the shard are streamed through
   it, which tells where passages occur; what overlaps or touches merges into spans.

An anchor of very many documents would make a shard too large.  Those take another way
to the same result: their windows are counted by Spark, combined before the shuffle,
and the confirmed ones are compiled for several salted shards of the anchor's stretches.

Every document is read whole, and a stretch goes only to the shards of its anchors, so
work grows with the corpus and not with corpus times passages.

Defined results: null ids and null texts are left out; texts of fewer than
``min_words`` words have no passages; rows that share an id are one document, so
repeated rows alone are no repetition; a passage repeated only inside one document is
not reported; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklex.llm.shared import stored
from sparklex.llm.text import binary_array, mix64, powers, word_hashes

MAX_BITS = 1 << 30  # of the anchor table
SHARD = 10_000  # stretches an automaton is compiled for
HOT = 2_000  # occurrences of an anchor beyond which it takes the salted way
MAX_HOT = 1_000_000  # anchors that can: with more, the bound rises


def selections(words: np.ndarray, offsets: np.ndarray, min_words: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of windows, position of the anchor that each selects, hashes of all k-word anchors) of a chunk of documents."""
    reach = min_words - k + 1  # anchors in a window
    n = len(words)
    if n < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n - k + 1, np.uint64)
    for j, p in enumerate(powers(k + 1)[1:]):
        grams += words[j : n - k + 1 + j] * p
    grams = mix64(grams)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    least, width = key, 1
    while width * 2 <= reach:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    inside = np.arange(len(least)) + min_words <= row_end[: len(least)]
    at = (least[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return np.flatnonzero(inside), at, grams


def anchors(words: np.ndarray, offsets: np.ndarray, min_words: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors selected in a chunk of documents, and where the windows that select each begin and end."""
    starts, at, grams = selections(words, offsets, min_words, k)
    at, first = np.unique(at, return_index=True)  # windows that select an anchor follow one another
    last = np.append(first, len(starts))[1:] - 1
    return at, grams[at], starts[first], starts[last] + min_words


class _Bits:
    """Bit table of a column ``a`` of hashes."""

    def __init__(self, hashes: DataFrame, n: int):
        self.bits = 1 << max(16, (16 * n).bit_length())
        while self.bits > MAX_BITS:
            self.bits >>= 1
        word = F.shiftrightunsigned(F.col("a").bitwiseAND(F.lit(self.bits - 1)), 6).cast("int")
        rows = hashes.select(word.alias("w"), F.expr("shiftleft(1L, int(a & 63))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        self.table = np.zeros(self.bits // 64, np.uint64)
        self.table[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & np.uint64(self.bits - 1)
        return (self.table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def compiled(passages: list[np.ndarray]) -> ahocorasick.Automaton:
    """The automaton of distinct sequences of word codes."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    seen = set()
    for passage in passages:
        if (raw := passage.tobytes()) not in seen:
            seen.add(raw)
            automaton.add_word(tuple(passage.tolist()), len(passage))
    automaton.make_automaton()
    return automaton


def located(automaton: ahocorasick.Automaton, codes: np.ndarray) -> np.ndarray:
    """(row, begin, end): where stretches hold passages, overlaps of a stretch merged."""
    out = [np.zeros((3, 0), np.int64)]
    if len(automaton):
        for lo in range(0, len(codes), 4000):
            part = np.pad(codes[lo : lo + 4000], ((0, 0), (0, 1)))
            # of zeros, a code that no passage has, one stays to part the stretches
            place = np.flatnonzero((part > 0) | (np.arange(part.shape[1]) == part.shape[1] - 1))
            hits = np.array(list(automaton.iter(tuple(part.ravel()[place].tolist()))), np.int64).reshape(-1, 2)
            if not len(hits):
                continue
            end = place[hits[:, 0]] + 1
            begin = end - hits[:, 1]
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], np.maximum.accumulate(end[order])
            # stretches don't touch, as the code between them is in no passage
            first = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
            last = np.append(first[1:], len(end)) - 1
            row = begin[first] // part.shape[1]
            at = row * part.shape[1]
            out.append(np.stack([lo + row, begin[first] - at, end[last] - at]))
    return np.concatenate(out, axis=1)


def confirmed(a: np.ndarray, least: np.ndarray, most: np.ndarray, codes: np.ndarray, min_words: int) -> list[np.ndarray]:
    """Passages of whole anchor groups: runs of windows that two documents have.

    Stretches are distinct; ``least`` and ``most`` are the ids of the documents that have each.
    """
    n, width = codes.shape
    windows = width - min_words + 1
    wide = _wide(codes)
    empty = np.concatenate([np.zeros((n, 1), np.int32), np.cumsum(codes == 0, axis=1, dtype=np.int32)], axis=1)
    lo = np.full(n, windows, np.int64)
    hi = np.full(n, -1, np.int64)
    # windows are only compared at the same place of a stretch, so sums need no common scale
    sums = np.zeros((n, width + 1), np.uint64)
    np.cumsum(wide * powers(width), axis=1, out=sums[:, 1:])
    rows = np.arange(n)
    for s in range(windows):
        whole = rows[empty[:, s + min_words] == empty[:, s]]
        if not len(whole):
            continue
        key = mix64(sums[whole, s + min_words] - sums[whole, s] + a[whole])
        order = np.argsort(key)
        key, at = key[order], whole[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        several = np.minimum.reduceat(least[at], first) != np.maximum.reduceat(most[at], first)
        shared = at[np.repeat(several, np.diff(first, append=len(at)))]
        lo[shared] = np.minimum(lo[shared], s)
        hi[shared] = s
    # a stretch's windows all hold its anchor, so between its first and last one nothing is uncovered
    return [codes[i, lo[i] : hi[i] + min_words] for i in np.flatnonzero(hi >= 0).tolist()]


def _wide(codes: np.ndarray) -> np.ndarray:
    wide = mix64(codes.astype(np.uint64) + np.uint64(1 << 32))
    wide[codes == 0] = 0
    return wide


class _Stretches:
    """Stretches of which equal ones are held, confirmed and streamed once."""

    def __init__(self, a: np.ndarray, ids: np.ndarray, starts: np.ndarray, codes: np.ndarray):
        key = mix64((_wide(codes) * powers(codes.shape[1])).sum(1, dtype=np.uint64) + mix64(a))
        order = np.lexsort((ids, key))
        self.first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        self.size = np.diff(self.first, append=len(key))
        self.ids, self.starts = ids[order], starts[order]
        self.a, self.codes = a[order[self.first]], codes[order[self.first]]

    def passages(self, min_words: int) -> list[np.ndarray]:
        return confirmed(self.a, self.ids[self.first], self.ids[self.first + self.size - 1], self.codes, min_words)

    def spans(self, automaton: ahocorasick.Automaton) -> pa.RecordBatch:
        """(doc_id, a, b) of what all of them hold."""
        row, begin, end = located(automaton, self.codes)
        n = self.size[row]
        at = np.repeat(self.first[row] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return pa.RecordBatch.from_arrays([pa.array(self.ids[at]), pa.array(self.starts[at] + np.repeat(begin, n)), pa.array(self.starts[at] + np.repeat(end, n))], ["doc_id", "a", "b"])


def _columns(batch: pa.RecordBatch, width: int) -> tuple:
    """(a, ids, starts, codes) of a batch of stretches."""
    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint32).reshape(-1, width)
    return (batch.column("a").to_numpy(zero_copy_only=False).view(np.uint64), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "begin")), codes)


def _locate(min_words: int, width: int):
    """Occurrences in stretches sorted by anchor, shard by shard of whole anchor groups."""

    def shard(held: list[tuple]) -> pa.RecordBatch:
        own = _Stretches(*(np.concatenate(x) for x in zip(*held)))
        return own.spans(compiled(own.passages(min_words)))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = _columns(batch, width)
            other = np.flatnonzero(cols[0] != held[-1][0][-1]) if held else []
            if size >= SHARD and len(other):  # up to the last anchor, whose group ends here
                cut = int(other[0])
                held.append(tuple(c[:cut] for c in cols))
                yield shard(held)
                held, size, cols = [], 0, tuple(c[cut:] for c in cols)
            held.append(cols)
            size += len(cols[0])
        if held:
            yield shard(held)

    return locate


def _locate_salted(width: int, min_words: int):
    """Occurrences in stretches sorted by (anchor, salt), the anchor's passages first."""

    def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        known = rows.filter(rows.column("begin").is_null())
        passages = np.frombuffer(b"".join(known.column("codes").to_pylist()), np.uint32).reshape(-1, min_words)
        for batch in rows.filter(rows.column("begin").is_valid()).to_batches(max_chunksize=SHARD):
            own = _Stretches(*_columns(batch, width))
            for lo in range(0, len(passages), SHARD):
                yield own.spans(compiled(list(passages[lo : lo + SHARD])))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, salt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "salt"))
            cuts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (salt[1:] != salt[:-1])) + 1).tolist(), len(a)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held and key != (a[lo], salt[lo]):
                    yield from shard(held)
                    held = []
                key = a[lo], salt[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from shard(held)

    return locate


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, k: int = 8) -> DataFrame:
    """(doc_id, first_word, end_word): every maximal span covered by repeated windows.

    Word offsets count from 0; ``end_word`` is exclusive.  A document has several rows
    when it has several spans.
    """
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    side = min_words - k
    width = side + min_words

    @F.arrow_udf("array<struct<a:bigint,n:bigint>>")
    def selected(texts: pa.Array) -> pa.Array:
        sizes, out = [0], [np.zeros((2, 0), np.int64)]
        for _, words, offsets in word_hashes(texts):
            at, grams, _, _ = anchors(words, offsets, min_words, k)
            cuts = np.searchsorted(at, offsets)
            for x, y in zip(cuts[:-1], cuts[1:]):
                a, n = np.unique(grams[x:y], return_counts=True)
                out.append(np.stack([a.view(np.int64), n]))
                sizes.append(len(a))
        a, n = np.concatenate(out, axis=1)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.StructArray.from_arrays([pa.array(a), pa.array(n)], ["a", "n"]))

    all_anchors = own.select("doc_id", F.inline(selected("text")))
    shared = all_anchors.groupBy("a").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.sum("n").alias("n")).where("x < y").select("a", "n")
    shared = stored(shared, "shared-anchors")
    n, total = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = shared.where(F.col("n") > max(HOT, total // MAX_HOT))
    hot_rows = hot.toArrow()
    order = np.argsort(hot_rows.column("a").to_numpy().view(np.uint64))
    hot_keys = hot_rows.column("a").to_numpy().view(np.uint64)[order]
    hot_salts = 1 + hot_rows.column("n").to_numpy()[order] // SHARD
    few = 8 * n <= MAX_BITS
    context = own.sparkSession.sparkContext
    table = context.broadcast((_Bits(shared, n) if few else None, hot_keys, hot_salts))

    def _hot(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = table.value[1]
        if not len(keys):
            return np.zeros(len(grams), bool), np.zeros(len(grams), np.int64)
        place = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        return keys[place] == grams, place

    def stretches(salted: bool):
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, _, salts = table.value
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for first, words, offsets in word_hashes(batch.column(1)):
                    at, grams, lo_word, hi_word = anchors(words, offsets, min_words, k)
                    is_hot, place = _hot(grams)
                    keep = is_hot if salted else ~is_hot & bits.has(grams) if bits else ~is_hot
                    at, grams, place, lo_word, hi_word = at[keep], grams[keep], place[keep], lo_word[keep], hi_word[keep]
                    if not len(at):
                        continue
                    row = np.searchsorted(offsets, at, "right") - 1
                    codes = np.maximum((words >> np.uint64(32)).astype(np.uint32), 1)
                    salt = (mix64(ids[first + row].astype(np.uint64) + at.astype(np.uint64)) % salts[place].astype(np.uint64)).astype(np.int32) if salted else np.zeros(len(at), np.int32)
                    for lo in range(0, len(at), 5000):
                        part = slice(lo, lo + 5000)
                        spot = at[part, None] - side + np.arange(width)
                        inside = (spot >= lo_word[part, None]) & (spot < hi_word[part, None])
                        around = np.where(inside, codes[np.clip(spot, 0, len(codes) - 1)], np.uint32(0))
                        begin = at[part] - side - offsets[row[part]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(grams[part].view(np.int64)), pa.array(salt[part]), pa.array(ids[first + row[part]]), pa.array(begin), binary_array(around)], ["a", "salt", "doc_id", "begin", "codes"]
                        )

        return cut

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct windows of a chunk that select a hot anchor, and the least and greatest id that has them."""
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, words, offsets in word_hashes(batch.column(1)):
                starts, at, grams = selections(words, offsets, min_words, k)
                keep = _hot(grams[at])[0] if len(at) else np.zeros(0, bool)
                starts, at = starts[keep], at[keep]
                if not len(starts):
                    continue
                row = ids[first + np.searchsorted(offsets, starts, "right") - 1]
                codes = np.maximum((words >> np.uint64(32)).astype(np.uint32), 1)
                key = np.zeros(len(starts), np.uint64)
                for j, p in enumerate(powers(min_words)):
                    key += words[starts + j] * p
                order = np.lexsort((row, key))
                key, row, starts, at = key[order], row[order], starts[order], at[order]
                one = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                last = np.append(one[1:], len(key)) - 1
                for lo in range(0, len(one), 5000):
                    part = one[lo : lo + 5000]
                    around = codes[starts[part, None] + np.arange(min_words)]
                    yield pa.RecordBatch.from_arrays([pa.array(grams[at[part]].view(np.int64)), binary_array(around), pa.array(row[part]), pa.array(row[last[lo : lo + 5000]])], ["a", "codes", "x", "y"])

    kind = "a bigint, salt int, doc_id bigint, begin bigint, codes binary"
    met = own.mapInArrow(stretches(False), kind)
    if not few:
        met = met.join(shared.select("a"), "a", "left_semi")
    spans = met.repartition("a").sortWithinPartitions("a").mapInArrow(_locate(min_words, width), "doc_id bigint, a bigint, b bigint")
    if len(hot_keys):
        counted = own.mapInArrow(windows, "a bigint, codes binary, x bigint, y bigint").groupBy("a", "codes").agg(F.min("x").alias("x"), F.max("y").alias("y"))
        passages = counted.where("x < y").join(hot, "a")
        passages = passages.select("a", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / SHARD).cast("int"))).alias("salt"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("begin"), "codes")
        met = passages.unionByName(own.mapInArrow(stretches(True), kind)).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("begin").isNotNull())
        spans = spans.unionByName(met.mapInArrow(_locate_salted(width, min_words), "doc_id bigint, a bigint, b bigint"))
    spans = spans.distinct()  # repeated rows, however many, have the same ones
    by_place = Window.partitionBy("doc_id").orderBy("a", "b")
    before = F.max("b").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(before >= F.col("a"), 0).otherwise(1)).withColumn("span", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "span").agg(F.min("a").alias("first_word"), F.max("b").alias("end_word")).drop("span")
