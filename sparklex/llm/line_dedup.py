"""Corpus-wide line dedup that can be undone, with sharded cuckoo filters.

State in a shared folder.  Every change is a numbered folder of its own, which counts
once it holds the marker ``DONE`` and is never rewritten then, so an index can be
opened again and a change that was broken off is repeated:

* ``occ``: every occurrence of a countable line (key, document, position)
* ``docs``: the documents that were inserted
* ``lines``: per line the change of its exact reference count, the filter part that
  holds it and the occurrence that owns it, where they changed
* ``filters``: the changed shards' cuckoo filters of live lines
* ``gone``: ids of deleted documents

Inserting counts a batch's lines (combined before they are shuffled, so a line of very
many documents is one row a task) and asks the shards' filters: a line unknown to its
filter is new, the others are looked up in the exact counts.  New lines get an owner
and enter the filter; of known lines no occurrence of the batch is kept.  Deleting
lowers the counts, takes lines that reach zero out of the very part of the filter that
holds them, and gives lines whose owner went to their earliest occurrence that is left.
A line's owner is looked up by document, never by line, so common lines skew nothing.

A line is keyed by 96 bits of hash of its text without surrounding blanks.  Lines of
nothing but white space are never dropped, nor are lines shorter than ``min_chars``.
The earliest (batch, doc_id, position) owns a line; every other occurrence is dropped.

Defined results: rows with a null id or null text pass unchanged, as do documents that
aren't in the index; repeated rows (same id and text) are treated alike and keep the
same lines; rows of one batch that share an id but not a text are separate documents,
ordered by a hash of the text; an id that is in the index can't be inserted again
before it was deleted (ValueError); empty texts stay empty; an empty table gives an
empty result; extra columns are carried along, but for those of the added names,
which are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparklex.llm.shared import free_name, fresh_path, stored
from sparklex.llm.text import mix64

SHARD_LINES = 2_000_000
_SLOTS = 4


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; insertions and deletions of 64-bit keys.

    ``contains`` has no false negatives for inserted keys and about 8 / 2^16 false
    positives.  All operations take arrays.
    """

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (_SLOTS * 0.85)))))
            table = np.zeros((buckets, _SLOTS), np.uint16)
        self.table = table

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, _SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @property
    def capacity(self) -> int:
        return int(self.table.size * 0.85)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix64(keys.astype(np.uint64))
        prints = np.maximum((h >> np.uint64(48)).astype(np.uint16), 1)
        one = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return prints, one, self._other(one, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (mix64(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self._places(keys)
        return (self.table[one] == prints[:, None]).any(1) | (self.table[two] == prints[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Adds distinct keys; False, with the filter unusable, if one finds no room."""
        prints, one, two = self._places(keys)
        prints, at = self._settle(prints, one)
        # of those left, where they came from isn't known any more, but either bucket leads to the other
        at = self._other(at, prints)
        rng = np.random.default_rng(len(keys))
        for _ in range(500):
            prints, at = self._settle(prints, at)
            if not len(prints):
                return True
            # one newcomer per full bucket evicts a random resident
            _, first = np.unique(at, return_index=True)
            slot = rng.integers(0, _SLOTS, len(first))
            evicted = self.table[at[first], slot]
            self.table[at[first], slot] = prints[first]
            prints[first] = evicted
            at[first] = self._other(at[first], evicted)
        return False

    def _settle(self, prints: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts what fits into its bucket; returns the rest."""
        for slot in range(_SLOTS):
            if not len(prints):
                break
            free = np.flatnonzero(self.table[at, slot] == 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.table[at[put], slot] = prints[put]
            left = np.ones(len(prints), bool)
            left[put] = False
            prints, at = prints[left], at[left]
        return prints, at

    def delete(self, keys: np.ndarray) -> None:
        """Removes keys that were inserted here, one copy of each."""
        prints, one, two = self._places(keys)
        left = np.arange(len(keys))
        while len(left):
            before = len(left)
            for at in (one, two):
                hit = self.table[at[left]] == prints[left, None]
                some = np.flatnonzero(hit.any(1))
                place = at[left[some]] * _SLOTS + hit[some].argmax(1)
                _, first = np.unique(place, return_index=True)
                self.table.reshape(-1)[place[first]] = 0
                left = np.delete(left, some[first])
            if len(left) == before:
                raise KeyError("a key that was never inserted")


class FilterChain:
    """Cuckoo filters of one shard: when the last is full the next begins, twice as large."""

    def __init__(self, parts: list[CuckooFilter]):
        self.parts = parts

    @classmethod
    def from_bytes(cls, data: bytes) -> FilterChain:
        parts = []
        while data:
            size = int.from_bytes(data[:8], "little")
            parts.append(CuckooFilter.from_bytes(data[8 : 8 + size]))
            data = data[8 + size :]
        return cls(parts)

    def to_bytes(self) -> bytes:
        blobs = [p.to_bytes() for p in self.parts]
        return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        return np.any([p.contains(keys) for p in self.parts], axis=0) if self.parts else np.zeros(len(keys), bool)

    def insert(self, keys: np.ndarray) -> int:
        """Adds keys, equal ones as many times; returns the number of the part that holds them."""
        if self.parts:
            last = self.parts[-1]
            if int((last.table > 0).sum()) + len(keys) <= last.capacity:
                grown = CuckooFilter(0, last.table.copy())
                if grown.insert(keys):
                    self.parts[-1] = grown
                    return len(self.parts) - 1
        size = max(len(keys), 2 * self.parts[-1].capacity if self.parts else 0)
        while not (made := CuckooFilter(size)).insert(keys):
            size *= 2
        self.parts.append(made)
        return len(self.parts) - 1

    def delete(self, keys: np.ndarray, parts: np.ndarray) -> None:
        """Removes keys from the parts that they were inserted into.

        Only there: another part that seems to know a key holds some other key's fingerprint.
        """
        for number, part in enumerate(self.parts):
            part.delete(keys[parts == number])


def _key64(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The filters' key of a line."""
    return mix64(h1.view(np.uint64) ^ h2.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, FilterChain, pa.Table]]:
    """(shard, its filters, its lines) of a partition sorted by shard, filters first; a shard's lines come in one piece."""
    shard, chain, held = None, FilterChain([]), []
    for batch in batches:
        if not batch.num_rows:
            continue
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(lo, hi - lo)
            if shards[lo] != shard:
                if held:
                    yield shard, chain, pa.Table.from_batches(held)
                shard, chain, held = int(shards[lo]), FilterChain([]), []
            for blob in part.column("filter").drop_null().to_pylist():
                chain = FilterChain.from_bytes(blob)
            lines = part.filter(part.column("filter").is_null())
            if lines.num_rows:
                held.append(lines)
    if held:
        yield shard, chain, pa.Table.from_batches(held)


_LINE = "shard int, h1 bigint, h2 int, refs bigint, doc_id bigint, th bigint, pos int, part int, filter binary"
_NAMES = [f.split()[0] for f in _LINE.split(", ")]


def _keys_of(lines: pa.Table) -> np.ndarray:
    return _key64(lines.column("h1").to_numpy(), lines.column("h2").to_numpy())


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with ``part`` 1 where their shard's filters may know them, else 0."""
    for _, chain, lines in _by_shard(batches):
        maybe = pa.array(chain.contains(_keys_of(lines)).astype(np.int32))
        yield from lines.set_column(_NAMES.index("part"), "part", maybe).to_batches()


def _admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """New lines with the filter part that now holds them, and the shard's new filters."""
    kinds = {"shard": pa.int32(), "h1": pa.int64(), "h2": pa.int32(), "refs": pa.int64(), "doc_id": pa.int64(), "th": pa.int64(), "pos": pa.int32(), "part": pa.int32(), "filter": pa.binary()}
    for shard, chain, lines in _by_shard(batches):
        part = chain.insert(_keys_of(lines))
        yield from lines.set_column(_NAMES.index("part"), "part", pa.array(np.full(lines.num_rows, part, np.int32))).to_batches()
        only = {"shard": [shard], "filter": [chain.to_bytes()]}
        yield pa.RecordBatch.from_arrays([pa.array(only.get(n, [None]), t) for n, t in kinds.items()], list(kinds))


def _take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filters of shards, less lines that nothing refers to any more."""
    for shard, chain, lines in _by_shard(batches):
        chain.delete(_keys_of(lines), lines.column("part").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([chain.to_bytes()], pa.binary())], ["shard", "filter"])


_TABLES = {
    "occ": "number bigint, h1 bigint, h2 int, doc_id bigint, th bigint, pos int",
    "docs": "number bigint, doc_id bigint, th bigint",
    "lines": "number bigint, h1 bigint, h2 int, change bigint, part int, owner struct<number:bigint,doc_id:bigint,th:bigint,pos:int>",
    "filters": "number bigint, shards int, shard int, filter binary",
    "gone": "number bigint, doc_id bigint",
}


class LineIndex:
    """Incremental, reversible line dedup; ``path`` is a folder that executors share, with one writer at a time.

    An existing index at ``path`` is opened, with the options that it was made with.
    ``shards`` fixes the number of filters; else it grows with the lines.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int | None = None, min_chars: int = 1):
        self.spark, self.path = spark, path or fresh_path(spark, "line-index")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._fs.exists(self._at(f"{self.path}/options")):
            options = json.loads(spark.read.text(f"{self.path}/options").first()[0])
        else:
            options = {"shards": shards, "min_chars": min_chars}
            spark.createDataFrame([(json.dumps(options),)], "value string").coalesce(1).write.text(f"{self.path}/options")
        self.fixed, self.min_chars = options["shards"], options["min_chars"]
        #: what each change holds, in order
        self.changes: list[dict] = []
        while self._fs.exists(self._at(f"{self._folder(len(self.changes))}/DONE")):
            self.changes.append(json.loads(spark.read.text(f"{self._folder(len(self.changes))}/DONE").first()[0]))

    def _folder(self, number: int) -> str:
        return f"{self.path}/change-{number:08d}"

    def _begin(self) -> int:
        """Number of the next change; what is left of a broken attempt at it goes."""
        number = len(self.changes)
        if self._fs.exists(self._at(f"{self._folder(number)}/DONE")):
            raise RuntimeError(f"change {number} of {self.path} was made by another writer")
        self._fs.delete(self._at(self._folder(number)), True)
        return number

    def _write(self, number: int, table: str, rows: DataFrame) -> None:
        rows = rows.withColumn("number", F.lit(number).cast("bigint")) if "number" not in rows.columns else rows
        fields = StructType.fromDDL(_TABLES[table]).fields
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).write.parquet(f"{self._folder(number)}/{table}")

    def _finish(self, number: int, tables: list[str], shards: int, lines: int) -> int:
        about = {"tables": tables, "shards": shards, "lines": lines}
        out = self._fs.create(self._at(f"{self._folder(number)}/DONE"), False)
        out.write(bytearray((json.dumps(about) + "\n").encode()))
        out.close()
        self.changes.append(about)
        return number

    def _table(self, table: str) -> DataFrame:
        own = [f"{self._folder(i)}/{table}" for i, c in enumerate(self.changes) if table in c["tables"]]
        return self.spark.read.schema(_TABLES[table]).parquet(*own) if own else self.spark.createDataFrame([], _TABLES[table])

    @property
    def shards(self) -> int:
        return self.changes[-1]["shards"] if self.changes else 0

    @property
    def known(self) -> int:
        """How many lines ever entered the filters."""
        return self.changes[-1]["lines"] if self.changes else 0

    def eligible(self, line: Column) -> Column:
        """Whether a line is one that can be dropped."""
        shown = line.rlike(r"(?U)\S")
        return shown if self.min_chars <= 1 else shown & (F.length(F.trim(line)) >= self.min_chars)

    def _lines_now(self, only: DataFrame | None = None) -> DataFrame:
        """(h1, h2, refs, part, owner) of lines with live occurrences; ``only``: of these keys."""
        rows = self._table("lines")
        if only is not None:
            rows = rows.join(only.select("h1", "h2"), ["h1", "h2"], "left_semi")
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("number")).otherwise(-1)).alias(c)
        return rows.groupBy("h1", "h2").agg(F.sum("change").alias("refs"), last("part"), last("owner")).where("refs > 0")

    def counts(self) -> DataFrame:
        """(h1, h2, refs): exact reference counts of all live lines."""
        return self._table("lines").groupBy("h1", "h2").agg(F.sum("change").alias("refs")).where("refs > 0")

    def _filters(self, shards: int) -> DataFrame:
        """(shard, filter): the latest of each of so many shards."""
        return self._table("filters").where(F.col("shards") == shards).groupBy("shard").agg(F.max_by("filter", "number").alias("filter"))

    def _live(self, table: str) -> DataFrame:
        """Rows of documents that weren't deleted after they came."""
        rows = self._table(table)
        if not any("gone" in c["tables"] for c in self.changes):
            return rows
        gone = self._table("gone").groupBy("doc_id").agg(F.max("number").alias("until"))
        return rows.join(gone, (rows["doc_id"] == gone["doc_id"]) & (rows["number"] < gone["until"]), "left_anti")

    def _met(self, shards: int, lines: DataFrame, filters: DataFrame) -> DataFrame:
        """Lines and filters by shard, each shard's filter first."""
        kinds = dict(f.split() for f in _LINE.split(", "))
        lines = lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
        rows = [t.select(*[(F.col(c) if c in t.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]) for t in (lines, filters)]
        return rows[0].unionByName(rows[1]).repartition(shards, "shard").sortWithinPartitions("shard", F.col("filter").isNull())

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> int:
        """Adds a batch of documents; returns its number."""
        number = self._begin()
        own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
        places = own.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        # a row of every document, with the key of no line, comes along in the same pass
        every = places.where(self.eligible(F.col("line")) | (F.col("pos") == 0)).withColumn("line", F.when(self.eligible(F.col("line")), F.trim("line")))
        keyed = every.select(F.when(F.col("line").isNotNull(), F.xxhash64("line")).alias("h1"), F.when(F.col("line").isNotNull(), F.hash("line")).alias("h2"), "doc_id", "th", "pos")
        self._write(number, "occ", keyed)
        occ = self.spark.read.schema(_TABLES["occ"]).parquet(f"{self._folder(number)}/occ")
        self._write(number, "docs", occ.where("pos = 0").select("number", "doc_id", "th"))
        mine = self.spark.read.schema(_TABLES["docs"]).parquet(f"{self._folder(number)}/docs")
        if self.changes and not mine.join(self._live("docs"), "doc_id", "left_semi").isEmpty():
            raise ValueError("an id of the batch is in the index")
        lines = occ.where("h1 is not null").groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.min(F.struct("doc_id", "th", "pos")).alias("at"))
        lines = stored(lines.select("h1", "h2", "refs", "at.*"), "batch-lines")
        n = lines.count()
        shards = self.fixed or self.shards or max(self.spark.sparkContext.defaultParallelism, -(-n // SHARD_LINES))
        if not self.fixed and self.known + n > 4 * shards * SHARD_LINES:
            shards = self._resize(-(-2 * (self.known + n) // SHARD_LINES))
            return self.insert(docs, doc_id, text)
        again = None
        if self.changes:
            asked = stored(self._met(shards, lines, self._filters(shards)).mapInArrow(_screen, _LINE), "screened")
            found = asked.where("part = 1").select("h1", "h2")
            again = stored(found.join(self.counts(), ["h1", "h2"], "left_semi"), "known-lines")
            new = asked.join(again, ["h1", "h2"], "left_anti").select("h1", "h2", "refs", "doc_id", "th", "pos")
        else:
            new = lines
        added = stored(self._met(shards, new, self._filters(shards)).mapInArrow(_admit, _LINE), "admitted")
        rows = added.where("filter is null").select("h1", "h2", F.col("refs").alias("change"), "part", F.struct(F.lit(number).cast("bigint").alias("number"), "doc_id", "th", "pos").alias("owner"))
        if again is not None:
            old = lines.join(again, ["h1", "h2"], "left_semi").select("h1", "h2", F.col("refs").alias("change"))
            rows = rows.unionByName(old, allowMissingColumns=True)
        self._write(number, "lines", rows)
        self._write(number, "filters", added.where("filter is not null").select(F.lit(shards).alias("shards"), "shard", "filter"))
        return self._finish(number, ["occ", "docs", "lines", "filters"], shards, self.known + n)

    def _resize(self, shards: int) -> int:
        """Makes the filters anew from the exact counts, for so many shards."""
        number = self._begin()
        added = stored(self._met(shards, self._lines_now(), self._filters(-1)).mapInArrow(_admit, _LINE), "resized")
        self._write(number, "lines", added.where("filter is null").select("h1", "h2", F.lit(0).alias("change"), "part", F.lit(None).alias("owner")))
        self._write(number, "filters", added.where("filter is not null").select(F.lit(shards).alias("shards"), "shard", "filter"))
        self._finish(number, ["lines", "filters"], shards, self.known)
        return shards

    def delete(self, doc_ids: DataFrame) -> int:
        """Takes documents out: one column of ids.  Unknown ids don't matter."""
        number, shards = self._begin(), self.shards
        ids = stored(doc_ids.select(F.col(doc_ids.columns[0]).cast("bigint").alias("doc_id")).where("doc_id is not null").distinct(), "line-deletions")
        live = self._live("occ").where("h1 is not null")
        place = F.struct("number", "doc_id", "th", "pos")
        gone = live.join(ids, "doc_id", "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first"))
        gone = stored(gone, "lines-that-lose")
        # the owner is the earliest occurrence, so it went if it is the earliest that went
        now = stored(self._lines_now(gone).join(gone, ["h1", "h2"]).withColumn("orphan", F.col("first") == F.col("owner")), "lines-touched")
        heirs = now.where("orphan and refs > n").select("h1", "h2")
        left = live.join(ids, "doc_id", "left_anti").join(heirs, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min(place).alias("heir"))
        rows = now.join(left, ["h1", "h2"], "left").select("h1", "h2", (-F.col("n")).alias("change"), F.lit(None).alias("part"), F.col("heir").alias("owner"))
        dead = now.where("refs = n").select("h1", "h2", "part")
        touched = dead.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard")).distinct() if shards else None
        self._write(number, "lines", rows)
        if shards:
            met = self._met(shards, dead, self._filters(shards).join(touched, "shard", "left_semi"))
            self._write(number, "filters", met.mapInArrow(_take_out, "shard int, filter binary").withColumn("shards", F.lit(shards)))
        self._write(number, "gone", ids)
        return self._finish(number, ["lines", "gone", *["filters"] * bool(shards)], shards, self.known)

    def owners(self) -> DataFrame:
        """(doc_id, th, pos) of the occurrence of every live line that stays."""
        if len(self.changes) == 1:
            return self._table("lines").select("owner.doc_id", "owner.th", "owner.pos")
        return self._lines_now().select("owner.doc_id", "owner.th", "owner.pos")

    def apply(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
        """docs with ``text`` without its dropped lines, and how many lines it had and lost."""
        id_, th, kept, done = (free_name(docs, c) for c in ("__id", "__th", "__kept", "__done"))
        rows = self._live("docs").select("doc_id", "th", F.lit(None).cast("int").alias("pos")).unionByName(self.owners())
        rows = rows.groupBy("doc_id", "th").agg(F.collect_list("pos").alias(kept)).withColumnsRenamed({"doc_id": id_, "th": th})
        joined = docs.join(rows, (docs[doc_id] == rows[id_]) & (F.xxhash64(docs[text]) == rows[th]), "left")

        def cut(lines: Column) -> Column:
            always = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: ~self.eligible(F.element_at(lines, i + 1)))
            stay = F.sort_array(F.concat(F.col(kept), always))
            return F.struct(F.array_join(F.transform(stay, lambda i: F.element_at(lines, i + 1)), "\n").alias("text"), F.size(lines).alias("n"), F.size(stay).alias("left"))

        # the lambda's variable holds the lines, which are then split once
        made = F.transform(F.array(F.split(docs[text], "\n", -1)), cut)[0]
        joined = joined.withColumn(done, F.when(F.col(kept).isNotNull(), made))
        n = F.when(docs[text].isNull(), 0).otherwise(F.size(F.split(docs[text], "\n", -1)))
        new = {
            text: F.when(F.col(done).isNull(), docs[text]).otherwise(F.col(f"{done}.text")),
            n_lines: F.coalesce(F.col(f"{done}.n"), n).cast("bigint"),
            n_dropped: F.coalesce(F.col(f"{done}.n") - F.col(f"{done}.left"), F.lit(0)).cast("bigint"),
        }
        return joined.select(*[docs[c] for c in docs.columns if c not in new], *[v.alias(c) for c, v in new.items()])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped", batches: int = 1, **options) -> DataFrame:
    """docs with all but the first occurrence of every line dropped; adds n_lines and n_dropped.

    With several ``batches`` the documents are inserted one range of ids after another,
    which gives the same rows: the later ones are judged by filters and counts alone.
    ``options`` go to LineIndex.  Columns of docs with the added names are replaced.
    """
    index = LineIndex(docs.sparkSession, **options)
    ends = docs.agg(F.min(doc_id).alias("a"), F.max(doc_id).alias("b")).first() if batches > 1 else (None, None)
    if ends[0] is None:
        index.insert(docs, doc_id, text)
        return index.apply(docs, doc_id, text, n_lines, n_dropped)
    cuts = [ends[0] + (ends[1] - ends[0] + 1) * i // batches for i in range(batches + 1)]
    for lo, hi in zip(cuts, cuts[1:]):
        index.insert(docs.where((F.col(doc_id) >= lo) & (F.col(doc_id) < hi)), doc_id, text)
    return index.apply(docs, doc_id, text, n_lines, n_dropped)


#: DuckDB; the same rows as op2 over whole tables.
ORACLE = r"""
with lines as (
    select doc_id, unnest(l) as line, generate_subscripts(l, 1) as pos
    from (select doc_id, string_split(text, chr(10)) as l from documents)
), ranked as (
    select *, regexp_matches(line, '[^\t-\r\x{85}\p{Z}]') and row_number() over (partition by trim(line) order by doc_id, pos) > 1 as gone
    from lines
)
select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text,
    count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped
from ranked group by doc_id
"""
