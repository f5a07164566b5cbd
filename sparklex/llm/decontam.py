"""Benchmark decontamination by pigeonhole edit matching.

Text is compared lower-cased, with every run of other characters than letters and
digits as one blank.  A test item with an error budget of e edits is cut into e + 1
pieces: an occurrence within the budget keeps at least one piece unchanged.  All
pieces go into one Aho-Corasick automaton; around each piece found, Myers's
bit-parallel algorithm (on Python's long integers, so items of any length) gives the
least edit distance of the whole item to any substring there.

Defined results: items that are null or hold no letter or digit match nothing; null
and empty texts are never contaminated; items with the same text are all reported, and
rows that share an item id are all looked for; rows that share an id are one document
(its least distance counts); items of fewer characters than ``1 / error_rate`` have no
budget and must occur exactly and as whole words; an empty table, of documents or of
items, gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.llm.shared import stored

_GAPS = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _GAPS.sub(" ", text.lower()).strip() if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly equal length."""
    n = min(budget, len(item) - 1) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers's masks of one item."""

    def __init__(self, item: str):
        self.item, self.masks = item, {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, text: str) -> int:
        """Least edit distance of the item to any substring of text."""
        m = len(self.item)
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score = full, 0, m
        best, get = m, self.masks.get
        for c in text:
            eq = get(c, 0)
            x = eq | down
            d = (((eq & up) + up) ^ up) | eq
            plus = down | ~(d | up)
            minus = up & d
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus = (plus << 1) & full
            minus = (minus << 1) & full
            up = (minus | ~(x | plus)) & full
            down = plus & x
            if score < best:
                best = score
        return best


class Matcher:
    """Automaton over the pieces of items; built once in a worker."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = [(item_id, Pattern(text), int(len(text) * error_rate)) for item_id, text in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (_, pattern, budget) in enumerate(self.items):
            for offset, piece in pieces(pattern.item, budget):
                where.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, int]:
        """Least distance within its budget of every item that text contains."""
        windows: dict[int, list[list[int]]] = {}
        for end, (length, at) in self.automaton.iter(text):
            begin = end + 1 - length
            for i, offset in at:
                _, pattern, budget = self.items[i]
                lo = max(0, begin - offset - budget)
                hi = begin - offset + len(pattern.item) + budget
                seen = windows.setdefault(i, [])
                for window in seen:
                    if lo <= window[1] and window[0] <= hi and max(hi, window[1]) - min(lo, window[0]) <= 2 * len(pattern.item):
                        window[:] = min(lo, window[0]), max(hi, window[1])
                        break
                else:
                    seen.append([lo, hi])
        found: dict[int, int] = {}
        for i, spans in windows.items():
            item_id, pattern, budget = self.items[i]
            if budget:
                best = min(0 if pattern.item in (part := text[lo:hi]) else pattern.distance(part) for lo, hi in spans)
            else:  # short: whole words, or it would be found inside many
                best = 0 if f" {pattern.item} " in f" {text} " else 1
            if best <= budget:
                found[item_id] = min(best, found.get(item_id, best))
        return found


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = 0.08, automaton_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, distance): every document that holds a test item within its budget.

    The budget is ``error_rate`` times the item's normalised length.  Items are spread by
    a hash over groups of about ``automaton_chars`` characters (an automaton takes some
    hundred bytes a character), of which only one at a time is on the driver and in
    workers.  Each further group is another pass over the documents, whose hits are
    written before the next begins, so a large benchmark costs time, not memory.
    """
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")

    @F.arrow_udf("string")
    def normal(texts: pa.Array) -> pa.Array:
        return pa.array([normalise(t.as_py()) for t in texts], pa.string())

    items = benchmark.select(F.col(item_id).cast("bigint").alias("i"), normal(F.col(item_text)).alias("t")).where("i is not null and t != ''")
    items = stored(items.distinct(), "benchmark-items")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    groups = max(1, -(-total // automaton_chars))
    out = None
    for number in range(groups):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(groups)) == number).orderBy("i", "t").collect()
        match, shared = _match_udf(own.sparkSession, [(r["i"], r["t"]) for r in part], error_rate)
        found = own.select("doc_id", F.explode(match("text")).alias("m")).select("doc_id", "m.*")
        if groups > 1:
            found = stored(found, "contaminated")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


_built: dict[str, Matcher | None] = {}


def _match_udf(spark, items: list[tuple[int, str]], error_rate: float):
    shared, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex
    element = pa.struct([("item_id", pa.int64()), ("distance", pa.int32())])

    @F.arrow_udf("array<struct<item_id:bigint,distance:int>>")
    def match(texts: pa.Array) -> pa.Array:
        if name not in _built:
            _built.clear()
            _built[name] = Matcher(shared.value, error_rate) if shared.value else None
        matcher = _built[name]
        out = []
        for value in texts:
            text = normalise(value.as_py())
            out.append([{"item_id": i, "distance": d} for i, d in matcher.matches(text).items()] if matcher and text else [])
        return pa.array(out, pa.list_(element))

    return match.asNondeterministic(), shared
