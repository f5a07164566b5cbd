"""Chat formatting by columnar byte assembly.

Turns are shuffled by conversation and sorted; per Arrow batch the lengths of all
header, content and closing segments are computed at once, their cumulative offsets
tell where each goes, and headers and contents are scattered into one preallocated
buffer, which becomes the Arrow string column.  No Python string is made.  Buffers hold
some conversations of about PART_BYTES, or a longer one, up to the 2 GB of a string.

Defined results: turns go by (turn, role, text), nulls first, so ties and repeated
rows are kept in a fixed order; a null role is ``unknown``, a null text is empty; rows
with a null conversation id form one conversation with a null id; contents are copied
byte for byte; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.llm.text import buffers

PART_BYTES = 16 << 20  # of a buffer; its indices take 16 times as much
LONG = 1 << 16  # contents from so many bytes on are copied whole

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def assemble(roles: pa.Array, texts: pa.Array, firsts: np.ndarray) -> pa.Array:
    """One string for each run of turns that begins at ``firsts``."""
    n = len(roles)
    coded = pc.fill_null(roles, "unknown").dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    headers = [np.frombuffer(f"{OPEN}{r}{MIDDLE}".encode(), np.uint8) for r in coded.dictionary.to_pylist()]
    close = np.frombuffer(CLOSE.encode(), np.uint8)
    data, offsets = buffers(texts)
    head = np.array([len(h) for h in headers], np.int64)[which]
    body = np.diff(offsets)
    turn = head + body + len(close)
    at = np.cumsum(turn) - turn
    total = int(turn.sum())
    out = np.empty(total, np.uint8)
    for r, header in enumerate(headers):
        out[at[which == r][:, None] + np.arange(len(header))] = header
    short = np.flatnonzero(body < LONG)
    n_bytes = body[short]
    inside = np.arange(n_bytes.sum()) - np.repeat(np.cumsum(n_bytes) - n_bytes, n_bytes)
    out[inside + np.repeat((at + head)[short], n_bytes)] = data[inside + np.repeat(offsets[:-1][short], n_bytes)]
    for i in np.flatnonzero(body >= LONG).tolist():
        out[at[i] + head[i] : at[i] + head[i] + body[i]] = data[offsets[i] : offsets[i + 1]]
    out[(at + head + body)[:, None] + np.arange(len(close))] = close
    bounds = np.append(at[firsts], total).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(firsts), [None, pa.py_buffer(bounds), pa.py_buffer(out)]) if n else pa.array([], pa.large_string())


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, roles, texts = (table.column(i) for i in range(3))
        texts = pa.chunked_array([c.cast(pa.large_string()) for c in texts.chunks]).combine_chunks()
        ids, roles = ids.combine_chunks(), roles.combine_chunks()
        key = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        firsts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])]))
        ends = np.append(firsts[1:], len(ids))
        size = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)))
        at = 0
        while at < len(firsts):  # conversations of about PART_BYTES, one at least
            to = max(at + 1, int(np.searchsorted(size[ends], size[firsts[at]] + PART_BYTES, "right")))
            lo, n = int(firsts[at]), int(ends[to - 1] - firsts[at])
            text = assemble(roles.slice(lo, n), texts.slice(lo, n), firsts[at:to] - lo).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(firsts[at:to])), pa.array((ends - firsts)[at:to]), text], ["conv_id", "n_turns", "text"])
            at = to

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        last = ids[-1]
        other = np.flatnonzero(~pc.fill_null(pc.equal(ids, last), False).to_numpy(zero_copy_only=False)) if last.is_valid else np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and (cut or held[-1].column(0)[0] != ids[0] and (held[-1].column(0)[0].is_valid or ids[0].is_valid)):
            yield from made(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        elif cut:
            yield from made(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
    if held:
        yield from made(pa.Table.from_batches(held))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, text): every conversation as one string."""
    own = turns.select(F.col(conv_id).alias("c"), F.col(turn).alias("n"), F.col(role).alias("r"), F.col(text).alias("t"))
    own = own.repartition("c").sortWithinPartitions("c", "n", "r", "t")
    return own.select("c", "r", "t").mapInArrow(_format, "conv_id bigint, n_turns bigint, text string")


ORACLE = """
select conv_id, count(*)::bigint as n_turns,
    string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
        order by turn nulls first, role nulls first, text nulls first) as text
from conversations group by conv_id
"""
