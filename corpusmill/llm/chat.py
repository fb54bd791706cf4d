r"""Formatting conversations for training, with a mask of the text that counts for the loss.

A turn is `### role: text</turn>` and a line end. Inside roles and texts the control strings and the
backslash are escaped: `\` as `\\`, `###` as `\h`, `</turn>` as `\e`, and in roles `:` as `\c`, so
that no text can open or close a turn and reading back restores every text.

A batch of turns is put together by columns: the lengths of all segments give their offsets by
cumulative sums, and headers, texts and ends are copied by index into one buffer made beforehand, which
becomes the column of an Arrow table as it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import freeing

OPEN, CLOSE = "### ", "</turn>\n"
LEARNED = "assistant"
#: Bytes after which a part of a very long conversation ends.
PART = 4 << 20
_ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\e"}
_PLAIN = {"\\": "\\", "h": "###", "e": "</turn>", "c": ":"}
FORMATTED = "conv_id long, first_turn long, part int, formatted string, n_turns int, loss_starts array<int>, loss_ends array<int>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(column: pa.Array, more: dict[str, str] = {}) -> pa.Array:  # noqa: B006
    column = column.cast(pa.large_string())
    for plain, code in (_ESCAPES | more).items():
        column = pc.replace_substring(column, plain, code)
    return column


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes and lengths of a string column without nulls."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]] if len(bounds) else data, np.diff(bounds)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns' bytes in one buffer, where each turn ends, and where its text starts and ends there."""
    of = lambda x: pa.scalar(x, pa.large_string())
    heads = pc.binary_join_element_wise(of(OPEN), escaped(roles, {":": "\\c"}), of(": "), of(""))
    parts = [_buffers(heads), _buffers(escaped(texts))]
    tail = np.frombuffer(CLOSE.encode(), np.uint8)
    n = len(roles)
    sizes = np.stack([parts[0][1], parts[1][1], np.full(n, len(tail))], axis=1)
    ends = np.cumsum(sizes.reshape(-1)).reshape(n, 3)
    out = np.empty(ends[-1, -1] if n else 0, np.uint8)
    for k, (data, size) in enumerate(parts):
        start = ends[:, k] - size
        out[np.arange(len(data)) + np.repeat(start - (np.cumsum(size) - size), size)] = data
    out[(ends[:, 2] - len(tail))[:, None] + np.arange(len(tail))] = tail
    return out, ends[:, 2], ends[:, 0], ends[:, 1]


def cuts_of(ids: np.ndarray, ends: np.ndarray, limit: int) -> np.ndarray:
    """Where rows begin: at each conversation's first turn, and where its turns up to there fill another `limit` bytes."""
    first = np.concatenate(([True], ids[1:] != ids[:-1]))
    opened = np.maximum.accumulate(np.where(first, np.append(0, ends[:-1]), 0))
    filled = (ends - opened - 1) // limit
    return np.flatnonzero(first | np.concatenate(([False], filled[1:] != filled[:-1])))


@freeing
def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        roles, texts = (pc.fill_null(batch.column(c).cast(pa.large_string()), "") for c in ("role", "text"))
        data, ends, lo, hi = assemble(roles, texts)
        ids = batch.column("conv_id")
        # Numbers that differ where conversations do; null is one of them.
        cut = cuts_of(ids.dictionary_encode(null_encoding="encode").indices.to_numpy(), ends, PART)
        stop = np.append(cut[1:], len(ends))
        begin = np.append(0, ends)[cut]
        # The buffer itself becomes the column of texts; spans are places within their row.
        formatted = pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(np.append(begin, ends[-1])), pa.py_buffer(data)).cast(pa.string())
        own = np.flatnonzero(np.asarray(pc.equal(roles, LEARNED)))
        row = np.searchsorted(cut, own, side="right") - 1
        offsets = pa.array(np.searchsorted(own, np.append(cut, len(ends))).astype(np.int32))
        spans = [pa.ListArray.from_arrays(offsets, pa.array((x[own] - begin[row]).astype(np.int32))) for x in (lo, hi)]
        first = pa.array(cut)
        columns = [ids.take(first), batch.column("turn").take(first), pa.array(np.arange(part, part + len(cut), dtype=np.int32)), formatted, pa.array((stop - cut).astype(np.int32)), *spans]
        part += len(cut)
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FORMATTED.split(", ")])


def format_turns(turns: DataFrame) -> DataFrame:
    """Formatted conversations, in parts of bounded size, of `turns` (conv_id, turn, role, text).

    A row is a part of one conversation; its parts in the order of first_turn and part, joined,
    are the whole. loss_starts and loss_ends are the byte spans of assistant texts in `formatted`.
    Turns are dealt by ranges of (conv_id, turn), so that one huge conversation is many tasks' work.
    A null text or role is empty; null ids form one conversation; null turns come first; rows with
    the same turn follow in the order of role and text. Other columns are ignored.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format, FORMATTED)


def _read(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn in a formatted part."""
    for turn in formatted.split(CLOSE)[:-1]:
        role, _, text = turn.removeprefix(OPEN).partition(": ")
        yield unescaped(role), unescaped(text)


@freeing
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, now, state = [], object(), None

    def close() -> None:
        if state:
            rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def taken() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in DIGESTS.split(", ")])
        rows.clear()
        return out

    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != now:
                close()
                now, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in _read(row["formatted"]):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            data = row["formatted"].encode()
            for a, b in zip(row["loss_starts"], row["loss_ends"], strict=True):
                text = unescaped(data[a:b].decode())
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(row["formatted"])
        yield taken()
    close()
    yield taken()


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from the output of `format_turns`.

    A digest needs its conversation in order, so the parts of one are read by one task, in a stream
    that holds one part at a time.
    """
    parts = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn", "part")
    return parts.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(_digest, DIGESTS)
