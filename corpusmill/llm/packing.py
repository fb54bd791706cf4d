"""Packing documents into sequences of bounded length by Karmarkar-Karp differencing.

Each document's ids are cut into full sequences and shorter pieces of at most PART ids. Pieces are
dealt into lots by a hash of their place in the table, a lot for about LOT_TOKENS ids, so that every
lot is one bounded task.
Within a lot, multiway differencing splits the pieces into windows of nearly equal length; while the
longest exceeds the capacity, the number of windows rises.
"""

from __future__ import annotations

import heapq
import math
import os
import zlib
from collections.abc import Iterator
from functools import cache, partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.pretokens import Encoder
from corpusmill.llm.words import freeing, mix
from corpusmill.plans.staging import staged, text_batches

#: A lot has about LOT_TOKENS ids and LOT_PIECES pieces at most; SLACK is the share of padding below which differencing is not tried.
CAPACITY, PART, LOT_TOKENS, LOT_PIECES, SLACK = 1024, 256, 1 << 17, 1 << 12, 0.005
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = _PIECES + ", sequence_id long, offset long"


@cache
def encoder(path: str) -> Encoder:
    """Pre-tokens are found here and their ids come from the library, which cuts no further; its added tokens stand for themselves."""
    from tokenizers import Tokenizer, pre_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    return Encoder(encode, {token.content: number for number, token in tokenizer.get_added_tokens_decoder().items()})


def cut(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, start and length of the pieces of documents of these sizes: full sequences, then parts of PART ids at most."""
    full = sizes // capacity
    count = full + -(-(sizes % capacity) // PART)
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    rest = np.maximum(nth - full[owner], 0)
    start = np.minimum(nth, full[owner]) * capacity + rest * PART
    return owner, start, np.where(nth < full[owner], capacity, np.minimum(PART, sizes[owner] - start))


@freeing
def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    coder, met, task = encoder(path), 0, TaskContext.get()
    salt = np.uint64((task.partitionId() if task else 0) << 40)
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for lo, hi, ids, ends in coder.batches(texts):
            sizes = np.diff(ends, prepend=0) + 1
            after = np.cumsum(sizes)
            whole = np.full(after[-1], end_id, "<u4")
            own = np.ones(len(whole), bool)
            own[after - 1] = False
            whole[own] = ids
            owner, start, length = cut(sizes, capacity)
            begin = after[owner] - sizes[owner] + start
            data = memoryview(whole.tobytes())
            sums = [zlib.crc32(data[a:b]) for a, b in zip((4 * begin).tolist(), (4 * (begin + length)).tolist(), strict=True)]
            # Lots are dealt by place in the table, so rows without an id and copies go to many.
            deal = mix(np.arange(met, met + len(owner), dtype=np.uint64) + salt).view(np.int64)
            met += len(owner)
            columns = [batch.column("doc_id").slice(lo, hi - lo).take(pa.array(owner)), *(pa.array(c, pa.int64()) for c in (start, length, sums, sizes[owner], deal))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])


def differenced(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size, by multiway differencing.

    Every partial partition has a sum for each window, the largest first. The two with the widest
    spread are merged, the largest of one with the smallest of the other, until one is left.
    """
    n = len(sizes)
    if windows <= 1:
        return np.zeros(n, np.int64)
    joins: list[tuple[np.ndarray, np.ndarray]] = []
    count, heap = n, []
    for i, size in enumerate(sizes.tolist()):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], nodes[0] = size, i
        heap.append((-size, i, sums, nodes))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, tie, b, nb = heap[0]
        nb = nb[::-1]
        sums, nodes = a + b[::-1], np.maximum(na, nb)
        both = np.flatnonzero(np.minimum(na, nb) >= 0)
        if both.size:
            joins.append((na[both], nb[both]))
            nodes[both] = np.arange(count, count + both.size)
            count += both.size
        order = sums.argsort()[::-1]
        sums = sums[order]
        sums -= sums[-1]
        heapq.heapreplace(heap, (-int(sums[0]), tie, sums, nodes[order]))
    # From the last partition's windows down to the pieces that were joined into them.
    parents = np.full(count, -1, np.int64)
    final = heap[0][3]
    parents[final[final >= 0]] = np.flatnonzero(final >= 0)
    at = count
    for left, right in reversed(joins):
        at -= len(left)
        parents[left] = parents[right] = parents[at : at + len(left)]
    return parents[:n]


def windows_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A window for each size, none above capacity; as few windows as differencing can fill."""
    windows = math.ceil(int(sizes.sum()) / (capacity * (1 - SLACK)))
    while True:
        window = differenced(sizes, windows)
        if np.bincount(window, sizes).max(initial=0) <= capacity:
            return window
        windows += 1


def _pack_lot(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
    size = rows["length"].to_numpy()
    full = size == capacity
    window = np.zeros(len(rows), np.int64)
    if not full.all():
        window[~full] = windows_of(size[~full], capacity)
    window[full] = np.arange(full.sum()) + (window[~full].max(initial=-1) + 1)
    rows["sequence_id"] = rows["lot"] * (1 << 20) + window
    rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
    return rows.drop(columns="lot")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row for each piece of every row of `docs` (doc_id, text), with its place in a sequence.

    A document's ids are those of the tokenizer file `path`, then `end_id`; the file's added tokens
    are met in texts as the library meets them, so their strings are single ids. A null text is empty
    and has `end_id` alone; rows with a null or repeated doc_id are documents of their own. start and length tell the piece, sequence_id and offset its place. Other
    columns are ignored; no rows give no pieces.
    """
    pieces = staged(text_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(partial(_cut, path=path, capacity=capacity, end_id=end_id), _PIECES + ", deal long"))
    tokens, count = pieces.agg(F.sum("length"), F.count("*")).first()
    lots = max(1, -(-(tokens or 0) // LOT_TOKENS), -(-count // LOT_PIECES))
    dealt = pieces.withColumn("lot", F.expr(f"pmod(deal, {lots}L)")).drop("deal")
    return dealt.groupBy("lot").applyInPandas(lambda rows: _pack_lot(rows, capacity), PACKED)
