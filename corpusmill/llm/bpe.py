"""Byte-level BPE: encoding whole texts by a public rank file, and decoding ids.

Merges of one word are ordered by a rank queue: a bitmap over the ranks in two levels of words, so
that the next rank is two find-first-set steps away, and for each rank a bucket of places in a
linked list of parts. Entries whose pair has changed meanwhile are skipped. The cost of
a word of n bytes is about n log n, so a very long one does no harm.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.pretokens import Encoder, gather
from corpusmill.llm.words import freeing
from corpusmill.plans.staging import text_batches

#: Words that a worker remembers: a merge costs far more than a place in the table.
REMEMBERED = 1_600_000


@cache
def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks by token, from lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Places by rank. A set bit of a word of `low` stands for a rank with a bucket; `merge` keeps the level above, a bit for each word that is not 0."""

    def __init__(self, ranks: int):
        self.shift = (max(ranks - 1, 1).bit_length() + 1) // 2  # both levels are about as wide
        self.low = [0] * (((ranks - 1) >> self.shift) + 1)
        self.bits = [1 << k for k in range(1 << self.shift)]
        self.buckets: dict[int, list[int]] = {}


def merge(word: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """The ids of one word. `queue` is empty before and after.

    A part is known by its start; `end` tells where it ends, which is where the next one starts, and
    `pair` the rank of it and the next. Of equal ranks the leftmost place comes first, so a bucket of
    several places is a heap. Pushing and popping stand here and not in methods, as calls would take
    most of the time.
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    low, buckets, shift, bits, top = queue.low, queue.buckets, queue.shift, queue.bits, 0
    rank_of, n, mask = ranks.get, len(word), len(queue.bits) - 1
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [rank_of(word[i : i + 2]) for i in range(n - 1)]
    pair.append(None)
    new = range(n - 1)
    while True:
        for i in new:
            if (rank := pair[i]) is None:
                continue
            if rank in buckets:
                heapq.heappush(buckets[rank], i)
            else:
                buckets[rank] = [i]
                low[rank >> shift] |= bits[rank & mask]
                top |= bits[rank >> shift]
        if not top:
            break
        at = (top & -top).bit_length() - 1
        lower = low[at]
        rank = (at << shift) + (lower & -lower).bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heapq.heappop(bucket)
        else:
            i = bucket[0]
            del buckets[rank]
            low[at] = lower = lower & (lower - 1)
            if not lower:
                top &= top - 1
        new = ()
        if pair[i] != rank:  # stale: one of the two parts has grown or gone
            continue
        j = end[i]
        end[i] = k = end[j]
        pair[i] = pair[j] = None
        if k < n:
            left[k] = i
            pair[i] = rank_of(word[i : end[k]])
        if (h := left[i]) >= 0:
            pair[h] = rank_of(word[h:k])
            new = (i, h)
        else:
            new = (i,)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


@cache
def encoder(path: str) -> Encoder:
    ranks = vocabulary(path)
    queue = RankQueue(max(ranks.values()) + 1)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = array("I"), array("q")
        for word in words:
            ids = merge(word.encode(), ranks, queue)
            flat.extend(ids)
            sizes.append(len(ids))
        return np.frombuffer(flat, np.uint32), np.frombuffer(sizes, np.int64)

    return Encoder(encode, most=REMEMBERED)


@cache
def _tokens(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes by id, with offsets and lengths; an id that is no token has length -1."""
    ranks = vocabulary(path)
    size = np.full(max(ranks.values()) + 1, -1, np.int64)
    ordered = sorted(ranks, key=ranks.get)
    size[[ranks[t] for t in ordered]] = [len(t) for t in ordered]
    held = np.maximum(size, 0)
    return np.frombuffer(b"".join(ordered), np.uint8), np.cumsum(held) - held, size


def decoded(ids: np.ndarray, ends: np.ndarray, path: str) -> pa.Array:
    """The bytes of each of several runs of ids."""
    flat, offset, size = _tokens(path)
    if len(ids) and (ids.max() >= len(size) or (size[ids] < 0).any()):
        raise ValueError("an id is not in the vocabulary")
    out, stop = gather(flat, offset, size, ids)
    bounds = np.append(0, np.append(0, stop)[ends])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


@freeing
def _round_trip(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for lo, hi, ids, ends in coder.batches(texts):
            rows = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), rows, decoded(ids, ends, path)], ["doc_id", "ids", "decoded"])


@freeing
def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
        out = decoded(np.concatenate([np.zeros(0, np.int64), *ids]), np.cumsum([len(x) for x in ids]), path)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "decoded"])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row of `docs` (doc_id, text).

    ids are those of the whole text, without special tokens; decoded are the bytes that they stand
    for. A null text is empty and has no ids. Other columns are ignored; repeated rows are repeated.
    """
    return text_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(partial(_round_trip, path=path), "doc_id long, ids array<int>, decoded binary")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) as in `round_trip`."""
    return round_trip(docs, path).select("doc_id", "ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded): the bytes of ids (doc_id, ids); null ids are empty, an unknown id is an error."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, path=path), "doc_id long, decoded binary")
