"""Blocks of chunks that SQL joins with a query's words and vector, and what is best in a block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import terms
from corpusmill.operators.text_search import COVER
from corpusmill.operators.vector_search import _distances, _first
from corpusmill.plans.staging import BATCH_BYTES, staged

#: Words that a block holds before it is given; chunks that are added to it at once; what sets the places of one chunk apart from those of the next.
WORDS, PART, APART = 1 << 19, 100, 1 << 32
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_BLOCK = "block long, term string, ids binary, counts binary, places binary"
#: What `covers` and `nearest` give.
COVERS, NEAREST = "array<struct<chunk_id: bigint, rank: double>>", "array<struct<chunk_id: bigint, distance: double>>"
_TEXT, _VECTOR = (pa.struct([("chunk_id", pa.int64()), (name, pa.float64())]) for name in ("rank", "distance"))


def worded(chunks: DataFrame) -> DataFrame:
    """(chunk_id, words, pos) of chunks (chunk_id, text): all words in order; without `pos` a word's place is its number."""
    return chunks.select(F.col("chunk_id").cast("long"), terms(F.col("text")).alias("words"), F.lit(None).cast("array<int>").alias("pos"))


def gathered(posted: DataFrame, inside: DataFrame) -> DataFrame:
    """The same from postings (term, chunk_id, pos) of those chunks that `inside` (chunk_id) has; written, so that rows keep their order."""
    own = posted.where("term is not null").join(inside.select("chunk_id"), "chunk_id", "left_semi")
    each = own.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "term"))).alias("w"))
    return staged(each.select(F.col("chunk_id").cast("long"), F.col("w.term").alias("words"), F.col("w.pos").alias("pos")))


def _block(batches: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
    """A row for each word: the chunks that have it in order, how often each does, and where."""
    words = pa.concat_arrays([b.column("words").flatten() for b in batches]).dictionary_encode()
    lengths = np.concatenate([b.column("words").value_lengths().to_numpy(zero_copy_only=False) for b in batches])
    owner = np.repeat(np.concatenate([b.column("chunk_id").to_numpy() for b in batches]), lengths)
    if batches[0].column("pos").null_count:
        pos = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    else:
        pos = np.concatenate([b.column("pos").flatten().to_numpy() for b in batches])
    code = words.indices.to_numpy()
    in_order = bool((owner[1:] >= owner[:-1]).all())
    order = np.argsort(code, kind="stable") if in_order else np.lexsort((pos, owner, code))
    code, owner, pos = code[order], owner[order], pos[order].astype(np.int32)
    first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1]))))[: len(code)]
    counts = np.diff(first, append=len(code)).astype(np.int32)
    rows, at = len(words.dictionary), np.searchsorted(code[first], np.arange(len(words.dictionary) + 1))
    places = np.append(first, len(code))[at]
    binary = lambda data, bounds: pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(data)])
    columns = [pa.array(np.full(rows, number)), words.dictionary, binary(owner[first], at), binary(counts, at), binary(pos, places)]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _BLOCK.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, number = [], 0, TaskContext.get().partitionId() << 32
    for part in (batch.slice(at, PART) for batch in batches for at in range(0, batch.num_rows, PART)):
        held.append(part)
        size += len(part.column("words").flatten())
        if size >= WORDS:
            yield _block(held, number)
            held, size, number = [], 0, number + 1
    if size:
        yield _block(held, number)
    held.clear()
    pa.default_memory_pool().release_unused()


def word_blocks(words: DataFrame) -> DataFrame:
    """(block, term, ids, counts, places) of (chunk_id, words, pos): postings of blocks of neighbouring chunks, made without moving them.

    A chunk's words are all in one block, so what a block's chunks are worth is known from its rows.
    """
    return words.mapInArrow(_blocks, _BLOCK)


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the session's Arrow batches for rows that hold whole blocks or texts; a smaller setting stays."""
    now = spark.conf.get(_LIMIT).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def _term(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int32), np.frombuffer(row["places"], np.int32)


def _scores(n: int, phrases: list[list[int]], found: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cover densities of a block's chunks that have all n words, the phrases (numbers of words), and none of the excluded words."""
    must = [_term(row) for row in sorted((r for r in found if r["kind"] == 0), key=lambda r: r["k"])]
    ids = must[0][0]
    for other, _, _ in must[1:]:
        ids = np.intersect1d(ids, other, assume_unique=True)
    for row in found:
        if row["kind"]:
            ids = np.setdiff1d(ids, _term(row)[0], assume_unique=True)
    owners, places = [], []
    for own, counts, pos in must:
        at = np.searchsorted(own, ids)
        many = counts[at]
        begin = (np.cumsum(counts) - counts)[at]
        places.append(pos[np.arange(many.sum()) + np.repeat(begin - (np.cumsum(many) - many), many)].astype(np.int64))
        owners.append(np.repeat(np.arange(len(ids)), many))
    for phrase in phrases:
        keys = [np.unique(owners[k] * APART + places[k] - i + len(phrase)) for i, k in enumerate(phrase)]
        start = keys[0]
        for other in keys[1:]:
            start = np.intersect1d(start, other, assume_unique=True)
        whole = np.zeros(len(ids), bool)
        whole[start // APART] = True
        places = [p[whole[o]] for p, o in zip(places, owners, strict=True)]
        owners = [o[whole[o]] for o in owners]
    owner, pos = np.concatenate(owners), np.concatenate(places)
    k = np.repeat(np.arange(n), [len(o) for o in owners])
    order = np.argsort(owner * APART + pos)
    owner, pos, k = owner[order], pos[order], k[order]
    # The last place of each word so far, counted from 1 within a chunk; 0 where there was none yet.
    low = np.full(len(owner), APART)
    for word in range(n):
        low = np.minimum(low, np.maximum.accumulate(owner * APART + np.where(k == word, pos + 1, 0)) - owner * APART)
    fresh = low > 0
    fresh[1:] &= (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    size = (pos - low + 2)[fresh]
    score = np.bincount(owner[fresh], np.where(size <= COVER, 1.0, COVER / size), len(ids))
    there = np.bincount(owner, minlength=len(ids)) > 0
    return ids[there], score[there]


def _best(ids: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Those that can be among the `most` best when scores are rounded to six digits: of one score, the least ids."""
    order = np.lexsort((ids, -score))
    ids, score = ids[order], score[order]
    if 0 < most < len(ids):
        nth = np.arange(len(ids)) - np.searchsorted(-score, -score)
        kept = (score >= score[most - 1] - 2e-6) & (nth < most)
        ids, score = ids[kept], score[kept]
    return ids[: len(ids) if most > 0 else 0], score[: len(ids) if most > 0 else 0]


def _lists(found: list[tuple[np.ndarray, np.ndarray]], kind: pa.StructType) -> pa.Array:
    values = [np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (0, 1)]
    pairs = pa.StructArray.from_arrays([pa.array(v, field.type) for v, field in zip(values, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32()), pairs)


def covers(n: pa.Array, phrases: pa.Array, terms: pa.Array, most: pa.Array) -> pa.Array:
    """The best of each block for an alternative of a query."""
    found = [_best(*_scores(n[i].as_py(), phrases[i].as_py(), terms[i].as_py()), most[i].as_py() or 0) for i in range(len(n))]
    return _lists(found, _TEXT)


def nearest(vector: pa.Array, ids: pa.Array, data: pa.Array, most: pa.Array) -> pa.Array:
    """The nearest of each block to a query's vector; none to a vector that is null or of another size."""
    found = []
    for i in range(len(ids)):
        own, asked = np.frombuffer(ids[i].as_buffer(), np.int64), vector[i].as_py()
        q, v = np.array(asked or [], np.float64)[None], np.frombuffer(data[i].as_buffer()).reshape(len(own), -1)
        alike = asked is not None and q.shape[1] == v.shape[1]
        found.append(_first(_distances(q @ v.T, q, np.linalg.norm(v, axis=1)), own, max(most[i].as_py() or 0, 0))[1:] if alike else (own[:0], np.zeros(0)))
    return _lists(found, _VECTOR)
