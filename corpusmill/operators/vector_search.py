"""Exact and approximate nearest vectors for a table of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.staging import staged, text_batches

#: Shares into which the blocks of a group are dealt.
SHARES = 16
#: Distances that a task of an exact search remembers.
REMEMBERED = 4_000_000
#: Vectors in a block; queries that are held against a block at once; digits that distances are kept to, so that ties don't hang on the order of addition.
BLOCK, QUERIES, DIGITS = 2048, 256, 9
_PACKED, _NEAR = "ids binary, data binary", "query_id long, chunk_id long, distance double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one size as rows of a matrix; a missing number is not a number."""
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows packed as (ids, matrix): a row for at most BLOCK vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            columns = [part.column("id").to_numpy().tobytes(), _matrix(part.column("v")).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["ids", "data"])


def _first(away: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and distance of each row's k least distances, equal ones by id; what is not a number is left out."""
    away = np.where(np.isfinite(away), away, np.inf)
    if 0 < k < away.shape[1]:
        row, at = np.nonzero((away <= np.partition(away, k - 1, axis=1)[:, k - 1 : k]) & np.isfinite(away))
    else:
        row, at = np.nonzero(np.isfinite(away))
    found, distance = np.broadcast_to(ids, away.shape)[row, at], away[row, at]
    order = np.lexsort((found, distance, row))
    row, found, distance = row[order], found[order], distance[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    kept = (nth < k) & np.isfinite(distance)
    return row[kept], found[kept], distance[kept]


def _distances(dots: np.ndarray, q: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.round(1 - dots / np.linalg.norm(q, axis=1)[:, None] / lengths, DIGITS) + 0.0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Pairs of blocks one after another, as views of their batch's memory."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_buffer() for name, column in zip(batch.schema.names, batch.columns, strict=True) if pa.types.is_binary(column.type)}


def _met(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Place, ids and vectors of a block of queries, some at a time, and ids and vectors of the block that they meet."""
    ids, queries = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
    v, q = np.frombuffer(row["data"]).reshape(len(ids), -1), np.frombuffer(row["q_data"]).reshape(len(queries), -1)
    for at in range(0, len(queries), QUERIES):
        yield at, queries[at : at + QUERIES], q[at : at + QUERIES], ids, v


def _near(query: np.ndarray, found: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(found), pa.array(distance)], [x.split()[0] for x in _NEAR.split(", ")])


def _nearest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks the k nearest of the one to each of the other.

    For the first queries it meets, a task remembers the k least distances so far; what is further away isn't given.
    """
    known, room = {}, REMEMBERED
    for row in _rows(batches):
        block = row["q_ids"].to_pybytes()
        for place, queries, q, ids, v in _met(row):
            away = _distances(q @ v.T, q, np.linalg.norm(v, axis=1))
            away[~np.isfinite(away)] = np.inf
            if 0 < k < away.shape[1]:
                best, so_far = np.partition(away, k - 1, axis=1)[:, :k], known.get((block, place))
                if so_far is not None:
                    best = np.partition(np.concatenate([so_far, best], axis=1), k - 1, axis=1)[:, :k]
                if so_far is not None or best.size <= room:
                    room -= best.size if so_far is None else 0
                    known[block, place] = best
                away[away > best[:, -1:]] = np.inf
            at, found, distance = _first(away, ids, k)
            yield _near(queries[at], found, distance)


def _grouped_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As `_blocks`, where all rows of a block have one value of `within`, which the block keeps."""
    for batch in batches:
        codes = batch.column("within").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        bounds = np.flatnonzero(np.diff(codes[order], prepend=-1, append=-1)) if len(order) else []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            own = batch.take(pa.array(order[lo:hi]))
            for block in _blocks(iter([own])):
                yield pa.RecordBatch.from_arrays([*block.columns, own.column("within").slice(0, 1)], ["ids", "data", "within"])


def packed(rows: DataFrame, id_: str, vector: str, within: str | None = None) -> DataFrame:
    """Rows with a vector as blocks (ids, data), each of one value of `within` where that is named."""
    plain = rows.where(F.col(vector).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v"), *([F.col(within).alias("within")] if within else []))
    if within is None:
        return plain.mapInArrow(_blocks, _PACKED)
    return plain.mapInArrow(_grouped_blocks, f"{_PACKED}, within {plain.schema['within'].dataType.simpleString()}")


def _ranked(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return near.withColumn("vector_rank", F.row_number().over(order)).where(F.col("vector_rank") <= k)


def _against(blocks: DataFrame, queries: DataFrame, within: str | None = None) -> DataFrame:
    """Every block beside every block of queries, or beside those of its own group. These are written first, so that Spark knows their size and broadcasts them only if they are few."""
    asked = staged(packed(queries, "query_id", "qvec", within).withColumnsRenamed({"ids": "q_ids", "data": "q_data", "within": "q_within"}))
    if within is None:
        return text_batches(blocks.crossJoin(asked))
    # A large group's blocks are dealt, and its queries go to each share, so that it is many tasks' work.
    dealt = blocks.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(SHARES)).cast("int"))
    asked = asked.withColumn("q_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return text_batches(dealt.join(asked, (F.col("within") == F.col("q_within")) & (F.col("share") == F.col("q_share"))).drop("share", "q_share", "within", "q_within"))


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, within: str | None = None) -> DataFrame:
    """(query_id, chunk_id, distance, vector_rank): each query's k nearest by cosine distance, then id.

    queries (query_id, qvec) and vectors (chunk_id, embedding) have long ids and one dimension. Both
    are packed into blocks and every block of the one meets every block of the other, so a task
    holds two blocks and gives k rows a query. Vectors without length have no distance. `within`
    names a column of both; queries meet only vectors with the same value of it.
    """
    return _ranked(_against(packed(vectors, "chunk_id", "embedding", within), queries, within).mapInArrow(partial(_nearest, k=max(k, 0)), _NEAR), k)


#: Rotations of which a code holds all signs; the share of each block that is scored exactly; seed of the rotations.
ROTATIONS, SHARE, SEED = 8, 0.15, 5


def rotations(size: int, count: int = ROTATIONS, seed: int = SEED) -> np.ndarray:
    """Random rotations side by side. Signs after a rotation miss less than signs of as many independent directions."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(count)], axis=1)


def sign_codes(vectors: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """On which side of each direction a vector lies, packed into 64-bit words."""
    bits = np.packbits(vectors @ turned >= 0, axis=1)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


def _coded(batches: Iterator[pa.RecordBatch], count: int, seed: int) -> Iterator[pa.RecordBatch]:
    turned = None
    for batch in batches:
        v, ids = _matrix(batch.column("v")), batch.column("id").to_numpy()
        with np.errstate(invalid="ignore"):
            sound = np.linalg.norm(v, axis=1) > 0
        v, ids = v[sound], ids[sound]
        if len(v) and turned is None:
            turned = rotations(v.shape[1], count, seed)
        for at in range(0, len(v), BLOCK):
            columns = [x[at : at + BLOCK].tobytes() for x in (ids, v)] + [sign_codes(v[at : at + BLOCK], turned).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["ids", "data", "codes"])


def vector_index(vectors: DataFrame, count: int = ROTATIONS, seed: int = SEED) -> DataFrame:
    """Blocks of `vectors` (chunk_id, embedding) with packed sign codes, for `approximate_top_k`; written once.

    Null vectors and vectors without length are left out. Vectors have one dimension.
    """
    plain = vectors.where("embedding is not null").select(F.col("chunk_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    return staged(plain.mapInArrow(partial(_coded, count=count, seed=seed), f"{_PACKED}, codes binary"))


def scored_of(n: int, k: int, share: float) -> int:
    """How many of a block's n vectors are scored exactly for a query."""
    return min(n, max(k, int(np.ceil(share * n))))


def _likely(batches: Iterator[pa.RecordBatch], k: int, share: float, count: int, seed: int) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks the k nearest among those whose codes differ least."""
    turned = None
    for row in _rows(batches):
        for _, queries, q, ids, v in _met(row):
            if turned is None:
                turned = rotations(v.shape[1], count, seed)
            codes, asked = np.frombuffer(row["codes"], np.uint64).reshape(len(ids), -1), sign_codes(q, turned)
            differ = np.zeros((len(q), len(ids)), np.uint16)
            for own, other in zip(asked.T, np.ascontiguousarray(codes.T), strict=True):
                differ += np.bitwise_count(own[:, None] ^ other[None, :])
            take = scored_of(len(ids), k, share)
            at = np.argpartition(differ, take - 1, axis=1)[:, :take]
            dots = np.matmul(v[at], q[:, :, None])[:, :, 0]
            row_no, found, distance = _first_of(_distances(dots, q, np.linalg.norm(v, axis=1)[at]), ids[at], k)
            yield _near(queries[row_no], found, distance)


def _first_of(away: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `_first`, where each row has ids of its own."""
    order = np.lexsort((ids, away), axis=1)[:, :k]
    distance = np.take_along_axis(away, order, axis=1)
    row, at = np.nonzero(np.isfinite(distance))
    return row, np.take_along_axis(ids, order, axis=1)[row, at], distance[row, at]


def approximate_top_k(queries: DataFrame, index: DataFrame, k: int, share: float = SHARE, count: int = ROTATIONS, seed: int = SEED) -> DataFrame:
    """As `vector_top_k`, over a `vector_index`; only the `share` of each block whose sign codes are nearest is scored.

    A code has `count` bits for each dimension and is compared by bit counts. No clusters are needed:
    the number of bits that differ estimates the angle itself, the better the more rotations there
    are. `count` and `seed` are those of the index; share 1 gives the exact result.
    """
    if k <= 0:
        return vector_top_k(queries, queries.select(F.col("query_id").alias("chunk_id"), F.col("qvec").alias("embedding")), 0)
    likely = partial(_likely, k=k, share=share, count=count, seed=seed)
    return _ranked(_against(index, queries).mapInArrow(likely, _NEAR), k)
