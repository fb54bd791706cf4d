"""Exact search for the highest integer inner products, by a table of distances to pivots.

One more coordinate gives all candidates the same length, so that the highest inner product is the
least distance. A candidate's and a query's distances to a pivot differ by at most the distance of
the two; the largest difference over all pivots is a lower bound. Candidates are evaluated in the
order of their bounds until the bound of the next is above the k-th distance found.

Candidates and queries are held in blocks; each block of queries meets each block of candidates. A
task keeps the best of the blocks of queries that it has met, so that what one block of candidates
gives is the threshold for the next, and gives them once.

Scaled components are whole numbers in double precision, which holds them exactly at any size.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pivots; candidates from which pivots and first thresholds are taken; vectors in a block; evaluated at a time.
PIVOTS, SAMPLE, CANDIDATES, QUERIES, STEP = 32, 2048, 2048, 512, 512
#: Blocks of queries whose best a task keeps; the range of scores.
KEPT, LOW, HIGH = 64, -(1 << 63), (1 << 63) - 1
_BLOCK = "block long, ids binary, vectors binary, table binary, floor binary"


def scaled(vectors: DataFrame, factor: float = 64.0) -> DataFrame:
    """(vec_id, v): floor(factor * x) of each component; rows with null or non-finite components drop out."""
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # `floor` gives a long, which is too small for some; numbers from 2**52 on have no fraction.
    whole = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)
    most = F.lit(sys.float_info.max)
    held = lambda x: F.greatest(-most, F.least(most, x.cast("double") * factor))
    return vectors.where(sound).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: whole(held(x))).alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers in the kind of number in which their inner products are exact: floating point, long, or as large as need be."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return a, b
    if most < 1 << 63:
        return a.astype(np.int64), b.astype(np.int64)
    return tuple(np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape) for m in (a, b))


def _as_scores(products: np.ndarray) -> np.ndarray:
    """Products as longs; what is beyond a long is the nearest one."""
    if products.dtype == object:
        return np.array([min(max(int(x), LOW), HIGH) for x in products.reshape(-1)], np.int64).reshape(products.shape)
    return products.astype(np.int64)


def pivots_of(sample: np.ndarray, square: float) -> np.ndarray:
    """Rows of the sample far from one another, each the farthest from those before."""
    extra = np.sqrt(np.maximum(square - (sample**2).sum(axis=1), 0))
    points = np.column_stack([sample, extra])
    chosen, near = [], np.full(len(points), np.inf)
    for _ in range(min(PIVOTS, len(points))):
        k = int(np.argmax(near)) if chosen else 0
        chosen.append(k)
        near = np.minimum(near, ((points - points[k]) ** 2).sum(axis=1))
    return points[chosen]


def _pack(rows: pd.DataFrame, width: int, square: float, unit: float, pivots: np.ndarray, sample: tuple[np.ndarray, np.ndarray] | None, k: int) -> pd.DataFrame:
    """One row for a block: ids, vectors, distances to pivots in `unit`s, and for queries the least score worth keeping."""
    rows = rows.sort_values("vec_id", kind="stable")
    ids, vectors = rows["vec_id"].to_numpy(np.int64), _matrix(rows["v"], width)
    extra = np.zeros(len(ids)) if sample else np.sqrt(np.maximum(square - (vectors**2).sum(axis=1), 0))
    points = np.column_stack([vectors, extra])
    apart = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * points @ pivots.T
    floor = np.full(len(ids), LOW)
    if sample and len(sample[0]) >= k:
        a, b = exact(vectors, sample[1])
        if a.dtype != object:  # numbers beyond a long are too slow for all pairs with the sample; the search finds thresholds of its own
            scores = _as_scores(a @ b.T)
            scores[ids[:, None] == sample[0][None, :]] = LOW
            floor = np.partition(scores, -k, axis=1)[:, -k]
    data = (ids, vectors, (np.sqrt(np.maximum(apart, 0)) / unit).astype(np.float32), floor)
    return pd.DataFrame([[rows["block"].iloc[0], *(x.tobytes() for x in data)]], columns=["block", "ids", "vectors", "table", "floor"])


def merged(found: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest, equal ones by the smaller id."""
    keep = np.lexsort((found, ~scores))[:k]
    return found[keep], scores[keep]


def best(query: np.ndarray, floor: int, ids: np.ndarray, vectors: np.ndarray, most: np.ndarray, k: int, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best for one query, of those known and these; `most` has the highest possible score of each."""
    order = np.argsort(-most)
    ceiling = most[order]
    found, scores = known
    if len(scores) == k:
        floor = max(floor, int(scores[-1]))
    for at in range(0, len(order), STEP):
        if ceiling[at] < floor:
            break
        step = order[at : at + STEP]
        got = _as_scores(vectors[step] @ query)
        good = np.flatnonzero(got >= floor)
        if len(good):
            found, scores = merged(np.append(found, ids[step[good]]), np.append(scores, got[good]), k)
            if len(scores) == k:
                floor = max(floor, int(scores[-1]))
    return found, scores


def _search(batches: Iterator[pa.RecordBatch], width: int, square: float, unit: float, k: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = {}

    def given() -> pa.RecordBatch:
        parts = [(np.full(len(found), own), found, scores) for queries, lists in held.values() for own, (found, scores) in zip(queries.tolist(), lists, strict=True)]
        held.clear()
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    none = np.zeros(0, np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            of = lambda name, kind=np.int64: np.frombuffer(row[name], kind)  # noqa: E731, B023
            ids, queries = of("ids"), of("q_ids")
            plain, asked_plain = of("vectors", np.float64).reshape(-1, width), of("q_vectors", np.float64).reshape(-1, width)
            vectors, asked = exact(plain, asked_plain)
            table, q_table = of("table", np.float32).reshape(len(ids), -1), of("q_table", np.float32).reshape(len(queries), -1)
            bound = np.zeros((len(queries), len(ids)), np.float32)
            apart = np.empty_like(bound)
            for own, other in zip(q_table.T, np.ascontiguousarray(table.T), strict=True):
                np.subtract(own[:, None], other[None, :], out=apart)
                np.maximum(bound, np.abs(apart, out=apart), out=bound)
            if row["q_block"] not in held and len(held) >= KEPT:
                yield given()
            lists = held.setdefault(row["q_block"], (queries, [(none, none)] * len(queries)))[1]
            reach = (asked_plain**2).sum(axis=1) + square
            for at, (own, far, floor) in enumerate(zip(queries.tolist(), reach.tolist(), of("q_floor").tolist(), strict=True)):
                # Half a unit, which rounding can't reach, as scores are whole numbers; and what single precision may take away.
                less = bound[at].astype(np.float64) * unit
                most = (far - np.maximum(less - 1e-6 * far**0.5 - 1e-3, 0) ** 2) / 2 + 0.5 + 1e-9 * far
                open_ = np.flatnonzero((most >= floor) & (ids != own))
                lists[at] = best(asked[at], floor, ids[open_], vectors[open_], most[open_], k, lists[at])
    yield given()


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query the k candidates of highest inner product.

    Both tables have vec_id and v, an array of whole numbers of any size; shorter vectors count as
    filled up with zeros. A candidate with the query's own vec_id is left out. Equal scores go by the
    smaller vec_id; a score beyond a long is the nearest long. Of queries that share a vec_id the one
    with the least vector counts; candidates are taken as they come. With no queries or no candidates
    there are no rows.
    """
    spark = candidates.sparkSession
    length = F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    queries, candidates = (rows.select("vec_id", F.col("v").cast("array<double>").alias("v")) for rows in (queries, candidates))
    n, width, square = candidates.agg(F.count("*"), F.max(F.size("v")), length).first()
    asked, q_width, q_square = (queries := queries.groupBy("vec_id").agg(F.min("v").alias("v"))).agg(F.count("*"), F.max(F.size("v")), length).first()
    if not n or not asked or k <= 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, q_width)
    # A little more than the longest, so that rounding leaves no length above it; distances are kept as shares of the longest of all.
    square *= 1 + 1e-12
    unit = max(square, q_square, 1.0) ** 0.5
    # A bounded sample, the same however the rows are dealt out.
    sample = candidates.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "v").limit(SAMPLE).toPandas()
    held = (sample["vec_id"].to_numpy(np.int64), _matrix(sample["v"], width))
    pivots = pivots_of(held[1], square)

    def blocks(rows: DataFrame, size: int, count: int, known: tuple | None) -> DataFrame:
        dealt = rows.withColumn("block", F.expr(f"pmod(xxhash64(vec_id, 7), {-(-count // size)}L)"))
        return dealt.groupBy("block").applyInPandas(lambda rows: _pack(rows, width, square, unit, pivots, known, k), _BLOCK)

    q = blocks(queries, QUERIES, asked, held).select(F.col("block").alias("q_block"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "table", "floor")))
    q = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-n // CANDIDATES) - 1).cast("long"))))
    pairs = blocks(candidates, CANDIDATES, n, None).join(q, "block")
    search = partial(_search, width=width, square=square, unit=unit, k=k)
    found = pairs.select("ids", "vectors", "table", "q_block", "q_ids", "q_vectors", "q_table", "q_floor").mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
