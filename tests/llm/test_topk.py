"""Exact top-k on numbers of any size, repeated ids and many blocks, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import topk

HIGH = (1 << 63) - 1


def brute(rows, asked, k):
    """Per query (rank, vec_id, score), with scores beyond a long as the nearest long."""
    whole = [(i, [int(np.floor(64.0 * float(x))) if abs(64.0 * float(x)) < 2**52 else int(64.0 * float(x)) for x in v]) for i, v in rows]
    queries = {}
    for i, v in whole:
        if asked(i):
            queries[i] = min(v, queries.get(i, v))
    out = set()
    for q, v in queries.items():
        scores = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -HIGH - 1), HIGH), i) for i, w in whole if i != q)[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)}
    return out


@pytest.mark.parametrize("large", [0.0, 1e9, 3e18, 1e30])
def test_numbers_of_any_size(spark, monkeypatch, large):
    """Components whose squares no long holds, and ones between zero and the first whole number."""
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "SAMPLE", 30)
    rng = np.random.default_rng(int(large % 97))
    vectors = rng.normal(size=(90, 4)).astype(np.float32)
    vectors[3] = [-1e-20, 1e-20, 0, -0.0]
    if large:
        vectors[[7, 20, 41]] *= np.float32(large)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    table = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    out = topk.top_k(table.where("vec_id % 5 = 0"), table, 6).collect()
    expected = brute(rows, lambda i: i % 5 == 0, 6)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in out} == expected and len(out) == len(expected)


def test_queries_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.25]), (1, [0.5, 0.5]), (2, [-1.0, 1.0]), (2, [1.0, 1.0]), (3, [])]
    table = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q_block", F.lit(1)))
    out = topk.top_k(table.where("vec_id = 0"), table, 3).orderBy("rank").collect()
    # The query is (0.5, 0.25), the lesser of the two; candidate 2 has two vectors, both of which count.
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out] == [(0, 1, 2, 32 * 64 + 16 * 64), (0, 2, 1, 32 * 32 + 16 * 32), (0, 3, 3, 0)]


def test_a_task_keeps_what_it_found(spark, monkeypatch):
    """Through all blocks of candidates a task gives each query k rows, or a few times that where it met many blocks of queries."""
    monkeypatch.setattr(topk, "CANDIDATES", 8)
    monkeypatch.setattr(topk, "SAMPLE", 4)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 3)]) for i in range(160)]
    table = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    for kept in (64, 1):
        monkeypatch.setattr(topk, "KEPT", kept)
        out = topk.top_k(table.where("vec_id % 20 = 0"), table, 5)
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in out.collect()} == brute(rows, lambda i: i % 20 == 0, 5)
