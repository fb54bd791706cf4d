"""Exact and approximate vector search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import vector_search as vs
from corpusmill.plans.views import table, view

SF = "/root/testdata/sf0.1"


def frames(spark, q, v):
    queries = spark.createDataFrame([(i, x) for i, x in q], "query_id long, qvec array<float>")
    return queries, spark.createDataFrame([(i, x) for i, x in v], "chunk_id long, embedding array<float>")


def found(df):
    return sorted((r.query_id, r.vector_rank, r.chunk_id) for r in df.collect())


def brute(q, v, k):
    out = []
    for i, a in q:
        if a is None or not any(a):
            continue
        away = [(round(1 - sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 9), j) for j, b in v if b is not None and any(b)]
        out += [(i, n, j) for n, (_, j) in enumerate(sorted(away)[:k], 1)]
    return sorted(out)


def odd(rng, n):
    """Vectors with ties, repeats, zeros and nulls among them."""
    return [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(n)] + [(n, None), (n + 1, [0.0] * 4), (n + 2, [1.0, 0.0, 0.0, 0.0]), (n + 3, [2.0, 0.0, 0.0, 0.0])]


@pytest.mark.parametrize("k", [0, 1, 7, 1000])
def test_exact_search(spark, monkeypatch, k):
    rng = np.random.default_rng(k)
    q, v = odd(rng, 9), odd(rng, 80)
    queries, vectors = frames(spark, q, v)
    assert found(vs.vector_top_k(queries, vectors, k)) == brute(q, v, k)
    # With every vector scored the search by codes is the exact one.
    assert found(vs.approximate_top_k(queries, vs.vector_index(vectors), k, share=1.0)) == brute(q, v, k)


def test_empty_tables(spark):
    queries, vectors = frames(spark, [], [(1, [1.0, 2.0])])
    assert vs.vector_top_k(queries, vectors, 3).count() == 0 and vs.approximate_top_k(queries, vs.vector_index(vectors), 3).count() == 0
    queries, vectors = frames(spark, [(1, [1.0, 2.0])], [])
    assert vs.vector_top_k(queries, vectors, 3).count() == 0 and vs.approximate_top_k(queries, vs.vector_index(vectors), 3).count() == 0


def test_recall_of_the_search_by_codes(spark):
    """At least nine of each query's exact ten, though less than a fifth of all pairs is scored."""
    q, c = view(spark, SF, "v_qvec"), table(spark, SF, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    index = vs.vector_index(c)
    near = vs.approximate_top_k(q, index, 10)
    met = vs.vector_top_k(q, c, 10).join(near.select("query_id", "chunk_id", "distance", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    rows = met.groupBy("query_id").agg(F.count("hit").alias("hits"), F.count("*").alias("nearest")).collect()
    assert len(rows) == q.count() and all(10 * r.hits >= 9 * r.nearest for r in rows)
    sizes = [len(bytes(r.ids)) // 8 for r in index.select("ids").collect()]
    assert sum(sizes) == c.count() and sum(vs.scored_of(n, 10, vs.SHARE) for n in sizes) < 0.2 * sum(sizes)


def test_codes_estimate_angles():
    rng = np.random.default_rng(1)
    v, turned = rng.normal(size=(300, 64)), vs.rotations(64)
    codes = vs.sign_codes(v, turned)
    assert codes.shape == (300, 8) and np.array_equal(vs.sign_codes(3 * v, turned), codes)
    differ = np.bitwise_count(codes[:1] ^ codes).sum(axis=1)
    angle = np.arccos(np.clip(v @ v[0] / np.linalg.norm(v, axis=1) / np.linalg.norm(v[0]), -1, 1))
    assert np.abs(differ / 512 * np.pi - angle).max() < 0.35 and np.corrcoef(differ, angle)[0, 1] > 0.8
    assert vs.sign_codes(rng.normal(size=(5, 3)), vs.rotations(3, 1)).shape == (5, 1)
