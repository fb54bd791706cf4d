"""Retrieval as a function of SQL, and embedding in one pass."""

import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import blocks, embedding, fusion, text_search
from corpusmill.plans import q_retrieval

TEXTS = ["red fox", "the red, red fox runs", "blue whale", "red whale and a blue fox", "", None, "fox red", "a big blue whale sings of red foxes", "rot"]
ASKED = ["red fox", '"red fox"', "fox or whale", "whale -blue", 'blue -"big blue"', '"blue whale" or rot', " ", None, "unknown", "red OR  fox", 'fox "red red"']


def library(spark, rng):
    chunks = [(i, None if i == 3 else i, t, None if i % 5 == 4 else [float(x) for x in rng.integers(-2, 3, 3)]) for i, t in enumerate(TEXTS)]
    queries = [(i, t, None if i == 2 else [float(x) for x in rng.integers(-2, 3, 3)]) for i, t in enumerate(ASKED)]
    return spark.createDataFrame(chunks, "chunk_id long, document_id long, text string, embedding array<float>"), spark.createDataFrame(queries, "query_id long, query string, qvec array<float>")


@pytest.mark.parametrize("p", [fusion.Params(), fusion.Params(2, 3, 4, 1, 0.9, 0.2), fusion.Params(0, 2, 5, -3), fusion.Params(3, 0, 2), fusion.Params(2, 2, 0)])
def test_table_function_equals_the_operator(spark, p):
    chunks, queries = library(spark, np.random.default_rng(3))
    posted = text_search.postings(chunks)
    fusion.register_hybrid_retrieve(spark, "found_by", chunks, posted)
    queries.createOrReplaceTempView("asked")
    call = f"found_by(q.query, q.qvec, {p.text_k}, {p.vector_k}, fused_k => {p.fused_k}, rrf_k => {p.rrf_k}, text_w => {p.text_weight}D, vec_w => {p.vector_weight}D)"
    key = lambda df: sorted((r.query_id, r.fused_rank, r.chunk_id, r.text_rank, r.vector_rank, r.rrf_score) for r in df.collect())
    out = key(spark.sql(f"SELECT q.query_id, f.* FROM asked q, LATERAL {call} f"))
    assert out == key(fusion.hybrid_retrieve(chunks, queries, p, posted)) == key(fusion.hybrid_retrieve(chunks, queries, p))
    # Chunk 3 has no document.
    assert (out or p.fused_k == 0) and all(r[2] != 3 for r in out)


def test_table_function_over_many_blocks_equals_the_operator(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(list("aabbcdex"), rng.integers(0, 60))) for _ in range(120)]
    chunks = [(int(i), None if i % 9 == 4 else 1, texts[i]) for i in rng.permutation(120)]
    chunks = spark.createDataFrame(chunks, "chunk_id long, document_id long, text string").repartition(5)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(0, 140, 3)], "chunk_id long, embedding array<float>")
    asked = ["a", "a b", "a b c d e", '"a b" x', "a b or c -x", "y or x a", '"x x" "a b"', '"a b c"', "none", "-a", 'b -"c d" "a a"']
    queries = spark.createDataFrame([(i, t, [1.0, float(i % 3), -1.0]) for i, t in enumerate(asked)], "query_id long, query string, qvec array<float>")
    queries.createOrReplaceTempView("asked")
    fusion.register_hybrid_retrieve(spark, "found_by", chunks, vectors=vectors)
    whole = chunks.join(vectors, "chunk_id", "left")
    for k in (3, 50):
        p = fusion.Params(k, k, 2 * k)
        found = spark.sql(f"SELECT q.query_id, f.* FROM asked q, LATERAL found_by(q.query, q.qvec, {k}, {k}, {2 * k}) f").select("query_id", "chunk_id", "text_rank", "vector_rank", "rrf_score", "fused_rank")
        assert sorted(found.collect()) == sorted(fusion.hybrid_retrieve(whole, queries, p).select(*found.columns).collect())


def test_table_function_takes_texts_apart_once(spark, tmp_path):
    spark.createDataFrame([(1, "red fox", "en", "s", 7), (20, "a fox", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [1.0, 0.0], 1), (20, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "red old fox")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = q_retrieval.r09_table_function(spark, str(tmp_path))
    assert sorted((r.chunk_id, r.text_rank, r.vector_rank) for r in found.collect()) == [(1, 1, 2), (20, None, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower(text") == 1


def test_blocks_are_bounded_whatever_the_session_sets(spark):
    key, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.unset(key)
        fusion.register_hybrid_retrieve(spark, "found_by", library(spark, np.random.default_rng(3))[0])
        assert int(spark.conf.get(key)) == 4 << 20
        spark.conf.set(key, "1024")
        blocks.small_batches(spark)
        assert spark.conf.get(key).removesuffix("b") == "1024"
    finally:
        spark.conf.set(key, before)


def test_one_score_is_cut_by_ids_and_near_scores_are_kept():
    ids, score = np.array([5, 3, 9, 1, 7, 2]), np.array([1.0, 1.0, 2.0, 1.0 - 4e-7, 0.5, 1.0])
    assert [x.tolist() for x in blocks._best(ids, score, 2)] == [[9, 2, 3, 1], [2.0, 1.0, 1.0, 1.0 - 4e-7]]
    assert [len(x) for x in blocks._best(ids, score, 0)] == [0, 0] and len(blocks._best(ids, score, 9)[0]) == 6


def test_table_function_of_one_query(spark):
    chunks, _ = library(spark, np.random.default_rng(3))
    fusion.register_hybrid_retrieve(spark, "found_by", chunks, text_search.postings(chunks))
    assert [r.chunk_id for r in spark.sql("SELECT chunk_id FROM found_by('red fox', NULL) ORDER BY fused_rank").collect()] == [0, 1, 6]
    assert [r.chunk_id for r in spark.sql("SELECT chunk_id FROM found_by('red fox', CAST(NULL AS ARRAY<FLOAT>), text_k => 1)").collect()] == [0]


def test_path_comes_from_metadata(spark):
    chunks = spark.createDataFrame([(1, 7, "a", '{"path": "Intro/part 1", "x": 1}'), (2, 7, "b", "no json"), (3, 7, "c", None)], "chunk_id long, document_id long, text string, metadata string")
    documents = spark.createDataFrame([(7, "T", "J", "u")], "document_id long, title string, journal_ref string, doi_url string")
    out = fusion.with_documents(spark.createDataFrame([(1,), (2,), (3,)], "chunk_id long"), chunks, documents)
    assert {r.chunk_id: r.path for r in out.collect()} == {1: "Intro/part 1", 2: None, 3: None}


def test_each_batch_is_encoded_once_by_an_encoder_that_fails_at_random(spark, tmp_path):
    """Both frames come from one pass: no batch is seen twice, and every row is in one of them."""
    folder = str(tmp_path)

    def encode(texts):
        with open(os.path.join(folder, f"{random.SystemRandom().getrandbits(60)}"), "w") as f:
            f.write("\n".join(texts))
        if random.SystemRandom().random() < 0.5:
            raise RuntimeError("by chance")
        return np.ones((len(texts), 4))

    data = spark.createDataFrame([(i, f"text{i}") for i in range(60)], "id long, text string").repartition(3)
    good, rejects = embedding.embedded(data, encode, 4, batch=3)
    for _ in range(2):
        a, b = [r.id for r in good.collect()], [r.id for r in rejects.collect()]
        assert sorted(a + b) == list(range(60))
    assert good.count() + rejects.count() == 60
    seen = [line for name in os.listdir(folder) for line in open(os.path.join(folder, name)).read().split("\n")]
    assert sorted(seen) == sorted(f"text{i}" for i in range(60))


def test_small_batches_of_an_encoder_come_back_as_one():
    """An encoder of one text at a time doesn't make a batch of Spark's out of each row."""
    held = np.zeros((1, 2))

    def encode(texts):
        if texts == ["bad"]:
            raise RuntimeError("no")
        held[:] = [[len(texts[0]), float("nan") if texts == ["nan"] else 0]]
        return held

    frame = pa.RecordBatch.from_pydict({"id": [1, None, 3, 2**53 + 1], "text": ["a", "bad", "nan", "four"]})
    out = list(embedding._encoded(iter([frame, frame.slice(0, 0)]), encode, 2, 1))
    assert [x.num_rows for x in out] == [4, 0]
    assert out[0].to_pydict() == {"id": [1, None, 3, 2**53 + 1], "embedding": [[1.0, 0.0], None, [3.0, None], [4.0, 0.0]], "error": [None, "RuntimeError: no", None, None]}


def test_long_ids_beside_a_null_stay_whole(spark):
    data = spark.createDataFrame([(None, "x"), (2**53 + 1, "x"), (2**53 + 3, "bad")], "id long, text string").coalesce(1)
    good, rejects = embedding.embedded(data, lambda texts: np.ones((len(texts), 3 if texts == ["bad"] else 4)), 4, batch=1)
    assert {(r.id, tuple(r.embedding)) for r in good.collect()} == {(None, (0.5,) * 4), (2**53 + 1, (0.5,) * 4)}
    assert [tuple(r) for r in rejects.collect()] == [(2**53 + 3, "ValueError: expected (1, 4), found (1, 3)")]


def test_default_encoder_counts_the_words_that_re_finds():
    every = "".join(chr(i) + ("\n" if i % 3 else "") for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    texts = ["", " ", "Red red FOX_1", "ΣΟΦΟΣ\x1cΣ İI\u2028ß", "w" * 5000, every]
    for text, found in zip(texts, embedding.hashed_features(8)(texts), strict=True):
        want = np.zeros(8)
        for word in re.findall(r"\w+", text.lower()):
            h = zlib.crc32(word.encode())
            want[h % 8] += 1 if h >> 31 else -1
        assert np.array_equal(found, want)


def test_pooling_of_what_cannot_be_pooled(spark):
    pool = lambda *vectors: embedding.mean_pooled(spark.createDataFrame([("g", v) for v in vectors], "g string, v array<double>"), ["g"], "v").collect()
    assert pool([1.0, 2.0], [3.0, 6.0])[0].mean == [2.0, 4.0]
    for wrong in ([[]], [None], [[1.0, None]], [[float("nan")]], [[1.0], [1.0, 2.0]]):
        with pytest.raises(Exception, match="pooled"):
            pool(*wrong)


def test_similarities_within_groups(spark, monkeypatch):
    monkeypatch.setattr(embedding, "SIDE", 4)
    rng = np.random.default_rng(0)
    rows = [(rng.choice(["a", "b", "c"]) if i else None, i, [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(40)] + [("a", 40, [0.0] * 5), ("b", 41, None)]
    data = spark.createDataFrame([(None if g is None else str(g), i, v) for g, i, v in rows], "label string, id long, v array<float>")
    out = {(r.a, r.b): (r.label, r.similarity) for r in embedding.group_similarity(data, "label", "id", "v").collect()}
    expected = {}
    for g, i, v in rows:
        for h, j, w in rows:
            if g == h and v is not None and w is not None:
                a, b = np.array(v), np.array(w)
                size = np.linalg.norm(a) * np.linalg.norm(b)
                expected[i, j] = (g, 1.0 if i == j else None if not size else round(float(a @ b / size), 6))
    assert {k: (x[0], x[1] if x[1] is None else round(x[1], 5)) for k, x in out.items()} == {k: (x[0], x[1] if x[1] is None else round(x[1], 5)) for k, x in expected.items()}
    assert all(out[a, b] == out[b, a] for a, b in out)
    with pytest.raises(ValueError, match="more than 3"):
        embedding.group_similarity(data, "label", "id", "v", most=3)


@pytest.mark.parametrize("k", [0, 1, 3, 40])
def test_bounded_top_k_equals_all_ranks(spark, k):
    """The k best by bounds are those of all ranks; no rank is above its bound."""
    rng = random.Random(k)
    texts = [(i, " ".join(rng.choice("a b c d e x x x y".split()) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    asked = [(i, q) for i, q in enumerate(["a", "a b", "a b c d e", '"a b" x', "a b or c -x", "y x a", '"x x" "a b"', "none"])]
    posted = text_search.postings(spark.createDataFrame(texts, "chunk_id long, text string"))
    queries = spark.createDataFrame(asked, "query_id long, query string")
    every = text_search.ranked(queries, posted).collect()
    expected = []
    for q, _ in asked:
        rows = sorted((-r.rank, r.chunk_id) for r in every if r.query_id == q)[:k]
        expected += [(q, c, -r, n) for n, (r, c) in enumerate(rows, 1)]
    assert sorted((r.query_id, r.chunk_id, r.rank, r.text_rank) for r in text_search.text_top_k(queries, posted, k).collect()) == sorted(expected)
    if k == 3:
        bounds = {}
        for r in text_search._matches(queries, posted, None)[2].collect():
            bounds[r.query_id, r.chunk_id] = max(r.bound, bounds.get((r.query_id, r.chunk_id), 0))
        assert all(r.rank <= bounds[r.query_id, r.chunk_id] + 1e-6 for r in every) and any(r.rank == bounds[r.query_id, r.chunk_id] for r in every)
