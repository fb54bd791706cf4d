"""What must stay small, or keep its results, as tables and texts grow."""

import math
import re
import time
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from __spark_entry__ import oracle_sql, queries
from corpusmill.functions.tokenizers import Words
from corpusmill.operators import embedding, parts
from corpusmill.operators import text_search as ts
from corpusmill.operators import vector_search as vs
from corpusmill.plans.staging import staged


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_formulas_take_memory_in_proportion_to_texts():
    text = "a $b$ " * 100_000
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    list(parts._formulas(iter([batch.slice(0, 0)]), "text", ["text", "spans"]))
    tracemalloc.start()
    (found,) = parts._formulas(iter([batch]), "text", ["text", "spans"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found.column("spans")[0]) == 100_000
    assert peak < 50 * len(text)


def test_rows_that_share_an_id_have_formulas_of_their_own(spark, tmp_path):
    sf = written(spark, tmp_path, "documents", [(1, "a b c"), (1, "a"), (2, None), (3, "")], "doc_id long, text string")
    found = sorted(tuple(r) for r in queries()["k09_math_spans"](spark, sf).collect())
    assert found == [(1, 0, 2, 15), (1, 2, 2, 15), (3, 0, 2, 15)]


def test_span_tokens_of_a_long_text(spark, tmp_path):
    sf = written(spark, tmp_path, "documents", [(1, "ab c " * 200_000), (2, "one two three four"), (3, "")], "doc_id long, text string")
    begun = time.monotonic()
    found = {r.doc_id: r.tokens for r in queries()["k07_span_tokens"](spark, sf).collect()}
    assert found == {1: 100_000, 2: 2}
    assert time.monotonic() - begun < 60


def test_numbers_that_round_to_zero_keep_their_sign(spark, tmp_path):
    rows = [(1, [-1e-8, 1e-8, 0.0, 1.0], 7), (2, [0.0, -0.0, None, -2.0], 8)]
    sf = written(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>, label int")
    signed = lambda v: [x if x is None else math.copysign(abs(x) + 1, x) for x in v]
    found = {r.vec_id: signed(r.unit) for r in queries()["e03_unit_vectors"](spark, sf).collect()}
    assert found[1] == [-1.0, 1.0, 1.0, 2.0]
    sf = written(spark, tmp_path / "means", "embeddings", rows[:1], "vec_id long, embedding array<float>, label int")
    assert [signed(r["mean"]) for r in queries()["e04_mean_vectors"](spark, sf).collect()] == [[-1.0, 1.0, 1.0, 2.0]]


def test_group_similarity_holds_one_pair_of_blocks_at_a_time():
    rng = np.random.default_rng(1)
    block = [{"id": i, "v": v} for i, v in enumerate(rng.normal(size=(100, 16)).astype(np.float32).tolist())]
    side = pa.array([block] * 60, pa.list_(pa.struct([("id", pa.int64()), ("v", pa.list_(pa.float32()))])))
    numbers = pa.array(range(60), pa.int32())
    batch = pa.RecordBatch.from_arrays([numbers, numbers, pa.array([99] * 60, pa.int32()), side, side], ["by", "i", "j", "left", "right"])
    tracemalloc.start()
    assert sum(out.num_rows for out in embedding._products(iter([batch]))) == 60 * 2 * 100 * 100
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000


@pytest.mark.parametrize(("numbers", "strips"), [(1 << 22, 8), (40, 13)])
def test_rows_of_a_large_group_are_moved_a_bounded_number_of_times(spark, monkeypatch, numbers, strips):
    tables = []
    monkeypatch.setattr(embedding, "staged", lambda df, *by: tables.append(staged(df, *by)) or tables[-1])
    monkeypatch.setattr(embedding, "SIDE", 4)
    monkeypatch.setattr(embedding, "NUMBERS", numbers, raising=False)
    v = np.random.default_rng(5).normal(size=(260, 2))
    v[7] = 0
    label = lambda k: None if k < 3 else 1 if k < 5 else 2
    data = spark.createDataFrame([(k, label(k), x) for k, x in enumerate(v.tolist())], "id long, label int, v array<double>")
    out = {(r.label, r.a, r.b): r.similarity for r in embedding.group_similarity(data, "label", "id", "v").collect()}
    with np.errstate(invalid="ignore"):
        u = v / np.linalg.norm(v, axis=1)[:, None]
    near = lambda a, b: 1.0 if a == b else None if 7 in (a, b) else round(float(u[a] @ u[b]), 6)
    assert out == {(label(a), a, b): near(a, b) for a in range(260) for b in range(260) if label(a) == label(b)}
    assert tables[-1].where("by = 2").count() <= strips


def test_similarities_that_round_to_zero_keep_their_sign(spark):
    data = spark.createDataFrame([(1, 7, [1.0, 0.0]), (2, 7, [-1e-8, 1.0]), (3, 7, [1e-8, 1.0])], "id long, label int, v array<float>")
    out = {(r.a, r.b): math.copysign(1, r.similarity) for r in embedding.group_similarity(data, "label", "id", "v").collect()}
    assert out[1, 2] == out[2, 1] == -1 and out[1, 3] == 1


def test_a_search_holds_one_pair_of_blocks_at_a_time_and_remembers_what_is_near():
    rng = np.random.default_rng(3)
    q, blocks = rng.normal(size=(4, 8)), rng.normal(size=(500, 64, 8))
    ids = np.arange(500 * 64).reshape(500, 64)
    columns = {"ids": [x.tobytes() for x in ids], "data": [x.tobytes() for x in blocks], "q_ids": [np.arange(4).tobytes()] * 500, "q_data": [q.tobytes()] * 500}
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns.values()], list(columns))
    tracemalloc.start()
    given = [(r["query_id"], r["distance"], r["chunk_id"]) for out in vs._nearest(iter([batch]), 10) for r in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(given) < 500 * 4 * 10 / 10 and peak < 1_500_000
    away = vs._distances(q @ blocks.reshape(-1, 8).T, q, np.linalg.norm(blocks.reshape(-1, 8), axis=1))
    for k in range(4):
        assert [c for _, _, c in sorted(g for g in given if g[0] == k)[:10]] == np.lexsort((np.arange(500 * 64), away[k]))[:10].tolist()


def test_search_in_a_data_set_as_in_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vs, "BLOCK", 8)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)], i % 3 if i % 11 else 5) for i in range(300)] + [(400, [0.0] * 3, 1), (420, [0.0] * 3, 5), (421, None, 5), (440, [1.0] * 3, 6)]
    sf = written(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>, label int")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet/*.parquet'")
    plain = lambda rs: sorted((q, c, "none" if d is None else str(d + 0.0), r) for q, c, d, r in rs)
    found = queries()["r07_vector_top_k_in_dataset"](spark, sf)
    assert plain(map(tuple, found.collect())) == plain(db.execute(oracle_sql()["r07_vector_top_k_in_dataset"]).fetchall())


def test_words_are_found_as_by_their_pattern():
    every = "".join(map(chr, range(0x110000)))
    for text in ("", " ", "a", "a_1 b-c\n\x1cé\u0301 x", every, "".join(np.random.default_rng(4).permutation(list(every[:0x3000])))):
        first, last = Words().spans(text)
        assert list(zip(first.tolist(), last.tolist())) == [m.span() for m in re.finditer(r"\w+|[^\w\s]", text)]


def test_tokens_of_a_text_are_found_once():
    class Counted(Words):
        calls = 0

        def spans(self, text):
            Counted.calls += 1
            return super().spans(text)

    batch = pa.RecordBatch.from_arrays([pa.array(["One two. " * 300, "short", "", None])], ["text"])
    (out,) = parts._measure(iter([batch]), Counted(), 256, ["text", "tokens", "borders"])
    assert out.column("tokens").to_pylist() == [900, 1, 0, 0] and Counted.calls == 2


def test_places_are_ranked_in_many_tasks_however_few_their_bytes(spark):
    asked = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    posted = ts.postings(spark.createDataFrame([(n, "a b x " * n) for n in range(1, 40)], "chunk_id long, text string"))
    found = ts.ranked(asked, posted)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.chunk_id: r.rank for r in found.collect()} == {n: 2.0 * n - 1 for n in range(1, 40)}
