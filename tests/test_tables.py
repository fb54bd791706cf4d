"""Interval joins, exact percentiles and stored upserts against brute force."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import conversations, evaluation, intervals
from corpusmill.sources import tables


@pytest.mark.parametrize("seed", range(3))
def test_interval_join(spark, seed):
    """Points of probes in spans of all lengths; no pair comes twice; columns of any name pass."""
    rng = random.Random(seed)
    size = lambda: rng.choice([0, 1, 2, 3, 7, 8, 9, 60, 1000, 10**12])
    some = lambda n: [(rng.choice(["a", "a", "a", "b", None]), s := rng.randint(-50, 80), s + size(), i) for i in range(n)]
    probes, spans = some(60), some(70)
    p = spark.createDataFrame(probes, "k string, s long, e long, span_start int")
    q = spark.createDataFrame(spans, "k string, s long, e long, probe_which int")
    out = intervals.intersecting(p, q, ["k"], "s", "e")
    assert out.columns == ["k", "s", "e", "span_start", "probe_which"]
    expected = [(k, s, e, i, j) for k, s, e, i in probes for m, a, b, j in spans if k is not None and k == m and (a <= s < b or a <= e - 1 < b)]
    assert sorted(map(tuple, out.collect())) == sorted(expected)
    assert intervals.intersecting(p, q.where("false"), ["k"], "s", "e").count() == 0 and intervals.intersecting(p.where("false"), q, ["k"], "s", "e").count() == 0


def test_interval_join_cuts_a_hot_key(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(2000).select(F.lit("hot").alias("k"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 15).alias("e"), "id")
        out = intervals.intersecting(rows, rows.withColumnRenamed("id", "other"), ["k"], "s", "e")
        tasks = out.groupBy(F.spark_partition_id().alias("t")).count().collect()
        assert sum(r["count"] for r in tasks) == 3 * 2000 - 2 and len(tasks) == 4 and max(r["count"] for r in tasks) < 3000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(("gathered", "ranges"), [(10_000, 4096), (5, 4), (1, 2), (30, 7)])
def test_percentiles(spark, monkeypatch, gathered, ranges):
    monkeypatch.setattr(evaluation, "GATHERED", gathered)
    monkeypatch.setattr(evaluation, "RANGES", ranges)
    rng = random.Random(gathered)
    groups = {"a": [rng.gauss(0, 1) for _ in range(200)], "same": [7.0] * 60, "one": [3.5], None: [float(rng.randint(0, 3)) for _ in range(90)], "wide": [0.0, 1e-300, 1e300, -1e300, 5.0, 5.0, 6.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("a", float("inf")), ("none", None)]
    rng.shuffle(rows)
    shares = [0.0, 0.25, 0.5, 0.99, 1.0]
    out = {(r.g, r.share): r["at"] for r in evaluation.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], shares).collect()}
    expected = {(g, s): np.percentile(vs, 100 * s) for g, vs in groups.items() for s in shares}
    assert out.keys() == expected.keys() and all(np.isclose(out[k], expected[k], rtol=1e-12, atol=0) for k in out)
    whole = evaluation.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", [], [0.5]).collect()
    assert len(whole) == 1 and np.isclose(whole[0]["at"], np.percentile([v for vs in groups.values() for v in vs], 50))


def test_percentiles_of_many_values(spark):
    """Counts of ranges, never all values of a group, go through one task."""
    rows = spark.range(300_000).select((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 1024).alias("v"))
    ours = evaluation.latency(rows.withColumn("g", F.lit(1)), "v", ["g"]).first()
    theirs = rows.agg(*(F.round(F.percentile("v", F.lit(p)), 6).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")))).first()
    assert (ours.p50, ours.p95, ours.p99) == tuple(theirs)


def test_stored_upserts_leave_other_parts_alone(spark, tmp_path):
    keys = ["a", "b", "c", "d", "e", "f"]
    kind = "a string, b string, c string, d string, e long, f long, version long, newest int, created long"
    row = lambda e, f, version, x, created: ("s", "r", None, "fp32", e, f, version, x, created)
    path = str(tmp_path / "stored")
    first = [row(e, f, 1, 10 * e + f, 5) for e in range(8) for f in range(8)]
    out = tables.upsert_stored(path, spark.createDataFrame(first, kind), keys, "version", "created", parts=16)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(first, key=repr)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    more = [row(1, 1, 2, 99, 9), row(1, 1, 3, 100, 8), row(9, 9, 1, 1, 1), row(2, 2, 0, -1, 2)]
    out = tables.upsert_stored(path, spark.createDataFrame(more, kind), keys, "version", "created", parts=16)
    expected = {(r[4], r[5]): r for r in first} | {(1, 1): row(1, 1, 3, 100, 5), (9, 9): row(9, 9, 1, 1, 1), (2, 2): row(2, 2, 1, 22, 2)}
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected.values(), key=repr)
    same = [f for f, t in files().items() if before.get(f) == t]
    assert len({os.path.dirname(f) for f in same}) >= 12 and len(same) < len(before)


def test_names_that_operators_use_inside(spark):
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k int, nth int, newest string")
    assert [tuple(r) for r in tables.first_by(rows, ["k"], [F.desc("nth")]).collect()] == [(1, 2, "y")]
    assert [tuple(r) for r in tables.upsert(rows.where("nth = 1"), rows.where("nth = 2"), ["k"], "nth", "newest").collect()] == [(1, 2, "x")]
    data = spark.createDataFrame([("a", 0, 5), ("a", 5, 7)], "island string, s long, e long")
    assert [tuple(r) for r in intervals.merged(data, ["island"], "s", "e").collect()] == [("a", 0, 7, 2)]


def test_judgements_of_all_forms(spark):
    rows = [(1, '["a", "", "b", null, "a"]', None), (2, None, '{"relevance": {"x": 3, "y": 0}}'), (3, '{"p": 2}', '{"relevance": ["q"]}'), (4, None, '{"other": 1}'), (5, "null", None), (6, "[]", '{"relevance": ["q"]}')]
    kind = "query_id long, relevance string, metadata string"
    out = sorted(tuple(r) for r in evaluation.judgements(spark.createDataFrame(rows, kind)).collect())
    assert out == [(1, "a", 3), (1, "b", 2), (2, "x", 3), (2, "y", 0), (3, "p", 2)]
    for wrong in ('"text"', "7", "[1", '{"a"'):
        with pytest.raises(Exception, match="neither a list nor a map"):
            evaluation.judgements(spark.createDataFrame([(9, wrong, None)], kind)).collect()


def test_touched_threads(spark):
    threads = spark.createDataFrame([(1, 10, "t"), (2, 20, "u"), (3, None, "v")], "thread_id int, updated_at int, name string")
    new = spark.createDataFrame([(1, 12), (1, 11), (2, 5), (3, 7), (9, 9)], "thread_id int, created_at int")
    assert sorted(map(tuple, conversations.touched(threads, new).collect())) == [(1, 12, "t"), (2, 20, "u"), (3, 7, "v")]
