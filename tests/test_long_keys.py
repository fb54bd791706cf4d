"""Operators on keys with very many rows: cut into pieces, they give what one stream gives, in many tasks."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import metrics, usage
from corpusmill.operators.ordered import placed


@pytest.fixture
def many_tasks(spark):
    """Shuffles of 40 partitions that are not merged afterwards."""
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def one_stream(hits, span, limit):
    """(event_id, count, allowed, retry_after) of sorted (key, seconds, event_id)."""
    out, now = {}, {}
    for key, s, event in sorted(hits, key=lambda h: (str(h[0]), h[1] is not None, h[1] or 0, h[2])):
        if s is None:
            out[event] = (1, True, None)
            continue
        opened, count = now.get(key, (None, 0))
        if opened is None or s >= opened + span:
            opened, count = s, 0
        now[key] = opened, count + 1
        fine = count == 0 or count + 1 <= limit
        out[event] = (count + 1, fine, None if fine else max(1, opened + span - s))
    return out


@pytest.mark.parametrize(("segment", "together", "span"), [(64, 3, 10), (100, 2, 400), (7, 4, 3), (1 << 16, 32, 50)])
def test_windows_of_a_user_with_a_third_of_all_events(many_tasks, monkeypatch, segment, together, span):
    spark = many_tasks
    monkeypatch.setattr(usage, "SEGMENT", segment)
    monkeypatch.setattr(usage, "TOGETHER", together)
    rng = random.Random(span)
    hits = [("hot", int(t), k) for k, t in enumerate(np.cumsum([rng.choice([0, 0, 0, 1, 1, 2, 30]) for _ in range(2000)]))]
    hits += [(f"k{rng.randint(0, 300)}", rng.choice([None, rng.randint(0, 3000)]), 2000 + k) for k in range(3990)] + [(None, t, 6000 + t) for t in range(9)]
    rng.shuffle(hits)
    frame = spark.createDataFrame(hits, "key string, s long, event_id long").select("key", F.timestamp_seconds("s").alias("ts"), "event_id")
    out = usage.fixed_windows(frame, "key", span, 4)
    rows = out.select("*", F.spark_partition_id().alias("task")).collect()
    assert {r.event_id: (r["count"], r.allowed, r.retry_after) for r in rows} == one_stream(hits, span, 4) and len(rows) == len(hits)
    if segment <= 100:
        assert len({r.task for r in rows if r.key == "hot"}) > 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=40), st.integers(1, 25), st.lists(st.integers(1, 39), max_size=5))
def test_steps_of_segments(times, span, cuts):
    """After all segments the open window is the one of a plain walk, whichever is open before them."""
    times = np.sort(np.array(times, np.int64)) + 100
    bounds = sorted({0, *(c for c in cuts if c < len(times)), len(times)})
    parts = [usage.steps_of(times[a:b], np.arange(a, b), span) for a, b in zip(bounds[:-1], bounds[1:])]
    whole = usage.composed(parts, span)
    for opened in [None, *range(int(times[0]) - span, int(times[0]) + 1)]:
        if opened is not None and opened > times[0] - 1:
            continue
        now = (opened, -7)
        for k, t in enumerate(times.tolist()):
            if now[0] is None or t >= now[0] + span:
                now = t, k
        place = lambda x: x if x[0] != opened else (opened, -7)  # noqa: E731, B023
        assert usage.after(opened, -7, whole, span) == place(now)
        at = (opened, -7)
        for part in parts:
            at = usage.after(*at, part, span)
        assert at == place(now)


@pytest.mark.parametrize("windows", [1, 2, 8])
def test_rate_of_series_that_are_cut(many_tasks, windows):
    spark = many_tasks
    rng = random.Random(windows)
    rows = [(rng.choice(["a", "a", "b", None]), rng.randint(-500, 6000), k, rng.choice([None, float(rng.randint(0, 50))])) for k in range(1500)] + [("gap", 0, 9000, 3.0), ("gap", 100_000, 9001, 5.0), ("c", None, 9002, 1.0)]
    series = spark.createDataFrame(rows, "name string, s long, event_id long, counter double").select("name", F.timestamp_seconds("s").alias("ts"), "event_id", "counter")
    order = Window.partitionBy("name").orderBy("ts", "event_id")
    before = F.lag("counter").over(order)
    up = F.when(before.isNull(), 0.0).when(F.col("counter") < before, F.col("counter")).otherwise(F.col("counter") - before)
    reach = Window.partitionBy("name").orderBy("us").rangeBetween(-60_000_000, 0)
    whole = series.withColumns({"up": up, "us": F.unix_micros("ts")}).select("event_id", F.round(F.sum("up").over(reach) / 60, 6).alias("rate"))
    out = metrics.rate(series, "counter", 60, windows)
    assert {r.event_id: r.rate for r in out.collect()} == {r.event_id: r.rate for r in whole.collect()}
    assert out.count() == len(rows)
    tasks = out.where("name = 'a'").select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks > 8 and metrics.rate(series.where("false"), "counter").count() == 0


def test_rate_by_the_clock_of_times_without_zone(spark):
    rows = [(f"2024-03-10 {h:02}:{m:02}:00", h * 60 + m, float(h * 60 + m)) for h in range(5) for m in (0, 20, 40)] + [("1969-12-31 23:59:59.5", 9000, 1.0), ("1970-01-01 00:00:00.25", 9001, 4.0)]
    series = spark.createDataFrame(rows, "t string, event_id long, counter double").selectExpr("'a' AS name", "CAST(t AS TIMESTAMP_NTZ) AS ts", "event_id", "counter")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        found = []
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            found.append({r.event_id: r.rate for r in metrics.rate(series, "counter", 3600).collect()})
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found[0] == found[1] and found[0][9001] == round(3 / 3600, 6)
    # Each hour has the increases of its three samples and of the one an hour before; at midnight the counter began anew.
    assert [found[0][m] for m in (120, 140, 160, 180)] == [round(80 / 3600, 6)] * 4


def test_rate_of_samples_that_share_a_time_and_an_id(many_tasks):
    rows = [("a", 60 * (k // 6), k // 6, float(k)) for k in range(600)]
    series = many_tasks.createDataFrame(random.Random(3).sample(rows, len(rows)), "name string, s long, event_id long, counter double")
    out = metrics.rate(series.select("name", F.timestamp_seconds("s").alias("ts"), "event_id", "counter").repartition(13), "counter", 60).collect()
    assert {(r.event_id, r.rate) for r in out} == {(k, round((5 if k == 0 else 11 if k == 1 else 12) / 60, 6)) for k in range(100)}


def test_places_across_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3]), rng.randint(0, 50), k) for k in range(500)]
    out = placed(spark.createDataFrame(rows, "g int, v int, k int").repartition(7), "g", ["v", "k"], "place").collect()
    expected, count = {}, {}
    for g, _, k in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        expected[k] = count[g] = count.get(g, -1) + 1
    assert {r.k: r.place for r in out} == expected and len(out) == 500
    assert placed(spark.createDataFrame([], "g int, v int"), "g", ["v"], "place").count() == 0
