import pytest
from pyspark.sql import functions as F

from corpusmill.operators import conversations, metrics, usage
from corpusmill.streaming import live

SF = "/root/testdata/sf0.001"


def drained(spark, stream, path, mode):
    """All that a stream over existing files gives."""
    name = f"t{abs(hash(str(path)))}"
    stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(path)).trigger(availableNow=True).start().awaitTermination()
    return {tuple(r) for r in spark.table(name).collect()}


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), "value", (F.col("user_id") % 5 == 0).alias("is_premium"))
    rows.coalesce(1).orderBy("ts").write.mode("overwrite").parquet(path)
    return path, spark.read.parquet(path)


def test_daily_usage_equals_batch(spark, events, tmp_path):
    path, rows = events
    live_rows = drained(spark, live.daily_usage(live.read_events(spark, path, rows._jdf.schema().toDDL()), 3), tmp_path / "c", "complete")
    batch = usage.daily_usage(rows, 3).select("user_id", "day", "is_premium", "used", "remaining")
    assert live_rows == {tuple(r) for r in batch.collect()} and live_rows


def test_trend_equals_batch(spark, events, tmp_path):
    path, rows = events
    live_rows = drained(spark, live.trend(live.read_events(spark, path, rows._jdf.schema().toDDL()), "value", "1 hour"), tmp_path / "c", "complete")
    batch = metrics.trend(rows, "value", "1 hour").select("name", F.col("start").cast("timestamp"), "value")
    assert live_rows == {tuple(r) for r in batch.collect()} and live_rows


def test_fixed_windows_equal_batch(spark, events, tmp_path):
    path, rows = events
    stream = live.fixed_windows(live.read_events(spark, path, rows._jdf.schema().toDDL()), "user_id", 43_200, 2)
    live_rows = drained(spark, stream, tmp_path / "c", "append")
    batch = usage.fixed_windows(rows, "user_id", 43_200, 2).select("user_id", "event_id", "count", "allowed")
    assert live_rows == {tuple(r) for r in batch.collect()} and live_rows


def test_collated_messages(spark, tmp_path):
    data = [(1, 2, "delta", "lo"), (1, 1, "delta", "hel"), (1, 0, "status", "x"), (1, 3, "done", ""), (2, 1, "delta", "open"), (3, 1, "delta", " "), (3, 2, "done", "")]
    rows = spark.createDataFrame(data, "message_id long, seq long, kind string, value string")
    rows.write.parquet(str(tmp_path / "in"))
    live_rows = drained(spark, live.collated(live.read_events(spark, str(tmp_path / "in"), "message_id long, seq long, kind string, value string")), tmp_path / "c", "append")
    assert live_rows == {(1, "hello")}
    assert {tuple(r) for r in conversations.collated(rows.where("message_id <> 2")).collect()} == live_rows


def test_new_documents_are_cut_once(spark, tmp_path):
    schema, source, target = "doc_id long, text string", str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "# A\n\nSome words that make a section.")], schema).write.mode("append").parquet(source)
    live.chunk_new_documents(spark, source, schema, target, str(tmp_path / "c"))
    spark.createDataFrame([(2, "# B\n\nOther words that make a section.")], schema).write.mode("append").parquet(source)
    live.chunk_new_documents(spark, source, schema, target, str(tmp_path / "c"))
    assert sorted(r.doc_id for r in spark.read.parquet(target).collect()) == [1, 2]
