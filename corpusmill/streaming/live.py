"""Live counters, trends, limits and message assembly, and incremental selection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.operators.sections import nodes
from corpusmill.operators.splitting import split

LATENESS = "1 hour"


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of a folder as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def daily_usage(requests: DataFrame, limit: int) -> DataFrame:
    """As the batch form, by tumbling UTC days; rows later than LATENESS are dropped."""
    days = requests.withWatermark("ts", LATENESS).groupBy("user_id", "is_premium", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    used = F.when(F.col("is_premium"), F.col("n")).otherwise(F.least("n", F.lit(limit)))
    left = F.when(~F.col("is_premium"), F.greatest(limit - F.col("n"), F.lit(0)))
    return days.select("user_id", F.to_date("w.start").alias("day"), "is_premium", used.alias("used"), left.alias("remaining"))


def trend(series: DataFrame, value: str, step: str) -> DataFrame:
    """Every series' last value in each step."""
    rows = series.withWatermark("ts", LATENESS).groupBy("name", F.window("ts", step).alias("w"))
    return rows.agg(F.max_by(value, F.struct("ts", "event_id")).alias("value")).select("name", F.col("w.start").alias("start"), "value")


def sliding_increase(series: DataFrame, up: str, size: str, slide: str) -> DataFrame:
    """Sum of increases in sliding windows, for rates; increases come with the samples."""
    rows = series.withWatermark("ts", LATENESS).groupBy("name", F.window("ts", size, slide).alias("w"))
    return rows.agg(F.sum(up).alias("increase")).select("name", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "increase")


def fixed_windows(hits: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """Decisions on hits (key, ts, event_id): a key's window opens at its first hit and its state goes when the window has passed.

    Within a batch, hits are taken in the order of time; across batches, in the order of arrival.
    """
    kind = hits.schema[key].dataType.simpleString()

    def decide(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for us, event in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["event_id"], strict=True):
            if opened is None or us >= opened + seconds * 1_000_000:
                opened, count = us, 0
            count += 1
            out.append((name[0], event, count, count == 1 or count <= limit))
        state.update((opened, count))
        state.setTimeoutTimestamp(max((opened + seconds * 1_000_000) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "event_id", "count", "allowed"])

    rows = hits.withWatermark("ts", LATENESS).groupBy(key)
    return rows.applyInPandasWithState(decide, f"{key} {kind}, event_id long, count int, allowed boolean", "opened long, count long", "append", GroupStateTimeout.EventTimeTimeout)


def collated(events: DataFrame) -> DataFrame:
    """(message_id, content) once a message's done event is there; deltas are kept until then."""
    kind = events.schema["message_id"].dataType.simpleString()

    def collect(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, values = map(list, state.get) if state.exists else ([], [])
        done = False
        for pdf in frames:
            delta = pdf[pdf["kind"] == "delta"]
            seqs += delta["seq"].tolist()
            values += delta["value"].tolist()
            done |= (pdf["kind"] == "done").any()
        if not done:
            state.update((seqs, values))
            return
        if state.exists:
            state.remove()
        text = "".join(v for _, v in sorted(zip(seqs, values, strict=True)))
        if text.strip():
            yield pd.DataFrame({"message_id": [name[0]], "content": [text]})

    return events.groupBy("message_id").applyInPandasWithState(collect, f"message_id {kind}, content string", "seqs array<long>, parts array<string>", "append", GroupStateTimeout.NoTimeout)


def chunk_new_documents(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Cuts the documents that arrived since the last call, and ends."""

    def cut(batch: DataFrame, _: int) -> None:
        nodes(batch, split).write.mode("append").parquet(target)

    read_events(spark, source, schema).writeStream.foreachBatch(cut).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
