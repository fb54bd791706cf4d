"""Threads and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEW = "New chat"


def threads(messages: DataFrame) -> DataFrame:
    """Threads that aren't archived, the latest activity first, with their messages in sequence."""
    nested = F.array_sort(F.collect_list(F.struct("sequence_num", "role", "content")))
    rows = messages.where("not is_archived").groupBy("user_id", "thread_id").agg(F.max("created_at").alias("updated_at"), nested.alias("messages"))
    return rows.orderBy("user_id", F.desc("updated_at"), "thread_id")


def last_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last n messages of every thread with their place from the oldest of them; none for n <= 0."""
    newest = F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("sequence_num")))
    rows = messages.withColumn("_k", newest).where(F.col("_k") <= n)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("thread_id").orderBy("sequence_num"))).drop("_k")


def appended(messages: DataFrame, new: DataFrame) -> DataFrame:
    """New messages (thread_id, n, role, content, created_at) with the sequence numbers that follow the stored ones."""
    base = messages.groupBy("thread_id").agg(F.max("sequence_num").alias("base"))
    k = F.row_number().over(Window.partitionBy("thread_id").orderBy("n"))
    return new.join(base, "thread_id", "left").withColumn("sequence_num", (F.coalesce("base", F.lit(0)) + k).cast("long")).drop("base", "n")


def touched(threads: DataFrame, new: DataFrame) -> DataFrame:
    """threads (thread_id, updated_at, …) after messages (thread_id, created_at) were appended: updated_at moves to the newest, and never back."""
    newest = new.groupBy("thread_id").agg(F.max("created_at").alias("newest"))
    rows = threads.join(newest, "thread_id", "left").withColumn("updated_at", F.greatest("updated_at", "newest"))
    return rows.select(*threads.columns)


def title(prompt: Column, size: int = 40) -> Column:
    """A thread's title from its first prompt."""
    line = F.substring(F.replace(F.trim(prompt), F.lit("\n"), F.lit(" ")), 1, size)
    return F.when(F.coalesce(F.trim(prompt), F.lit("")) == "", NEW).otherwise(line)


def effective_prompts(messages: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(thread_id, prompt): the explicit one unless blank, else the last user message with a text; null is an error of the request."""
    said = F.when((F.col("role") == "user") & (F.trim("content") != ""), F.col("sequence_num"))
    last = messages.groupBy("thread_id").agg(F.max_by("content", said).alias("last"))
    if explicit is None:
        return last.select("thread_id", F.col("last").alias("prompt"))
    rows = last.join(explicit, "thread_id", "full_outer")
    return rows.select("thread_id", F.coalesce(F.when(F.trim("prompt") != "", F.col("prompt")), F.col("last")).alias("prompt"))


def collated(events: DataFrame) -> DataFrame:
    """(message_id, content) of ordered events (message_id, seq, kind, value): deltas joined; blank results are left out."""
    deltas = events.where("kind = 'delta'").groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("d"))
    return deltas.select("message_id", F.array_join(F.transform("d", lambda x: x["value"]), "").alias("content")).where("trim(content) <> ''")


def displayed(messages: DataFrame) -> DataFrame:
    """What a reader sees: user and assistant messages, threads without a title under a general one."""
    return messages.where(F.col("role").isin("user", "assistant")).withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit(NEW)))


def without_deleted(rows: DataFrame, deletes: DataFrame) -> DataFrame:
    """Threads or messages without those that their own user deletes (thread_id, user_id)."""
    return rows.join(deletes, ["thread_id", "user_id"], "left_anti")
