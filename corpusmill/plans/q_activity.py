"""Queries of conversations, usage, histories and time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import conversations as c
from corpusmill.operators import metrics as m
from corpusmill.operators import usage as u
from corpusmill.plans.registry import query
from corpusmill.plans.views import duck, table, view

_M = duck("v_messages")


@query(_M + " SELECT user_id, thread_id, max(created_at) AS updated_at, array_to_string(list(concat(sequence_num, ':', role, ':', content) ORDER BY sequence_num), chr(10)) AS messages FROM v_messages WHERE NOT is_archived GROUP BY user_id, thread_id")
def t01_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform("messages", lambda x: F.concat(x["sequence_num"].cast("string"), F.lit(":"), x["role"], F.lit(":"), x["content"]))
    return c.threads(view(spark, sf_dir, "v_messages")).withColumn("messages", F.array_join(lines, "\n"))


@query(_M + """, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY sequence_num DESC) AS k FROM v_messages)
SELECT thread_id, sequence_num, role, CAST(row_number() OVER (PARTITION BY thread_id ORDER BY sequence_num) AS INTEGER) AS place FROM r WHERE k <= 3""")
def t02_last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.last_messages(view(spark, sf_dir, "v_messages"), 3).select("thread_id", "sequence_num", "role", "place")


@query(_M + """, s AS (SELECT * FROM v_messages WHERE role <> 'assistant'), n AS (SELECT * FROM v_messages WHERE role = 'assistant'), b AS (SELECT thread_id, max(sequence_num) AS b FROM s GROUP BY thread_id)
SELECT n.thread_id, CAST(coalesce(b, 0) + row_number() OVER (PARTITION BY n.thread_id ORDER BY n.sequence_num) AS BIGINT) AS sequence_num, md5(content) AS content_md5 FROM n LEFT JOIN b USING (thread_id)""")
def t03_appended_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_messages")
    new = rows.where("role = 'assistant'").select("thread_id", F.col("sequence_num").alias("n"), "role", "content", "created_at")
    return c.appended(rows.where("role <> 'assistant'"), new).select("thread_id", "sequence_num", F.md5("content").alias("content_md5"))


@query(_M + " SELECT thread_id, max(created_at) AS updated_at FROM v_messages GROUP BY thread_id HAVING count(*) FILTER (role <> 'assistant') > 0")
def t03_touched_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each thread was last active, after the assistant's messages have been appended."""
    rows = view(spark, sf_dir, "v_messages")
    threads = rows.where("role <> 'assistant'").groupBy("thread_id").agg(F.max("created_at").alias("updated_at"))
    return c.touched(threads, rows.where("role = 'assistant'"))


@query(_M + " SELECT thread_id, CASE WHEN trim(coalesce(content, '')) = '' THEN 'New chat' ELSE substr(replace(trim(content), chr(10), ' '), 1, 40) END AS title FROM v_messages WHERE sequence_num = 0")
def t04_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_messages").where("sequence_num = 0").select("thread_id", c.title(F.col("content")).alias("title"))


@query(_M + " SELECT thread_id, arg_max(content, sequence_num) FILTER (WHERE role = 'user' AND trim(content) <> '') AS prompt FROM v_messages GROUP BY thread_id")
def t05_effective_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.effective_prompts(view(spark, sf_dir, "v_messages"))


@query(_M + ", d AS (SELECT thread_id AS message_id, string_agg(content, '' ORDER BY sequence_num) FILTER (WHERE role <> 'system') AS content FROM v_messages GROUP BY thread_id) SELECT message_id, md5(content) AS content_md5 FROM d WHERE trim(content) <> ''")
def t06_collated_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "system", "status").otherwise("delta")
    events = view(spark, sf_dir, "v_messages").select(F.col("thread_id").alias("message_id"), F.col("sequence_num").alias("seq"), kind.alias("kind"), F.col("content").alias("value"))
    return c.collated(events).select("message_id", F.md5("content").alias("content_md5"))


@query(_M + " SELECT thread_id, sequence_num, role, CASE WHEN user_id % 2 = 0 THEN 'New chat' ELSE 'Talk' END AS title FROM v_messages WHERE role IN ('user', 'assistant')")
def t07_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_messages").withColumn("title", F.when(F.col("user_id") % 2 == 0, " ").otherwise(" Talk"))
    return c.displayed(rows).select("thread_id", "sequence_num", "role", "title")


@query(_M + " SELECT thread_id, sequence_num FROM v_messages WHERE NOT is_archived")
def t08_cascading_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_messages")
    return c.without_deleted(rows, rows.where("is_archived").select("thread_id", "user_id").distinct()).select("thread_id", "sequence_num")


_R = duck("v_requests")


@query(_R + """ SELECT user_id, CAST(ts AS DATE) AS day, is_premium, CASE WHEN is_premium THEN count(*) ELSE least(count(*), 3) END AS used, CASE WHEN NOT is_premium THEN 3 END AS limit_,
CASE WHEN NOT is_premium THEN greatest(3 - count(*), 0) END AS remaining, CAST(CAST(ts AS DATE) + 1 AS DATE) AS reset_day FROM v_requests GROUP BY user_id, CAST(ts AS DATE), is_premium""")
def u01_daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.daily_usage(view(spark, sf_dir, "v_requests"), 3)


@query(_R + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS nth FROM v_requests) SELECT event_id, CAST(nth AS INTEGER) AS nth, is_premium OR nth <= 3 AS accepted FROM r")
def u02_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.decisions(view(spark, sf_dir, "v_requests"), 3).select("event_id", "nth", "accepted")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (
  SELECT user_id, event_id, us, i, us AS opened, 1 AS n FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.us, e.i, CASE WHEN e.us < f.opened + 43200000000 THEN f.opened ELSE e.us END, CASE WHEN e.us < f.opened + 43200000000 THEN f.n + 1 ELSE 1 END
  FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, event_id, CAST(n AS INTEGER) AS count, n = 1 OR n <= 2 AS allowed, CASE WHEN NOT (n = 1 OR n <= 2) THEN CAST(greatest(ceil((opened + 43200000000 - us) / 1000000.0), 1) AS BIGINT) END AS retry_after FROM f""")
def u03_fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.fixed_windows(table(spark, sf_dir, "events"), "user_id", 43_200, 2)


@query("SELECT c_custkey, concat('login:', sha256(lower(trim(c_mktsegment)))) AS key, concat('10.0.', c_nationkey, '.1') AS address FROM customer")
def u04_limit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = F.concat(F.lit(" 10.0."), F.col("c_nationkey").cast("string"), F.lit(".1 , 10.9.9.9"))
    return table(spark, sf_dir, "customer").select("c_custkey", u.limit_key("login", F.concat(F.lit(" "), F.col("c_mktsegment"))).alias("key"), u.client_address(hops, F.lit("x")).alias("address"))


@query("SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS total FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def u05_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("gone", F.col("o_orderstatus") == "F")
    found, total = u.page(rows, "o_orderdate", "o_orderkey", 3, 20, "gone")
    return found.select("o_orderkey", "o_orderdate").crossJoin(total)


_V = duck("v_versions") + ", h AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY created_at, version_id) AS n, count(*) OVER (PARTITION BY prompt_id) AS c FROM v_versions)"


@query(_V + " SELECT prompt_id, version_id, CAST(n AS INTEGER) AS version_number, n = c AS is_active FROM h")
def u06_version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.version_history(view(spark, sf_dir, "v_versions")).select("prompt_id", "version_id", "version_number", "is_active")


@query(_V + " SELECT prompt_id, version_id, n = CASE WHEN prompt_id % 2 = 0 THEN 1 ELSE c END AS is_active FROM h")
def u07_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second prompt goes back to its first version; a later wish for an unknown version changes nothing."""
    history = u.version_history(view(spark, sf_dir, "v_versions"))
    wishes = history.where("prompt_id % 2 = 0").select("prompt_id").distinct().select("prompt_id", F.inline(F.expr("array(struct(1 as version_number, 1 as at), struct(100000 as version_number, 2 as at))")))
    return u.activated(history, wishes).select("prompt_id", "version_id", "is_active")


_S = duck("v_metrics")


@query(_S + ", l AS (SELECT name, arg_max(gauge, (ts, event_id)) AS value FROM v_metrics WHERE regexp_matches(name, '^[a-p]') GROUP BY name) SELECT count(*) AS series, round(sum(value), 6) AS total FROM l")
def m01_instant_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.instant_totals(m.latest(view(spark, sf_dir, "v_metrics"), "gauge", names="^[a-p]"))


@query("WITH l AS (SELECT CAST(user_id AS VARCHAR) AS name, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id) SELECT name, value FROM l ORDER BY value DESC, name LIMIT 10")
def m02_top_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("name"), "ts", "event_id", "value")
    return m.top(m.latest(series, "value"))


@query(_S + " SELECT name, time_bucket(INTERVAL '1 hour', ts) AS start, arg_max(gauge, (ts, event_id)) AS value FROM v_metrics GROUP BY name, time_bucket(INTERVAL '1 hour', ts)")
def m03_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.trend(view(spark, sf_dir, "v_metrics"), "gauge", "1 hour")


@query(_S + """, p AS (SELECT *, lag(counter) OVER (PARTITION BY name ORDER BY ts, event_id) AS prev FROM v_metrics),
i AS (SELECT name, event_id, epoch_us(ts) AS us, CASE WHEN prev IS NULL THEN 0 WHEN counter < prev THEN counter ELSE counter - prev END AS up FROM p)
SELECT name, event_id, round(sum(up) OVER (PARTITION BY name ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) / 3600, 6) AS rate FROM i""")
def m04_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.rate(view(spark, sf_dir, "v_metrics"), "counter", 3600)


@query(_S + " SELECT DISTINCT name FROM v_metrics")
def m05_series_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.names(view(spark, sf_dir, "v_metrics"))
