"""Queries of the chunk tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.functions.tokenizers import with_token_spans
from corpusmill.operators import sections as s
from corpusmill.operators.parts import math_spans
from corpusmill.plans.registry import query
from corpusmill.plans.staging import text_batches
from corpusmill.plans.views import duck, table, view

_WORDS = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"
_HEADINGS = duck("v_md") + r""",
m AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(#{1,6})\s+(.+)$', concat(chr(64976), '\1', chr(64977), '\2', chr(64978)), 'g'), chr(64976))[2:] AS s FROM v_md),
p AS (SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS pos, len(s) AS n FROM m),
h AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(strpos(s, chr(64977)) - 1 AS INTEGER) AS level,
  regexp_replace(substr(s, strpos(s, chr(64977)) + 1, strpos(s, chr(64978)) - strpos(s, chr(64977)) - 1), '^\s+|\s+$', '', 'g') AS title,
  regexp_replace(substr(s, strpos(s, chr(64978)) + 1), '^\s+|\s+$', '', 'g') AS body, pos = n - 1 AS last FROM p)"""
_KEPT = _HEADINGS + r""",
d AS (SELECT *, regexp_matches(trim(regexp_replace(lower(title), '[^a-z0-9_]+', ' ', 'g')), '^(references|reference list|list of references|bibliography|works cited|citations|acknowledgements|acknowledgments|acknowledgement|acknowledgment|thanks|thank you)( |$)') AS d FROM h),
r AS (SELECT *, sum(CAST(d AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM d),
k0 AS (SELECT *, max(CASE WHEN d THEN level END) OVER (PARTITION BY doc_id, run ORDER BY pos) AS top, min(CASE WHEN NOT d THEN level END) OVER (PARTITION BY doc_id, run ORDER BY pos) AS since FROM r),
k AS (SELECT doc_id, pos, level, title, body, last FROM k0 WHERE NOT d AND (top IS NULL OR since <= top))"""
_CARRY = _KEPT + """,
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM k),
f AS (
  SELECT doc_id, pos, i, CASE WHEN NOT last AND length(body) BETWEEN 1 AND 19 THEN body ELSE '' END AS carry, CASE WHEN NOT last AND length(body) BETWEEN 1 AND 19 THEN '' ELSE body END AS text FROM o WHERE i = 1
  UNION ALL
  SELECT x.doc_id, x.pos, x.i, CASE WHEN NOT x.last AND length(x.w) BETWEEN 1 AND 19 THEN x.w ELSE '' END, CASE WHEN NOT x.last AND length(x.w) BETWEEN 1 AND 19 THEN '' ELSE x.w END
  FROM (SELECT o.*, concat_ws(chr(10), nullif(f.carry, ''), nullif(o.body, '')) AS w FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1) x)"""


@query(_HEADINGS + " SELECT doc_id, pos, level, title, md5(body) AS body_md5, last FROM h")
def k01_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with the text below them."""
    return s.headings(view(spark, sf_dir, "v_md")).select("doc_id", "pos", "level", "title", F.md5("body").alias("body_md5"), "last")


@query(_KEPT + " SELECT doc_id, pos, level, title FROM k")
def k03_kept_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.kept_sections(s.headings(view(spark, sf_dir, "v_md"))).select("doc_id", "pos", "level", "title")


@query(_KEPT + """,
u AS (SELECT a.doc_id, a.pos, a.title, a.level, max(b.pos) AS parent_pos FROM k a LEFT JOIN k b ON b.doc_id = a.doc_id AND b.pos < a.pos AND b.level < a.level GROUP BY a.doc_id, a.pos, a.title, a.level),
t AS (SELECT doc_id, pos, parent_pos, title AS path FROM u WHERE parent_pos IS NULL UNION ALL SELECT u.doc_id, u.pos, u.parent_pos, concat(t.path, '/', u.title) FROM t JOIN u ON u.doc_id = t.doc_id AND u.parent_pos = t.pos)
SELECT doc_id, pos, parent_pos, path FROM t""")
def k05_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts below headings have no part in this, so they stay behind.
    rows = s.with_hierarchy(s.kept_sections(s.headings(view(spark, sf_dir, "v_md")).drop("body", "last")))
    return rows.select("doc_id", "pos", "parent_pos", "path")


@query(_CARRY + " SELECT doc_id, pos, md5(text) AS text_md5 FROM f")
def k06_carried_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.kept_tree(s.headings(view(spark, sf_dir, "v_md")))
    return rows.select("doc_id", "pos", F.md5("text").alias("text_md5"))


@query(_HEADINGS + f" SELECT doc_id, pos, CAST(len(regexp_extract_all(body, '{_WORDS}')) AS INTEGER) AS tokens, len(regexp_extract_all(body, '{_WORDS}')) > 256 AS oversized FROM h")
def k07_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and the size gate."""
    n = t.token_count(F.col("body"))
    return s.headings(view(spark, sf_dir, "v_md")).select("doc_id", "pos", n.alias("tokens"), (n > s.MAX_TOKENS).alias("oversized"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\$[^$\n\\]+\$')) AS INTEGER) AS formulas FROM documents")
def k09_inline_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\$[^$\n\\]+\$")).alias("formulas"))


@query(r"""
WITH p AS (SELECT doc_id, length(text) AS n, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]|\s+') AS p FROM documents),
t AS (SELECT doc_id, n, x, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM (SELECT doc_id, n, unnest(p) AS x, unnest(range(len(p))) AS i FROM p))
SELECT d.doc_id, count(t.x) AS tokens FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id AND NOT regexp_matches(t.x, '^\s') AND t.first < t.n // 2 AND t.first + length(t.x) > t.n // 4
WHERE d.text <> '' GROUP BY d.doc_id""")
def k07_span_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that overlap the second quarter of each text, those that are cut by its ends included."""
    n = F.length("text")
    # The ends are columns of the rows: inside the filter each token would have its whole text measured again.
    rows = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text", F.floor(n / 4).alias("start"), F.floor(n / 2).alias("end"))
    spans = with_token_spans(text_batches(rows), "text")
    inside = F.filter("spans", lambda x: (x["first"] < F.col("end")) & (x["last"] > F.col("start")))
    return spans.select("doc_id", F.size(inside).cast("long").alias("tokens"))


@query(r"""
WITH p AS (SELECT doc_id, translate(text, '$\', '') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (length(replace(t, ' ', ' $a$ ')) - length(t)) // 4 AS inline, CAST(2 AS BIGINT) AS display, CAST(15 AS BIGINT) AS display_signs FROM p""")
def k09_math_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of texts whose blanks each hold one, with two display formulas at the end and one that isn't closed."""
    bare = F.translate("text", "$\\", "")
    text = F.concat(F.replace(bare, F.lit(" "), F.lit(" $a$ ")), F.lit("\n$$x\n\ny$$\n\\[ z \\] \n $$ open"))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.alias("text"))
    found = math_spans(text_batches(rows), "text")
    display = F.filter("spans", lambda s: s["kind"] == "display")
    found = found.select("doc_id", F.size("spans").cast("long").alias("all"), F.transform(display, lambda s: (s["last"] - s["first"]).cast("long")).alias("sizes"))
    shown = F.size("sizes").cast("long")
    return found.select("doc_id", (F.col("all") - shown).alias("inline"), shown.alias("display"), F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x).alias("display_signs"))


@query("""
WITH s AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + 3600000000 AS b FROM events),
m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, min(a) AS start_us, max(b) AS end_us, count(*) AS merged FROM g GROUP BY user_id, g""")
def k10_merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping or touching hours after events of a user as one."""
    from corpusmill.operators.intervals import merged

    rows = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start_us"), (F.unix_micros(F.col("ts").cast("timestamp")) + 3_600_000_000).alias("end_us"))
    return merged(rows, ["user_id"], "start_us", "end_us")


@query("""
WITH s AS (SELECT o_custkey, epoch_us(o_orderdate) AS a, epoch_us(o_orderdate) + 864000000000 AS b, o_orderkey FROM orders)
SELECT p.o_orderkey, count(*) AS met FROM s p JOIN s q ON p.o_custkey = q.o_custkey AND p.o_orderkey <> q.o_orderkey AND ((q.a <= p.a AND p.a < q.b) OR (q.a <= p.b - 1 AND p.b - 1 < q.b)) GROUP BY p.o_orderkey""")
def k11_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order, a customer's other orders within ten days: by the two end points of the probe."""
    from corpusmill.operators.intervals import intersecting

    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("a"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) + 864_000_000_000).alias("b"))
    met = intersecting(rows, rows.select("o_custkey", F.col("o_orderkey").alias("other"), "a", "b"), ["o_custkey"], "a", "b").where("o_orderkey <> other")
    return met.groupBy("o_orderkey").agg(F.count("*").alias("met"))


@query(_HEADINGS + f""",
u AS (SELECT doc_id, pos AS unit, len(regexp_extract_all(body, '{_WORDS}')) AS tokens FROM h),
w AS (
  SELECT doc_id, unit, tokens, 0 AS win, tokens AS total FROM u WHERE unit = 0
  UNION ALL
  SELECT u.doc_id, u.unit, u.tokens, CASE WHEN w.total + u.tokens <= 256 THEN w.win ELSE w.win + 1 END, CASE WHEN w.total + u.tokens <= 256 THEN w.total + u.tokens ELSE u.tokens END FROM w JOIN u ON u.doc_id = w.doc_id AND u.unit = w.unit + 1)
SELECT doc_id, CAST(win AS INTEGER) AS "window", min(unit) AS "first", max(unit) AS "last", CAST(sum(tokens) AS BIGINT) AS tokens FROM w GROUP BY doc_id, win""")
def k15_packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.headings(view(spark, sf_dir, "v_md"))
    return s.packed(rows.select("doc_id", F.col("pos").alias("unit"), t.token_count(F.col("body")).cast("long").alias("tokens")))


@query()
def k17_chunk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes with parts of oversized sections, links and metadata."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# Text\n\n"), F.col("text")).alias("text"))
    return s.nodes(docs, metadata={"origin": "documents"})


@query(_CARRY.replace("FROM v_md", "FROM v_long_md").replace(duck("v_md"), duck("v_long_md")) + f""",
x AS (SELECT doc_id, len(regexp_extract_all(text, '{_WORDS}')) > 256 AS big, length(regexp_replace(text, '\\s', '', 'g')) AS signs FROM f)
SELECT doc_id, count(*) AS sections, count(*) FILTER (big) AS oversized, CAST(sum(signs) AS BIGINT) AS signs, true AS linked FROM x GROUP BY doc_id""")
def k17_tree_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tree of many sections must add up to: every text is in it once, and parts form one chain below each oversized section."""
    nodes = s.nodes(view(spark, sf_dir, "v_long_md"))
    chains = nodes.where("part > 0").groupBy("parent_id").agg(F.count_if(F.col("prev_id").isNull()).alias("heads"), F.count_if(F.col("next_id").isNull()).alias("tails"), F.count("*").alias("n"), F.max("part").alias("last"))
    joined = nodes.join(chains.select(F.col("parent_id").alias("node_id"), ((F.col("heads") == 1) & (F.col("tails") == 1) & (F.col("n") == F.col("last"))).alias("whole")), "node_id", "left")
    signs = F.length(F.regexp_replace("text", r"\s", "")).cast("long")
    return joined.groupBy("doc_id").agg(F.count_if(F.col("part") == 0).alias("sections"), F.count("whole").alias("oversized"), F.sum(signs).alias("signs"), F.coalesce(F.bool_and("whole"), F.lit(True)).alias("linked"))


@query(r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?m)^#{1,6}\s+.+$')")
def k19_without_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.without_headings(table(spark, sf_dir, "documents")).select("doc_id")
