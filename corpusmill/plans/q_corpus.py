"""Queries of sources, cleaning and corpus analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.operators import analytics, clean
from corpusmill.plans.registry import query
from corpusmill.plans.staging import scratch, until_end
from corpusmill.plans.views import duck, table, view
from corpusmill.sources import jsonl, tables

_META_DUCK = duck("v_raw_meta") + r""",
j AS (SELECT doc_id, coalesce(CAST(raw_json AS JSON)->'root', CAST(raw_json AS JSON)) AS j FROM v_raw_meta),
p AS (SELECT doc_id, j->>'id' AS id, j->>'title' AS title, j->>'categories' AS categories, j->>'$."journal-ref"' AS journal_ref, j->>'$."report-no"' AS report_no, j->>'doi' AS doi,
  CASE WHEN json_type(j->'authors_parsed') = 'ARRAY' THEN CAST(j->'authors_parsed' AS VARCHAR[][]) END AS a, CAST(j->'versions' AS JSON[]) AS v FROM j),
n AS (SELECT *, list_filter(list_transform(a, lambda x: trim(regexp_replace(concat_ws(' ', nullif(trim(x[1]), ''), nullif(trim(regexp_replace(x[2], '\s*-\s*', '-', 'g')), ''), nullif(trim(x[3]), '')), '\s+', ' ', 'g'))), lambda y: y <> '') AS names FROM p WHERE nullif(trim(id), '') IS NOT NULL),
meta AS (SELECT doc_id, id, title, categories, journal_ref, report_no, doi, nullif(array_to_string(names, ', '), '') AS authors, CAST(coalesce(len(names), 0) AS INTEGER) AS number_of_authors,
  try_strptime(v[1]->>'created', '%Y-%m-%dT%H:%M:%SZ') AS created, try_strptime(v[-1]->>'created', '%Y-%m-%dT%H:%M:%SZ') AS last_updated FROM n)
"""
_MD_DUCK = duck("v_raw_md") + r""",
b AS (SELECT regexp_replace(regexp_replace(id, '^.*/', ''), '\.html$', '') AS id, text FROM v_raw_md),
c AS (SELECT CASE WHEN regexp_matches(id, '^[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?$') THEN id WHEN regexp_matches(id, '^.+[0-9]{7}(v[0-9]+)?$') THEN regexp_replace(id, '^(.+?)([0-9]{7}(v[0-9]+)?)$', '\1/\2') ELSE id END AS id, text FROM b),
md AS (SELECT id, arg_min(text, md5(text)) AS text FROM c GROUP BY id)
"""


@query(duck("v_raw_meta") + " SELECT doc_id, json_type(CAST(raw_json AS JSON)->'root') IS NOT NULL AS wrapped, CAST(length(raw_json) AS BIGINT) AS chars FROM v_raw_meta")
def s01_raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.try_parse_json("raw_json")
    return view(spark, sf_dir, "v_raw_meta").select("doc_id", F.try_variant_get(j, "$.root", "variant").isNotNull().alias("wrapped"), F.length("raw_json").cast("long").alias("chars"))


@query("SELECT doc_id, lang, source, CAST(length(text) AS BIGINT) AS chars FROM documents")
def s02_markdown_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.length("text").cast("long").alias("chars"))


@query(r"SELECT CAST(doc_id AS VARCHAR) AS source_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text_md5, lang FROM documents WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''")
def s03_jsonl_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as JSON lines and read back with checks."""
    path = scratch(spark, "jsonl")
    docs = table(spark, sf_dir, "documents")
    jsonl.write(docs.select(F.col("doc_id").cast("string").alias("source_id"), "text", F.struct("lang").alias("metadata")), path)
    found, _ = jsonl.read_documents(spark, until_end(spark, path))
    return found.select("source_id", F.md5("text").alias("text_md5"), F.get_json_object("metadata", "$.lang").alias("lang"))


@query("SELECT text, concat('[\"', item_id, '\"]') AS relevance FROM benchmark")
def s04_jsonl_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages written as queries with a relevance beside the metadata, and read back."""
    path = scratch(spark, "jsonl")
    items = table(spark, sf_dir, "benchmark")
    jsonl.write(items.select("text", F.array(F.col("item_id").cast("string")).alias("relevance"), F.lit("none").alias("metadata")), path)
    return jsonl.read_queries(spark, until_end(spark, path))[0].select("text", "relevance")


@query(duck("v_chunks") + " SELECT CAST(chunk_id AS VARCHAR) AS source_id, text, 'sample' AS dataset_name FROM v_chunks WHERE text <> '' ORDER BY md5(concat(CAST(chunk_id AS VARCHAR), '7')), chunk_id LIMIT 100")
def s06_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = tables.sampled(view(spark, sf_dir, "v_chunks").where("text <> ''"), "chunk_id", 100, "7")
    return chosen.select(F.col("chunk_id").cast("string").alias("source_id"), "text", F.lit("sample").alias("dataset_name"))


@query("SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey")
def s07_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    rows = tables.insert_if_absent(stored, table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return rows.select("o_custkey", "o_orderkey")


@query("SELECT doc_id, lang, source FROM documents")
def s13_load_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset loaded twice under one name: the second load finds it stored and changes nothing."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), scratch(spark, "datasets")
    tables.load_once(spark, path, docs, "documents")
    until_end(spark, path)
    return tables.load_once(spark, path, docs.withColumn("lang", F.lit("other")), "documents")


_UPSERT_DUCK = """
WITH o AS (SELECT o_custkey AS k, o_orderpriority AS p, o_orderkey AS version, o_totalprice AS metric, o_orderdate AS created_at FROM orders),
m AS (SELECT k, p, max(version) AS version, arg_max(metric, version) AS metric, min(created_at) AS created_at FROM o GROUP BY k, p)
SELECT k, p, version, metric, created_at FROM m"""


def _order_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_custkey k", "o_orderpriority p", "o_orderkey version", "o_totalprice metric", "o_orderdate created_at")


@query(_UPSERT_DUCK)
def s08_upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_metrics(spark, sf_dir)
    odd = F.crc32(F.col("version").cast("string").cast("binary")) % 2 == 1
    first = tables.upsert(rows.where(~odd).limit(0), rows.where(~odd), ["k", "p"], "version", "created_at")
    return tables.upsert(first, rows.where(odd), ["k", "p"], "version", "created_at")


_SIX = [
    "o_orderstatus AS dataset_name", "o_orderpriority AS run_id", "concat('model ', CAST(o_custkey % 3 AS STRING)) AS model_key", "'fp32' AS quantization",
    "o_custkey % 50 AS query_id", "o_custkey % 7 AS document_id", "o_orderkey AS version", "o_totalprice AS score", "o_orderdate AS created_at",
]
_SIX_KEYS = ["dataset_name", "run_id", "model_key", "quantization", "query_id", "document_id"]


@query(f"""
WITH r AS (SELECT {', '.join(_SIX)} FROM orders)
SELECT {", ".join(_SIX_KEYS)}, max(version) AS version, arg_max(score, version) AS score, min(created_at) AS created_at FROM r GROUP BY ALL""")
def s08_stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into a stored table by a key of six columns; the second replaces only the parts that it touches."""
    rows, path = table(spark, sf_dir, "orders").selectExpr(*_SIX), until_end(spark, scratch(spark, "pair_metrics"))
    odd = F.crc32(F.col("version").cast("string").cast("binary")) % 2 == 1
    tables.upsert_stored(path, rows.where(~odd), _SIX_KEYS, "version", "created_at")
    return tables.upsert_stored(path, rows.where(odd), _SIX_KEYS, "version", "created_at").select(*rows.columns)


@query("SELECT o_custkey AS k, max(o_orderkey) AS version, arg_max(o_totalprice, o_orderkey) AS metric, min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey")
def s09_upsert_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_metrics(spark, sf_dir).drop("p")
    return tables.upsert(rows.limit(0), rows, ["k"], "version", "created_at")


@query("SELECT doc_id FROM documents WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def s10_pending_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"))
    return tables.pending_documents(table(spark, sf_dir, "documents"), chunks).select("doc_id")


@query(duck("v_chunks") + " SELECT chunk_id FROM v_chunks WHERE text <> '' AND chunk_id NOT IN (SELECT vec_id FROM embeddings) AND chunk_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s11_pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedded = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    failed = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id"))
    return tables.pending_embeddings(view(spark, sf_dir, "v_chunks"), embedded, failed).select("chunk_id")


@query(_META_DUCK + "SELECT * FROM meta")
def c01_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unwrapping, fields, usable ids, authors, their number, and first and last version."""
    return clean.metadata(view(spark, sf_dir, "v_raw_meta"))


@query(_META_DUCK + "SELECT id, max(last_updated) AS last_updated, CAST(count(*) > 0 AS BOOLEAN) AS found FROM meta GROUP BY id")
def c07_newest_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.newest_metadata(clean.metadata(view(spark, sf_dir, "v_raw_meta"))).select("id", "last_updated", F.lit(True).alias("found"))


@query(_MD_DUCK + "SELECT id, md5(text) AS text_md5 FROM md")
def c08_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical ids, one text for each."""
    return clean.markdown(view(spark, sf_dir, "v_raw_md")).select("id", F.md5("text").alias("text_md5"))


@query(_META_DUCK + "," + _MD_DUCK.split("WITH RECURSIVE ")[1] + """
SELECT meta.doc_id, meta.id, meta.number_of_authors, md5(md.text) AS text_md5, concat('https://www.doi.org/', coalesce(nullif(trim(doi), ''), concat('10.48550/arXiv.', meta.id))) AS doi_url
FROM meta JOIN md ON meta.id = md.id WHERE categories ILIKE '%astro-ph%'""")  # fmt: skip
def c10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join, link and scope."""
    docs = clean.documents(clean.metadata(view(spark, sf_dir, "v_raw_meta")), clean.markdown(view(spark, sf_dir, "v_raw_md")))
    return docs.select("doc_id", "id", "number_of_authors", F.md5("text").alias("text_md5"), "doi_url")


_PER_DOC = duck("v_chunks") + """,
d AS (SELECT d.doc_id, count(c.chunk_id) AS chunks, count(c.chunk_id) FILTER (WHERE c.text <> '') AS filled FROM documents d LEFT JOIN v_chunks c ON c.document_id = d.doc_id GROUP BY d.doc_id)"""
_QUALITY = """,
q AS (SELECT count(*) AS all_chunks, count(*) FILTER (WHERE c.text = '') AS empty_chunks, avg(length(c.text)) AS mean_length, avg(length(c.text)) FILTER (WHERE c.text <> '') AS mean_filled_length,
  count(*) FILTER (WHERE c.document_id IS NULL) AS null_documents, count(*) FILTER (WHERE c.document_id IS NOT NULL AND d.doc_id IS NULL) AS dangling_documents
  FROM v_chunks c LEFT JOIN documents d ON d.doc_id = c.document_id)"""
_TOTALS = """,
s AS (SELECT count(*) AS documents, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(filled) AS BIGINT) AS filled, avg(chunks) AS mean_chunks, min(chunks) AS min_chunks, max(chunks) AS max_chunks,
  avg(filled) AS mean_filled, min(filled) AS min_filled, max(filled) AS max_filled, count(*) FILTER (WHERE chunks = 0) AS without_chunks, count(*) FILTER (WHERE filled = 0) AS without_filled FROM d)"""


@query(_PER_DOC + " SELECT * FROM d")
def a01_chunks_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.per_document(table(spark, sf_dir, "documents"), view(spark, sf_dir, "v_chunks"))


@query(_PER_DOC + _TOTALS + " SELECT * REPLACE (round(mean_chunks, 6) AS mean_chunks, round(mean_filled, 6) AS mean_filled) FROM s")
def a02_document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.totals(a01_chunks_per_document(spark, sf_dir))


@query(duck("v_chunks") + _QUALITY + " SELECT * REPLACE (round(mean_length, 6) AS mean_length, round(mean_filled_length, 6) AS mean_filled_length) FROM q")
def a03_chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.chunk_quality(table(spark, sf_dir, "documents"), view(spark, sf_dir, "v_chunks"))


@query(_PER_DOC + _TOTALS + _QUALITY + """ SELECT s.* REPLACE (round(mean_chunks, 6) AS mean_chunks, round(mean_filled, 6) AS mean_filled), q.* REPLACE (round(mean_length, 6) AS mean_length, round(mean_filled_length, 6) AS mean_filled_length),
CASE WHEN all_chunks = 0 THEN 0.0 ELSE round((all_chunks - empty_chunks)::DOUBLE / all_chunks, 6) END AS filled_fraction FROM s, q""")
def a04_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.summary(table(spark, sf_dir, "documents"), view(spark, sf_dir, "v_chunks"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(concat('  ', source, ' & ', lang, '-', source, '! ')), '&', 'and'), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')) AS title FROM documents")
def k02_normal_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("  "), F.col("source"), F.lit(" & "), F.col("lang"), F.lit("-"), F.col("source"), F.lit("! "))
    return table(spark, sf_dir, "documents").select("doc_id", t.normal_title(title).alias("title"))
