"""Inputs that the tables hold only in another form, as Spark SQL and DuckDB SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CHUNKS = """
SELECT doc_id AS chunk_id,
       CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id % 49 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS document_id,
       CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS text
FROM documents"""
_RAW_META = """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat('{"root":', p, '}') ELSE p END AS raw_json FROM (
  SELECT doc_id, concat('{"id":"',
    CASE WHEN doc_id % 20 = 19 THEN ' '
         WHEN doc_id % 2 = 0 THEN concat('0704.', lpad(CAST(doc_id % 10000 AS STRING), 4, '0'))
         ELSE concat('astro-ph/', lpad(CAST(doc_id AS STRING), 7, '0')) END,
    '","title":"T', CAST(doc_id AS STRING), '","categories":"', CASE WHEN doc_id % 4 = 0 THEN 'hep-th' ELSE 'gr-qc Astro-Ph.GA' END,
    '","journal-ref":', CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE concat('"J ', source, '"') END,
    ',"doi":', CASE WHEN doc_id % 3 = 1 THEN concat('" 10.1/', CAST(doc_id AS STRING), ' "') ELSE 'null' END,
    ',"authors_parsed":', CASE WHEN doc_id % 7 = 0 THEN 'null'
       ELSE concat('[["', source, '"," J. -  ', lang, ' ",""],[""," ",""],["Doe","A",""]]') END,
    ',"versions":', CASE WHEN doc_id % 6 = 0 THEN '[]'
       ELSE '[{"version":"v1","created":"2007-04-02T19:18:42Z"},{"version":"v2","created":"2008-01-05T00:00:00Z"}]' END, '}') AS p
  FROM documents)"""
_RAW_MD = """
SELECT concat('https://host.example/html/',
    CASE WHEN doc_id % 2 = 0 THEN concat('0704.', lpad(CAST(doc_id % 10000 AS STRING), 4, '0'))
         ELSE concat('astro-ph', lpad(CAST(doc_id AS STRING), 7, '0')) END, '.html') AS id,
    concat(text, copy) AS text
FROM documents JOIN (SELECT '' AS copy UNION ALL SELECT ' dup' AS copy) AS c ON copy = '' OR doc_id % 10 = 0"""
_MD_SPARK = r"""
SELECT doc_id, array_join(transform(split(text, '\n'), (l, i) -> concat(repeat('#', CAST(1 + i % 3 AS INT)), ' ',
    CASE WHEN i % 7 = 6 THEN 'References' ELSE concat('Section ', CAST(i AS STRING)) END, '\n\n', l)), '\n\n') AS text
FROM documents"""
_MD_DUCK = """
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: concat(repeat('#', CAST(1 + (i - 1) % 3 AS INT)), ' ',
    CASE WHEN (i - 1) % 7 = 6 THEN 'References' ELSE concat('Section ', CAST(i - 1 AS STRING)) END, chr(10), chr(10), l)), concat(chr(10), chr(10))) AS text
FROM documents"""
#: The whole text as one long section, and then its lines as sections of their own.
_LONG_SPARK = _MD_SPARK.replace("SELECT doc_id, array_join(", r"SELECT doc_id, concat('# Whole\n\n', text, '\n\n', array_join(").replace(" AS text\n", ") AS text\n")
_LONG_DUCK = _MD_DUCK.replace("SELECT doc_id, array_to_string(", "SELECT doc_id, concat('# Whole', chr(10), chr(10), text, chr(10), chr(10), array_to_string(").replace(" AS text\n", ") AS text\n")
_QTEXT_SPARK = """
SELECT item_id AS query_id, concat('  ', lower(concat_ws(' ', try_element_at(split(text, ' '), 1), try_element_at(split(text, ' '), -1))), ' \n') AS query FROM benchmark"""
_QTEXT_DUCK = """
SELECT item_id AS query_id, concat('  ', lower(concat_ws(' ', string_split(text, ' ')[1], string_split(text, ' ')[-1])), ' ', chr(10)) AS query FROM benchmark"""
_QVEC = "SELECT vec_id AS query_id, embedding AS qvec, label FROM embeddings WHERE vec_id % 20 = 0"
_QRELS = """
SELECT q.vec_id AS query_id, d.vec_id AS doc_id, CAST(1 + d.vec_id % 3 AS INT) AS grade
FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0"""
_MESSAGES = """
SELECT conv_id AS thread_id, conv_id % 10 AS user_id, turn AS sequence_num, role, text AS content,
       TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR + turn * INTERVAL '1' MINUTE AS created_at,
       conv_id % 9 = 0 AS is_archived
FROM conversations"""
_REQUESTS = "SELECT event_id, user_id, ts, user_id % 5 = 0 AS is_premium FROM events"
_METRICS = """
SELECT event_type AS name, ts, event_id, value AS gauge,
       sum(value) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS counter
FROM events"""
_VERSIONS = "SELECT o_custkey AS prompt_id, o_orderkey AS version_id, o_orderdate AS created_at, o_orderpriority AS content FROM orders"

#: Name: Spark SQL, DuckDB SQL and the tables below.
_VIEWS = {
    "v_chunks": (_CHUNKS, _CHUNKS, ["documents"]),
    "v_raw_meta": (_RAW_META, _RAW_META, ["documents"]),
    "v_raw_md": (_RAW_MD, _RAW_MD, ["documents"]),
    "v_md": (_MD_SPARK, _MD_DUCK, ["documents"]),
    "v_long_md": (_LONG_SPARK, _LONG_DUCK, ["documents"]),
    "v_qtext": (_QTEXT_SPARK, _QTEXT_DUCK, ["benchmark"]),
    "v_qvec": (_QVEC, _QVEC, ["embeddings"]),
    "v_qrels": (_QRELS, _QRELS, ["embeddings"]),
    "v_messages": (_MESSAGES, _MESSAGES, ["conversations"]),
    "v_requests": (_REQUESTS, _REQUESTS, ["events"]),
    "v_metrics": (_METRICS, _METRICS, ["events"]),
    "v_versions": (_VERSIONS, _VERSIONS, ["orders"]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived inputs; the tables are parameters of the SQL, so no temporary views are left behind."""
    text, _, tables = _VIEWS[name]
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    # Braces of JSON text are doubled for the formatter.
    if name == "v_raw_meta":
        text = text.replace("{documents}", "\0").replace("{", "{{").replace("}", "}}").replace("\0", "{documents}")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


def duck(*names: str) -> str:
    """A WITH list of derived inputs for DuckDB, to be followed by more or by SELECT."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_VIEWS[n][1]})" for n in names)
