"""Queries of retrieval, reranking and their evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import vectors as v
from corpusmill.operators import embedding as e
from corpusmill.operators import evaluation as ev
from corpusmill.operators import fusion as fu
from corpusmill.operators import lookup
from corpusmill.operators import text_search as ts
from corpusmill.operators import vector_search as vs
from corpusmill.plans.registry import query
from corpusmill.plans.staging import staged
from corpusmill.plans.views import duck, table, view

_WORD = r"[\p{L}\p{M}\p{N}_]+"
_TEXT = f""",
q AS (SELECT query_id, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS query FROM v_qtext),
n AS (SELECT query_id, list_distinct(regexp_extract_all(query, '{_WORD}')) AS must FROM q),
nt AS (SELECT query_id, len(must) AS n, unnest(must) AS term FROM n),
w AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents WHERE text <> ''),
post AS (SELECT chunk_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM w),
m AS (SELECT nt.query_id, nt.n, p.chunk_id, p.term, p.pos FROM nt JOIN post p USING (term)),
full_ AS (SELECT query_id, chunk_id FROM m GROUP BY query_id, chunk_id, n HAVING count(DISTINCT term) = n),
occ AS (SELECT m.* FROM m JOIN full_ USING (query_id, chunk_id)),
lasts AS (SELECT r.query_id, r.chunk_id, r.n, r.pos, o.term, max(o.pos) AS l FROM occ r JOIN occ o ON o.query_id = r.query_id AND o.chunk_id = r.chunk_id AND o.pos <= r.pos GROUP BY r.query_id, r.chunk_id, r.n, r.pos, o.term),
lo AS (SELECT query_id, chunk_id, pos, min(l) AS low FROM lasts GROUP BY query_id, chunk_id, n, pos HAVING count(*) = n),
cov AS (SELECT query_id, chunk_id, low, min(pos) - low + 1 AS size FROM lo GROUP BY query_id, chunk_id, low),
ranked AS (SELECT query_id, chunk_id, round(sum(CASE WHEN size <= 16 THEN 1.0::DOUBLE ELSE 16.0::DOUBLE / size END), 6) AS rank FROM cov GROUP BY query_id, chunk_id)"""
_TEXT_TOP = """,
tt AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, chunk_id) AS INTEGER) AS text_rank FROM ranked),
ttk AS (SELECT * FROM tt WHERE text_rank <= 50)"""
_VECTOR_TOP = """,
qv AS (SELECT {id} AS query_id, qvec FROM v_qvec),
vd AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_distance(CAST(qvec AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS distance FROM qv, {source}),
vt AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS vector_rank FROM vd),
vtk AS (SELECT * FROM vt WHERE vector_rank <= 50)"""
_BOTH = "(SELECT e.vec_id, e.embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.text <> '')"
_FUSED = duck("v_qtext", "v_qvec") + _TEXT + _TEXT_TOP + _VECTOR_TOP.format(id="query_id // 20", source=_BOTH) + """,
ff AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, text_rank, vector_rank,
  round(coalesce(0.3::DOUBLE / (64 + text_rank), 0) + coalesce(0.7::DOUBLE / (64 + vector_rank), 0), 12) AS rrf_score
  FROM ttk a FULL JOIN (SELECT * FROM vtk WHERE query_id IN (SELECT query_id FROM q)) b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS INTEGER) AS fused_rank FROM ff),
fused AS (SELECT * FROM fr WHERE fused_rank <= 100)"""  # fmt: skip
_DOCS = "(SELECT doc_id, text, concat_ws('/', lang, source) AS path, concat('T', chr(10), source) AS title, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE concat('J', lang) END AS journal_ref, concat('https://www.doi.org/10.1/', CAST(doc_id AS VARCHAR)) AS doi_url FROM documents)"
_CITATION = "concat('[', concat_ws('. ', nullif(replace(title, chr(10), ' '), ''), nullif(replace(journal_ref, chr(10), ' '), '')), '](', doi_url, ')')"
_SNIPPET = r"substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 160)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    journal = "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE concat('J', lang) END journal_ref"
    return table(spark, sf_dir, "documents").selectExpr("doc_id document_id", r"concat('T\n', source) title", journal, "concat('https://www.doi.org/10.1/', doc_id) doi_url")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "text", F.to_json(F.struct(F.concat_ws("/", "lang", "source").alias("path"))).alias("metadata"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; embedding is null where none is stored, which only the vector branch minds."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return _texts(spark, sf_dir).join(vectors, "chunk_id", "left")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All queries; those without a stored vector have a null qvec and run on text alone."""
    vectors = view(spark, sf_dir, "v_qvec").select((F.col("query_id") / 20).cast("long").alias("query_id"), "qvec")
    return ts.normal_queries(view(spark, sf_dir, "v_qtext")).join(vectors, "query_id", "left")


@query(duck("v_qtext") + r" SELECT query_id, trim(regexp_replace(query, '\s+', ' ', 'g')) AS query FROM v_qtext WHERE trim(regexp_replace(query, '\s+', ' ', 'g')) <> ''")
def r01_normal_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.normal_queries(view(spark, sf_dir, "v_qtext"))


@query(f"""
SELECT item_id AS query_id, list_sort(list_distinct(regexp_extract_all(lower(concat(string_split_regex(text, '\\s+')[1], ' ', string_split_regex(text, '\\s+')[-1])), '{_WORD}'))) AS must,
  list_sort(list_distinct(regexp_extract_all(lower(string_split_regex(text, '\\s+')[2]), '{_WORD}'))) AS must_not FROM benchmark""")
def r02_parsed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", r"\s+")
    asked = F.concat_ws(" ", F.try_element_at(words, F.lit(1)), F.concat(F.lit("-"), F.try_element_at(words, F.lit(2))), F.try_element_at(words, F.lit(-1)))
    first = F.try_element_at(ts.parsed(asked), F.lit(1))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_sort(first["must"]).alias("must"), F.array_sort(first["must_not"]).alias("must_not"))


def _posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.postings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))


@query(duck("v_qtext") + _TEXT + " SELECT query_id, chunk_id, rank FROM ranked")
def r04_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches with their rank."""
    return ts.ranked(view(spark, sf_dir, "v_qtext"), _posted(spark, sf_dir))


@query(duck("v_qtext") + _TEXT + _TEXT_TOP + " SELECT query_id, chunk_id, rank, text_rank FROM ttk")
def r05_text_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.text_top_k(view(spark, sf_dir, "v_qtext"), _posted(spark, sf_dir), 50)


@query(duck("v_qvec") + _VECTOR_TOP.format(id="query_id", source=_BOTH) + " SELECT query_id, chunk_id, distance, vector_rank FROM vtk")
def r06_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vs.vector_top_k(view(spark, sf_dir, "v_qvec"), _chunks(spark, sf_dir).where("text <> ''"), 50)


@query(duck("v_qvec") + """,
d AS (SELECT q.query_id, e.vec_id AS chunk_id, q.label, round(list_cosine_distance(CAST(q.qvec AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS distance FROM v_qvec q JOIN embeddings e ON e.label = q.label),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS vector_rank FROM d)
SELECT query_id, chunk_id, distance, vector_rank FROM t WHERE vector_rank <= 200""")
def r07_vector_top_k_in_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label is a data set: queries meet vectors of their own only. Pairs without a distance come last."""
    from pyspark.sql import Window

    q, c = view(spark, sf_dir, "v_qvec"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    near = vs.vector_top_k(q, c, 200, "label").drop("vector_rank")
    long = lambda x: F.coalesce(v.norm(F.col(x)) > 0, F.lit(False))
    short = q.where(~long("qvec")).join(c, "label").unionByName(q.where(long("qvec")).join(c.where(~long("embedding")), "label"))
    none = F.when(F.col("qvec").isNotNull() & F.col("embedding").isNotNull(), F.lit(float("nan")))
    rows = near.unionByName(short.select("query_id", "chunk_id", none.alias("distance")))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "chunk_id")
    return rows.withColumn("vector_rank", F.row_number().over(order)).where("vector_rank <= 200")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.hybrid_retrieve(_chunks(spark, sf_dir), _queries(spark, sf_dir), posted=_posted(spark, sf_dir))


@query(_FUSED + " SELECT query_id, chunk_id, text_rank, vector_rank, rrf_score, fused_rank FROM fused")
def r08_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


@query(_FUSED + f" SELECT query_id, chunk_id, rrf_score, fused_rank, {_CITATION} AS citation, {_SNIPPET} AS snippet, path FROM fused JOIN {_DOCS} d ON d.doc_id = chunk_id")
def r09_hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid candidates with document columns, path, citation and snippet."""
    found = fu.with_documents(_found(spark, sf_dir), _texts(spark, sf_dir), _documents(spark, sf_dir))
    return found.select("query_id", "chunk_id", "rrf_score", "fused_rank", "citation", "snippet", "path")


@query(_FUSED.replace("<= 50", "<= 20").replace("0.3::", "0.6::").replace("0.7::", "0.25::").replace("(64 +", "(10 +").replace("<= 100", "<= 25") + " SELECT query_id, chunk_id, text_rank, vector_rank, rrf_score, fused_rank FROM fused")
def r09_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same retrieval called from SQL for every query, with parameters of its own."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    fu.register_hybrid_retrieve(spark, "hybrid_retrieve", _texts(spark, sf_dir), vectors=vectors)
    call = "hybrid_retrieve(q.query, q.qvec, text_k => 20, vec_k => 20, fused_k => 25, rrf_k => 10, text_w => 0.6D, vec_w => 0.25D)"
    # The queries are written first, so that Spark knows how few they are and sends them to words and vectors.
    return spark.sql(f"SELECT q.query_id, f.* FROM {{asked}} q, LATERAL {call} f", asked=staged(_queries(spark, sf_dir)))


def _recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query the number of its exact ten nearest, and how many of them the search by sign codes finds."""
    q, c = view(spark, sf_dir, "v_qvec"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    near = vs.approximate_top_k(q, vs.vector_index(c), 10).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    met = vs.vector_top_k(q, c, 10).join(near, ["query_id", "chunk_id"], "left")
    return met.groupBy("query_id").agg(F.count("*").alias("nearest"), F.count("hit").alias("hits"))


@query()
def r11_approximate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact ten nearest that the search by sign codes finds, for each query."""
    return _recall(spark, sf_dir).select("query_id", (F.col("hits") / F.col("nearest")).alias("recall"))


@query(duck("v_qvec") + """,
d AS (SELECT query_id, vec_id, round(list_cosine_distance(CAST(qvec AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS distance FROM v_qvec, embeddings),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS vector_rank FROM d WHERE isfinite(distance))
SELECT query_id, count(*) AS nearest, true AS enough FROM t WHERE vector_rank <= 10 GROUP BY query_id""")
def r11_approximate_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every query's recall is 0.9 or more, beside the number of its exact neighbours."""
    return _recall(spark, sf_dir).select("query_id", "nearest", (10 * F.col("hits") >= 9 * F.col("nearest")).alias("enough"))


@query(f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents WHERE text <> ''),
p AS (SELECT doc_id, unnest(w) AS term FROM w) SELECT term, count(DISTINCT doc_id) AS chunks, count(*) AS places FROM p GROUP BY term""")
def r12_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.document_frequencies(_posted(spark, sf_dir))


@query("SELECT event_type, count(*) AS found FROM events WHERE json_type(CAST(props AS JSON)) = 'OBJECT' GROUP BY event_type")
def r13_metadata_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of rows whose metadata is an object at all; the lookup itself is r13_containment_lookup."""
    is_object = F.schema_of_variant(F.try_parse_json("props")).startswith("OBJECT")
    return table(spark, sf_dir, "events").where(is_object).groupBy("event_type").agg(F.count("*").alias("found"))


@query("""SELECT event_id, event_type FROM events WHERE json_contains(CAST(props AS JSON), '{"k": 42}')""")
def r13_containment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose metadata contains a key with a value."""
    return lookup.containing(table(spark, sf_dir, "events"), "props", {"k": 42}).select("event_id", "event_type")


_RERANK = f""",
c AS (SELECT f.*, list_distinct(regexp_extract_all(lower(q.query), '{_WORD}')) AS a, list_distinct(regexp_extract_all(lower(d.text), '{_WORD}')) AS b FROM fused f JOIN q USING (query_id) JOIN documents d ON d.doc_id = f.chunk_id),
s AS (SELECT query_id, chunk_id, fused_rank, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 9) AS relevance_score FROM c)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, queries = _texts(spark, sf_dir), _queries(spark, sf_dir)
    # The few results are written before they meet the texts, and again with them, as scores and order both use them.
    return staged(staged(_found(spark, sf_dir)).join(texts.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", "query"), "query_id"))


@query(_FUSED + _RERANK + " SELECT query_id, chunk_id, relevance_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, fused_rank) AS INTEGER) AS relevance_rank FROM s")
def x01_scored_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and their order, with checks."""
    return fu.scored(_candidates(spark, sf_dir)).select("query_id", "chunk_id", "relevance_score", "relevance_rank")


@query(_FUSED + _RERANK + """,
g AS (SELECT f.query_id, f.chunk_id, f.fused_rank, CASE WHEN s.fused_rank % 2 = 1 THEN s.relevance_score END AS relevance_score FROM fused f JOIN s ON s.query_id = f.query_id AND s.chunk_id = f.chunk_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC NULLS LAST, fused_rank) AS INTEGER) AS final_rank FROM g)
SELECT query_id, chunk_id, relevance_score, final_rank FROM r WHERE final_rank <= 10""")
def x04_merged_reranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer that answers for every other candidate: those first, the others after them, then the cut."""
    rows = _candidates(spark, sf_dir)
    answered = fu.scored(rows).where("fused_rank % 2 = 1")
    return fu.reranked(rows.drop("text", "query"), answered, 10).select("query_id", "chunk_id", "relevance_score", "final_rank")


@query(_FUSED + _RERANK + f""",
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, fused_rank) AS INTEGER) AS final_rank FROM s)
SELECT query_id, chunk_id, final_rank, {_CITATION} AS citation FROM r JOIN {_DOCS} d ON d.doc_id = chunk_id WHERE final_rank <= 10""")
def r16_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From queries to reranked passages with citations."""
    rows, texts = _candidates(spark, sf_dir), _texts(spark, sf_dir)
    best = fu.reranked(rows.drop("text", "query"), fu.scored(rows), 10)
    return fu.with_documents(best, texts, _documents(spark, sf_dir)).select("query_id", "chunk_id", "final_rank", "citation")


_METRICS = duck("v_qvec", "v_qrels") + _VECTOR_TOP.format(id="query_id", source="embeddings").replace("<= 50", "<= 200") + """,
p AS (SELECT v.query_id, v.chunk_id AS doc_id, v.vector_rank AS rank, v.distance, r.grade FROM vtk v LEFT JOIN v_qrels r ON r.query_id = v.query_id AND r.doc_id = v.chunk_id),
i AS (SELECT query_id, count(*) FILTER (WHERE grade > 0) AS relevant, sum(CASE WHEN k <= 10 THEN (pow(2, grade) - 1) / log2(k + 1) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS k FROM v_qrels) GROUP BY query_id),
f AS (SELECT query_id, count(*) FILTER (WHERE grade > 0 AND rank <= 50) AS h50, count(*) FILTER (WHERE grade > 0 AND rank <= 100) AS h100, count(*) FILTER (WHERE grade > 0 AND rank <= 200) AS h200,
  sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) END) AS dcg, min(CASE WHEN grade > 0 THEN rank END) AS first_ FROM p GROUP BY query_id),
m AS (SELECT q.query_id, round(coalesce(h50::DOUBLE / relevant, 0), 6) AS recall_50, round(coalesce(h100::DOUBLE / relevant, 0), 6) AS recall_100, round(coalesce(h200::DOUBLE / relevant, 0), 6) AS recall_200,
  round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(1.0::DOUBLE / first_, 0), 6) AS mrr FROM v_qvec q LEFT JOIN f USING (query_id) LEFT JOIN i USING (query_id))"""


def _pairs(spark: SparkSession, sf_dir: str, sizes: tuple[int, ...] = (64,)) -> DataFrame:
    """Ranked and judged results of models, which keep the first so many components of each vector."""
    c, q, qrels = table(spark, sf_dir, "embeddings"), view(spark, sf_dir, "v_qvec"), view(spark, sf_dir, "v_qrels")
    k = ev.clamped_cutoff(200, c.count())
    runs = []
    for size in sizes:
        asked, vectors = q.select("query_id", F.slice("qvec", 1, size).alias("qvec")), c.select(F.col("vec_id").alias("chunk_id"), F.slice("embedding", 1, size).alias("embedding"))
        runs.append(vs.vector_top_k(asked, vectors, k).select(F.lit(f"first {size}").alias("model_key"), "query_id", F.col("chunk_id").alias("doc_id"), F.col("vector_rank").alias("rank"), "distance"))
    return ev.pair_rows(reduce(DataFrame.unionByName, runs), qrels)


@query("""
WITH l AS (SELECT doc_id % 97 AS query_id, array_agg(source ORDER BY doc_id) AS r FROM documents GROUP BY 1),
f AS (SELECT query_id, list_filter(r, lambda x: x <> 'src3') AS r FROM l),
x AS (SELECT query_id, len(r) AS n, unnest(r) AS doc_id, unnest(range(len(r))) AS pos FROM f)
SELECT query_id, doc_id, CAST(max(n - pos) AS INTEGER) AS grade FROM x GROUP BY query_id, doc_id""")
def v01_judgements_from_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 97).alias("query_id"), "doc_id", F.when(F.col("source") != "src3", F.col("source")).otherwise("").alias("s"))
    lists = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "s"))), lambda x: x["s"]).alias("relevance"))
    return ev.judgements_from_lists(lists)


@query("""
WITH l AS (SELECT doc_id % 97 AS query_id, array_agg(source ORDER BY doc_id) AS r FROM documents GROUP BY 1),
x AS (SELECT query_id, len(r) AS n, unnest(r) AS doc_id, unnest(range(len(r))) AS pos FROM l)
SELECT query_id, doc_id, CAST(CASE WHEN query_id % 3 = 2 THEN count(*) ELSE max(n - pos) END AS INTEGER) AS grade FROM x GROUP BY query_id, doc_id""")
def v01_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance as a list, as a list in the metadata alone, and as a map beside another in the metadata."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 97).alias("query_id"), "doc_id", "source")
    lists = rows.groupBy("query_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "source"))), lambda x: x["source"])).alias("listed"))
    counts = rows.groupBy("query_id", "source").count().groupBy("query_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", "count")))).alias("counted"))
    both, kind = lists.join(counts, "query_id"), F.col("query_id") % 3
    in_metadata = lambda x: F.concat(F.lit('{"dataset": "d", "relevance": '), x, F.lit("}"))
    own = F.when(kind == 0, F.col("listed")).when(kind == 2, F.col("counted"))
    return ev.judgements(both.select("query_id", own.alias("relevance"), F.when(kind == 1, in_metadata("listed")).when(kind == 2, in_metadata("listed")).alias("metadata")))


@query(duck("v_qrels") + " SELECT q.query_id, q.doc_id, q.grade FROM v_qrels q JOIN labels l ON l.doc_id = q.doc_id")
def v02_known_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "labels").select("doc_id", F.lit(None).cast("string").alias("source_id"))
    return ev.known_only(view(spark, sf_dir, "v_qrels"), docs)


@query("""
WITH r AS (SELECT lang AS dataset, source AS text, doc_id AS n FROM documents)
SELECT dataset, text, min(n) AS n, sha256(concat(dataset, chr(31), text)) AS query_id FROM r WHERE text <> 'src1' GROUP BY dataset, text""")
def v03_registered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("dataset"), F.col("source").alias("text"), F.col("doc_id").alias("n"))
    stored = rows.where("text = 'src1'").select("dataset", "text").distinct().withColumn("query_id", F.md5("text"))
    return ev.register_queries(stored, rows)[0]


@query(_METRICS + " SELECT * FROM m")
def v04_query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at three cuts, nDCG and reciprocal rank."""
    return ev.query_metrics(view(spark, sf_dir, "v_qvec").select("query_id"), _pairs(spark, sf_dir), view(spark, sf_dir, "v_qrels"))


@query(_METRICS + " SELECT query_id, doc_id, rank, distance, grade, round(1 - distance, 9) AS score FROM p")
def v07_pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("score", F.round("score", 9)).drop("model_key")


def _summary(size: int) -> str:
    cut = _METRICS.replace("CAST(qvec AS DOUBLE[])", f"CAST(qvec AS DOUBLE[])[1:{size}]").replace("CAST(embedding AS DOUBLE[])", f"CAST(embedding AS DOUBLE[])[1:{size}]")
    means = ", ".join(f"round(avg({x}), 6) AS mean_{x}" for x in ("recall_50", "recall_100", "recall_200", "ndcg", "mrr"))
    return f"SELECT * FROM ({cut} SELECT 'first {size}' AS model_key, count(*) AS queries, {means} FROM m)"


@query(" UNION ALL ".join(map(_summary, (32, 64))))
def v08_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of a run over all enabled models; the model's key is a grouping column, so many models are one job."""
    chosen = ev.selected_models({"first 16": False, "first 32": True, "first 64": True})
    queries = view(spark, sf_dir, "v_qvec").select("query_id", F.explode(F.array(*map(F.lit, chosen))).alias("model_key"))
    pairs = _pairs(spark, sf_dir, tuple(int(key.split()[1]) for key in chosen))
    return ev.run_summary(ev.query_metrics(queries, pairs, view(spark, sf_dir, "v_qrels"), by=("model_key",)), ["model_key"])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def v09_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.latency(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("SELECT doc_id, concat(CASE WHEN lang = 'en' THEN 'query: ' WHEN lang = 'de' THEN 'passage: ' WHEN lang = 'fr' THEN concat('Instruct: Given a web search query, retrieve relevant passages that answer the query', chr(10), 'Query:') ELSE '' END, source) AS prepared FROM documents")
def e02_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("lang").isin("en", "de"), "e5").when(F.col("lang") == "fr", "instruct").otherwise("other")
    return table(spark, sf_dir, "documents").select("doc_id", e.prefixed(F.col("source"), model, F.col("lang") != "de").alias("prepared"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / CASE WHEN sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) = 0 THEN 1 ELSE sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) END, 6)) AS unit FROM embeddings")
def e03_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(v.unit(F.col("embedding")), lambda x: v.rounded(x, 6)).alias("unit"))


@query("""
WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, round(avg(x), 6) AS x FROM x GROUP BY label, i)
SELECT label, list(x ORDER BY i) AS mean FROM m GROUP BY label""")
def e04_mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = e.mean_pooled(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return pooled.select("label", F.transform("mean", lambda x: v.rounded(x, 6)).alias("mean"))


#: The default encoder in SQL: each distinct word's CRC-32, bit by bit, gives a place and a sign.
_ENCODED = r"""
WITH d AS (SELECT doc_id AS id, text FROM documents WHERE text <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings)),
w AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS w FROM d),
h AS (
  SELECT w, xor(list_reduce(list_transform(range(0, length(hex(encode(w))), 2), lambda i: CAST(CONCAT('0x', substr(hex(encode(w)), CAST(i + 1 AS INTEGER), 2)) AS BIGINT)),
    lambda a, x: list_reduce(range(8), lambda b, y: xor(b >> 1, CAST(3988292384 AS BIGINT) * (b & 1)), xor(a, x)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS h
  FROM (SELECT DISTINCT w FROM w)),
x AS (SELECT id, h % 64 AS i, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM w JOIN h USING (w) GROUP BY id, h % 64),
n AS (SELECT id, sqrt(sum(x * x)) AS n FROM x GROUP BY id)"""


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a vector, as (id, text)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti")


@query()
def e06_missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeds the documents that have no vector yet, checks and normalises."""
    return e.embedded(_missing(spark, sf_dir), e.hashed_features(64), 64)[0]


@query(_ENCODED + " SELECT d.id, CAST(x.i AS INTEGER) AS place, round(CAST(CAST(x.x / n.n AS FLOAT) AS DOUBLE), 6) AS part FROM d JOIN x USING (id) JOIN n USING (id) WHERE x.x <> 0")
def e06_embedded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of `e06_missing_embeddings` by their parts that aren't zero."""
    parts = e06_missing_embeddings(spark, sf_dir).select("id", F.posexplode("embedding").alias("place", "part"))
    return parts.where("part <> 0").select("id", "place", v.rounded(F.col("part").cast("double"), 6).alias("part"))


def _fails_at_sevens(texts: list[str]) -> object:
    """An encoder that can't take texts whose length seven divides."""
    if any(len(x) % 7 == 0 for x in texts):
        raise ValueError("unreadable")
    return e.hashed_features(8)(texts)


@query("SELECT doc_id AS id, 'ValueError: unreadable' AS error FROM documents WHERE text <> '' AND length(text) % 7 = 0 AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def s12_rejected_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an encoder fails at is recorded by the pass that embeds the rest."""
    return e.embedded(_missing(spark, sf_dir), _fails_at_sevens, 8, batch=1)[1]


@query("""
SELECT a.label, a.vec_id AS a, b.vec_id AS b, CASE WHEN a.vec_id = b.vec_id THEN 1.0 ELSE round(1 - list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) END AS similarity
FROM embeddings a JOIN embeddings b ON a.label = b.label""")
def e07_group_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.group_similarity(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", most=None)
