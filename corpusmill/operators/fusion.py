"""Reciprocal-rank fusion, hybrid retrieval and reranking for a table of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.operators import blocks, vector_search
from corpusmill.operators.text_search import postings, text_top_k
from corpusmill.operators.vector_search import vector_top_k
from corpusmill.plans.staging import staged


@dataclass(frozen=True)
class Params:
    text_k: int = 50
    vector_k: int = 50
    fused_k: int = 100
    rrf_k: int = 64
    text_weight: float = 0.3
    vector_weight: float = 0.7
    top_k: int = 10


def fused(text: DataFrame, vector: DataFrame, p: Params) -> DataFrame:
    """(query_id, chunk_id, text_rank, vector_rank, rrf_score, fused_rank) of both rankings; an absent rank adds nothing."""
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(max(p.rrf_k, 0)) + F.col(r)), F.lit(0.0))
    both = text.select("query_id", "chunk_id", "text_rank").join(vector.select("query_id", "chunk_id", "vector_rank"), ["query_id", "chunk_id"], "full_outer")
    both = both.withColumn("rrf_score", F.round(part(p.text_weight, "text_rank") + part(p.vector_weight, "vector_rank"), 12))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "chunk_id")
    return both.withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= max(p.fused_k, 0))


def hybrid_retrieve(chunks: DataFrame, queries: DataFrame, p: Params = Params(), posted: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Fused candidates for queries (query_id, query, qvec) among chunks (chunk_id, document_id, text, embedding).

    Both branches carry ids and ranks only. A null embedding or qvec leaves the chunk or query to the
    text branch. Blank queries have no results; `posted` may be stored postings.
    """
    asked = queries.where(F.trim(F.coalesce("query", F.lit(""))) != "") if "query" in queries.columns else queries
    inside = chunks.where(F.col("document_id").isNotNull())
    # Stored postings may be of more chunks; those of chunks without a document are left out among the matches, which are few.
    words = text_top_k(asked.select("query_id", "query"), posted if posted is not None else postings(inside), p.text_k, inside.select("chunk_id") if posted is not None else None)
    near = vector_top_k(asked.select("query_id", "qvec"), inside.where("text <> ''").select("chunk_id", "embedding"), p.vector_k)
    return fused(words, near, p)


def with_documents(found: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Text, snippet, document columns and citation, joined when only the results are left; and the path, where chunks have `metadata` as JSON."""
    path = [F.get_json_object("metadata", "$.path").alias("path")] if "metadata" in chunks.columns else []
    texts = chunks.select("chunk_id", "document_id", "text", *path)
    # Written first, so that Spark knows how few results there are and sends them to the texts, not the texts to them.
    rows = staged(found).join(texts, "chunk_id").join(documents, "document_id")
    return rows.withColumns({"snippet": t.snippet(F.col("text")), "citation": t.citation(F.col("title"), F.col("journal_ref"), F.col("doi_url"))})


def overlap_score(query: Column, passage: Column) -> Column:
    """The default scorer: shared distinct words over all."""
    a, b = F.array_distinct(t.terms(query)), F.array_distinct(t.terms(passage))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def scored(candidates: DataFrame, score: Column | None = None) -> DataFrame:
    """Candidates (query_id, chunk_id, query, text, fused_rank) with relevance_score and relevance_rank.

    Any column expression or Arrow function may score; equal scores go by the first place of the
    passage. ok tells whether all scores of a query are numbers.
    """
    value = overlap_score(F.col("query"), F.col("text")) if score is None else score
    rows = candidates.withColumn("relevance_score", F.round(value.cast("double"), 9))
    bad = F.col("relevance_score").isNull() | F.isnan("relevance_score") | (F.abs("relevance_score") == float("inf"))
    rows = rows.withColumn("ok", ~F.bool_or(bad).over(Window.partitionBy("query_id")))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance_score"), "fused_rank", "chunk_id")
    return rows.withColumn("relevance_rank", F.row_number().over(order))


def reranked(candidates: DataFrame, scores: DataFrame, top_k: int, enabled: bool = True) -> DataFrame:
    """Candidates in their final order, cut to top_k after reranking.

    scores are (query_id, chunk_id, relevance_score, ok): scored candidates first, by score; those
    without a score after them in fused order; scores of unknown chunks count for nothing. A query
    whose scores aren't ok, or all with `enabled` false, keep the fused order.
    """
    first = scores.groupBy("query_id", "chunk_id").agg(F.max("relevance_score").alias("relevance_score"), F.bool_and("ok").alias("ok"))
    rows = candidates.join(first, ["query_id", "chunk_id"], "left")
    use = F.lit(enabled) & F.coalesce(F.bool_and("ok").over(Window.partitionBy("query_id")), F.lit(False))
    rows = rows.withColumn("relevance_score", F.when(use, F.col("relevance_score"))).drop("ok")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("relevance_score"), "fused_rank", "chunk_id")
    return rows.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= top_k)


#: Arguments of the table function after query and embedding: name, type, and the parameter that gives the default.
_ARGUMENTS = [
    ("text_k", "INT", "text_k"), ("vec_k", "INT", "vector_k"), ("fused_k", "INT", "fused_k"), ("rrf_k", "INT", "rrf_k"),
    ("text_w", "DOUBLE", "text_weight"), ("vec_w", "DOUBLE", "vector_weight"),
]
_TERMS = r"regexp_extract_all(lower({0}), '(?U)[\\w]+', 0)"
#: A query's alternatives, as `text_search.parsed` has them.
_PARSED = rf"""
filter(transform(split(lower({{0}}), '\\s+or\\s+(?=(?:[^"]*"[^"]*")*[^"]*$)'), x -> named_struct(
  'must', array_distinct(concat(
    flatten(transform(filter(split(regexp_replace(x, '-?"[^"]*"', ' '), '\\s+'), w -> w <> '' AND NOT startswith(w, '-')), w -> {_TERMS.format("w")})),
    flatten(transform(regexp_extract_all(x, '(?<!-)"([^"]*)"', 1), w -> {_TERMS.format("w")})))),
  'phrases', filter(transform(regexp_extract_all(x, '(?<!-)"([^"]*)"', 1), w -> {_TERMS.format("w")}), w -> size(w) > 0),
  'must_not', array_distinct(flatten(transform(concat(
    filter(split(regexp_replace(x, '-?"[^"]*"', ' '), '\\s+'), w -> startswith(w, '-')), regexp_extract_all(x, '-"([^"]*)"', 1)), w -> {_TERMS.format("w")}))))),
  a -> size(a.must) > 0)"""
_RETRIEVE = """
WITH alts AS (SELECT alt, a.must AS must, a.phrases AS phrases, a.must_not AS must_not FROM (SELECT posexplode({parsed}) AS (alt, a))),
words AS (
  SELECT alt, size(must) AS n, transform(phrases, p -> transform(p, t -> array_position(must, t) - 1)) AS phrases, kind, k, term FROM alts
  LATERAL VIEW inline(concat(transform(must, (t, k) -> named_struct('kind', 0, 'k', k, 'term', t)), transform(must_not, t -> named_struct('kind', 1, 'k', 0, 'term', t)))) w),
met AS (
  SELECT alt, block, n, first(phrases) AS phrases, collect_list(struct(kind, k, ids, counts, places)) AS terms
  FROM words JOIN {name}_words USING (term) GROUP BY alt, block, n HAVING count_if(kind = 0) = n),
best AS (SELECT {name}_covers(n, phrases, terms, {name}.text_k) AS l FROM met),
ranked AS (SELECT chunk_id, round(max(rank), 6) AS rank FROM (SELECT inline_outer(l) FROM best) WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
by_text AS (SELECT chunk_id, row_number() OVER (ORDER BY rank DESC, chunk_id) AS r FROM ranked),
near AS (SELECT {name}_nearest({name}.embedding, ids, data, {name}.vec_k) AS l FROM {name}_vectors WHERE {name}.embedding IS NOT NULL AND trim({query}) <> ''),
by_vector AS (SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS r FROM (SELECT inline_outer(l) FROM near) WHERE chunk_id IS NOT NULL),
-- Both lists, of bounded length, as arrays: a union or outer join of what depends on arguments isn't allowed here.
lists AS (
  SELECT explode(concat(t.l, v.l)) AS c
  FROM (SELECT collect_list(struct(chunk_id, r AS text_rank, CAST(NULL AS INT) AS vector_rank)) AS l FROM by_text WHERE r <= {name}.text_k) t
  CROSS JOIN (SELECT collect_list(struct(chunk_id, CAST(NULL AS INT) AS text_rank, r AS vector_rank)) AS l FROM by_vector WHERE r <= {name}.vec_k) v),
one AS (SELECT c.chunk_id, max(c.text_rank) AS text_rank, max(c.vector_rank) AS vector_rank FROM lists GROUP BY c.chunk_id),
scores AS (
  SELECT *, round(coalesce({name}.text_w / (greatest({name}.rrf_k, 0) + text_rank), 0D) + coalesce({name}.vec_w / (greatest({name}.rrf_k, 0) + vector_rank), 0D), 12) AS rrf_score
  FROM one),
fused AS (SELECT *, row_number() OVER (ORDER BY rrf_score DESC, chunk_id) AS fused_rank FROM scores)
SELECT chunk_id, text_rank, vector_rank, rrf_score, fused_rank FROM fused WHERE fused_rank <= greatest({name}.fused_k, 0)"""


def register_hybrid_retrieve(spark: SparkSession, name: str, chunks: DataFrame, posted: DataFrame | None = None, vectors: DataFrame | None = None) -> None:
    """Makes hybrid retrieval a table function of SQL that computes, with the same results as `hybrid_retrieve`.

    `SELECT * FROM name('red fox', array(0.1F, …))` for one query, or for a table of them
    `SELECT q.query_id, f.* FROM queries q, LATERAL name(q.query, q.qvec, text_k => 20, vec_w => 0.5D) f`;
    arguments that are left out have the defaults of `Params`. It reads the views name_words (block, term,
    ids, counts, places) and name_vectors (ids, data), blocks of chunks, which are made here, and calls
    name_covers and name_nearest, which give what is best in a block. Words are those of the chunks' texts
    where no stored postings are given; `vectors` (chunk_id, embedding) may lie apart from the chunks.
    """
    inside = chunks.where(F.col("document_id").isNotNull())
    with_text = inside.where("text <> ''")
    own = with_text.select("chunk_id", "embedding") if vectors is None else vectors.join(with_text.select("chunk_id"), "chunk_id", "left_semi")
    # Vectors are few bytes and meet every query, so Spark must not put them into few tasks by their size.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    own = own.where("embedding is not null").repartition(tasks, "chunk_id")
    blocks.small_batches(spark)
    vector_search.packed(own, "chunk_id", "embedding").createOrReplaceTempView(f"{name}_vectors")
    blocks.word_blocks(blocks.worded(with_text) if posted is None else blocks.gathered(posted, inside)).createOrReplaceTempView(f"{name}_words")
    spark.udf.register(f"{name}_covers", F.arrow_udf(blocks.covers, blocks.COVERS))
    spark.udf.register(f"{name}_nearest", F.arrow_udf(blocks.nearest, blocks.NEAREST))
    query = f"coalesce({name}.query, '')"
    body = _RETRIEVE.format(name=name, query=query, parsed=_PARSED.format(f"trim(regexp_replace({query}, '(?U)\\\\s+', ' '))"))
    p = Params()
    more = ", ".join(f"{a} {kind} DEFAULT {getattr(p, of)}{'D' if kind == 'DOUBLE' else ''}" for a, kind, of in _ARGUMENTS)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(query STRING, embedding ARRAY<FLOAT>, {more})
        RETURNS TABLE (chunk_id BIGINT, text_rank INT, vector_rank INT, rrf_score DOUBLE, fused_rank INT) RETURN {body}""")


def register_table_function(spark: SparkSession, name: str, found: DataFrame) -> None:
    """Makes candidates callable from SQL: `SELECT * FROM name(query_id, k)`, a table function over a view.

    A parameter can't stand in LIMIT, so the cut is by rank.
    """
    found.createOrReplaceTempView(f"{name}_candidates")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(query BIGINT, k INT)
        RETURNS TABLE (chunk_id BIGINT, text_rank INT, vector_rank INT, rrf_score DOUBLE, fused_rank INT)
        RETURN SELECT c.chunk_id, c.text_rank, c.vector_rank, c.rrf_score, c.fused_rank FROM {name}_candidates c
        WHERE c.query_id = {name}.query AND c.fused_rank <= {name}.k""")
