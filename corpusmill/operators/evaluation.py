"""Retrieval quality against graded judgements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.staging import staged


def judgements_from_lists(rows: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade) of (query_id, relevance array<string>): length less place; empty ids go first, a repeated id keeps its first grade."""
    ids = rows.select("query_id", F.filter("relevance", lambda x: F.coalesce(x != "", F.lit(False))).alias("r"))
    each = ids.select("query_id", F.size("r").alias("n"), F.posexplode("r").alias("pos", "doc_id"))
    return each.groupBy("query_id", "doc_id").agg((F.max(F.col("n") - F.col("pos"))).cast("int").alias("grade"))


def judgements_from_maps(rows: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade) of (query_id, relevance map<string,int>)."""
    return rows.select("query_id", F.explode("relevance").alias("doc_id", "grade")).select("query_id", "doc_id", F.col("grade").cast("int"))


def judgements(rows: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade) of rows (query_id, relevance, metadata), both JSON texts.

    A row's own relevance wins over the one in its metadata; none in either, or a JSON null, judges
    nothing. A list grades by place, as `judgements_from_lists`, a map by its numbers; anything else is an error.
    """
    given = lambda x: F.nullif(F.nullif(F.trim(x), F.lit("null")), F.lit(""))
    text = F.coalesce(given(F.col("relevance")), given(F.get_json_object("metadata", "$.relevance")))
    known = rows.select("query_id", text.alias("text")).where("text is not null")
    wrong = F.raise_error(F.concat(F.lit("relevance of query "), F.col("query_id").cast("string"), F.lit(" is neither a list nor a map")))
    is_list, is_map = F.startswith("text", F.lit("[")), F.startswith("text", F.lit("{"))
    # Each form is read inside its own branch, so that no order of filters meets the error of the other.
    read = lambda mine, kind: F.when(F.coalesce(mine, F.lit(False)), F.coalesce(F.from_json("text", kind), wrong.cast(kind)))
    other = F.when(F.col("text").isNotNull() & ~is_list & ~is_map, wrong)
    forms = known.select("query_id", read(is_list, "array<string>").alias("listed"), read(is_map, "map<string,int>").alias("mapped"), other.alias("other")).where("other is null")
    lists = judgements_from_lists(forms.where("listed is not null").select("query_id", F.col("listed").alias("relevance")))
    return lists.unionByName(judgements_from_maps(forms.where("mapped is not null").select("query_id", F.col("mapped").alias("relevance"))))


def known_only(qrels: DataFrame, documents: DataFrame) -> DataFrame:
    """Judgements of documents that are there, by their own ids; others don't count anywhere."""
    names = documents.select(F.coalesce("source_id", F.col("doc_id").cast("string")).alias("name"), F.col("doc_id").alias("own"))
    return qrels.join(names, qrels["doc_id"].cast("string") == names["name"]).select("query_id", F.col("own").alias("doc_id"), "grade")


def register_queries(stored: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New distinct texts of a dataset to append, and the text's id of every row."""
    fresh = rows.groupBy("dataset", "text").agg(F.min("n").alias("n")).join(stored, ["dataset", "text"], "left_anti").withColumn("query_id", F.sha2(F.concat_ws("\x1f", "dataset", "text"), 256))
    known = stored.select("dataset", "text", "query_id").unionByName(fresh.select("dataset", "text", "query_id"))
    return fresh, rows.join(known, ["dataset", "text"])


def pair_rows(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Ranked results (query_id, doc_id, rank, distance) with score and grade, null where unjudged."""
    return ranked.join(qrels, ["query_id", "doc_id"], "left").withColumn("score", 1 - F.col("distance"))


def query_metrics(queries: DataFrame, pairs: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = (50, 100, 200), ndcg_at: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Recall at cuts, nDCG and reciprocal rank of every query; those without results or judgements have 0.

    `by` names more grouping columns of queries and pairs, as a model's key.
    """
    keys = [*by, "query_id"]
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))
    ideal = qrels.withColumn("k", place).groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("relevant"), F.sum(F.when(F.col("k") <= ndcg_at, gain(F.col("grade")) / F.log2(F.col("k") + 1))).alias("ideal"))
    hit = F.col("grade") > 0
    found = pairs.groupBy(*keys).agg(
        *(F.count_if(hit & (F.col("rank") <= c)).alias(f"hits_{c}") for c in cuts),
        F.sum(F.when(F.col("rank") <= ndcg_at, gain(F.col("grade")) / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
    )
    rows = queries.select(*keys).distinct().join(found, keys, "left").join(ideal, "query_id", "left")
    or_zero = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    recall = [or_zero(F.try_divide(F.col(f"hits_{c}"), F.col("relevant"))).alias(f"recall_{c}") for c in cuts]
    return rows.select(*keys, *recall, or_zero(F.try_divide(F.col("dcg"), F.col("ideal"))).alias("ndcg"), or_zero(1 / F.col("first")).alias("mrr"))


def run_summary(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Means over a run's queries."""
    names = [c for c in metrics.columns if c.startswith("recall_") or c in ("ndcg", "mrr")]
    return metrics.groupBy(*by).agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 6).alias(f"mean_{c}") for c in names))


#: Values of a group that are put in order at once; ranges into which wider ones are cut in a round.
GATHERED, RANGES = 10_000, 4096


def percentiles(rows: DataFrame, value: str, by: list[str], shares: list[float]) -> DataFrame:
    """(by, share, at): exact percentiles with linear interpolation of every group's values; nulls and what is no finite number don't count.

    A percentile lies between two values by their rank. Ranges of values that hold those ranks are
    cut into RANGES, whose rows are counted, and the one that a rank falls into goes on, until it holds
    one value or GATHERED rows at most. So no task holds more than that, or the counts of the ranges.
    """
    keys = [f"key{k}" for k in range(len(by))]
    values = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v) and abs(v) < double('inf')")
    spans = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    share = F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share")
    wanted = staged(spans.select("*", share).withColumn("place", F.col("share") * (F.col("n") - 1)))
    ranks = wanted.select(*keys, F.col("n").alias("rows"), "low", "high", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    ranks = staged(ranks.withColumn("before", F.lit(0).cast("long")))
    same = lambda a, b, names: reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names), F.lit(True))
    span = [*keys, "low", "high"]
    narrow = (F.col("rows") <= GATHERED) | (F.col("low") == F.col("high"))
    done, open_ = [ranks.where(narrow)], ranks.where(~narrow)
    while not open_.isEmpty():
        cut = F.floor((F.col("v.v") / 2 - F.col("s.low") / 2) / (F.col("s.high") / 2 - F.col("s.low") / 2) * RANGES).cast("int").alias("range_no")
        inside = same("v", "s", keys) & (F.col("v.v") >= F.col("s.low")) & (F.col("v.v") <= F.col("s.high"))
        met = values.alias("v").join(open_.select(*span).distinct().alias("s"), inside).select(*(F.col(f"s.{c}").alias(c) for c in span), cut, "v.v")
        counts = met.groupBy(*span, "range_no").agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        counts = staged(counts.withColumn("below", F.sum("c").over(Window.partitionBy(*span).orderBy("range_no")) - F.col("c")))
        rank = F.col("r.rank") - F.col("r.before")
        falls = same("r", "c", span) & (rank >= F.col("c.below")) & (rank < F.col("c.below") + F.col("c.c"))
        ranks = staged(open_.alias("r").join(counts.alias("c"), falls).select(
            *(F.col(f"r.{k}").alias(k) for k in keys), F.col("c.c").alias("rows"), F.col("c.least").alias("low"), F.col("c.most").alias("high"), "r.rank", (F.col("r.before") + F.col("c.below")).alias("before")))
        done.append(ranks.where(narrow))
        open_ = ranks.where(~narrow)
    found = reduce(lambda a, b: a.unionByName(b), done)
    inside = same("v", "s", keys) & (F.col("v.v") >= F.col("s.low")) & (F.col("v.v") <= F.col("s.high"))
    wide = found.where("low < high").select(*span).distinct()
    lists = values.alias("v").join(wide.alias("s"), inside).groupBy(*(F.col(f"s.{c}").alias(c) for c in span)).agg(F.array_sort(F.collect_list("v.v")).alias("values"))
    exact = F.coalesce(F.element_at("l.values", (F.col("f.rank") - F.col("f.before") + 1).cast("int")), F.col("f.low"))
    at = found.alias("f").join(lists.alias("l"), same("f", "l", span), "left").select(*(F.col(f"f.{k}").alias(k) for k in keys), "f.rank", exact.alias("at"))
    low, high = (wanted.alias("w").join(at.alias("a"), same("w", "a", keys) & (of("w.place") == F.col("a.rank"))).select(*(F.col(f"w.{k}").alias(k) for k in keys), "w.share", "w.place", "a.at") for of in (F.floor, F.ceil))
    part = F.col("l.place") - F.floor("l.place")
    out = low.alias("l").join(high.alias("h"), same("l", "h", [*keys, "share"]))
    return out.select(*(F.col(f"l.{k}").alias(c) for k, c in zip(keys, by, strict=True)), F.col("l.share").alias("share"), (F.col("l.at") * (1 - part) + F.col("h.at") * part).alias("at"))


def latency(rows: DataFrame, value: str, by: list[str], exact: bool = True) -> DataFrame:
    """50th, 95th and 99th percentiles with linear interpolation, exact in bounded memory, or faster and about right."""
    if not exact:
        return rows.groupBy(*by).agg(*(F.round(F.percentile_approx(value, p / 100, 10_000), 6).alias(f"p{p}") for p in (50, 95, 99)))
    found = percentiles(rows, value, by, [0.5, 0.95, 0.99])
    return found.groupBy(*by).agg(*(F.round(F.max(F.when(F.col("share") == p / 100, F.col("at"))), 6).alias(f"p{p}") for p in (50, 95, 99)))


def clamped_cutoff(k: int, documents: int, quantization: str = "fp32") -> int:
    """How many results a run can ask for; a run needs documents, and vectors are kept in single precision only."""
    if documents < 1:
        raise ValueError("there are no documents")
    if quantization != "fp32":
        raise ValueError(f"unsupported quantization {quantization!r}")
    return min(k, documents)


def selected_models(specs: dict[str, bool], keys: list[str] | None = None) -> list[str]:
    """The enabled models of a run, in the order of `specs`, or those of them that `keys` names; an unknown key is an error."""
    if unknown := sorted(set(keys or ()) - set(specs)):
        raise ValueError(f"unknown models: {', '.join(unknown)}")
    return [key for key, enabled in specs.items() if enabled and (keys is None or key in keys)]
