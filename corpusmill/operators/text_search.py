"""Full-text search: query syntax, postings, matching and cover-density rank for a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import collapse, terms
from corpusmill.plans.staging import staged

#: Covers up to this length count fully, longer ones in proportion.
COVER = 16
_MUST, _NOT, _PHRASE = 0, 1, 2


def normal_queries(queries: DataFrame) -> DataFrame:
    """Queries with collapsed white space; blank ones have no results and are left out."""
    return queries.withColumn("query", collapse(F.col("query"))).where("query <> ''")


def parsed(query: Column) -> Column:
    """Alternatives (parted by `or`) of a query: must and must_not terms, and phrases as arrays of terms.

    All words of an alternative are needed, `"…"` as they stand; `-` excludes a word or the words of
    a phrase.
    """
    alternatives = F.split(F.lower(query), r'\s+or\s+(?=(?:[^"]*"[^"]*")*[^"]*$)')

    def one(x: Column) -> Column:
        quoted = F.filter(F.transform(F.regexp_extract_all(x, F.lit(r'(?<!-)"([^"]*)"'), F.lit(1)), terms), lambda p: F.size(p) > 0)
        plain = F.regexp_replace(x, r'-?"[^"]*"', " ")
        words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
        banned = F.concat(F.filter(words, lambda w: w.startswith("-")), F.regexp_extract_all(x, F.lit(r'-"([^"]*)"'), F.lit(1)))
        flat = lambda xs: F.array_distinct(F.flatten(F.transform(xs, terms)))
        must = F.array_distinct(F.concat(flat(F.filter(words, lambda w: ~w.startswith("-"))), F.flatten(quoted)))
        return F.struct(must.alias("must"), quoted.alias("phrases"), flat(banned).alias("must_not"))

    return F.filter(F.transform(alternatives, one), lambda a: F.size(a["must"]) > 0)


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, pos) of every word of chunks (chunk_id, text) with a text."""
    return chunks.where("text <> ''").select("chunk_id", F.posexplode(terms(F.col("text"))).alias("pos", "term")).select("term", "chunk_id", "pos")


def document_frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count_distinct("chunk_id").alias("chunks"), F.count("*").alias("places"))


def _density(places: Column, n: Column) -> Column:
    """Sum over minimal covers of all n terms; places are (pos, k) in order, k numbering the terms from 0."""

    def step(s: Column, x: Column) -> Column:
        last = F.transform(s["last"], lambda p, k: F.when(k == x["k"], x["pos"]).otherwise(p))
        low = F.array_min(last)
        fresh = (low >= 0) & (low != s["low"])
        size = x["pos"] - low + 1
        worth = F.when(size <= COVER, 1.0).otherwise(COVER / size)
        return F.struct(last.alias("last"), F.when(low >= 0, low).otherwise(s["low"]).alias("low"), (s["score"] + F.when(fresh, worth).otherwise(0.0)).alias("score"))

    start = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.lit(-1).alias("low"), F.lit(0.0).alias("score"))
    return F.aggregate(places, start, step, lambda s: s["score"])


def _matches(queries: DataFrame, posted: DataFrame, inside: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the queries need, their words with places by chunk, and (query_id, alt, chunk_id, bound) of chunks that have all words of an alternative.

    No two minimal covers end at one place, and of those that hold one place of a word each begins
    with another word. So there are no more of them than places left when each word has had one, nor
    than words times the places of the rarest; `bound` is what they can be worth.
    """
    wanted = normal_queries(queries).select("query_id", F.posexplode(parsed(F.col("query"))).alias("alt", "a"))
    term = lambda kind, t, phrase, i, size: F.struct(F.lit(kind).alias("kind"), t.alias("term"), phrase.alias("phrase"), i.alias("i"), size.alias("size"))
    no, zero = F.lit(-1), F.lit(0)
    needed = F.concat(
        F.transform("a.must", lambda t, k: term(_MUST, t, no, k, zero)),
        F.transform("a.must_not", lambda t: term(_NOT, t, no, zero, zero)),
        F.flatten(F.transform("a.phrases", lambda p, j: F.transform(p, lambda t, i: term(_PHRASE, t, j, i, F.size(p))))),
    )
    rows = staged(wanted.select("query_id", "alt", F.size("a.must").alias("n"), F.size("a.phrases").alias("phrases"), F.inline(needed)))
    # Only the queries' words go on, once for all queries, with their places together; the terms are of known size, so few of them are sent to the postings.
    held = posted.join(rows.select("term").distinct(), "term", "left_semi").groupBy("chunk_id", "term").agg(F.collect_list("pos").alias("places"))
    held = staged(held.withColumn("n_places", F.size("places")))
    which = ["query_id", "alt", "chunk_id"]
    # Chunks with the rarest word of an alternative are looked up first, and only they for the other words.
    spread = held.groupBy("term").agg(F.count("*").alias("chunks"))
    musts = rows.where(F.col("kind") == _MUST).join(spread, "term", "left")
    rarest = staged(musts.groupBy("query_id", "alt").agg(F.min_by("term", F.struct(F.coalesce("chunks", F.lit(0)), "term")).alias("term"), F.first("n").alias("n")))
    likely = rarest.join(held.select("chunk_id", "term"), "term").drop("term")
    likely = likely if inside is None else likely.join(inside, "chunk_id", "left_semi")
    asked = likely.join(rows.where(F.col("kind") != _PHRASE).select("query_id", "alt", "kind", "term"), ["query_id", "alt"])
    # A word is there once in `held`, so counting them is enough.
    own = F.when(F.col("kind") == _MUST, F.col("n_places"))
    has = asked.join(held.select("chunk_id", "term", "n_places"), ["chunk_id", "term"]).groupBy(*which).agg(
        F.count(own).alias("found"), F.count_if(F.col("kind") == _NOT).alias("banned"), F.first("n").alias("n"), F.sum(own).alias("all"), F.min(own).alias("fewest"))
    covers = F.least(F.col("all") - F.col("n") + 1, F.col("n") * F.col("fewest"))
    bound = F.when(F.col("n") <= COVER, covers).otherwise(covers * F.lit(COVER) / F.col("n")).cast("double")
    matched = has.where((F.col("found") == F.col("n")) & (F.col("banned") == 0)).select(*which, bound.alias("bound"))
    return rows, held, matched


def _ranks(rows: DataFrame, held: DataFrame, matched: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank) of those matches (query_id, alt, chunk_id) that have their phrases too."""
    which = ["query_id", "alt", "chunk_id"]
    met = matched.select(*which).join(rows.where(F.col("kind") != _NOT), ["query_id", "alt"]).join(held, ["chunk_id", "term"])
    # Places are few bytes and much work, so Spark must not put them into few tasks by their size.
    spark = met.sparkSession
    met = met.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *which)
    met = met.groupBy(*which).agg(F.first("n").alias("n"), F.first("phrases").alias("phrases"), F.collect_list(F.struct("kind", "places", "phrase", "i", "size")).alias("m"))
    each = lambda x: F.transform(x["places"], lambda p: F.struct(x["kind"].alias("kind"), p.alias("pos"), x["phrase"].alias("phrase"), x["i"].alias("i"), x["size"].alias("size")))
    met = met.withColumn("m", F.flatten(F.transform("m", each)))
    of = lambda kind: F.filter("m", lambda x: x["kind"] == kind)
    places = F.array_sort(F.transform(of(_MUST), lambda x: F.struct(x["pos"].alias("pos"), x["i"].alias("k"))))
    met = met.select("query_id", "chunk_id", "n", "phrases", "m", places.alias("places"))
    # A phrase is there where all its words, each moved back by its place in it, stand at one place.
    moved = F.array_distinct(F.transform(of(_PHRASE), lambda x: F.struct(x["phrase"].alias("phrase"), (x["pos"] - x["i"]).alias("at"), x["i"].alias("i"), x["size"].alias("size"))))
    met = met.withColumn("moved", F.when(F.col("phrases") > 0, moved))
    whole = F.filter("moved", lambda s: F.size(F.filter("moved", lambda x: (x["phrase"] == s["phrase"]) & (x["at"] == s["at"]))) == s["size"])
    met = met.where((F.col("phrases") == 0) | (F.size(F.array_distinct(F.transform(whole, lambda x: x["phrase"]))) == F.col("phrases")))
    scored = met.select("query_id", "chunk_id", _density(F.col("places"), F.col("n")).alias("rank"))
    return scored.groupBy("query_id", "chunk_id").agg(F.round(F.max("rank"), 6).alias("rank"))


def ranked(queries: DataFrame, posted: DataFrame, inside: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, rank) of all chunks, or of those in `inside` (chunk_id), that match a query of queries (query_id, query).

    Postings are cut to the queries' terms; a chunk matches if it has all terms of an alternative,
    its phrases in neighbouring places, and none of the excluded ones. Which chunks have the terms is
    found first, and only they are joined with their places. rank is the best alternative's cover density.
    """
    return _ranks(*_matches(queries, posted, inside))


def text_top_k(queries: DataFrame, posted: DataFrame, k: int, inside: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, rank, text_rank) of each query's k best; none for k <= 0.

    Places are gathered only where a chunk can be among the k best: first for the 2k with the highest
    bounds, and then for those others whose bound reaches the k-th rank found.
    """
    rows, held, matched = _matches(queries, posted, inside)
    matched = staged(matched)
    each = matched.groupBy("query_id", "chunk_id").agg(F.max("bound").alias("bound"))
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "chunk_id")
    likely = staged(each.withColumn("nth", F.row_number().over(by_bound)).where(F.col("nth") <= 2 * k).select("query_id", "chunk_id"))
    # What goes to the places is written first, so that Spark knows how little it is.
    best = staged(_ranks(rows, held, staged(matched.join(likely, ["query_id", "chunk_id"], "left_semi"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("rank"), "chunk_id")
    reached = best.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).select("query_id", F.col("rank").alias("least"))
    others = matched.join(likely, ["query_id", "chunk_id"], "left_anti").join(reached, "query_id", "left")
    # Ranks are rounded, so a bound may be short by half a unit of the last digit.
    others = others.where(F.col("least").isNull() | (F.col("bound") + 1e-6 >= F.col("least"))).select("query_id", "chunk_id").distinct()
    more = _ranks(rows, held, staged(matched.join(others, ["query_id", "chunk_id"], "left_semi")))
    return best.unionByName(more).withColumn("text_rank", F.row_number().over(order)).where(F.col("text_rank") <= k)
