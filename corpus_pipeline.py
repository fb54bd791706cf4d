"""The corpus pipeline: five training-data operators, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import packing, rules, suffixes, toxicity
from corpusmill.llm.neardup import near_duplicates
from corpusmill.llm.queries import TOKENIZER, table
from corpusmill.plans.staging import staged


def _free(docs: DataFrame, name: str) -> str:
    """`name`, or a longer one that `docs` doesn't have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled documents, doesn't find toxic.

    Null and empty texts stay; rows that are equal, or share a text, get the same decision; columns are
    passed on whatever their names; an empty table stays empty.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't outliers of their language and source.

    Null and empty texts have no words and go. Rows with the same id, text, language and source get the
    same decision; null ids, languages and sources count as values. Columns are passed on whatever
    their names; an empty table stays empty.
    """
    parts = ["doc_id", "text", "lang", "source"]
    key = F.xxhash64(*parts, *(F.isnull(c) for c in parts))
    kept = rules.judged(docs.select(key.alias("doc_id"), "text", "lang", "source")).where("kept")
    name = _free(docs, "row_key")
    return docs.withColumn(name, key).join(kept.select(F.col("doc_id").alias(name)).distinct(), name, "left_semi").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Of rows that share an id, the one with the least content hash stays, whatever their order. Rows
    without an id, null texts and texts without words are copies of nothing and stay; columns are passed
    on whatever their names; an empty table stays empty.
    """
    kept = near_duplicates(docs.where("doc_id is not null")).where("kept").select("doc_id").distinct()
    name = _free(docs, "content")
    content = F.struct(F.isnull("text"), F.xxhash64("text"), F.xxhash64(*docs.columns))
    same = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*docs.columns).withColumn(name, content)
    least = same.groupBy("doc_id").agg(F.min(name).alias(name))
    # Rows that are left with one id are equal, so it doesn't matter which of them stays.
    one = same.join(least, ["doc_id", name], "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null"))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of an earlier document; a character that loses a byte goes; n_chars follows.

    Null texts stay null. Rows that share an id keep what they have in common with each other; a null
    id counts as the largest. Columns are passed on whatever their names; an empty table stays empty.
    """
    rest = [c for c in docs.columns if c != "text"]
    found = suffixes.without_repeats(docs, [F.struct(*rest).alias("row"), F.isnull("text").alias("empty")], as_text=True)
    texts = found.select(*(F.col("carried.row")[c].alias(c) for c in rest), F.when(~F.col("carried.empty"), F.col("kept")).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the packed sequences.

    A null or empty text is its end token alone; rows with a repeated or null id are documents of
    their own; other columns don't matter; an empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("near dedup", near_dedup_stage),
    ("suffix dedup", suffix_dedup_stage),
    ("packing", packing_stage),
]
#: A trained classifier, robust estimates and library tokens have no SQL form; tests hold the operators, not this chain, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents table; what a stage gives is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
