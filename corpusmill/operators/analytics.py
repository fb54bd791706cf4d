"""What a corpus of documents and chunks holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_document(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, chunks, filled) of every document; chunks are counted before they meet documents."""
    counted = chunks.where("document_id is not null").groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("chunks"), F.count_if(F.col("text") != "").alias("filled"))
    return documents.select("doc_id").join(counted, "doc_id", "left").na.fill(0, ["chunks", "filled"])


def totals(counted: DataFrame) -> DataFrame:
    """One row over all documents; chunks without a document don't count."""
    of = lambda c: [F.round(F.avg(c), 6).alias(f"mean_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    without = [F.count_if(F.col(c) == 0).alias(f"without_{c}") for c in ("chunks", "filled")]
    return counted.agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.sum("filled").alias("filled"), *of("chunks"), *of("filled"), *without)


def chunk_quality(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row over all chunks: empty ones, lengths, and chunks without or with an unknown document."""
    known = documents.select(F.col("doc_id").alias("document_id"), F.lit(True).alias("known")).distinct()
    size, filled = F.length("text"), F.col("text") != ""
    return chunks.select("document_id", "text").join(known, "document_id", "left").agg(
        F.count("*").alias("all_chunks"),
        F.count_if(~filled).alias("empty_chunks"),
        F.round(F.avg(size), 6).alias("mean_length"),
        F.round(F.avg(F.when(filled, size)), 6).alias("mean_filled_length"),
        F.count_if(F.col("document_id").isNull()).alias("null_documents"),
        F.count_if(F.col("document_id").isNotNull() & F.col("known").isNull()).alias("dangling_documents"),
    )


def summary(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Totals, quality and the share of filled chunks as one row; two one-row frames meet."""
    both = totals(per_document(documents, chunks)).crossJoin(chunk_quality(documents, chunks))
    share = (F.col("all_chunks") - F.col("empty_chunks")) / F.col("all_chunks")
    return both.withColumn("filled_fraction", F.when(F.col("all_chunks") == 0, 0.0).otherwise(F.round(share, 6)))
