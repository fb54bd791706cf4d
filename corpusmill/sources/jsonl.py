"""JSON lines: strict readers of documents and queries, and a writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import strip


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start, nth) of all lines; large files are read in blocks, of which start tells the place, and nth counts up inside a block."""
    read = spark.read.option("lineSep", "\n").text(path)
    value = F.regexp_replace("value", "\r$", "").alias("value")
    return read.select(value, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"))


def _numbered(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Some of `lines` with their number in the file: lines are counted by block, so no file is one task's work."""
    blocks = lines.groupBy("file", "start").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "start", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(blocks, ["file", "start"]).withColumn("line", (F.col("nth") - F.col("first") + F.col("before") + 1).cast("long"))


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("j", F.try_parse_json("value")).withColumn("object", F.coalesce(F.schema_of_variant("j").startswith("OBJECT"), F.lit(False)))


def _get(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("j", f"$.{name}", kind)


def _read(spark: SparkSession, path: str, columns: list[Column], strict: bool) -> tuple[DataFrame, DataFrame]:
    """Sound lines as `columns`, and rejects; only rejects, and all lines in strict reading, need their numbers."""
    lines = _lines(spark, path)
    marked = _parsed(lines.where(strip(F.col("value")) != "")).withColumn("text", F.nullif(strip(_get("text")), F.lit("")))
    marked = marked.withColumn("error", F.when(F.col("j").isNull(), "invalid JSON").when(~F.col("object"), "not an object").when(F.col("text").isNull(), "empty text"))
    rejects = _numbered(marked.where("error is not null").select("file", "start", "nth", "error", "value"), lines).select("file", "line", "error", "value")
    if strict:
        told = F.concat_ws(" ", F.col("error"), F.lit("in line"), F.col("line").cast("string"), F.lit("of"), F.col("file"))
        marked = _numbered(marked, lines).withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(told)))
    return marked.where("error is null").select(*columns), rejects


def read_documents(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents (source_id, text, metadata as JSON text) and rejects (file, line, error, value).

    Blank lines are skipped. A line that is no JSON object, or has no text, is a reject; with
    `strict` reading it is an error that names line and file.
    """
    return _read(spark, path, [_get("source_id").alias("source_id"), F.col("text"), F.to_json(_get("metadata", "variant")).alias("metadata")], strict)


def read_queries(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Queries (text, metadata, relevance as JSON text) and rejects, with the same checks as documents.

    Metadata that is no object is empty; a relevance in it wins over one beside it.
    """
    meta = _get("metadata", "variant")
    is_object = F.coalesce(F.schema_of_variant(meta).startswith("OBJECT"), F.lit(False))
    relevance = F.coalesce(F.to_json(_get("metadata.relevance", "variant")), F.to_json(_get("relevance", "variant")))
    return _read(spark, path, [F.col("text"), F.coalesce(F.when(is_object, F.to_json(meta)), F.lit("{}")).alias("metadata"), relevance.alias("relevance")], strict)


def write(rows: DataFrame, path: str) -> None:
    """One JSON object a line, UTF-8 as it is."""
    rows.write.option("ignoreNullFields", "false").json(path)
