"""Selecting what is still to do, and adding to or replacing rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusmill.functions.names import free
from corpusmill.plans.staging import staged


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in a total order."""
    nth = free("nth", rows)
    return rows.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(nth) == 1).drop(nth)


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows to append: those with a key that the target lacks, one for each key."""
    return first_by(rows, keys, order).join(target.select(*keys), keys, "left_anti")


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], version: str, created: str) -> DataFrame:
    """Target and rows as one table: for each key the columns of the highest version, and the first creation time."""
    rest = [c for c in target.columns if c not in (*keys, created)]
    both = target.unionByName(rows)
    newest = free("newest", target)
    merged = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias(newest), F.min(created).alias(created))
    return merged.select(*keys, f"{newest}.*", created).select(*target.columns)


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Writes those partitions that `rows` has and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert_stored(path: str, rows: DataFrame, keys: list[str], version: str, created: str, parts: int = 64) -> DataFrame:
    """Upserts `rows` into the table stored at `path`, and gives the table as it then is.

    The table lies in `parts` folders by a hash of the keys. Only those that rows fall into are read,
    merged and replaced; files of the others stay as they are. What replaces a folder is written
    elsewhere first, so a failure on the way leaves the table whole. Rows may repeat a key: their
    highest version counts. Null keys are keys like others.
    """
    spark, part = rows.sparkSession, free("part", rows)
    kind = StructType([*rows.schema, StructField(part, IntegerType())])
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    touched = [r[0] for r in dealt.select(part).distinct().collect()]  # as many as there are parts at most
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    before = spark.read.schema(kind).parquet(path).where(F.col(part).isin(touched)) if there else dealt.limit(0)
    replace_partitions(staged(upsert(before, dealt, [*keys, part], version, created)), path, [part])
    return spark.read.schema(kind).parquet(path).drop(part)


def pending_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with a text and without a chunk."""
    with_text = documents.where(F.coalesce(F.col("text") != "", F.lit(False)))
    return with_text.join(chunks.select(F.col("document_id").alias("doc_id")), "doc_id", "left_anti")


def pending_embeddings(chunks: DataFrame, embedded: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """Chunks with a text that have neither an embedding nor a failure in this run."""
    left = chunks.where("text <> ''").join(embedded.select("chunk_id"), "chunk_id", "left_anti")
    return left.join(rejects.select("chunk_id"), "chunk_id", "left_anti") if rejects is not None else left


def load_once(spark: SparkSession, path: str, rows: DataFrame, dataset: str) -> DataFrame:
    """The dataset's stored rows; only where there are none, `rows` are stored first."""
    from pyspark.errors import AnalysisException

    def stored() -> DataFrame | None:
        try:
            return spark.read.schema(rows.schema).parquet(f"{path}/dataset={dataset}")
        except AnalysisException:
            return None

    found = stored()
    if found is None or found.isEmpty():
        rows.write.mode("overwrite").parquet(f"{path}/dataset={dataset}")
        found = stored()
    return found


def sampled(rows: DataFrame, id_: str, n: int, seed: str) -> DataFrame:
    """n rows that a seeded hash of the id puts first: a sample that doesn't depend on how rows are dealt out."""
    return rows.orderBy(F.md5(F.concat(F.col(id_).cast("string"), F.lit(seed)).cast("binary")), id_).limit(n)
