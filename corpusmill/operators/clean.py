"""Raw metadata and markdown to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.sources.tables import first_by

_AUTHORS, _VERSIONS = "array<array<string>>", "array<struct<version string, created string>>"


def payload(raw: Column) -> Column:
    """The variant below `root`, or all of it."""
    j = F.try_parse_json(raw)
    return F.coalesce(F.try_variant_get(j, "$.root", "variant"), j)


def metadata(raw: DataFrame, json: str = "raw_json") -> DataFrame:
    """Typed metadata, a row for each payload with an id; columns of `raw` other than the JSON stay."""
    rest = [c for c in raw.columns if c != json]
    rows = raw.select(*rest, payload(F.col(json)).alias("j"))
    get = lambda k, kind="string": F.try_variant_get("j", f"$['{k}']", kind)
    authors, versions = get("authors_parsed", _AUTHORS), get("versions", _VERSIONS)
    rows = rows.select(*rest, get("id").alias("id"), get("title").alias("title"), get("categories").alias("categories"), get("journal-ref").alias("journal_ref"), get("report-no").alias("report_no"), get("doi").alias("doi"), authors.alias("a"), versions.alias("v"))
    return rows.where(F.nullif(F.trim("id"), F.lit("")).isNotNull()).select(
        *rest, "id", "title", "categories", "journal_ref", "report_no", "doi",
        t.authors_line(F.col("a")).alias("authors"),
        F.coalesce(F.size(t.author_names(F.col("a"))), F.lit(0)).alias("number_of_authors"),
        t.timestamp(F.try_element_at("v", F.lit(1))["created"]).alias("created"),
        t.timestamp(F.try_element_at("v", F.lit(-1))["created"]).alias("last_updated"),
    )


def newest_metadata(rows: DataFrame) -> DataFrame:
    """One row for each id: the last updated, and of equal ones the least by content."""
    content = F.md5(F.to_json(F.struct(*rows.columns)))
    return first_by(rows, ["id"], [F.col("last_updated").desc_nulls_last(), content])


def markdown(raw: DataFrame) -> DataFrame:
    """Canonical ids and texts, one text for each id: the least by its hash."""
    rows = raw.where(F.nullif(F.trim("id"), F.lit("")).isNotNull()).select(t.canonical_id(F.col("id")).alias("id"), "text")
    return rows.groupBy("id").agg(F.min_by("text", F.struct(F.md5("text"), F.length("text"))).alias("text"))


def documents(meta: DataFrame, md: DataFrame, category: str = "astro-ph") -> DataFrame:
    """Metadata and text of the ids that have both, in scope, with their link.

    The scope is applied before the join, so that out-of-scope texts meet no row.
    """
    scoped = meta.where(F.col("categories").ilike(f"%{category}%"))
    return scoped.join(md, "id").withColumn("doi_url", t.doi_url(F.col("doi"), F.col("id")))
