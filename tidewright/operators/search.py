"""Keyword, entity and statistics queries over the knowledge store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.skew import skew_join


def folded(c: Column | str) -> Column:
    """Lower case with dotted and dotless i of either case as one letter."""
    return F.lower(F.translate(c, "İIı", "iii"))


def contains_text(keyword: str, *columns: str) -> Column:
    """Whether any column contains the keyword, case aside; NULL contains nothing."""
    low = keyword.translate({ord("İ"): "i", ord("I"): "i", ord("ı"): "i"}).lower()
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(folded(c), F.lit(low)), F.lit(False))
    return found


def entity_name(field: str) -> Column:
    """The named JSON field of the metadata, else "name", else the exact text; blank counts as absent."""
    pick = [F.nullif(F.trim(F.get_json_object("metadata", f"$.{f}")), F.lit("")) for f in (field, "name")]
    return F.coalesce(*pick, F.nullif(F.trim(F.regexp_replace("exact_text", r"\s+", " ")), F.lit("")))


def search_extractions(extractions: DataFrame, documents: DataFrame, keyword: str, category: str | None = None, limit: int | None = 100) -> DataFrame:
    """Extractions whose text or context contains the keyword: the ``limit`` most confident, or all in no order."""
    e = extractions.where(contains_text(keyword, "exact_text", "context"))
    if category is not None:
        e = e.where(F.col("category") == category)
    d = documents.select(F.col("id").alias("document_id"), "filename", "doc_type")
    found = e.select("id", "document_id", "category", "page_number", "confidence")
    found = skew_join(found, d, "document_id", hashed=False)
    return found.orderBy(F.col("confidence").desc_nulls_last(), "id").limit(limit) if limit else found


def entity_summary(extractions: DataFrame, documents: DataFrame, category: str, field: str) -> DataFrame:
    """(entity, display_name, n_mentions, n_files, first_filename, avg_confidence) of one category's entities.

    The display name is the most confident spelling; a missing confidence counts as 0 in the average. The files of an
    entity, of which there is no bound, are rows of :func:`entity_files` rather than a list in one.
    """
    d = documents.select(F.col("id").alias("document_id"), "filename")
    e = extractions.where(F.col("category") == category).select("id", "document_id", "confidence", entity_name(field).alias("name")).where("name is not null")
    order = F.struct(F.coalesce("confidence", F.lit(-1.0)), F.col("id"))
    return (
        skew_join(e, d, "document_id", hashed=False)
        .groupBy(folded("name").alias("entity"))
        .agg(
            F.max_by("name", order).alias("display_name"),
            F.count(F.lit(1)).alias("n_mentions"),
            F.countDistinct("filename").alias("n_files"),
            F.min("filename").alias("first_filename"),
            F.round(F.avg(F.coalesce("confidence", F.lit(0.0))) + 1e-9, 3).alias("avg_confidence"),
        )
    )


def entity_files(extractions: DataFrame, documents: DataFrame, category: str, field: str) -> DataFrame:
    """(entity, filename, n_mentions): the files that name each entity of a category."""
    d = documents.where("filename is not null").select(F.col("id").alias("document_id"), "filename")
    e = extractions.where(F.col("category") == category).select("document_id", entity_name(field).alias("name")).where("name is not null")
    return skew_join(e, d, "document_id", hashed=False).groupBy(folded("name").alias("entity"), "filename").agg(F.count(F.lit(1)).alias("n_mentions"))


#: Categories that state a requirement. Fixed values.
REQUIREMENTS = ("distance", "penalty", "temporal", "permit", "prohibition", "protected_area")


def requirements_for(extractions: DataFrame, documents: DataFrame, activity: str) -> DataFrame:
    """Per category of requirement, how many extractions of legal documents concern the activity; empty groups are absent."""
    d = documents.where("doc_type = 'legal'").select(F.col("id").alias("document_id"))
    e = extractions.where(F.col("category").isin(*REQUIREMENTS) & contains_text(activity, "exact_text", "context"))
    return skew_join(e, d, "document_id", hashed=False).groupBy("category").agg(F.count(F.lit(1)).alias("n_requirements"), F.min("id").alias("first_id"), F.max("confidence").alias("best_confidence"))


def cross_document_entity(extractions: DataFrame, documents: DataFrame, name: str) -> DataFrame:
    """Every mention of a name in text, context or metadata with its document, by document type and confidence."""
    d = documents.select(F.col("id").alias("document_id"), "filename", "doc_type")
    e = extractions.where(contains_text(name, "exact_text", "context", "metadata"))
    return skew_join(e.select("id", "document_id", "category", "confidence"), d, "document_id", hashed=False)


def statistics(documents: DataFrame, extractions: DataFrame, links: DataFrame) -> DataFrame:
    """(measure, value): one row per figure."""
    n = F.count(F.lit(1)).cast("double")
    d = documents.agg(n.alias("documents"), F.coalesce(F.sum("pages"), F.lit(0)).cast("double").alias("pages"))
    e = extractions.agg(n.alias("extractions"), F.round(F.avg("confidence") + 1e-9, 3).alias("average_confidence"), F.countDistinct("category").cast("double").alias("categories"))
    x = links.agg(n.alias("cross_references"))
    melt = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in df.columns])).alias("r")).select("r.*")
    return melt(d).unionByName(melt(e)).unionByName(melt(x))
