"""The knowledge store: insert-or-get, keep-first, upsert and top-k as set operations on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.skew import skew_join


def text_or_none(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("None"))


def content_hash(category: str = "category", text: str = "exact_text", context: str = "context") -> Column:
    """Hash that makes two extractions of one document the same record; NULL reads "None"."""
    return F.sha2(F.concat_ws("|", text_or_none(category), text_or_none(text), text_or_none(context)), 256)


def insert_documents(documents: DataFrame) -> DataFrame:
    """(filename, kept_id, n_offered): the first document offered under each filename is kept. NULL is a filename of its own."""
    return documents.groupBy("filename").agg(F.min_by("id", "doc_id").alias("kept_id"), F.count(F.lit(1)).alias("n_offered"))


def insert_extractions(extractions: DataFrame) -> DataFrame:
    """(document_id, content_hash, kept_id, n_offered): the first extraction of each content in a document is kept."""
    return extractions.groupBy("document_id", content_hash().alias("content_hash")).agg(F.min("id").alias("kept_id"), F.count(F.lit(1)).alias("n_offered"))


def query_extractions(extractions: DataFrame, documents: DataFrame, category: str | None = None, min_confidence: float | None = None, doc_type: str | None = None, limit: int | None = 100) -> DataFrame:
    """Extractions with their document, optionally filtered: the ``limit`` most confident (NULL last, ties by id), or all
    of them in no order."""
    e = extractions
    if category is not None:
        e = e.where(F.col("category") == category)
    if min_confidence is not None:
        e = e.where(F.col("confidence") >= min_confidence)
    d = documents.select(F.col("id").alias("document_id"), "filename", "doc_type")
    if doc_type is not None:
        d = d.where(F.col("doc_type") == doc_type)
    found = e.select("id", "document_id", "category", "exact_text", "page_number", "confidence", "marine_relevance")
    found = skew_join(found, d, "document_id", hashed=False)
    return found.orderBy(F.col("confidence").desc_nulls_last(), "id").limit(limit) if limit else found


def document_summary(documents: DataFrame) -> DataFrame:
    """(grouping, value, n_documents, n_pages): the total, and counts by type and by language, in one pass."""
    sets = documents.groupingSets([[], [F.col("doc_type")], [F.col("lang")]], "doc_type", "lang").agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum("pages"), F.lit(0)).alias("n_pages"), F.grouping("doc_type").alias("__t"), F.grouping("lang").alias("__l"))
    kind = F.when(F.col("__t") == 0, "doc_type").when(F.col("__l") == 0, "lang").otherwise("total")
    return sets.select(kind.alias("grouping"), F.coalesce("doc_type", "lang", F.lit("")).alias("value"), "n_documents", "n_pages")


def extraction_counts(extractions: DataFrame) -> DataFrame:
    return extractions.groupBy("category").agg(F.count(F.lit(1)).alias("n_extractions"))


def insert_cross_references(links: DataFrame) -> DataFrame:
    """One undirected edge per (lower id, higher id, type) with its highest confidence; loops are no links."""
    lo, hi = F.least("extraction1_id", "extraction2_id").alias("low_id"), F.greatest("extraction1_id", "extraction2_id").alias("high_id")
    return links.where("extraction1_id <> extraction2_id").groupBy(lo, hi, "link_type").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_offered"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of ``old`` and ``new``, the highest ``version`` per key; the newer table wins ties.

    Rows without a version lose against any other. Extra columns must agree in both tables.
    """
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col(version).cast("string"), F.lit("")), F.col("__new"))).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])
