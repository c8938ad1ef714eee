"""Aggregates behind reports and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def category_totals(extractions: DataFrame) -> DataFrame:
    """Counts by category with their share of all extractions."""
    total = extractions.agg(F.count(F.lit(1)).alias("__t"))
    c = extractions.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("n_documents"))
    return c.crossJoin(F.broadcast(total)).select("category", "n", "n_documents", F.round(F.col("n") / F.col("__t"), 6).alias("share"))


def first_texts(extractions: DataFrame, k: int = 5) -> DataFrame:
    """The first k texts of each document and category, with how many more there are."""
    group = ["document_id", "category"]
    n = extractions.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group).orderBy("id")
    top = extractions.select("id", *group, "exact_text").withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
    same = F.expr("d1 <=> d2 and category = c2")
    left, right = top.withColumnRenamed("document_id", "d1"), n.select(F.col("document_id").alias("d2"), F.col("category").alias("c2"), "n")
    return left.join(right, same).select("id", F.col("d1").alias("document_id"), "category", "position", "exact_text", F.greatest(F.col("n") - k, F.lit(0)).alias("n_more"))


def confidence_histogram(extractions: DataFrame, bins: int = 20) -> DataFrame:
    """Counts in equal bins over the range of confidences; the highest value falls into the last bin. One value is one bin."""
    c = extractions.where("confidence is not null").select("confidence")
    span = c.agg(F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    k = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("confidence") - F.col("lo")) / width + 1e-9), F.lit(bins - 1)))
    return c.crossJoin(F.broadcast(span)).groupBy(k.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def per_document(extractions: DataFrame, documents: DataFrame) -> DataFrame:
    """Per document: extractions, categories, average confidence; documents without any count 0."""
    e = extractions.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("category").alias("n_categories"), F.round(F.avg("confidence") + 1e-9, 3).alias("avg_confidence"))
    d = documents.select(F.col("id").alias("document_id"), "doc_type")
    return d.join(e, "document_id", "left").select("document_id", "doc_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_categories", F.lit(0)).alias("n_categories"), "avg_confidence")


def json_summary(extractions: DataFrame, documents: DataFrame) -> DataFrame:
    """(measure, value): documents, extractions, and extractions by category, as a report's summary holds them."""
    d = documents.agg(F.count(F.lit(1)).alias("value")).select(F.lit("total_documents").alias("measure"), "value")
    e = extractions.groupingSets([[], [F.col("category")]], "category").agg(F.count(F.lit(1)).alias("value"), F.grouping("category").alias("__g"))
    return d.unionByName(e.select(F.when(F.col("__g") == 1, "total_extractions").otherwise(F.coalesce("category", F.lit(""))).alias("measure"), "value"))


def source_counts(extractions: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_type, n_documents, n_extractions): what each kind of source brought into the store; NULL reads unknown."""
    n = extractions.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    d = documents.select(F.col("id").alias("document_id"), F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"))
    return d.join(n, "document_id", "left").groupBy("doc_type").agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_extractions"))
