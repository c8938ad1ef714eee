"""Sources and sinks of the knowledge store: page files, JSON results of three layouts, annotated CSV, CSV and JSON export."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of a result file that hold no extractions. Fixed values.
ABOUT = ("filename", "doc_type", "language", "pages", "source_path", "extractions", "results", "metadata", "error")
COMMON = ("category", "exact_text", "context", "page_number", "confidence", "marine_relevance")
#: Other names of categories, and the type each part of a path suggests. Fixed values.
ALIASES = {"methods": "method", "mpas": "protected_area", "distances": "distance", "penalties": "penalty", "prohibitions": "prohibition", "permits": "permit", "datasets": "data_source", "data_sources": "data_source", "data": "data_source"}
TYPES = (("research", "research"), ("legal", "legal"), ("dataset", "dataset"), ("data", "dataset"))


def text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(filename, source_path, text, n_chars): whole text files of a folder, not recursive."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(folder).select("value", "_metadata.file_path", "_metadata.file_name")
    return raw.select(F.col("file_name").alias("filename"), F.col("file_path").alias("source_path"), F.col("value").alias("text"), F.length("value").cast("bigint").alias("n_chars"))


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, page, text) of PDF files; needs an installed PDF reader, without one the text is NULL and page 0."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select(F.col("path"), F.col("content"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import io

            import pypdf
        except ImportError:
            pypdf = None
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                if pypdf is None:
                    rows.append((name, 0, None))
                else:
                    rows += [(name, i + 1, p.extract_text()) for i, p in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages)]
            yield pd.DataFrame(rows, columns=["filename", "page", "text"])

    return raw.mapInPandas(read, "filename STRING, page INT, text STRING")


def guessed_type(path: Column) -> Column:
    """Document type by the first part of the path that names one, else "unknown"."""
    out = F.lit("unknown")
    for word, kind in reversed(TYPES):
        out = F.when(F.contains(F.lower(path), F.lit(word)), kind).otherwise(out)
    return out


def canonical_category(category: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(names, F.lower(category)), F.lower(category), F.lit("uncategorised"))


def result_files(spark: SparkSession, folder: str, doc_type: str | None = None) -> DataFrame:
    """Extractions of JSON result files, one per file, in any of three layouts; unreadable files give no rows.

    Layouts: {"extractions" or "results": {category: [item]}}, the same as a flat list of items with a category, and
    categories at the top level. A single item may stand for a list. Other fields of an item go to ``metadata``.
    """
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder).select(F.col("value").alias("j"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"))
    top = raw.withColumn("top", F.from_json("j", "map<string,string>"))
    body = F.coalesce(F.element_at("top", "extractions"), F.element_at("top", "results"))
    body = F.when(F.trim(body).isin("[]", "{}"), None).otherwise(body)
    rest = F.map_filter("top", lambda k, v: ~k.isin(*ABOUT) & (F.trim(v).startswith("[") | F.trim(v).startswith("{")))
    groups = F.when(body.isNull(), rest).when(F.trim(body).startswith("{"), F.from_json(body, "map<string,string>"))
    items = lambda v: F.when(F.trim(v).startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v))
    named = F.flatten(F.transform(F.map_entries(groups), lambda g: F.transform(items(g["value"]), lambda x: F.struct(g["key"].alias("c"), x.alias("x")))))
    flat = F.transform(F.from_json(body, "array<string>"), lambda x: F.struct(F.lit(None).cast("string").alias("c"), x.alias("x")))
    rows = top.select("path", "file", "top", F.explode(F.coalesce(F.when(F.trim(body).startswith("["), flat), named)).alias("r"))
    item = rows.select("path", F.coalesce(F.element_at("top", "filename"), F.col("file")).alias("filename"), F.coalesce(F.lit(doc_type), F.element_at("top", "doc_type"), guessed_type(F.col("path"))).alias("doc_type"), F.col("r.c").alias("c"), F.from_json("r.x", "map<string,string>").alias("x")).where("x is not null")
    get = lambda k: F.element_at("x", k)
    return item.select(
        "filename",
        "doc_type",
        canonical_category(F.coalesce("c", get("category"))).alias("category"),
        get("exact_text").alias("exact_text"),
        get("context").alias("context"),
        F.try_to_number(get("page_number"), F.lit("99999999")).cast("int").alias("page_number"),
        F.expr("try_cast(x['confidence'] as double)").alias("confidence"),
        F.expr("try_cast(x['marine_relevance'] as double)").alias("marine_relevance"),
        F.to_json(F.map_filter("x", lambda k, v: ~k.isin(*COMMON))).alias("metadata"),
    )


def annotated_csv(spark: SparkSession, path: str) -> DataFrame:
    """An annotated sheet: a header, quoted cells that may hold line ends, doubled quotes, a byte-order mark or none."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def flat(df: DataFrame) -> DataFrame:
    """Columns that a CSV file cannot hold as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_store(tables: dict[str, DataFrame], folder: str, partition_by: dict[str, str] | None = None) -> None:
    """The tables of the store as parquet, extractions partitioned by category unless told otherwise."""
    by = {"extractions": "category"} if partition_by is None else partition_by
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(by[name]) if name in by else w).parquet(f"{folder}/{name}.parquet")


def html_report(counts: list[tuple[str, int]], title: str = "Extractions") -> str:
    """A page with one bar per category, from aggregated counts."""
    most = max((n for _, n in counts), default=1) or 1
    rows = "".join(f'<tr><td>{c}</td><td><div style="background:#47a;width:{round(300 * n / most)}px">&nbsp;</div></td><td>{n}</td></tr>' for c, n in counts)
    return f"<!doctype html><meta charset=utf-8><title>{title}</title><h1>{title}</h1><table>{rows}</table>"
