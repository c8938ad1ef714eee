"""All queries of the core with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("store_queries", "gap_queries", "text_queries", "evaluation_queries", "extraction_queries", "document_queries", "parser_queries", "field_queries")


def _modules() -> list:
    return [import_module(f"tidewright.plans.{m}") for m in MODULES]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return queries()["k4_topk_extractions"](spark, sf)


def queries() -> dict[str, Query]:
    found = {f.__name__: f for m in _modules() for f in m.QUERIES}
    return found | import_module("tidewright.plans.problems").queries()


def oracle_sql() -> dict[str, str]:
    found = {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
    return found | import_module("tidewright.plans.problems").ORACLES
