"""Extractors over the documents. None has an SQL oracle: sentences, number words, reference lists and the patterns' dialect
have no form in SQL; hand-made cases of every category test them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import extraction as X
from tidewright.sources.tables import spread, table


def _d(s, sf):
    return spread(table(s, sf, "documents").select("doc_id", "doc_type", "text"), "doc_id")


def _extractor(category: str):
    def query(s, sf):
        found = X.extract(_d(s, sf), (category,))
        names = list(X.SPECS[category].fields(X.Match()))
        return found.select("doc_id", "record_hash", "pattern", "position", "exact_text", *[F.col("fields").getItem(n).alias(n) for n in names], "confidence", "marine_relevance", "n_mentions")

    query.__name__ = f"x_{category}"
    return query


def x_all_routed(s, sf):
    """All extractors of each document's type in one scan, counted by type of document and category."""
    found = X.extract(_d(s, sf), routed=True, keep=("doc_type",))
    return found.groupBy("doc_type", "category").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_mentions").alias("n_mentions"))


def x_relevant(s, sf):
    """Records of all extractors and the relevance of their sentences, by category."""
    return X.extract(_d(s, sf)).groupBy("category").agg(F.count(F.lit(1)).alias("n_records"), F.round(F.avg("marine_relevance") + 1e-9, 4).alias("avg_relevance"), F.round(F.avg("confidence") + 1e-9, 4).alias("avg_confidence"))


QUERIES = (*[_extractor(c) for c in X.SPECS], x_all_routed, x_relevant)
ORACLES: dict[str, str] = {}
