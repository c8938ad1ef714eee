"""Links between extractions of different documents and kinds.

A link joins two classes of extractions (all mentions of a species in a document type, all methods of a document, all
copies of a text), not every pair of their members: each operator gives one row per pair of classes with a
representative (the smallest id) and the number of members of either, and ``members`` gives every extraction its class.
Pairs within a large class are therefore never spelled out, and no link between different texts is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.search import entity_name, folded
from tidewright.operators.skew import skew_join
from tidewright.operators.store import insert_cross_references


def with_type(extractions: DataFrame, documents: DataFrame) -> DataFrame:
    """Extractions with the type of their document ("unknown" if NULL)."""
    d = documents.select(F.col("id").alias("document_id"), F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"))
    return skew_join(extractions, d, "document_id", hashed=False)


def species_members(extractions: DataFrame, documents: DataFrame) -> DataFrame:
    """(entity, doc_type, id): the class of every species mention."""
    e = with_type(extractions.where("category = 'species'"), documents)
    return e.select(folded(entity_name("species_name")).alias("entity"), "doc_type", "id").where("entity is not null")


def species_across_types(extractions: DataFrame, documents: DataFrame) -> DataFrame:
    """Species named in documents of two types: one row per species and pair of types, confidence 1."""
    c = species_members(extractions, documents).groupBy("entity", "doc_type").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    pairs = F.expr("filter(flatten(transform(r, a -> transform(r, b -> struct(a, b)))), p -> p.a.doc_type < p.b.doc_type)")
    # A species has one class per document type, so the pairs of an entity are bounded by the square of the types.
    every = c.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("doc_type", "id", "n"))).alias("r")).select("entity", F.explode(pairs).alias("p"))
    return every.select(
        "entity",
        F.col("p.a.doc_type").alias("type_1"),
        F.col("p.b.doc_type").alias("type_2"),
        F.col("p.a.id").alias("id_1"),
        F.col("p.b.id").alias("id_2"),
        F.col("p.a.n").alias("n_1"),
        F.col("p.b.n").alias("n_2"),
        F.lit("species_cross_source").alias("link_type"),
        F.lit(1.0).alias("confidence"),
    )


def same_document(extractions: DataFrame, first: Column, second: Column, link_type: Column | str, confidence: float) -> DataFrame:
    """Documents that hold extractions of both kinds: one row each, linking the two classes."""
    link = F.lit(link_type) if isinstance(link_type, str) else link_type
    c = extractions.groupBy("document_id").agg(
        F.min(F.when(first, F.col("id"))).alias("id_1"), F.min(F.when(second, F.col("id"))).alias("id_2"), F.count_if(first).alias("n_1"), F.count_if(second).alias("n_2")
    )
    return c.where("n_1 > 0 and n_2 > 0").withColumn("link_type", link).withColumn("confidence", F.lit(confidence))


def methods_and_data(extractions: DataFrame) -> DataFrame:
    """Methods and data sources of one document, confidence 0.9."""
    return same_document(extractions, F.col("category") == "method", F.col("category") == "data_source", "method_uses_data", 0.9)


#: Categories that place something. Fixed values.
SPATIAL = ("protected_area", "distance", "coordinate")


def conflicts_and_places(extractions: DataFrame) -> DataFrame:
    """Conflicts and each kind of place of one document, confidence 0.7."""
    e = extractions.where(F.col("category").isin("conflict", *SPATIAL))
    c = e.groupBy("document_id", "category").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    a = c.where("category = 'conflict'").select("document_id", F.col("id").alias("id_1"), F.col("n").alias("n_1"))
    b = c.where("category <> 'conflict'").select("document_id", "category", F.col("id").alias("id_2"), F.col("n").alias("n_2"))
    return a.join(b, "document_id").select("document_id", "id_1", "id_2", "n_1", "n_2", F.concat(F.lit("conflict_in_"), F.col("category")).alias("link_type"), F.lit(0.7).alias("confidence"))


def words(text: Column, longer_than: int) -> Column:
    """Distinct lower-case words (parted by white space) of more than ``longer_than`` characters."""
    return F.array_distinct(F.filter(F.split(folded(text), r"\s+"), lambda w: F.length(w) > longer_than))


def text_classes(extractions: DataFrame, texts: Column) -> DataFrame:
    """(text, id, n): copies of a text as one class with its smallest id."""
    return extractions.select(folded(texts).alias("text"), "id").where("text is not null").groupBy("text").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


def token_overlap(left: DataFrame, right: DataFrame, longer_than: int, least: int, base: float) -> DataFrame:
    """Pairs of text classes (from :func:`text_classes`) that share at least ``least`` long words.

    An inverted index: both sides are exploded to keys and joined on the key. Where two or more shared words are asked
    for, a key is a pair of words, which far fewer texts hold than a single word, so that common words make no hot key
    by themselves; the shared words of each pair of texts that meets are then counted.
    """
    a = left.select(F.col("text").alias("text_1"), F.col("id").alias("id_1"), F.col("n").alias("n_1"), words(F.col("text"), longer_than).alias("w1"))
    a = a.where(F.size("w1") >= least)
    b = right.select(F.col("text").alias("text_2"), F.col("id").alias("id_2"), F.col("n").alias("n_2"), words(F.col("text"), longer_than).alias("w2")).where(F.size("w2") >= least)
    grams = lambda w: F.transform(
        F.flatten(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.transform(F.slice(w, i + 1, F.size(w)), lambda x: F.array_sort(F.array(F.element_at(w, i), x))))), lambda p: F.array_join(p, " ")
    )
    if least >= 2:  # two shared words at once: far rarer than one
        x, y = a.withColumn("k", F.explode(grams(F.col("w1")))), b.withColumn("k", F.explode(grams(F.col("w2"))))
    else:
        x, y = a.withColumn("k", F.explode("w1")), b.withColumn("k", F.explode("w2"))
    pairs = x.select("k", "id_1").join(y.select("k", "id_2"), "k").select("id_1", "id_2").distinct()
    shared = F.size(F.array_intersect("w1", "w2"))
    found = pairs.join(a, "id_1").join(b, "id_2").withColumn("n_shared", shared).where(F.col("n_shared") >= least)
    return found.select("text_1", "text_2", "id_1", "id_2", "n_1", "n_2", "n_shared", F.round(F.least(F.lit(1.0), F.lit(base) + 0.1 * F.col("n_shared")), 2).alias("confidence"))


def methods_and_data_words(extractions: DataFrame) -> DataFrame:
    """Methods and data sources whose texts share two words of five letters or more, whatever their documents."""
    m = text_classes(extractions.where("category = 'method'"), F.col("exact_text")).where(F.size(F.split("text", r"\s+")) >= 2)
    d = text_classes(extractions.where("category = 'data_source'"), F.col("exact_text"))
    return token_overlap(m, d, 4, 2, 0.5)


def integrated(extractions: DataFrame, documents: DataFrame, category: str, field: str, entity_type: str) -> DataFrame:
    """(entity_type, entity, entity_name, legal, research, data counts) of one category: a conditional count per entity."""
    e = with_type(extractions.where(F.col("category") == category), documents).select("id", "doc_type", entity_name(field).alias("name")).where("name is not null")
    count = lambda t: F.count_if(F.col("doc_type") == t)
    return e.groupBy(folded("name").alias("entity")).agg(F.min_by("name", "id").alias("entity_name"), count("legal").alias("legal_mentions"), count("research").alias("research_mentions"), count("dataset").alias("data_mentions")).select(F.lit(entity_type).alias("entity_type"), "*")


def conflicts_and_stakeholders(extractions: DataFrame) -> DataFrame:
    """Documents with conflicts and stakeholders; confidence 0.8 if any two share a word of four letters or more, else 0.6."""
    e = extractions.where("category in ('conflict', 'stakeholder')")
    w = e.select("document_id", "category", F.explode(words(F.coalesce("exact_text", F.lit("")), 3)).alias("w"))
    both = w.groupBy("document_id", "w").agg(F.countDistinct("category").alias("k")).where("k = 2").select("document_id").distinct().withColumn("shared", F.lit(True))
    c = same_document(e, F.col("category") == "conflict", F.col("category") == "stakeholder", "conflict_stakeholder", 0.6)
    return c.join(both, "document_id", "left").withColumn("confidence", F.when(F.col("shared"), 0.8).otherwise(0.6)).drop("shared")


def all_links(extractions: DataFrame, documents: DataFrame) -> DataFrame:
    """(low_id, high_id, link_type, confidence, n_offered): the links of all rules between representatives, kept once.

    Copies are not expanded: a link joins the smallest ids of two classes, whose members :func:`species_members` and the
    document ids name.
    """
    ends = [F.col("id_1").alias("extraction1_id"), F.col("id_2").alias("extraction2_id"), "link_type", "confidence"]
    found = [
        species_across_types(extractions, documents).select(*ends),
        methods_and_data(extractions).select(*ends),
        conflicts_and_stakeholders(extractions).select(*ends),
        conflicts_and_places(extractions).select(*ends),
    ]
    return insert_cross_references(reduce(DataFrame.unionByName, found))
