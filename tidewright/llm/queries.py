"""The pN_ queries of the operators in this subpackage. Only p2_found has an SQL oracle; the others are tested otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import encoding, format_duplicates, language, leakage, mixing, quality, scan_noise
from tidewright.llm.vocabulary import Vocabulary, bounded_vocabulary, word_counts
from tidewright.sources.tables import table


def _named(df: DataFrame, name: str, *columns: str) -> DataFrame:
    return df.select(F.lit(name).alias("source_table"), F.col("id").cast("string").alias("record_id"), *columns)


def _vocabulary(spark: SparkSession, sf: str, titles: bool = False) -> Vocabulary:
    """The bounded vocabulary of the documents, which carry neither scan noise nor wrong encodings."""
    counts = word_counts(table(spark, sf, "documents"), "text", "doc_id", pairs=not titles)
    if titles:
        more = word_counts(table(spark, sf, "validate_legal_reference"), "title", "id")
        counts = counts.unionByName(more).groupBy("word").agg(F.sum("n").alias("n"))
    return bounded_vocabulary(counts)


def _scan_noise(spark: SparkSession, sf: str) -> DataFrame:
    known = _vocabulary(spark, sf)
    columns = ("field", "repaired", "n_furniture", "n_broken", "n_misread")
    a = _named(scan_noise.cleaned(table(spark, sf, "extractions"), "id", ("exact_text", "context"), known, document_col="document_id", page_col="page_number"), "extractions", *columns)
    b = _named(scan_noise.cleaned(table(spark, sf, "validate_method"), "id", ("context",), known, document_col="source_file", page_col="page_number"), "validate_method", *columns)
    return a.unionByName(b)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scan_noise(spark, sf).select("source_table", "record_id", "field").distinct()


def p1_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return _scan_noise(spark, sf)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return format_duplicates.format_copies(table(spark, sf, "extractions"))


def p2_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return format_duplicates.collapse(table(spark, sf, "extractions"))


def _encoding(spark: SparkSession, sf: str) -> DataFrame:
    known = _vocabulary(spark, sf, titles=True)
    a = _named(encoding.restored(table(spark, sf, "extractions"), "id", "context", known), "extractions", "restored", "complete")
    b = _named(encoding.restored(table(spark, sf, "validate_legal_reference"), "id", "title", known), "validate_legal_reference", "restored", "complete")
    return a.unionByName(b)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _encoding(spark, sf).select("source_table", "record_id").distinct()


def p3_restored(spark: SparkSession, sf: str) -> DataFrame:
    return _encoding(spark, sf)


def _languages(spark: SparkSession, sf: str) -> DataFrame:
    return language.all_languages(table(spark, sf, "documents"), table(spark, sf, "extractions"), table(spark, sf, "common_words"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _languages(spark, sf).where("is_case").select("source_table", "record_id", "segment", "language").distinct()


def p6_languages(spark: SparkSession, sf: str) -> DataFrame:
    return _languages(spark, sf)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p7_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_targets")
    return mixing.shares(mixing.mixture(table(spark, sf, "documents"), targets), targets)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.not_prose(table(spark, sf, "documents"), table(spark, sf, "common_words")).distinct()


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.text_statistics(table(spark, sf, "documents"), table(spark, sf, "common_words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_repaired, p2_found, p2_collapsed, p3_found, p3_restored, p6_found, p6_languages, p7_found, p7_evidence, p8_mixture, p8_shares, p9_found, p9_statistics)
    return {f.__name__: f for f in found}


def _normal_sql(text: str) -> str:
    """Normalized text in SQL: single marks between digits are fenced, other gaps between digits become one sign, the rest goes."""
    t = f"replace(replace(replace(lower(translate({text}, 'İIı', 'iii')), 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    for _ in range(2):
        t = f"regexp_replace({t}, '([0-9])([^\\p{{L}}\\p{{N}}\\s\x02\x03])([0-9])', '\\1\x02\\2\x03\\3', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, '([0-9])[^\\p{{L}}\\p{{N}}\x01\x02\x03]+([0-9])', '\\1\x01\\2', 'g')"
    return f"regexp_replace({t}, '(\x02.\x03|\x01)|[^\\p{{L}}\\p{{N}}]', '\\1', 'g')"


P2_FOUND = f"""with j as (select id, try_cast(metadata as json) as m from extractions where metadata is not null),
    u as (select id, case when json_type(m) = 'VARCHAR' then try_cast(m ->> '$' as json) else m end as m from j),
    f as (select id, case when json_type(m) = 'OBJECT' and len(json_keys(m)) = 1 and json_keys(m)[1] = 'fields' then m -> '$.fields' else m end as m from u),
    o as (select id, m, unnest(json_keys(m)) as n from f where json_type(m) = 'OBJECT'), a as (select id, unnest(from_json(m, '["JSON"]')) as e from f where json_type(m) = 'ARRAY'),
    p as (select id, n, m -> ('$."' || n || '"') as v from o
        union all select id, case when json_type(e) = 'OBJECT' then e ->> '$.attribute' else e ->> '$[0]' end, case when json_type(e) = 'OBJECT' then e -> '$.value' else e -> '$[1]' end from a),
    x as (select id, list_sort(list(n || '=' || coalesce(v::varchar, 'null'))) as x from p group by id),
    k as (select e.id, document_id, category, page_number, {_normal_sql('exact_text')} as t, {_normal_sql('context')} as c, metadata is null as no, x.x from extractions e left join x using (id)),
    g as (select id, min(id) over (partition by document_id, category, page_number, t, c, no, x) as kept_id from k)
    select kept_id, id as copy_id from g where id <> kept_id"""


P2_COLLAPSED = f"with p as (select * from ({P2_FOUND})) select id, 1 + count(copy_id) as n_copies from extractions left join p on kept_id = id where id not in (select copy_id from p) group by id"


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p2_collapsed": P2_COLLAPSED}
