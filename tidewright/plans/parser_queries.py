"""Field parsers, matching and search queries with the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import parsers as P
from tidewright.operators import gaps, linking, matching
from tidewright.operators import evaluation as V
from tidewright.plans.gap_queries import ALL
from tidewright.plans.store_queries import FOLD
from tidewright.sources.tables import table


def _e(s, sf, category):
    return table(s, sf, "extractions").where(F.col("category") == category)


def parse_distances(s, sf):
    x = F.col("exact_text")
    r = P.number_range(x)
    return _e(s, sf, "distance").select("id", P.number(x).alias("value"), P.qualifier(x).alias("qualifier"), r["low"].alias("low"), r["high"].alias("high"), r["is_range"].alias("is_range"))


def parse_amounts(s, sf):
    x = F.col("exact_text")
    return _e(s, sf, "penalty").select("id", P.number(x).alias("amount"), P.currency(x).alias("currency"), P.months(F.col("context")).alias("months"))


def parse_coordinates(s, sf):
    x = F.col("exact_text")
    return _e(s, sf, "coordinate").select("id", P.latitude(x).alias("latitude"), P.longitude(x).alias("longitude"))


def l3_legal_research(s, sf):
    return matching.legal_research_search(table(s, sf, "extractions"), table(s, sf, "documents"))


def v13_greedy_matches(s, sf):
    """Method texts of the extractions against the correct ones of the annotated sheet."""
    found = linking.text_classes(_e(s, sf, "method"), F.col("exact_text"))
    truth = linking.text_classes(table(s, sf, "validate_method").where(V.yes("is_correct")).withColumn("id", F.format_string("v%010d", "id")), F.col("exact_text"))
    return matching.greedy_matches(found, truth)


def t38_classifier_folds(s, sf):
    """Held-out precision of the quality classifier on the annotated sheets."""
    v = V.sheets({c: table(s, sf, f"validate_{c}") for c in V.SHEETS}).where(V.yes("is_correct").isNotNull())
    rows = v.select(F.concat_ws("|", "category", "id").alias("id"), F.coalesce("exact_text", F.lit("")).alias("text"), V.yes("is_correct").cast("double").alias("label"))
    return matching.classifier_folds(rows)


def v14_similarity(s, sf):
    """Word similarity of each annotated distance's text to its context."""
    v = table(s, sf, "validate_distance").where("exact_text is not null and context is not null").select("id", F.lower("exact_text").alias("a"), F.lower("context").alias("b"))
    return v.select("id", F.round(matching.jaccard("a", "b"), 6).alias("similarity"))


def g20_gaps_by_category(s, sf):
    """The kinds of gap of each category, counted."""
    return gaps.all_gaps(table(s, sf, "extractions"), table(s, sf, "documents")).groupBy("gap_category", "gap_type", "severity").agg(F.count(F.lit(1)).alias("n"))


QUERIES = (t38_classifier_folds, parse_distances, parse_amounts, parse_coordinates, l3_legal_research, v13_greedy_matches, v14_similarity, g20_gaps_by_category)

N = P.NUMBER


def val(text: str) -> str:
    return f"(case when regexp_matches({text}, '^[0-9]{{1,3}}(?:[.,][0-9]{{3}})+$') then try_cast(replace(replace({text}, '.', ''), ',', '') as double) when regexp_matches({text}, '[.,].*[.,]') then try_cast(regexp_replace(regexp_replace({text}, '[.,]([0-9]*)$', '#\\1'), '[.,]', '', 'g').replace('#', '.') as double) else try_cast(replace({text}, ',', '.') as double) end)"


def pick(text: str, pattern: str, group: int = 1) -> str:
    return "nullif(regexp_extract(" + text + ", '" + pattern.replace("'", "''") + f"', {group}), '')"


RANGE = rf"({N}) *(?:[-–—]|to|and|ile|ilâ) *({N})"
A, B = val(pick("exact_text", RANGE, 1)), val(pick("exact_text", RANGE, 2))
ONE = val(pick("exact_text", f"({N})"))


def cases(text: str, kinds: tuple) -> str:
    return "case " + " ".join(f"when regexp_matches({text}, '{p}') then '{k}'" for k, p in kinds) + " end"


def degrees(hemispheres: str, negative: str, most: int) -> str:
    p = rf"([0-9]{{1,3}}(?:\.[0-9]+)?)\s*°\s*(?:([0-9]{{1,2}})\s*['′]\s*)?(?:([0-9]{{1,2}}(?:\.[0-9]+)?)\s*[\"″]\s*)?([{hemispheres}])"
    d, m, s = (f"coalesce(try_cast({pick('exact_text', p, i)} as double), {'null' if i == 1 else '0.0'})" for i in (1, 2, 3))
    x = f"round(case when regexp_extract(exact_text, '{p.replace(chr(39), chr(39) * 2)}', 4) in ({', '.join(repr(c) for c in negative)}) then -1.0 else 1.0 end::double * ({d} + {m} / 60 + {s} / 3600), 6)"
    return f"case when {x} between -{most} and {most} then {x} end"


LOW = FOLD.format("context")
ORACLES = {
    "parse_distances": f"select id, {ONE} as value, {cases('lower(exact_text)', P.QUALIFIERS)} as qualifier, case when {A} is not null and {B} is not null then least({A}, {B}) else {ONE} end as low, case when {A} is not null and {B} is not null then greatest({A}, {B}) else {ONE} end as high, coalesce({A} is not null and {B} is not null, false) as is_range from extractions where category = 'distance'",
    "parse_amounts": f"select id, {ONE} as amount, {cases(FOLD.format('exact_text'), P.CURRENCIES)} as currency, round(try_cast({pick(LOW, '([0-9]+) *(?:months?|ay|days?|gün|years?|yil)')} as double) * case when regexp_matches({pick(LOW, '[0-9]+ *(months?|ay|days?|gün|years?|yil)')}, '^(day|gün)') then 1.0::double / 30 when regexp_matches({pick(LOW, '[0-9]+ *(months?|ay|days?|gün|years?|yil)')}, '^(year|yil)') then 12.0::double else 1.0::double end, 6) as months from extractions where category = 'penalty'",
    "parse_coordinates": f"select id, {degrees('NSKG', 'SG', 90)} as latitude, {degrees('EWDB', 'WB', 180)} as longitude from extractions where category = 'coordinate'",
    "l3_legal_research": f"""with e as (select e.id, coalesce(doc_type, 'unknown') as doc_type, list_distinct([w for w in regexp_split_to_array({FOLD.format("concat_ws(' ', exact_text, context)")}, '\\s+') if length(w) > 5]) as w from extractions e join documents d on e.document_id = d.id),
        p as (select q.id, r.id as r, len(list_intersect(q.w, r.w)) as n from e q join e r on q.doc_type = 'legal' and r.doc_type = 'research' and regexp_extract(q.id, '([0-9]+)$', 1)::bigint % 100 = 0), k as (select * from p where n >= 3)
        select id, count(*) as n_links, arg_min(r, row(-n, r)) as best_id, max(n) as n_shared from k group by id""",
    "v14_similarity": """with w as (select id, list_distinct([x for x in regexp_split_to_array(trim(lower(exact_text), ' '), '\\s+') if x <> '']) as a, list_distinct([x for x in regexp_split_to_array(trim(lower(context), ' '), '\\s+') if x <> '']) as b from validate_distance where exact_text is not null and context is not null)
        select id, case when len(a) + len(b) = 0 then 0.0 else round(len(list_intersect(a, b))::double / (len(a) + len(b) - len(list_intersect(a, b))), 6) end::double as similarity from w""",
    "g20_gaps_by_category": f"select gap_category, gap_type, severity, count(*) as n from ({ALL}) group by 1, 2, 3",
}
