"""Gap rules and their ranking with the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import gaps
from tidewright.plans.store_queries import FOLD
from tidewright.sources.tables import table


def _ed(s, sf):
    return table(s, sf, "extractions"), table(s, sf, "documents")


def _rule(name, rule, both=False):
    def query(s, sf):
        e, d = _ed(s, sf)
        return rule(e, d) if both else rule(e)

    query.__name__ = name
    return query


def g18_prioritized(s, sf):
    return gaps.prioritized(gaps.all_gaps(*_ed(s, sf)))


def g19_top_gaps(s, sf):
    return gaps.top_gaps(g18_prioritized(s, sf), 20)


def g21_summary(s, sf):
    return gaps.summary(g18_prioritized(s, sf))


def r6_gap_matrix(s, sf):
    return gaps.matrix(gaps.all_gaps(*_ed(s, sf)))


RULES = {
    "g1_method_gaps": gaps.method_gaps, "g2_geographic_gaps": gaps.geographic_gaps, "g3_thematic_gaps": gaps.thematic_gaps, "g4_temporal_gaps": gaps.temporal_gaps, "g5_unregulated_activities": gaps.unregulated_activities,
    "g6_missing_penalties": gaps.missing_penalties, "g7_vague_requirements": gaps.vague_requirements, "g8_enforcement_gaps": gaps.enforcement_gaps, "g9_missing_data_types": gaps.missing_data_types, "g10_coverage_gaps": gaps.coverage_gaps,
    "g11_resolution_gaps": gaps.resolution_gaps, "g12_unprotected_species": gaps.unprotected_species, "g13_legal_data_mismatch": gaps.legal_data_mismatch, "g15_unmonitored_areas": gaps.unmonitored_areas,
    "g16_access_barriers": gaps.access_barriers, "g17_research_policy_disconnect": gaps.research_policy_disconnect,
}
def derived(e):
    """A store made of the whole one in which other rules fire: some categories become others, confidences are halved and
    the metadata of sources and findings are plain."""
    other = F.create_map(*[F.lit(x) for pair in DERIVED.items() for x in pair])
    category = F.coalesce(F.element_at(other, F.col("category")), F.col("category"))
    plain = F.when(category == "data_source", F.lit(PLAIN["data_source"])).when(category == "finding", F.lit(PLAIN["finding"])).otherwise(F.col("metadata"))
    return e.select("id", "document_id", category.alias("category"), "exact_text", "context", (F.col("confidence") / 2).alias("confidence"), plain.alias("metadata"))


def g22_derived_gaps(s, sf):
    """All rules over the derived store."""
    e, d = _ed(s, sf)
    return gaps.prioritized(gaps.all_gaps(derived(e), d))


def r4_gap_report(s, sf):
    """Gaps in the order of a report: by category, the most severe first, numbered."""
    return gaps.report_order(gaps.all_gaps(*_ed(s, sf)))


#: What the derived store changes.
DERIVED = {"temporal": "prohibition", "stakeholder": "permit", "policy": "permit"}
PLAIN = {"data_source": '{"source_type": "survey", "access_type": "restricted"}', "finding": '{"finding_type": "recommendation"}'}
QUERIES = (g22_derived_gaps, r4_gap_report, *[_rule(n, f) for n, f in RULES.items()], _rule("g14_method_legal_disconnect", gaps.method_legal_disconnect, True), g18_prioritized, g19_top_gaps, g21_summary, r6_gap_matrix)


def meta(field: str) -> str:
    return f"nullif(trim(json_extract_string(try_cast(metadata as json), '$.{field}'), ' '), '')"


def row(category: str, kind: str, severity: str, subject: str, source: str, evidence: int = 1) -> str:
    return f"select '{category}' as gap_category, '{kind}' as gap_type, {severity} as severity, {subject} as subject, {evidence} as n_evidence from {source}"


def terms(values: tuple[str, ...]) -> str:
    return "(select unnest([" + ", ".join(f"'{v}'" for v in values) + "]) as term)"


def plain(text: str) -> str:
    return f"trim(regexp_replace({FOLD.format(text)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _has(text: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({FOLD.format(text)}, '{w}')" for w in words) + ")"


_N = "(select category, metadata, context, document_id, confidence from extractions)"
SQL = {
    "g1_method_gaps": row("research", "method_gap", "case when n is null then 'critical' else 'important' end", "term",
        f"(select term, n from {terms(gaps.EXPECTED_METHODS)} left join (select coalesce({meta('method_type')}, 'unknown') as term, count(*) as n from extractions where category = 'method' group by 1) using (term), "
        f"(select avg(n) as a from (select count(*) as n from extractions where category = 'method' group by coalesce({meta('method_type')}, 'unknown'))) where coalesce(n, 0) < a * 0.3)"),
    "g2_geographic_gaps": row("research", "geographic_gap", "'important'", "name", f"(select {meta('name')} as name, count(distinct document_id) as n from extractions where category = 'protected_area' group by 1 having name is not null and n < 2)"),
    "g3_thematic_gaps": row("research", "thematic_gap", "case when n > 0 then 'important' else 'critical' end", "term", f"(select term, (select count(*) from extractions where category = term) as n from {terms(gaps.THEMES)}) where n < 5"),
    "g4_temporal_gaps": row("research", "temporal_gap", "'important'", "'temporal'", "(select count(*) as n from extractions where category = 'temporal') where n = 0", 0),
    "g5_unregulated_activities": row("legal", "unregulated_activity", "'critical'", "term", f"{terms(gaps.ACTIVITIES)} where exists (select 1 from extractions where category in ('method', 'finding', 'conflict', 'stakeholder') and contains({FOLD.format('context')}, replace(term, '_', ' '))) and not exists (select 1 from extractions where category in ('prohibition', 'permit', 'distance', 'penalty') and {FOLD.format(meta('activity'))} = term)", 2),
    "g6_missing_penalties": row("legal", "missing_penalty", "'important'", "p", f"(select distinct {plain(meta('activity'))} as p from extractions where category = 'prohibition') where p <> '' and not exists (select 1 from (select distinct {plain(meta('violation'))} as v from extractions where category = 'penalty') where v <> '' and (contains(' ' || p || ' ', ' ' || v || ' ') or contains(' ' || v || ' ', ' ' || p || ' ')))"),
    "g7_vague_requirements": row("legal", "vague_requirement", "'important'", "n::varchar", "(select count(*) as n from extractions where category = 'distance' and confidence < 0.5) where n > 0"),
    "g8_enforcement_gaps": row("legal", "enforcement_gap", "'important'", "n::varchar", f"(select count(*) as n from extractions where category = 'permit' and {meta('issuing_authority')} is null) where n > 0"),
    "g9_missing_data_types": row("data", "missing_data_type", "'critical'", "term", f"{terms(gaps.ESSENTIAL_DATA)} where not exists (select 1 from extractions where category = 'data_source' and contains({FOLD.format(meta('source_type'))}, term[1:4]))"),
    "g10_coverage_gaps": row("data", "coverage_gap", "'important'", "'coverage'", f"(select avg(({meta('spatial_coverage')} is null and {meta('temporal_coverage')} is null)::int) as share from extractions where category = 'data_source') where share > 0.3"),
    "g11_resolution_gaps": row("data", "resolution_gap", "'minor'", "'resolution'", f"(select avg(({meta('resolution')} is null)::int) as share from extractions where category = 'data_source') where share > 0.5"),
    "g12_unprotected_species": row("integration", "unprotected_important_species", "'critical'", "name", f"(select {FOLD.format(meta('species_name'))} as name, count(distinct document_id) as n, count({meta('protection_status')}) as k from extractions where category = 'species' group by 1) where name is not null and n >= 3 and k = 0", 2),
    "g13_legal_data_mismatch": " union all ".join(row("integration", "legal_data_mismatch", "'critical'", f"'{t}'", f"(select count(*) filter (where category = 'permit' and {_has('context', w)}) as r, count(*) filter (where category = 'data_source' and {_has(meta('source_type'), w)}) as d from extractions) where r > 0 and d = 0", 2) for t, w in gaps.REQUIRED_DATA.items()),
    "g14_method_legal_disconnect": row("integration", "method_legal_disconnect", "'important'", "name", f"(select {plain(meta('method_type'))} as name, count(*) as n from extractions where category = 'method' group by 1) where name <> '' and n >= 5 and not exists (select 1 from (select {plain('e.context')} as t from extractions e join documents d on e.document_id = d.id where d.doc_type = 'legal') where contains(' ' || t || ' ', ' ' || name || ' '))", 2),
    "g15_unmonitored_areas": row("integration", "unmonitored_mpa", "'critical'", "name", f"(select distinct {plain(meta('name'))} as name from extractions where category = 'protected_area') where name <> '' and not exists (select 1 from (select {plain('context')} as t from extractions where category = 'data_source') where contains(' ' || t || ' ', ' ' || name || ' '))", 2),
    "g16_access_barriers": row("integration", "data_access_barrier", "'important'", "'access'", f"(select avg(coalesce({meta('access_type')} in ('restricted', 'proprietary'), false)::int) as share from extractions where category = 'data_source') where share > 0.2"),
    "g17_research_policy_disconnect": row("integration", "research_policy_disconnect", "'critical'", "'recommendation'", f"(select count(*) filter (where category = 'finding' and {meta('finding_type')} = 'recommendation') as r, count(*) filter (where category = 'policy') as p from extractions) where r > 10 and p < 5", 2),
}
ALL = " union all ".join(f"select * from ({q})" for q in SQL.values())
SCORED = f"""select *, round(case severity when 'critical' then 3.0 when 'important' then 2.0 else 1.0 end * case gap_category when 'integration' then 1.5 when 'legal' then 1.3 when 'data' then 1.1 else 1.0 end
    + least(n_evidence * 0.1, 0.5) + 0.3, 6)::double as priority_score from ({ALL})"""
ORACLES = SQL | {
    "g18_prioritized": SCORED,
    "g19_top_gaps": f"select * from ({SCORED}) order by priority_score desc, gap_category, gap_type, subject limit 20",
    "g21_summary": f"with g as ({ALL}) select 'total' as measure, count(*) as value from g union all select term, (select count(*) from g where severity = term) from {terms(tuple(gaps.SEVERITY))} union all select term, (select count(*) from g where gap_category = term) from {terms(tuple(gaps.WEIGHT))}",
    "r6_gap_matrix": f"select gap_category, count(*) filter (where severity = 'critical') as critical, count(*) filter (where severity = 'important') as important, count(*) filter (where severity = 'minor') as minor from ({ALL}) group by 1",
}
_CATEGORY = "case category " + " ".join(f"when '{a}' then '{b}'" for a, b in DERIVED.items()) + " else category end"
_DERIVED = f"""with derived as (select id, document_id, {_CATEGORY} as category, exact_text, context, confidence / 2 as confidence,
    case category when 'data_source' then '{PLAIN["data_source"]}' when 'finding' then '{PLAIN["finding"]}' else metadata end as metadata from extractions) """
ORACLES |= {
    "g22_derived_gaps": _DERIVED + SCORED.replace("extractions", "derived"),
    "r4_gap_report": f"""select row_number() over (partition by gap_category order by case severity when 'critical' then 0 when 'important' then 1 else 2 end, gap_type, subject)::int as number, gap_category, gap_type, severity, subject from ({ALL})""",
}
