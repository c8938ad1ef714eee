"""Queries over the knowledge store with the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import linking, search, store
from tidewright.sources.tables import table

#: Spellings shared by the SQL below: folded text, and an entity's name from the metadata or the text.
FOLD = "lower(translate({0}, 'İIı', 'iii'))"


def name_sql(field: str) -> str:
    pick = ", ".join(f"nullif(trim(json_extract_string(try_cast(e.metadata as json), '$.{f}'), ' '), '')" for f in (field, "name"))
    return f"coalesce({pick}, nullif(trim(regexp_replace(e.exact_text, '\\s+', ' ', 'g')), ''))"


def _e(s, sf):
    return table(s, sf, "extractions")


def _d(s, sf):
    return table(s, sf, "documents")


def _x(s, sf):
    return table(s, sf, "cross_references")


def k1_insert_documents(s, sf):
    return store.insert_documents(_d(s, sf))


def k2_insert_extractions(s, sf):
    return store.insert_extractions(_e(s, sf))


def k4_topk_extractions(s, sf):
    return store.query_extractions(_e(s, sf), _d(s, sf), category="species", min_confidence=0.5, doc_type="legal", limit=100)


def k4_all_extractions(s, sf):
    return store.query_extractions(_e(s, sf), _d(s, sf), min_confidence=0.8, limit=None)


def k5_document_summary(s, sf):
    return store.document_summary(_d(s, sf))


def k6_extraction_counts(s, sf):
    return store.extraction_counts(_e(s, sf))


def k7_cross_references(s, sf):
    return store.insert_cross_references(_x(s, sf))


def k8_upsert_integrated(s, sf):
    e, d = _e(s, sf), _d(s, sf)
    old = linking.integrated(e.where("confidence >= 0.8"), d, "species", "species_name", "species").withColumn("version", F.lit(1))
    new = linking.integrated(e, d, "species", "species_name", "species").where("research_mentions > 0").withColumn("version", F.lit(2))
    return store.upsert(old, new, ["entity_type", "entity"], "version")


def q1_search(s, sf):
    return search.search_extractions(_e(s, sf), _d(s, sf), "seagrass", limit=100)


def q1_search_all(s, sf):
    return search.search_extractions(_e(s, sf), _d(s, sf), "deniz çayırı", limit=None)


def q2_species_summary(s, sf):
    return search.entity_summary(_e(s, sf), _d(s, sf), "species", "species_name")


def q2_species_files(s, sf):
    return search.entity_files(_e(s, sf), _d(s, sf), "species", "species_name")


def q3_methods_summary(s, sf):
    return search.entity_summary(_e(s, sf), _d(s, sf), "method", "method_type")


def q4_requirements_for_activity(s, sf):
    return search.requirements_for(_e(s, sf), _d(s, sf), "anchoring")


def q5_cross_document_entity(s, sf):
    return search.cross_document_entity(_e(s, sf), _d(s, sf), "Wetland Park")


def q6_statistics(s, sf):
    return search.statistics(_d(s, sf), _e(s, sf), _x(s, sf))


def l1_species_links(s, sf):
    return linking.species_across_types(_e(s, sf), _d(s, sf))


def l1_species_members(s, sf):
    return linking.species_members(_e(s, sf), _d(s, sf))


def l2_methods_data(s, sf):
    return linking.methods_and_data(_e(s, sf))


def l2b_methods_data_words(s, sf):
    return linking.methods_and_data_words(_e(s, sf))


def l4_conflicts_stakeholders(s, sf):
    return linking.conflicts_and_stakeholders(_e(s, sf))


def l5_conflicts_places(s, sf):
    return linking.conflicts_and_places(_e(s, sf))


def l6_integrated(s, sf):
    e, d = _e(s, sf), _d(s, sf)
    a = linking.integrated(e, d, "species", "species_name", "species")
    b = linking.integrated(e, d, "method", "method_type", "method")
    return a.unionByName(b).unionByName(linking.integrated(e, d, "protected_area", "name", "protected_area"))


def l0_all_links(s, sf):
    return linking.all_links(_e(s, sf), _d(s, sf))


def l7_entity_names(s, sf):
    e = _e(s, sf).where("category = 'protected_area'")
    return e.select("id", search.entity_name("name").alias("entity_name"))


QUERIES = (
    k1_insert_documents, k2_insert_extractions, k4_topk_extractions, k4_all_extractions, k5_document_summary, k6_extraction_counts, k7_cross_references, k8_upsert_integrated,
    q1_search, q1_search_all, q2_species_summary, q2_species_files, q3_methods_summary, q4_requirements_for_activity, q5_cross_document_entity, q6_statistics,
    l0_all_links, l1_species_links, l1_species_members, l2_methods_data, l2b_methods_data_words, l4_conflicts_stakeholders, l5_conflicts_places, l6_integrated, l7_entity_names,
)

HAS = "(coalesce(contains(" + FOLD.format("e.exact_text") + ", '{0}'), false) or coalesce(contains(" + FOLD.format("e.context") + ", '{0}'), false))"


def summary_sql(category: str, field: str) -> str:
    return f"""
        with n as (select e.id, e.confidence, d.filename, {name_sql(field)} as name from extractions e join documents d on e.document_id = d.id where e.category = '{category}')
        select {FOLD.format('name')} as entity, arg_max(name, row(coalesce(confidence, -1.0), id)) as display_name, count(*) as n_mentions, count(distinct filename) as n_files,
               min(filename) as first_filename, round(avg(coalesce(confidence, 0.0)) + 1e-9, 3) as avg_confidence
        from n where name is not null group by 1"""


def integrated_sql(category: str, field: str, kind: str) -> str:
    return f"""select '{kind}' as entity_type, {FOLD.format('name')} as entity, arg_min(name, id) as entity_name,
        count(*) filter (where doc_type = 'legal') as legal_mentions, count(*) filter (where doc_type = 'research') as research_mentions, count(*) filter (where doc_type = 'dataset') as data_mentions
        from (select e.id, d.doc_type, e.confidence, {name_sql(field)} as name from extractions e join documents d on e.document_id = d.id where e.category = '{category}') where name is not null group by 2"""


def same_sql(first: str, second: str, link: str, confidence: float) -> str:
    return f"""select document_id, min(case when category = '{first}' then id end) as id_1, min(case when category = '{second}' then id end) as id_2,
        count(*) filter (where category = '{first}') as n_1, count(*) filter (where category = '{second}') as n_2, '{link}' as link_type, {confidence}::double as confidence
        from extractions group by document_id having count(*) filter (where category = '{first}') > 0 and count(*) filter (where category = '{second}') > 0"""


MEMBERS = f"select {FOLD.format(name_sql('species_name'))} as entity, coalesce(d.doc_type, 'unknown') as doc_type, e.id from extractions e join documents d on e.document_id = d.id where e.category = 'species' and {name_sql('species_name')} is not null"
WORDS = "list_distinct([w for w in regexp_split_to_array({0}, '\\s+') if length(w) > {1}])"

ORACLES = {
    "k1_insert_documents": "select filename, arg_min(id, doc_id) as kept_id, count(*) as n_offered from documents group by filename",
    "k2_insert_extractions": """select document_id, sha256(coalesce(category, 'None') || '|' || coalesce(exact_text, 'None') || '|' || coalesce(context, 'None')) as content_hash, min(id) as kept_id, count(*) as n_offered from extractions group by 1, 2""",
    "k4_topk_extractions": """select e.id, e.document_id, category, exact_text, page_number, confidence, marine_relevance, filename, doc_type from extractions e join documents d on e.document_id = d.id
        where category = 'species' and confidence >= 0.5 and doc_type = 'legal' order by confidence desc, e.id limit 100""",
    "k4_all_extractions": "select e.id, e.document_id, category, exact_text, page_number, confidence, marine_relevance, filename, doc_type from extractions e join documents d on e.document_id = d.id where confidence >= 0.8",
    "k5_document_summary": """select 'total' as "grouping", '' as value, count(*) as n_documents, coalesce(sum(pages), 0)::bigint as n_pages from documents
        union all select 'doc_type', coalesce(doc_type, ''), count(*), coalesce(sum(pages), 0)::bigint from documents group by doc_type
        union all select 'lang', coalesce(lang, ''), count(*), coalesce(sum(pages), 0)::bigint from documents group by lang""",
    "k6_extraction_counts": "select category, count(*) as n_extractions from extractions group by category",
    "k7_cross_references": """select least(extraction1_id, extraction2_id) as low_id, greatest(extraction1_id, extraction2_id) as high_id, link_type, max(confidence) as confidence, count(*) as n_offered
        from cross_references where extraction1_id <> extraction2_id group by 1, 2, 3""",
    "k8_upsert_integrated": f"""with newer as ({integrated_sql('species', 'species_name', 'species')}),
        older as ({integrated_sql('species', 'species_name', 'species').replace('where name is not null', 'where name is not null and confidence >= 0.8')})
        select *, 2 as version from newer where research_mentions > 0
        union all select *, 1 as version from older o where not exists (select 1 from newer n where n.entity = o.entity and n.research_mentions > 0)""",
    "q1_search": f"select e.id, e.document_id, category, page_number, confidence, filename, doc_type from extractions e join documents d on e.document_id = d.id where {HAS.format('seagrass')} order by confidence desc nulls last, e.id limit 100",
    "q1_search_all": f"select e.id, e.document_id, category, page_number, confidence, filename, doc_type from extractions e join documents d on e.document_id = d.id where {HAS.format('deniz çayiri')}",
    "q2_species_summary": summary_sql("species", "species_name"),
    "q2_species_files": f"select {FOLD.format('name')} as entity, filename, count(*) as n_mentions from (select d.filename, {name_sql('species_name')} as name from extractions e join documents d on e.document_id = d.id where e.category = 'species') where name is not null and filename is not null group by 1, 2",
    "q3_methods_summary": summary_sql("method", "method_type"),
    "q4_requirements_for_activity": f"""select category, count(*) as n_requirements, min(e.id) as first_id, max(confidence) as best_confidence from extractions e join documents d on e.document_id = d.id
        where doc_type = 'legal' and category in ('distance', 'penalty', 'temporal', 'permit', 'prohibition', 'protected_area') and {HAS.format('anchoring')} group by category""",
    "q5_cross_document_entity": f"""select e.id, e.document_id, category, confidence, filename, doc_type from extractions e join documents d on e.document_id = d.id
        where {HAS.format('wetland park')} or coalesce(contains({FOLD.format('e.metadata')}, 'wetland park'), false)""",
    "q6_statistics": """select 'documents' as measure, count(*)::double as value from documents union all select 'pages', coalesce(sum(pages), 0)::double from documents
        union all select 'extractions', count(*)::double from extractions union all select 'average_confidence', round(avg(confidence) + 1e-9, 3) from extractions
        union all select 'categories', count(distinct category)::double from extractions union all select 'cross_references', count(*)::double from cross_references""",
    "l1_species_links": f"""with c as (select entity, doc_type, min(id) as id, count(*) as n from ({MEMBERS}) group by 1, 2)
        select a.entity, a.doc_type as type_1, b.doc_type as type_2, a.id as id_1, b.id as id_2, a.n as n_1, b.n as n_2, 'species_cross_source' as link_type, 1.0::double as confidence
        from c a join c b on a.entity = b.entity and a.doc_type < b.doc_type""",
    "l1_species_members": MEMBERS,
    "l2_methods_data": same_sql("method", "data_source", "method_uses_data", 0.9),
    "l2b_methods_data_words": f"""with t as (select category, {FOLD.format('exact_text')} as text, min(id) as id, count(*) as n from extractions where category in ('method', 'data_source') and exact_text is not null group by 1, 2),
        w as (select *, {WORDS.format('text', 4)} as w, len(regexp_split_to_array(text, '\\s+')) as k from t),
        p as (select a.text as text_1, b.text as text_2, a.id as id_1, b.id as id_2, a.n as n_1, b.n as n_2, len(list_intersect(a.w, b.w))::int as n_shared from w a join w b on a.category = 'method' and b.category = 'data_source' and a.k >= 2)
        select *, round(least(1.0, 0.5 + 0.1 * n_shared), 2)::double as confidence from p where n_shared >= 2""",
    "l4_conflicts_stakeholders": f"""with c as ({same_sql('conflict', 'stakeholder', 'conflict_stakeholder', 0.6)}),
        w as (select document_id, category, unnest({WORDS.format(FOLD.format("coalesce(exact_text, '')"), 3)}) as w from extractions where category in ('conflict', 'stakeholder')),
        s as (select distinct document_id from (select document_id, w from w group by 1, 2 having count(distinct category) = 2))
        select c.document_id, id_1, id_2, n_1, n_2, link_type, case when s.document_id is not null then 0.8 else 0.6 end::double as confidence from c left join s using (document_id)""",
    "l5_conflicts_places": """with c as (select document_id, category, min(id) as id, count(*) as n from extractions where category in ('conflict', 'protected_area', 'distance', 'coordinate') group by 1, 2)
        select a.document_id, a.id as id_1, b.id as id_2, a.n as n_1, b.n as n_2, 'conflict_in_' || b.category as link_type, 0.7::double as confidence from c a join c b using (document_id) where a.category = 'conflict' and b.category <> 'conflict'""",
    "l6_integrated": " union all ".join(integrated_sql(*x) for x in (("species", "species_name", "species"), ("method", "method_type", "method"), ("protected_area", "name", "protected_area"))),
    "l7_entity_names": f"select e.id, {name_sql('name')} as entity_name from extractions e where category = 'protected_area'",
}
_LINKS = " union all ".join(f"select id_1, id_2, link_type, confidence from ({ORACLES[n]})" for n in ("l1_species_links", "l2_methods_data", "l4_conflicts_stakeholders", "l5_conflicts_places"))
ORACLES["l0_all_links"] = f"select least(id_1, id_2) as low_id, greatest(id_1, id_2) as high_id, link_type, max(confidence) as confidence, count(*) as n_offered from ({_LINKS}) where id_1 <> id_2 group by 1, 2, 3"
