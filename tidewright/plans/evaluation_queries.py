"""Evaluation and report queries with the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import evaluation as V
from tidewright.operators import reports as R
from tidewright.operators.search import folded
from tidewright.operators.skew import skew_join
from tidewright.plans.store_queries import FOLD
from tidewright.sources.tables import table


def _s(s, sf):
    return V.sheets({c: table(s, sf, f"validate_{c}") for c in V.SHEETS})


def _e(s, sf):
    return table(s, sf, "extractions")


def v1_sheet_sample(s, sf):
    return V.sample(_e(s, sf), 50, 42).select("id", "category")


def v3_ground_truth(s, sf):
    return _s(s, sf).where(V.yes("is_correct")).select("category", "id", "exact_text")


def v5_middle_documents(s, sf):
    return V.middle_documents(_e(s, sf))


def v6_precision(s, sf):
    return V.precision(_s(s, sf))


def v9_kappa(s, sf):
    return V.kappa(_s(s, sf))


def v11_macro_micro(s, sf):
    return V.macro_micro(_s(s, sf))


def v12_exact_match(s, sf):
    truth = _s(s, sf).where(V.yes("is_correct"))
    return V.exact_match(_e(s, sf).where(F.col("category").isin(*V.SHEETS)), truth)


def v17_confidence_by_outcome(s, sf):
    return V.confidence_by_outcome(_s(s, sf))


def v18_errors(s, sf):
    return V.errors(_s(s, sf))


def r1_category_totals(s, sf):
    return R.category_totals(_e(s, sf))


def r2_first_texts(s, sf):
    return R.first_texts(_e(s, sf))


def r5_per_document(s, sf):
    return R.per_document(_e(s, sf), table(s, sf, "documents"))


def r7_confidence_histogram(s, sf):
    return R.confidence_histogram(_e(s, sf))


def v8_recall(s, sf):
    """How many of the correct rows of the sheets the store holds for their file, word for word."""
    key = F.trim(folded("exact_text")).alias("__k")
    d = table(s, sf, "documents").select(F.col("id").alias("document_id"), F.col("filename").alias("source_file"))
    found = skew_join(_e(s, sf).where(F.col("category").isin(*V.SHEETS)), d, "document_id", hashed=False).select("source_file", "category", key)
    return V.recall_by_category(found, _s(s, sf).where(V.yes("is_correct")).select("source_file", "category", key))


def v15_overall(s, sf):
    return V.overall(v12_exact_match(s, sf))


def v17_error_examples(s, sf):
    return V.error_examples(_s(s, sf))


def v17_worst_category(s, sf):
    return V.worst_category(_s(s, sf))


def r3_summary(s, sf):
    return R.json_summary(_e(s, sf), table(s, sf, "documents"))


def s8_source_counts(s, sf):
    return R.source_counts(_e(s, sf), table(s, sf, "documents"))


QUERIES = (v8_recall, v15_overall, v17_error_examples, v17_worst_category, r3_summary, s8_source_counts, v1_sheet_sample, v3_ground_truth, v5_middle_documents, v6_precision, v9_kappa, v11_macro_micro, v12_exact_match, v17_confidence_by_outcome, v18_errors, r1_category_totals, r2_first_texts, r5_per_document, r7_confidence_histogram)

S = " union all ".join(f"select '{c}' as category, id, source_file, exact_text, confidence, marine_relevance, is_correct, is_relevant, error_type from validate_{c}" for c in V.SHEETS)
Y = "(nullif(lower(trim({0}, ' ')), '') in ('y', 'yes', 'true', '1'))"
C, B = Y.format("is_correct"), Y.format("is_relevant")
WILSON = "case when {n} = 0 then 0.0 else greatest(0.0, least(1.0, ({p} + 1.96 * 1.96 / (2 * {n}) {s} 1.96 * sqrt(({p} * (1 - {p}) + 1.96 * 1.96 / (4 * {n})) / {n})) / (1 + 1.96 * 1.96 / {n}))) end"
COUNTS = f"(select category, count(*) filter (where {C}) as k, count(*) filter (where not {C}) as w, count(*) filter (where {C} is null) as u from ({S}) group by category)"
low, high = (WILSON.format(p="p", n="n", s=s) for s in "-+")
ORACLES = {
    "v1_sheet_sample": "select id, category from (select id, category, row_number() over (partition by category order by md5('42|' || id), id) as k, count(*) over (partition by category) as n from extractions) where k <= 50 and n >= 5",
    "v3_ground_truth": f"select category, id, exact_text from ({S}) where {C}",
    "v5_middle_documents": "select document_id, n, rank from (select document_id, count(*) as n, row_number() over (order by count(*), document_id) - 1 as rank, count(*) over () as t from extractions where document_id is not null group by document_id) where rank >= t // 4 and rank < 3 * t // 4",
    "v6_precision": f"select category, k as n_correct, w as n_incorrect, u as n_unannotated, round(p, 6)::double as precision, round({low}, 6)::double as low, round({high}, 6)::double as high from (select *, (k + w)::double as n, case when k + w = 0 then 0.0 else k / (k + w)::double end::double as p from {COUNTS})",
    "v9_kappa": f"""with c as (select category, count(*) as n, avg((a = b)::int) as po, avg(a::int) as pa, avg(b::int) as pb from (select category, {C} as a, {B} as b from ({S})) where a is not null and b is not null group by category),
        k as (select category, n, case when pa * pb + (1 - pa) * (1 - pb) = 1 then 1.0 else round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) end::double as kappa from c)
        select *, case when kappa >= 0.8 then 'excellent' when kappa >= 0.6 then 'good' when kappa >= 0.4 then 'moderate' else 'poor' end as level from k""",
    "v11_macro_micro": f"""with r as (select avg(k / (k + w)::double) as macro, sum(k)::double / sum(k + w) as p, sum(k + w)::double as n from {COUNTS} where k + w > 0)
        select 'macro_precision' as measure, round(macro, 6) as value from r union all select 'micro_precision', round(p, 6) from r union all select 'micro_low', round({low}, 6) from r union all select 'micro_high', round({high}, 6) from r""",
    "v12_exact_match": f"""with f as (select distinct category, trim({FOLD.format('exact_text')}, ' ') as x from extractions where category in ('distance', 'method', 'legal_reference')), t as (select distinct category, trim({FOLD.format('exact_text')}, ' ') as x from ({S}) where {C}),
        m as (select coalesce(f.category, t.category) as category, f.x as fx, t.x as tx from (select * from f where x <> '') f full join (select * from t where x <> '') t on f.category = t.category and f.x = t.x),
        c as (select category, count(*) filter (where fx is not null and tx is not null) as tp, count(*) filter (where tx is null) as fp, count(*) filter (where fx is null) as fn from m group by category),
        p as (select *, case when tp + fp = 0 then 0.0 else tp::double / (tp + fp) end as p, case when tp + fn = 0 then 0.0 else tp::double / (tp + fn) end as r from c)
        select category, tp, fp, fn, round(p, 6)::double as precision, round(r, 6)::double as recall, case when p + r = 0 then 0.0 else round(2 * p * r / (p + r), 6) end::double as f1 from p""",
    "v17_confidence_by_outcome": f"select category, {C} as correct, count(*) as n, round(avg(confidence) + 1e-9, 3) as avg_confidence, round(avg(marine_relevance) + 1e-9, 3) as avg_relevance from ({S}) where {C} is not null group by 1, 2",
    "v18_errors": f"""with w as (select coalesce(nullif(trim(error_type, ' '), ''), 'unspecified') as error_type, category, id from ({S}) where not {C})
        select error_type, count(*) as n, round(count(*)::double / (select count(*) from w), 6) as share, min(row(category, id))[1] as first_category, min(row(category, id))[2]::bigint as first_id from w group by 1""",
    "r1_category_totals": "select category, count(*) as n, count(distinct document_id) as n_documents, round(count(*)::double / (select count(*) from extractions), 6) as share from extractions group by 1",
    "r2_first_texts": "select id, document_id, category, position::int as position, exact_text, greatest(n - 5, 0) as n_more from (select *, row_number() over (partition by document_id, category order by id) as position, count(*) over (partition by document_id, category) as n from extractions) where position <= 5",
    "r5_per_document": "select d.id as document_id, doc_type, coalesce(n, 0) as n, coalesce(k, 0) as n_categories, a as avg_confidence from documents d left join (select document_id, count(*) as n, count(distinct category) as k, round(avg(confidence) + 1e-9, 3) as a from extractions group by 1) e on d.id = e.document_id",
    "r7_confidence_histogram": "with s as (select min(confidence) as lo, max(confidence) as hi from extractions) select (case when hi = lo then 0 else least(floor((confidence - lo) / ((hi - lo) / 20) + 1e-9), 19) end)::int as bin, count(*) as n from extractions, s where confidence is not null group by 1",
}
_K = f"trim({FOLD.format('exact_text')}, ' ')"
_P, _R = "(case when tp + fp = 0 then 0.0 else tp::double / (tp + fp) end)", "(case when tp + fn = 0 then 0.0 else tp::double / (tp + fn) end)"
_F1 = "(case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end)"
_KIND = "coalesce(nullif(lower(trim(error_type, ' ')), ''), 'unspecified')"
ORACLES |= {
    "v8_recall": f"""with t as (select source_file, category, {_K} as k from ({S}) where {C}), f as (select distinct filename as source_file, category, {_K} as k from extractions e join documents d on e.document_id = d.id),
        c as (select category, count(*) as n_human, count(*) filter (where exists (select 1 from f where f.source_file = t.source_file and f.category = t.category and f.k = t.k)) as n_matched from t where source_file is not null or true group by category),
        r as (select *, n_matched::double / n_human as p, n_human::double as n from c) select category, n_human, n_matched, round(p, 6) as recall, round({low}, 6)::double as low, round({high}, 6)::double as high from r""",
    "v15_overall": f"""with m as ({ORACLES['v12_exact_match']}), c as (select *, {_P} as p, {_R} as r from m), a as (select avg(p) as mp, avg(r) as mr, avg({_F1}) as mf, sum(tp)::double as tp, sum(fp)::double as fp, sum(fn)::double as fn from c),
        o as (select mp, mr, mf, {_P} as p, {_R} as r from a)
        select unnest(['macro_precision', 'macro_recall', 'macro_f1', 'micro_precision', 'micro_recall', 'micro_f1']) as measure, unnest([round(mp, 6), round(mr, 6), round(mf, 6), round(p, 6), round(r, 6), round({_F1}, 6)]) as value from o""",
    "v17_error_examples": f"select category, error_type, position::int as position, id, text from (select category, {_KIND} as error_type, id::bigint as id, substr(exact_text, 1, 100) as text, row_number() over (partition by category, {_KIND} order by id) as position from ({S}) where not {C}) where position <= 3",
    "v17_worst_category": f"select arg_min(category, row(k::double / (k + w), category)) as least_precise, arg_min(category, row(-w, category)) as most_errors from {COUNTS} where k + w > 0",
    "r3_summary": "select 'total_documents' as measure, count(*) as value from documents union all select 'total_extractions', count(*) from extractions union all select coalesce(category, ''), count(*) from extractions group by category",
    "s8_source_counts": "select coalesce(doc_type, 'unknown') as doc_type, count(*) as n_documents, coalesce(sum(n), 0)::bigint as n_extractions from documents d left join (select document_id, count(*) as n from extractions group by 1) on document_id = d.id group by 1",
}
