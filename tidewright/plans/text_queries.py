"""Scalar text operators over whole tables with the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import fields as V
from tidewright.functions import text as T
from tidewright.plans.field_queries import dialect
from tidewright.plans.store_queries import FOLD
from tidewright.sources.tables import spread, table


def _e(s, sf):
    return spread(table(s, sf, "extractions").select("id", "document_id", "category", "exact_text", "context"), "id")


def _d(s, sf):
    return spread(table(s, sf, "documents").select("doc_id", "text"), "doc_id")


def context():
    return F.col("context")


def t1_document_class(s, sf):
    return _d(s, sf).select("doc_id", T.document_class(F.col("text")).alias("document_class"))


def s4_long_enough(s, sf):
    return _d(s, sf).where(F.length(F.trim("text")) >= 50).select("doc_id")


def t6_without_references(s, sf):
    return _e(s, sf).select("id", T.without_references(context()).alias("clean"))


def t9_scan_quality(s, sf):
    return _e(s, sf).select("id", F.round(T.scan_quality(context()), 6).alias("quality"))


def t14_garbled(s, sf):
    return _e(s, sf).select("id", T.is_garbled(context()).alias("garbled"))


def t15_coherence(s, sf):
    return _e(s, sf).select("id", T.coherence(context()).alias("coherence")).select("id", "coherence", (F.col("coherence") < 0.25).alias("incoherent"))


def t17_citations(s, sf):
    return _e(s, sf).select("id", T.is_citation(context()).alias("citation"), T.citation_count(context()).alias("n_citations"))


def t24_relevance(s, sf):
    return _e(s, sf).select("id", T.marine_relevance(context()).alias("relevance"))


def t25_false_positives(s, sf):
    return _e(s, sf).select("id", T.false_positive(context(), F.col("exact_text")).alias("reason")).where("reason is not null")


def t30_activities(s, sf):
    return _e(s, sf).select("id", T.activity(context()).alias("a")).select("id", F.col("a.name").alias("activity"), F.col("a.confidence").alias("confidence"))


def t31_reference_points(s, sf):
    return _e(s, sf).select("id", T.reference_point(context()).alias("r")).select("id", "r.term", "r.kind").where("term is not null")


def t36_record_hash(s, sf):
    e = _e(s, sf).select("id", F.substring(F.md5(F.concat_ws("|", "document_id", "category", F.coalesce("exact_text", F.lit("None")))), 1, 16).alias("record_hash"))
    return e.groupBy("record_hash").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))


def t7_references(s, sf):
    return _e(s, sf).select("id", T.has_reference(context()).alias("has_reference"))


def t8_mended(s, sf):
    """Contexts that the scan normaliser changes."""
    return _e(s, sf).select("id", context().alias("before"), T.mended(context()).alias("mended")).where("mended <> before").select("id", "mended")


def t27_marine_documents(s, sf):
    return _d(s, sf).select("doc_id", T.document_is_marine(F.col("text")).alias("is_marine"))


def t2_predicates(s, sf):
    """Language and kind of each document, from its class."""
    of = T.document_class(F.col("text"))
    return _d(s, sf).select("doc_id", F.when(of.endswith("turkish"), "turkish").otherwise("english").alias("spoken"), of.startswith("legal").alias("is_legal"), of.startswith("scientific").alias("is_scientific"))


def t23_filter_chain(s, sf):
    """Whether each extraction passes the common filters, and the multiplier of its confidence."""
    e = _e(s, sf).select("id", V.filter_chain(F.col("exact_text"), context(), F.col("category")).alias("r"))
    return e.select("id", "r.valid", "r.multiplier")


QUERIES = (t23_filter_chain, t7_references, t8_mended, t27_marine_documents, t2_predicates, t1_document_class, s4_long_enough, t6_without_references, t9_scan_quality, t14_garbled, t15_coherence, t17_citations, t24_relevance, t25_false_positives, t30_activities, t31_reference_points, t36_record_hash)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def presence(text: str, terms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({text}, {q(T.fold_term(t))})::int" for t in terms) + ")"


def occurrences(text: str, terms: tuple[str, ...]) -> str:
    pattern = "|".join(sorted({T.fold_term(t) for t in terms}, key=lambda t: (-len(t), t)))
    return f"len(regexp_extract_all({text}, {q('(?:' + pattern + ')')}))"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


H = "substr(text, 1, 5000)"
LOW = FOLD.format(H)
_kind = lambda lang: f"case when {presence(LOW, T.LEGAL[lang])} >= {presence(LOW, T.SCIENTIFIC[lang])} then 'legal_{lang}' else 'scientific_{lang}' end"
_clean = "context"
for _p in (r"\((?:Değişik|Ek|İptal|Amended)[^)]*\)", r"(?i)R\.?G\.?[- ][0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?:[- ][0-9]{1,5})?", r"[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}", r"[0-9]{1,5} +sayılı", r"(?:19|20)[0-9]{2}[-–—](?:19|20)[0-9]{2}"):
    _clean = f"regexp_replace({_clean}, {q(_p)}, ' ', 'g')"
LC = FOLD.format("context")
M, B, O = occurrences(LC, T.MARINE + T.MARINE_TURKISH), occurrences(LC, T.BUILDING), occurrences(LC, T.OTHER_DOMAIN)
NEAR = "substr(context, greatest(1, instr(context, exact_text) - 50)::bigint, length(exact_text) + 100)"
def _point(language: str) -> str:
    word = lambda t: "regexp_extract(context, " + q("(?:^|[^\\p{L}\\p{N}_])".join(["(?i)", f"({dialect(t)[4:]}[\\p{{L}}\\p{{N}}_\\p{{M}}]*)"])) + ", 1)"
    return "case " + " ".join(f"when {word(t)} <> '' then {{'term': {word(t)}, 'kind': {q(T.point_kind(t))}}}" for t in T.REFERENCE_POINTS[language]) + " end"


def _scores(language: int) -> str:
    return ", ".join(f"{{'score': {presence(LC, tuple(dict.fromkeys(map(T.fold_term, k[language]))))} * {k[2]}, 'i': {-i}}}" for i, k in enumerate(T.KEYWORDS.values()))


ORACLES = {
    "t1_document_class": f"select doc_id, case when text is null or text = '' then 'unknown' when {count(H, f'[{T.TURKISH_LETTERS}]')} > length({H}) * 0.02 then {_kind('turkish')} else {_kind('english')} end as document_class from documents",
    "s4_long_enough": "select doc_id from documents where length(trim(text, ' ')) >= 50",
    "t6_without_references": f"select id, trim(regexp_replace({_clean}, '[ \\t\\r\\n]+', ' ', 'g'), ' ') as clean from extractions",
    "t9_scan_quality": f"""select id, case when context is null or context = '' then 0.0 else round(greatest(0.0, least(1.0, 1.0 - ({count('context', '[¸˘¨˙]')} + {count('context', '[a-z][A-Z][a-z]')} + {count('context', '[0-9][a-zA-Z][0-9]')} + 2 * {count('context', '[\\p{L}\\p{N}_]{25,}')})::double / greatest(length(context)::double / 100, 1.0))), 6) end::double as quality from extractions""",
    "t14_garbled": """select id, case when context is null or length(context) < 10 then false else (length(context) > 200 and not regexp_matches(substr(context, 1, 200), '[.!?;:]'))
        or (contains(trim(context, ' '), chr(10)) and len([l for l in string_split(trim(context, ' '), chr(10)) if trim(l, ' ') <> '' and length(trim(l, ' ')) < 30 and not regexp_matches(trim(l, ' '), '[,:-]\\z') and not regexp_matches(trim(l, ' '), '^[A-Z][a-z]+ [A-Z][a-z]+\\z')]) > 0)
        or regexp_matches(lower(context), 'elsevier|springer|wiley|doi\\.org|https?://|www\\.') or regexp_matches(context, 'Writing *[-–] *(?:review|original|draft)|Methodology|Funding acquisition|Visualization|Validation') end as garbled from extractions""",
    "t15_coherence": f"""with c as (select id, context, regexp_replace({LC}, '[^a-zğüşöç]', '', 'g') as c from extractions),
        n as (select *, length(c) as n, len([i for i in range(1, length(c)) if c[i:i+1] in ({', '.join(map(q, dict.fromkeys(T.BIGRAMS)))})])::double as pairs, {count('c', '[aeiouöü]')}::double as v, {count('context', '[^ \\t\\r\\n]+')}::double as w, length(regexp_replace(context, '[ \\t\\r\\n]+', '', 'g'))::double as l from c),
        s as (select id, case when context is null or length(context) < 10 or n < 6 then 0.5 else round(pairs / (n - 1) * 0.5 + greatest(0.0, least(1.0, 1 - abs(v / n - 0.4) * 3)) * 0.25 + greatest(0.0, least(1.0, 1 - abs(l / w - 5.5) / 5)) * 0.25, 6) end::double as coherence from n)
        select *, coherence < 0.25 as incoherent from s""",
    "t17_citations": "select id, coalesce(" + " or ".join([f"{count('context', p)} >= 2" for p in T.INLINE_CITATIONS] + [f"regexp_matches(context, {q(p)})" for p in T.REFERENCE_ENTRIES] + [f"length(regexp_extract(lower(trim(context, ' ')), {q(T.JOURNAL)}, 1)) > length(lower(trim(context, ' '))) * 0.5"]) + ", false) as citation, (" + " + ".join(count("context", p) for p in T.INLINE_CITATIONS) + ")::int as n_citations from extractions",
    "t24_relevance": f"select id, case when context is null or {M} + {B} = 0 then 0.5 else round({M}::double / ({M} + {B}), 6) end::double as relevance from extractions",
    "t25_false_positives": f"""select * from (select id, case when context is null or context = '' then 'empty' when {O} >= 2 and {M} = 0 then 'other_domain' when {B} >= 3 and {M} = 0 then 'building'
        when instr(context, exact_text) > 0 and ({' or '.join(f'regexp_matches({NEAR}, {q(p)})' for p in T.LAW_REFERENCES)}) then 'law_reference' when 2 * {B} - 4 * {M} > 5 and {M} = 0 then 'score' end as reason from extractions) where reason is not null""",
    "t30_activities": f"""with b as (select id, case when len(regexp_extract_all(context, '[çğışöüÇĞİŞÖÜ]')) > 2 then list_max([{_scores(0)}]) else list_max([{_scores(1)}]) end as b from extractions where context is not null union all select id, null from extractions where context is null)
        select id, case when b.score >= 2 then ([{', '.join(q(a) for a in T.KEYWORDS)}])[1 - b.i] else 'unspecified' end as activity, case when b.score >= 2 then greatest(0.4, least(1.0, b.score / 25.0)) else 0.25 end::double as confidence from b""",
    "t31_reference_points": f"""with w as (select id, case when len(regexp_extract_all(context, '[çğışöüÇĞİŞÖÜ]')) > 2 then {_point('turkish')} else {_point('english')} end as p from extractions) select id, p.term, p.kind from w where p is not null""",
    "t36_record_hash": "select record_hash, min(id) as first_id, count(*) as n from (select id, md5(concat_ws('|', document_id, category, coalesce(exact_text, 'None')))[1:16] as record_hash from extractions) group by 1",
}
_mend = "context"
for _p, _r in T.MENDED:
    _mend = f"regexp_replace({_mend}, {q(_p)}, {q(_r)}, 'g')"
_mend = f"regexp_replace(regexp_replace({_mend}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
_LT = FOLD.format("text")
ORACLES |= {
    "t7_references": "select id, coalesce(" + " or ".join(f"regexp_matches(context, {q(p)})" for p in (r"[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}", r"[0-9]{1,5} +sayılı", *T.LAW_REFERENCES)) + ", false) as has_reference from extractions",
    "t8_mended": f"select id, mended from (select id, context, {_mend} as mended from extractions) where mended <> context",
    "t27_marine_documents": f"select doc_id, coalesce({occurrences(_LT, T.MARINE + T.MARINE_TURKISH)} >= 5, false) as is_marine from documents",
    "t2_predicates": f"select doc_id, case when document_class like '%turkish' then 'turkish' else 'english' end as spoken, document_class like 'legal%' as is_legal, document_class like 'scientific%' as is_scientific from ({ORACLES['t1_document_class']})",
}
_GROUPS, _NAME = f"lower(regexp_replace(exact_text, '^\\s+|\\s+\\z', '', 'g')) in ({', '.join(map(q, V.GENERIC_GROUPS))})", "lower(regexp_replace(exact_text, '^\\s+|\\s+\\z', '', 'g'))"
_BINOMIAL = "regexp_matches(regexp_replace(exact_text, '^\\s+|\\s+\\z', '', 'g'), '^[A-Z][a-z]{2,}\\s+[a-z]{2,}\\z')"
_QUALIFIED = "(" + " or ".join(f"coalesce(contains(lower(context), {q(t)}), false)" for t in V.QUALIFYING) + ")"
ORACLES["t23_filter_chain"] = f"""with a as ({ORACLES['t15_coherence'].replace('context', 'exact_text')}), b as ({ORACLES['t17_citations'].replace('context', 'exact_text')}), c as ({ORACLES['t17_citations']}),
    x as (select e.id, coalesce(b.citation or a.coherence < 0.2 or (category = 'species' and not ({_BINOMIAL} or not ({_NAME} in ({', '.join(map(q, V.PLACE_NAMES))}) or ({_GROUPS} and not {_QUALIFIED})))), false) as bad,
        case when coalesce(c.n_citations, 0) >= 3 then 0.5 else 1.0 end * case when a.coherence < 0.35 then 0.6 else 1.0 end
            * case when category = 'species' then case when {_BINOMIAL} then 1.5 when {_GROUPS} then 0.7 when regexp_matches({_NAME}, '\\S\\s+\\S') then 1.0 else 0.8 end else 1.0 end as w
        from extractions e join a using (id) join b using (id) join c using (id))
    select id, not bad as valid, case when bad then 0.0 else round(greatest(0.1, least(1.5, w)), 6) end::double as multiplier from x"""
