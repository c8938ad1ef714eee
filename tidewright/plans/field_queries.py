"""Field parsers over the stored extractions, each with the SQL it is held against.

The tables of labels and patterns are fixed values that both sides read; how a label is chosen, a pattern is sought, a
list is cut and a number is read is written on either side by itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import fields as V
from tidewright.functions import text as T
from tidewright.sources.tables import table


def _rows(s, sf, *categories):
    e = table(s, sf, "extractions").where(F.col("category").isin(*categories))
    return e.select("id", "exact_text", "context", F.coalesce(T.is_turkish(F.col("context")), F.lit(False)).alias("turkish"))


def _query(name, doc, categories, columns):
    def query(s, sf):
        x, c, t = F.col("exact_text"), F.col("context"), F.col("turkish")
        return _rows(s, sf, *categories).select("id", *[of(x, c, t).alias(n) for n, of in columns.items()])

    query.__name__, query.__doc__ = name, doc
    return query


def _first(pattern: str):
    """What the first match of a pattern captures, as a column of the text."""
    return lambda x: F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


def t5_ranges(s, sf):
    """Ranges and bounds that distances, periods and penalties state."""
    return _rows(s, sf, "distance", "temporal", "penalty").select("id", V.stated_range(F.col("exact_text")).alias("r")).select("id", "r.*")


PARAMETER, POLLUTANT = r"(?iu)(pH|salinity|tuzluluk|oxygen|oksijen|turbidity|temperature|noise|water quality|discharge)", r"(?iu)(nitrate|phosphate|nitrat|fosfat|metal|oil|petrol)"
LIST = lambda name, most: lambda x, c, t: F.array_join(V.listed(name, c, t, most), "; ")
SEARCH = lambda name: lambda x, c, t: V.searched(name, c, t)
LABEL = lambda rules, default=None: lambda x, c, t: V.labelled(V.lower(x), t, rules, default)
QUERIES = (
    _query("f2_distance_units", "The unit of each distance.", ("distance",), {"unit": lambda x, c, t: V.distance_unit(_first(r"[0-9] ?(\p{L}+)")(x))}),
    t5_ranges,
    _query("f4_qualifiers", "Lower and upper bounds.", ("distance",), {"qualifier": lambda x, c, t: V.qualifier(x, t)}),
    _query("f5_penalty_types", "Kinds of penalty.", ("penalty",), {"penalty_type": lambda x, c, t: V.penalty_type(x, t)}),
    _query("f7_currencies", "Currencies, the default of a language included.", ("penalty",), {"currency": lambda x, c, t: V.currency(_first(r"(TL|lira|euro|EUR|USD|₺|€|\$)")(x), t)}),
    _query("f9_violations", "What was violated, and under which law.", ("penalty",), {"violation": SEARCH("violation"), "legal_reference": SEARCH("legal_reference")}),
    _query("f13_conditions", "Kinds of environmental condition.", ("environmental",), {"condition_type": lambda x, c, t: V.condition_type(_first(PARAMETER)(c), _first(POLLUTANT)(c), x)}),
    _query("f14_thresholds", "Lower and upper thresholds.", ("environmental",), {"threshold": lambda x, c, t: V.labelled(V.lower(c), t, V.THRESHOLDS)}),
    _query("f15_prohibitions", "Kinds and scope of prohibitions.", ("prohibition",), {"prohibition_type": lambda x, c, t: V.prohibition_type(x, F.lit(None).cast("string"), F.lit(None).cast("string"), t), "scope": SEARCH("scope")}),
    _query("f16_exceptions", "Exceptions from prohibitions.", ("prohibition",), {"exceptions": LIST("exceptions", 3)}),
    _query("f17_permits", "Kinds of permit, and what they require.", ("permit",), {"permit_type": lambda x, c, t: V.permit_type(F.lit(None).cast("string"), F.lit(None).cast("string"), c, t), "requirements": LIST("requirements", 5)}),
    _query("f19_restrictions", "Restrictions of protected areas.", ("protected_area",), {"restrictions": LIST("restrictions", 5)}),
    _query("f22_boundaries", "Location and boundary of coordinates.", ("coordinate",), {"location": SEARCH("location"), "boundary": lambda x, c, t: V.labelled(V.lower(c), t, V.BOUNDARIES)}),
    _query("f23_laws", "Kind and date of legal references.", ("legal_reference",), {"reference_type": LABEL(V.LAWS, "legal_reference"), "date": lambda x, c, t: V.law_date(c)}),
    _query("f24_stakeholders", "Kind and role of stakeholders.", ("stakeholder",), {"stakeholder_type": LABEL(V.STAKEHOLDERS, "stakeholder"), "role": SEARCH("role"), "responsibilities": LIST("responsibilities", 3)}),
    _query("f25_institutions", "Kind and jurisdiction of the institutions that stakeholders name.", ("stakeholder",), {"institution_type": LABEL(V.INSTITUTIONS), "jurisdiction": SEARCH("jurisdiction")}),
    _query("f29_conflicts", "Kind and severity of conflicts.", ("conflict",), {"conflict_type": lambda x, c, t: V.conflict_type(V.lower(c)), "severity": lambda x, c, t: V.labelled(V.lower(c), t, V.SEVERITIES)}),
    _query("f28_plain_activities", "The longest activity keyword that a text holds.", ("conflict", "prohibition"), {"keyword": lambda x, c, t: V.longest_keyword(V.lower(x), t)}),
    _query("f32_methods", "Kind, tools and sample size of methods.", ("method",), {"method_type": lambda x, c, t: V.method_type(x), "sample_size": lambda x, c, t: V.sample_size(c)}),
    _query("f34_findings", "Kind, figure and significance of findings.", ("finding",), {"finding_type": lambda x, c, t: V.label(V.lower(x), V.FINDINGS, "finding"), "quantitative_result": lambda x, c, t: V.quantitative_result(x), "significance": SEARCH("significance")}),
    _query("f35_policies", "Kind, scope and aims of the laws that are referred to.", ("legal_reference",), {"policy_type": lambda x, c, t: V.label(V.lower(x), V.POLICIES, "policy"), "scope": SEARCH("policy_scope"), "objectives": LIST("objectives", 3)}),
    _query("f36_sources", "Kind, coverage and resolution of data sources.", ("data_source",), {"source_type": lambda x, c, t: V.label(V.lower(x), V.SOURCES, "data_source"), "temporal_coverage": lambda x, c, t: V.year_range(c), "spatial_coverage": SEARCH("spatial_coverage")}),
    _query("f37_objectives", "Kind of objectives.", ("objective",), {"objective_type": lambda x, c, t: V.label(V.lower(x), V.OBJECTIVES, "objective")}),
    _query("f38_results", "Kind of result and related method.", ("finding",), {"result_type": lambda x, c, t: V.result_type(c), "related_method": lambda x, c, t: V.related_method(c, t)}),
    _query("f39_conclusions", "Kind, strength and audience of conclusions.", ("finding", "objective"), {"conclusion_type": lambda x, c, t: V.label(V.lower(c), V.CONCLUSIONS, "main_conclusion"), "strength": lambda x, c, t: V.graded(c, V.STRENGTHS, "moderate"), "audience": lambda x, c, t: V.label(V.lower(c), V.AUDIENCES)}),
    _query("f40_gaps", "Kind, severity, domain and solution of gaps.", ("gap",), {"gap_type": lambda x, c, t: V.label(V.lower(F.concat_ws(" ", x, c)), V.GAPS, "knowledge_gap"), "severity": lambda x, c, t: V.graded(c, V.GAP_SEVERITIES, "important"), "domain": lambda x, c, t: V.label(V.lower(c), V.DOMAINS), "solution": SEARCH("solution")}),
    _query("t22_species_valid", "Names that can be species, the context telling of lone group names.", ("species",), {"valid": lambda x, c, t: V.species_valid(x, c)}),
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_sql(text: str, terms) -> str:
    return "(" + " or ".join(f"coalesce(contains({text}, {q(t)}), false)" for t in terms) + ")"


def label_sql(text: str, rules, default: str | None = None) -> str:
    return "case " + " ".join(f"when {any_sql(text, terms)} then {q(name)}" for name, terms in rules) + (f" else {q(default)}" if default else "") + " end"


def lang(of, rules) -> str:
    return f"case when turkish then {of(rules['turkish'])} else {of(rules['english'])} end"


def dialect(pattern: str) -> str:
    """A pattern whose word and space classes hold for all alphabets, as the other engine writes it."""
    inside, out, i = False, [], 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\w", r"\s", r"\S", r"\d"):
            members = {r"\w": r"\p{L}\p{N}_\p{M}", r"\s": r"\s\x{a0}\x{2000}-\x{200a}\x{85}\x{2028}\x{2029}", r"\d": r"\p{Nd}"}.get(two)
            out.append(members if inside else f"[{members}]" if members else two)
            i += 2
        elif two == r"\b":  # the start or end of a word
            out.append(r"(?:$|[^\p{L}\p{N}_])" if out else r"(?:^|[^\p{L}\p{N}_])")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        elif pattern[i] in "iıIİ":  # one letter, whatever its case and dot
            out.append("iıIİ" if inside else "[iıIİ]")
            i += 1
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return "(?i)" + "".join(out)


def found_sql(text: str, patterns) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({text}, {q(dialect(p))}, 1), ' '), '')" for p in patterns) + ")"


def searched_sql(name: str) -> str:
    return f"substr({lang(lambda p: found_sql('context', p), V.SEARCHES[name])}, 1, 100)"


def list_sql(name: str, most: int) -> str:
    every = lambda ps: "list_concat(" + ", ".join(f"regexp_extract_all(coalesce(context, ''), {q(dialect(p))}, 1)" for p in ps) + ")"
    return f"coalesce(array_to_string(list_filter(list_transform({lang(every, V.LISTS[name])}, lambda x: trim(x, ' ')), lambda x: x <> '' and length(x) < 100)[1:{most}], '; '), '')"


def graded_sql(grades, default: str) -> str:
    return "case " + " ".join(f"when regexp_matches(context, {q(dialect(p))}) then {q(name)}" for name, p in grades) + f" else {q(default)} end"


def sql(category: str, **columns: str) -> str:
    where = " or ".join(f"category = {q(c)}" for c in category.split())
    return f"with e as (select id, exact_text, context, len(regexp_extract_all(coalesce(context, ''), '[çğışöüÇĞİŞÖÜ]')) > 2 as turkish from extractions where {where}) select id, " + ", ".join(f"{v} as {n}" for n, v in columns.items()) + " from e"


X, C = "lower(exact_text)", "lower(context)"
CURRENCY = r"nullif(regexp_extract(exact_text, '(TL|lira|euro|EUR|USD|₺|€|\$)', 1), '')"
UNIT = r"lower(nullif(regexp_extract(exact_text, '[0-9] ?(\p{L}+)', 1), ''))"
_p, _q = f"lower(coalesce(nullif(regexp_extract(context, {q(dialect(PARAMETER[5:]))}, 1), ''), ''))", f"lower(coalesce(nullif(regexp_extract(context, {q(dialect(POLLUTANT[5:]))}, 1), ''), ''))"
_where = {"p": _p, "q": _q, "t": f"coalesce({X}, '')"}
CONDITION = "case " + " ".join(f"when {' or '.join(any_sql(_where[w], terms) for w in where)} then {q(name)}" for name, where, terms in V.CONDITIONS) + " else 'environmental_condition' end"
_score = {k: "(" + " + ".join(f"contains({C}, {q(t)})::int" for t in terms) + ")" for k, terms in V.CONFLICTS}
_best = f"greatest({', '.join(_score.values())})"
CONFLICT = f"case when context is null or {_best} = 0 then 'spatial' " + " ".join(f"when {x} = {_best} then {q(k)}" for k, x in _score.items()) + " end"


def keyword_sql(language: int) -> str:
    words = list(dict.fromkeys(k.lower() for a in T.KEYWORDS.values() for k in a[language]))
    return f"list_sort([{{'n': -length(k), 'i': i, 'k': k}} for k, i in [{', '.join(map(q, words))}] if contains({X}, k)])[1].k"


def related_sql(terms) -> str:
    return "case " + " ".join(f"when contains({C}, {q(t.lower())}) then {q(t)}" for t in terms) + " end"


def _number(p: str, i: int) -> str:
    return f"try_cast(replace(nullif(regexp_extract(exact_text, {q(dialect(p))}, {i}), ''), ',', '.') as double)"


_ANY = "[" + ", ".join(f"case when {_number(p, 1)} is not null then {{'low': least({_number(p, 1)}, {_number(p, 2)}), 'high': greatest({_number(p, 1)}, {_number(p, 2)}), 'is_range': true, 'qualifier': null::varchar}} end" for p in V.RANGES) + ", " + ", ".join(
    f"case when {_number(p, 1)} is not null then {{'low': {'null::double' if k == 'maximum' else _number(p, 1)}, 'high': {'null::double' if k == 'minimum' else _number(p, 1)}, 'is_range': false, 'qualifier': {q(k)}}} end" for p, k in V.BOUNDS
) + "]"
_FIRST = f"list_filter({_ANY}, lambda r: r is not null)[1]"
ORACLES = {
    "t5_ranges": "select id, p.low, p.high, coalesce(p.is_range, false) as is_range, p.qualifier from (select id, " + _FIRST + " as p from extractions where category in ('distance', 'temporal', 'penalty'))",
    "f2_distance_units": sql("distance", unit=f"case when {UNIT} in ('m', 'm.') then 'metre' when regexp_matches({UNIT}, '^miles?$') then 'mile' else {label_sql(UNIT, V.DISTANCE_UNITS, 'metre')} end"),
    "f4_qualifiers": sql("distance", qualifier=f"case when coalesce(exact_text, '') <> '' then {lang(lambda r: label_sql(X, r), V.QUALIFIERS)} end"),
    "f5_penalty_types": sql("penalty", penalty_type=lang(lambda r: label_sql(X, r, "unspecified_penalty"), V.PENALTY_TYPES)),
    "f7_currencies": sql("penalty", currency=f"case when {CURRENCY} is null then case when turkish then 'TL' end when regexp_matches(upper({CURRENCY}), 'L[Iİ]RA') then 'TL' else replace(upper({CURRENCY}), '₺', 'TL') end"),
    "f9_violations": sql("penalty", violation=searched_sql("violation"), legal_reference=searched_sql("legal_reference")),
    "f13_conditions": sql("environmental", condition_type=CONDITION),
    "f14_thresholds": sql("environmental", threshold=lang(lambda r: label_sql(C, r), V.THRESHOLDS)),
    "f15_prohibitions": sql("prohibition", prohibition_type=lang(lambda r: label_sql(X, r, "restriction"), V.PROHIBITIONS), scope=searched_sql("scope")),
    "f16_exceptions": sql("prohibition", exceptions=list_sql("exceptions", 3)),
    "f17_permits": sql("permit", permit_type=lang(lambda r: label_sql(C, r, "permit"), V.PERMITS), requirements=list_sql("requirements", 5)),
    "f19_restrictions": sql("protected_area", restrictions=list_sql("restrictions", 5)),
    "f22_boundaries": sql("coordinate", location=searched_sql("location"), boundary=lang(lambda r: label_sql(C, r), V.BOUNDARIES)),
    "f23_laws": sql("legal_reference", reference_type=lang(lambda r: label_sql(X, r, "legal_reference"), V.LAWS), date=found_sql("context", (r"(\d{1,2}[/.]\d{1,2}[/.]\d{4})", r"(\d{4})"))),
    "f24_stakeholders": sql("stakeholder", stakeholder_type=lang(lambda r: label_sql(X, r, "stakeholder"), V.STAKEHOLDERS), role=searched_sql("role"), responsibilities=list_sql("responsibilities", 3)),
    "f25_institutions": sql("stakeholder", institution_type=lang(lambda r: label_sql(X, r), V.INSTITUTIONS), jurisdiction=searched_sql("jurisdiction")),
    "f29_conflicts": sql("conflict", conflict_type=CONFLICT, severity=lang(lambda r: label_sql(C, r), V.SEVERITIES)),
    "f28_plain_activities": sql("conflict prohibition", keyword=f"case when turkish then {keyword_sql(0)} else {keyword_sql(1)} end"),
    "f32_methods": sql("method", method_type=label_sql(X, V.METHODS, "research_method"), sample_size="try_cast(" + found_sql("context", (r"(?:n\s*=\s*|sample\s+size\s*=\s*|örneklem\s*=\s*)(\d+)", r"(\d+)\s+(?:participants|respondents|katılımcı)")) + " as int)"),
    "f34_findings": sql("finding", finding_type=label_sql(X, V.FINDINGS, "finding"), quantitative_result=found_sql("exact_text", (r"(\d+(?:[.,]\d+)?%)", r"(\d+(?:[.,]\d+)?\s*(?:km²|km2|ha|hectares))", r"(p\s*[<>=]\s*\d+(?:[.,]\d+)?)")), significance=searched_sql("significance")),
    "f35_policies": sql("legal_reference", policy_type=label_sql(X, V.POLICIES, "policy"), scope=searched_sql("policy_scope"), objectives=list_sql("objectives", 3)),
    "f36_sources": sql("data_source", source_type=label_sql(X, V.SOURCES, "data_source"), temporal_coverage=r"nullif(regexp_replace(regexp_extract(context, '([0-9]{4}\s*[-–]\s*[0-9]{4})', 1), '\s*[-–]\s*', '-'), '')", spatial_coverage=searched_sql("spatial_coverage")),
    "f37_objectives": sql("objective", objective_type=label_sql(X, V.OBJECTIVES, "objective")),
    "f38_results": sql("finding", result_type=f"case when regexp_matches(context, {q(dialect(V.STATISTIC))}) then 'statistical' when regexp_matches(context, {q(dialect(V.QUANTITY))}) then 'quantitative' when {any_sql(C, ('spatial', 'map', 'area', 'region', 'zone', 'location'))} then 'spatial' else 'qualitative' end",
        related_method=f"case when turkish then {related_sql(V.RELATED_METHODS['english'] + V.RELATED_METHODS['turkish'])} else {related_sql(V.RELATED_METHODS['english'])} end"),
    "f39_conclusions": sql("finding objective", conclusion_type=label_sql(C, V.CONCLUSIONS, "main_conclusion"), strength=graded_sql(V.STRENGTHS, "moderate"), audience=label_sql(C, V.AUDIENCES)),
    "f40_gaps": sql("gap", gap_type=label_sql("lower(concat_ws(' ', exact_text, context))", V.GAPS, "knowledge_gap"), severity=graded_sql(V.GAP_SEVERITIES, "important"), domain=label_sql(C, V.DOMAINS), solution=searched_sql("solution")),
    "t22_species_valid": sql("species", valid=f"coalesce(regexp_matches(regexp_replace(exact_text, '^\\s+|\\s+\\z', '', 'g'), '^[A-Z][a-z]{{2,}}\\s+[a-z]{{2,}}\\z') or not (lower(regexp_replace(exact_text, '^\\s+|\\s+\\z', '', 'g')) in ({', '.join(map(q, V.PLACE_NAMES))}) or (lower(regexp_replace(exact_text, '^\\s+|\\s+\\z', '', 'g')) in ({', '.join(map(q, V.GENERIC_GROUPS))}) and not {any_sql(C, V.QUALIFYING)})), true)"),
}
