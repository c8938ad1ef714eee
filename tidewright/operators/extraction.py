"""Extraction of typed facts from documents.

A document is scanned with the patterns of its language (:mod:`tidewright.operators.patterns`), in Arrow batches: each
match comes with its groups, the sentence that holds it and 300 characters on either side. All that follows are
expressions over these columns: matches in reference lists, garbled, citation-like or incoherent ones are skipped; legal
references are taken out of the sentence, and with them a match that was part of one; statements that are no marine ones
or whose sentence is of too little marine relevance fall out, as do the rejects of each extractor; the rest get the
fields of their category (:mod:`tidewright.functions.fields`), a confidence and a hash of their key. Of the records of a
document with one key the first is kept, in the order of the patterns and of the text.

Defined results: NULL and empty texts and unknown document types (if ``routed``) give no rows; documents of an unknown
language are read as English; repeated rows are documents of one id, whose facts fall together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import fields as V
from tidewright.functions import text as T
from tidewright.functions.documents import bibliography, numbers_in_digits, sentences
from tidewright.operators import patterns

WINDOW, BROAD = 300, 500
COHERENT = 0.2
Fields = dict[str, Column]


class Match:
    """The columns of a match as the rules of an extractor see them."""

    def __init__(self):
        self.text, self.sentence, self.context, self.broad = F.col("exact_text"), F.col("sentence"), F.col("context"), F.col("broad")
        self.low, self.turkish, self.relevance = F.col("low"), F.col("turkish"), F.col("marine_relevance")

    def __getitem__(self, group: str) -> Column:
        return F.nullif(F.trim(F.col("groups")[group]), F.lit(""))

    def search(self, name: str) -> Column:
        return V.searched(name, self.context, self.turkish)

    def lists(self, name: str, most: int) -> Column:
        return F.nullif(F.array_join(V.listed(name, self.context, self.turkish, most), "; "), F.lit(""))


@dataclass(frozen=True)
class ExtractorSpec:
    """What is done with the matches of a category.

    ``least``: the least relevance of the sentence, in legal and other documents; ``clean``: legal references are taken
    out of the sentence first, ``drop``: and a match with them; ``false_positives``: the sentence is tested. ``fields``
    names the columns, ``valid`` what has to hold, ``bonus`` what is added to the ``base`` confidence, ``key`` the
    fields that make a record.
    """

    category: str
    fields: Callable[[Match], Fields]
    key: tuple[str, ...]
    least: tuple[float, float]
    base: float
    bonus: Callable[[Match, Fields], tuple[tuple[Column, float], ...]]
    valid: Callable[[Match, Fields], Column] | None = None
    clean: bool = False
    drop: bool = False
    false_positives: bool = False
    relevance_bonus: float = 0.1


def has(c: Column) -> Column:
    return c.isNotNull()


def no_lines(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"[\r\n]")


def activity(m: Match) -> Column:
    """The activity of the context, which :func:`passed` adds for the categories in ``ACTIVE``."""
    return F.col("activity")


#: What a context or name may not hold.
BUILDING = {
    "turkish": ("kat yüksekli", "bina yüksekli", "iç yükseklik", "tavan yüksekli", "bodrum kat", "zemin kat", "asma kat", "merdiven", "rampa ", "konut ", "oturma odası", "yatak odası", "mutfak", "banyo", "tuvalet", "pencere", "parmaklık", "duvar kalınlı", "piyes", "yapı ruhsat", "fenni mesul", "müstakil konut", "mescit", "spor salon", "çocuk bahçe", "nüfus", "yapı yoğunluğu", "kat adedi", "erişilebilirlik", "engelli tuvalet", "yaya kaldırım", "ticaret yapıl", "karma kullanım"),
    "english": ("floor height", "ceiling height", "building height", "room dimension", "stairwell", "basement", "residential", "bedroom", "kitchen", "bathroom"),
}
LAND_LAW = ("arazi toplulaştırma", "imar planı", "imar kanun", "yapı ruhsat", "kültür varlık", "tabiat varlık", "sit alanı koruma", "mesleki sorumluluk", "inşaat ruhsat", "yapı kullanma", "hazine arazisi", "devlet orman", "mera kanun", "zoning", "building permit", "construction permit", "heritage", "cultural property", "land consolidation")
ASSESSMENTS = ("cumulative impact assessment", "cumulative impact analysis", "cumulative effects assessment", "environmental impact assessment", "strategic environmental assessment", "eia", "ced raporu", "ced", "çed")
EXCEPTIONS = ("dışında", "hariç", "müstesna", "istisna", "haricinde")
NO_STAKEHOLDER = tuple("the this that these those which where marine ocean coastal spatial planning figure table section chapter results contents available journal elsevier springer copyright published abstract introduction however although furthermore moreover reinforcement neural path reward actor learning federal biodiversity transition agriculture aquaculture energy cahiers options established establishing promote sector".split()) + ("twin delayed", "deep deterministic")
NO_INSTITUTION = ("the", "a", "an", "this", "that", "once a", "research", "communication from the", "proposal for", "regulatory", "interministerial", "proposal for marine national", "research universitary")
FRAGMENTS = (" The ", " the ", " data ", " concerning ", " related to ", " effort ", " approach ")
NO_POLICY = ("marine", "ocean", "contents lists available at sciencedirect", "contents lists", "journal", "elsevier", "springer", "wiley", "sciencedirect", "copyright", "published by", "all rights reserved", "twin delayed deep deterministic", "deep deterministic", "reinforcement learning", "neural network", "path planning", "deep q", "reward", "actor critic", "available at", "proximal", "disturbance zone", "belgian science", "information and", "term planning", "analytical", "amending delegated", "amending", "bonus_baltspace", "seventh", "connecting the", "map consists", "national sea systems", "into the eia", "msfd into", "eu of the european", "establishing a f", "affairs and climate", "energy and mining", "model parameter", "suggested ", "variables ", "nbs ", "proposal for a", "bozhesku", "ec eu")
SENTENCE_VERBS = tuple("are is was were have has had been established organised organized connected linked appeared committed applied implemented provisions references elements variables because although however during between".split())
ALGORITHMS = ("algorithm", "path planning", "neural network", "reinforcement learning", "deep learning", "td3", "ddpg", "ddqn", "auv ", "usv ", "uav ", "robot", "autonomous vehicle", "reward", "convergence", "obstacle avoidance", "hyperparameter", "calibrat", "wake model")


def distance_fields(m: Match) -> Fields:
    unit = V.distance_unit(m["unit"])
    metres = lambda c: F.when(unit == "kilometre", V.decimal(c) * 1000).otherwise(V.decimal(c))
    point = T.reference_point(m.context)
    return {
        "activity": activity(m)["name"], "value": metres(m["value"]).cast("string"), "min_value": metres(m["min"]).cast("string"), "max_value": metres(m["max"]).cast("string"), "unit": F.when(unit == "kilometre", "metre").otherwise(unit),
        "qualifier": V.qualifier(m["qualifier"], m.turkish), "reference_point": point["term"], "reference_point_type": point["kind"], "is_range": m["min"].isNotNull().cast("string"),
    }


def distance_valid(m: Match, f: Fields) -> Column:
    value, low, high = V.decimal(m["value"]), V.decimal(m["min"]), V.decimal(m["max"])
    year = V.lower(m["unit"]).isin("metre", "metrelik", "mt", "m", "m.") & (value > 1900) | (low > 1900) | (high > 1900) | (low >= high)
    return ~F.coalesce(year, F.lit(False)) & ~V.by_language(m.turkish, lambda t: V.any_of(m.low, t), BUILDING)


def penalty_fields(m: Match) -> Fields:
    length = F.coalesce(F.concat_ws(" ", m["duration"], m["unit"]), F.lit(None))
    span = F.concat(m["min"], F.lit("-"), m["max"], F.lit(" "), m["unit"])
    return {
        "penalty_type": V.penalty_type(m["type"], m.turkish), "amount": V.amount(m["amount"]).cast("string"), "currency": V.currency(F.coalesce(m["currency"], m["currency2"]), m.turkish),
        "duration": F.when(has(m["duration"]), length).otherwise(span), "violation": m.search("violation"), "legal_reference": m.search("legal_reference"),
    }


def temporal_fields(m: Match) -> Fields:
    day = lambda month, d, default: F.when(has(m[month]), F.concat(m[month], F.lit(" "), F.coalesce(m[d], F.lit(default))))
    clock = lambda h, x: F.when(has(m[h]), F.concat(m[h], F.lit(":"), m[x]))
    kinds = (("season", "seasonal"), ("period", "biological_period"), ("start_hour", "time_of_day"), ("duration", "duration"), ("start_year", "multi_year"), ("start_month", "date_range"))
    return {
        "restriction_type": reduce(lambda rest, k: F.when(has(m[k[0]]), k[1]).otherwise(rest), reversed(kinds), F.lit("temporal_restriction")),
        "start_date": F.coalesce(m["start_year"], clock("start_hour", "start_min"), m["period"], m["season"], day("start_month", "start", "1")), "end_date": F.coalesce(m["end_year"], clock("end_hour", "end_min"), day("end_month", "end", "31")),
        "duration": F.when(has(m["duration"]), F.concat_ws(" ", m["duration"], m["unit"])), "activity": activity(m)["name"], "legal_reference": m.search("legal_reference"),
    }


def environmental_fields(m: Match) -> Fields:
    return {
        "condition_type": V.condition_type(m["parameter"], m["pollutant"], m["type"]), "description": F.coalesce(F.nullif(F.concat_ws(" ", m["parameter"], m["pollutant"], m["type"], m["threshold"]), F.lit("")), F.lit("environmental condition")),
        "value": V.decimal(m["value"]).cast("string"), "unit": m["unit"], "threshold_type": V.labelled(V.lower(m["threshold"]), m.turkish, V.THRESHOLDS), "legal_reference": m.search("legal_reference"),
    }


def prohibition_fields(m: Match) -> Fields:
    return {
        "prohibition_type": V.prohibition_type(m["prohibition"], m["method"], m["area"], m.turkish), "activity": m["activity"], "scope": F.coalesce(m["area"], m.search("scope")), "exceptions": m.lists("exceptions", 3), "legal_reference": m.search("legal_reference"),
    }


def species_fields(m: Match) -> Fields:
    return {"species_name": F.coalesce(m["species"], m["scientific_name"]), "scientific_name": m["scientific_name"], "activity_context": F.when(m.turkish, V.found(m.context, V.SEARCHES["species_activity"]["turkish"])).otherwise(V.found(m.context, V.SEARCHES["species_activity"]["english"])), "legal_reference": m.search("legal_reference")}


def coordinate_fields(m: Match) -> Fields:
    part = lambda c: F.coalesce(V.decimal(c), F.lit(0.0))
    axis = lambda plain, d, mi, se: F.coalesce(V.decimal(m[plain]), V.decimal(m[d]) + part(m[mi]) / 60 + part(m[se]) / 3600)
    signed = lambda x, side, minus: F.when(F.upper(m[side]) == minus, -x).otherwise(x)
    return {
        "latitude": F.round(signed(axis("lat", "lat_deg", "lat_min", "lat_sec"), "lat_dir", "S"), 9).cast("string"), "longitude": F.round(signed(axis("lon", "lon_deg", "lon_min", "lon_sec"), "lon_dir", "W"), 9).cast("string"), "coordinate_system": F.lit("WGS84"),
        "location_description": m.search("location"), "boundary_type": V.labelled(m.low, m.turkish, V.BOUNDARIES), "legal_reference": m.search("legal_reference"),
    }


def stakeholder_fields(m: Match) -> Fields:
    return {"stakeholder_name": F.coalesce(m["name"], m["role"]), "stakeholder_type": V.labelled(V.lower(m["type"]), m.turkish, V.STAKEHOLDERS, "stakeholder"), "role": m.search("role"), "responsibilities": m.lists("responsibilities", 3), "legal_reference": m.search("legal_reference")}


def stakeholder_valid(m: Match, f: Fields) -> Column:
    name = f["stakeholder_name"]
    digits = F.length(F.regexp_replace(name, r"\P{N}", ""))
    return F.coalesce(no_lines(name) & F.length(name).between(3, 150) & ~V.any_of(V.lower(name), NO_STAKEHOLDER) & (digits <= F.length(name) * 0.3), F.lit(True))


def institution_valid(m: Match, f: Fields) -> Column:
    name = m["name"]
    proper = F.size(F.filter(F.split(name, r"\s+"), lambda w: w.rlike(r"^\p{Lu}.")))
    starter = name.rlike(r"^(?:The|A|An|Once|This|That|In|On|By|For|With|MEL|IOC)\s") & ~name.rlike(r"^\w+\s+\p{Lu}")
    return F.coalesce(no_lines(m.text) & ~V.lower(name).isin(*NO_INSTITUTION) & ~starter & (F.length(name) >= 5) & ~V.any_of(name, FRAGMENTS) & (proper >= 2), F.lit(False))


def conflict_fields(m: Match) -> Fields:
    a, b = (V.plain_activity(F.substring(m[x], 1, 50), m.sentence, m.turkish) for x in ("activity1", "activity2"))
    return {"conflict_type": V.conflict_type(V.lower(F.concat_ws(" ", m.context, m["activity1"], m["activity2"]))), "activity_1": a, "activity_2": b, "severity": V.labelled(m.low, m.turkish, V.SEVERITIES), "resolution": V.resolution(m.broad, m.turkish)}


def conflict_valid(m: Match, f: Fields) -> Column:
    a, b = m["activity1"], m["activity2"]
    short = F.coalesce((F.length(a) <= 40) & (F.length(b) <= 40), F.lit(False))
    whole = ~F.contains(F.concat_ws(" ", a, b, m.sentence), F.lit("�"))
    marine = V.is_marine(f["activity_1"], m.turkish) | V.is_marine(f["activity_2"], m.turkish)
    return short & V.valid_activity(a) & V.valid_activity(b) & ~V.any_of(V.lower(F.concat_ws(" ", a, b)), V.NO_MATTER) & whole & (V.lower(f["activity_1"]) != V.lower(f["activity_2"])) & marine


def finding_valid(m: Match, f: Fields) -> Column:
    said = m["description"]
    figures = said.rlike(r"(?i)\d+(?:[.,]\d+)?%|p\s*[<>=]|\d+\s*(?:km|ha|hectare|m2|km2)")
    return F.coalesce((F.length(said) >= 20) & no_lines(said) & ~said.rlike(r"[a-z]-\s+[a-z]") & ~V.any_of(V.lower(said), ALGORITHMS) & figures, F.lit(False))


def policy_valid(m: Match, f: Fields) -> Column:
    title = m["title"]
    low = V.lower(title)
    words = F.filter(F.split(title, r"\s+"), lambda w: F.length(w) >= 2)
    verbs = F.arrays_overlap(F.split(low, r"\s+"), F.array(*[F.lit(w) for w in SENTENCE_VERBS]))
    return F.coalesce(~V.any_of(low, NO_POLICY) & F.length(title).between(3, 150) & no_lines(title) & F.size(words).between(2, 8) & ~verbs, F.lit(False))


def result_valid(m: Match, f: Fields) -> Column:
    said = m["result"]
    figures = said.rlike(r"(?i)\d+(?:\.\d+)?%|\d+(?:\.\d+)?\s*(?:km|ha|m²|species|individuals|dB)") | said.rlike(r"p\s*[<>=]|r\s*=|CI\s*=|SD\s*=|±")
    return F.coalesce((F.length(said) >= 10) & no_lines(said) & ~said.rlike(r"\S{31,}") & figures, F.lit(False))


def _bonus(*pairs: tuple[str, float]):
    return lambda m, f: tuple((has(f[name]), more) for name, more in pairs)


def _long(group: str):
    return lambda m, f: F.coalesce(F.length(m[group]) >= 10, F.lit(False))


#: The extractors, by category.
SPECS = {
    s.category: s
    for s in (
        ExtractorSpec("distance", distance_fields, ("value", "unit", "activity", "exact_text:50"), (0.15, 0.15), 0.7, lambda m, f: ((m.relevance > 0.6, 0.1), (activity(m)["confidence"] > 0.4, 0.05), (has(f["reference_point"]), 0.05)), distance_valid, True, True, True),
        ExtractorSpec("penalty", penalty_fields, ("penalty_type", "amount", "violation:30"), (0.05, 0.15), 0.7, lambda m, f: ((has(f["amount"]) | has(f["duration"]), 0.1), (has(f["violation"]), 0.05)), None, True, True, True),
        ExtractorSpec("temporal", temporal_fields, ("restriction_type", "start_date", "end_date", "activity"), (0.15, 0.2), 0.7, lambda m, f: ((has(f["start_date"]) | has(f["duration"]), 0.1), (activity(m)["confidence"] > 0.4, 0.05)), lambda m, f: ~V.any_of(m.low, LAND_LAW), True, True, True),
        ExtractorSpec("environmental", environmental_fields, ("condition_type", "description:30", "value"), (0.05, 0.1), 0.7, _bonus(("value", 0.1), ("unit", 0.05)), lambda m, f: ~V.any_of(V.lower(m.text), ASSESSMENTS) & no_lines(m.text) & ~m.text.rlike(r"(?i)ph\d{5,}|doi:|10\.\d{4}"), True, True, True),
        ExtractorSpec("prohibition", prohibition_fields, ("prohibition_type", "activity", "scope"), (0.05, 0.15), 0.7, _bonus(("activity", 0.1), ("scope", 0.05)), lambda m, f: no_lines(m.text) & ~V.lower(F.trim(m.text)).rlike("(?:" + "|".join(EXCEPTIONS) + r")\z") & F.coalesce(F.length(m["activity"]).between(3, 80), F.lit(True)), True, True, True),
        ExtractorSpec("species", species_fields, ("species_name", "scientific_name"), (0.1, 0.1), 0.6, _bonus(("scientific_name", 0.2)), lambda m, f: F.when(has(m["scientific_name"]), (m.relevance >= 0.15) & no_lines(m.text)).otherwise(True), True, False, True),
        ExtractorSpec("protected_area", lambda m: {"area_type": F.coalesce(F.substring(m["area_type"], 1, 100), F.lit("protected_area")), "name": F.substring(m["name"], 1, 200), "designation": m["designation"], "restrictions": m.lists("restrictions", 5), "legal_reference": m.search("legal_reference")}, ("area_type", "name", "designation"), (0.1, 0.1), 0.7, _bonus(("name", 0.1), ("designation", 0.05)), None, True, False, True),
        ExtractorSpec("permit", lambda m: {"permit_type": V.permit_type(m["permit_type"], m["permit"], m.context, m.turkish), "issuing_authority": m["authority"], "requirements": m.lists("requirements", 5), "validity_period": m["validity"], "activity": activity(m)["name"], "legal_reference": m.search("legal_reference")}, ("permit_type", "issuing_authority", "activity"), (0.05, 0.15), 0.7, _bonus(("permit_type", 0.1), ("issuing_authority", 0.05)), None, True, False, True),
        ExtractorSpec("coordinate", coordinate_fields, ("latitude", "longitude", "location_description"), (0.05, 0.05), 0.8, _bonus(("location_description", 0.05), ("boundary_type", 0.05)), lambda m, f: F.coalesce(f["latitude"].cast("double").between(-90, 90) & f["longitude"].cast("double").between(-180, 180), F.lit(False)), False, False, True),
        ExtractorSpec("legal_reference", lambda m: {"reference_type": V.labelled(V.lower(m["type"]), m.turkish, V.LAWS, "legal_reference"), "law_number": m["law_number"], "article_number": m["article"], "title": V.title(m.context, m.turkish), "date": V.law_date(m.context)}, ("reference_type", "law_number", "article_number"), (0.05, 0.05), 0.8, _bonus(("law_number", 0.1), ("article_number", 0.05)), relevance_bonus=0.0),
        ExtractorSpec("stakeholder", stakeholder_fields, ("stakeholder_name", "stakeholder_type", "role"), (0.05, 0.05), 0.7, _bonus(("role", 0.1)), stakeholder_valid, False, False, True),
        ExtractorSpec("institution", lambda m: {"institution_name": F.substring(F.concat_ws(" ", m["name"], m["type"]), 1, 200), "institution_type": V.labelled(V.lower(m["type"]), m.turkish, V.INSTITUTIONS), "role": m.search("charge"), "jurisdiction": m.search("jurisdiction"), "legal_reference": m.search("legal_reference")}, ("institution_name", "institution_type", "role"), (0.05, 0.05), 0.75, _bonus(("role", 0.1)), institution_valid),
        ExtractorSpec("conflict", conflict_fields, ("conflict_type", "activity_1", "activity_2"), (0.15, 0.15), 0.7, lambda m, f: ((has(f["severity"]), 0.05), (has(f["resolution"]), 0.05), (f["conflict_type"] != "spatial", 0.05)), conflict_valid),
        ExtractorSpec("method", lambda m: {"method_type": V.method_type(m["method"]), "description": F.substring(m.sentence, 1, 200), "tools_used": F.nullif(F.array_join(V.tools(m.context), "; "), F.lit("")), "sample_size": V.sample_size(m.context).cast("string")}, ("method_type", "description:30", "sample_size"), (0.1, 0.1), 0.7, _bonus(("tools_used", 0.1))),
        ExtractorSpec("finding", lambda m: {"finding_type": V.label(V.lower(m["description"]), V.FINDINGS, "finding"), "description": m["description"], "quantitative_result": V.quantitative_result(m["description"]), "significance": m.search("significance")}, ("finding_type", "description:30", "quantitative_result"), (0.15, 0.15), 0.5, lambda m, f: ((has(f["quantitative_result"]), 0.2), (m["description"].rlike(r"\d%"), 0.1)), finding_valid, relevance_bonus=0.15),
        ExtractorSpec("policy", lambda m: {"policy_type": V.label(V.lower(m["type"]), V.POLICIES, "policy"), "title": m["title"], "scope": m.search("policy_scope"), "objectives": m.lists("objectives", 3), "legal_reference": m.search("legal_reference")}, ("policy_type", "title", "scope"), (0.05, 0.05), 0.7, _bonus(("objectives", 0.1)), policy_valid),
        ExtractorSpec("data_source", lambda m: {"source_type": V.label(V.lower(F.concat_ws(" ", m["source_type"], m["source_name"])), V.SOURCES, "data_source"), "source_name": F.substring(m["source_name"], 1, 100), "spatial_coverage": m.search("spatial_coverage"), "temporal_coverage": V.year_range(m.context), "resolution": V.resolution_of_data(m.context)}, ("source_type", "source_name", "spatial_coverage"), (0.1, 0.1), 0.7, _bonus(("source_name", 0.1))),
        ExtractorSpec("objective", lambda m: {"objective_type": V.label(V.lower(m.text), V.OBJECTIVES, "objective"), "objective_text": F.substring(m["obj"], 1, 300), "study_area": V.study_area(m.context, m.turkish)}, ("objective_type", "objective_text:50"), (0.1, 0.1), 0.7, _bonus(("study_area", 0.1)), _long("obj")),
        ExtractorSpec("result", lambda m: {"result_type": V.result_type(m.context), "result_text": F.substring(m["result"], 1, 300), "quantitative_value": V.found(m.context, (V.QUANTITY,)), "statistical_significance": V.found(m.context, (V.STATISTIC,)), "related_method": V.related_method(m.context, m.turkish)}, ("result_type", "result_text:50"), (0.1, 0.1), 0.6, _bonus(("quantitative_value", 0.1), ("statistical_significance", 0.1)), result_valid),
        ExtractorSpec("conclusion", lambda m: {"conclusion_type": V.label(V.lower(m.text), V.CONCLUSIONS, "main_conclusion"), "conclusion_text": F.substring(m["conc"], 1, 300), "evidence_strength": V.graded(m.context, V.STRENGTHS, "moderate"), "target_audience": V.label(m.low, V.AUDIENCES)}, ("conclusion_type", "conclusion_text:50"), (0.1, 0.1), 0.7, lambda m, f: ((f["evidence_strength"].isin("strong", "moderate"), 0.1),), lambda m, f: F.coalesce((F.length(m["conc"]) >= 10) & no_lines(m["conc"]) & ~m["conc"].rlike(r"[a-z]-\s+[A-Z][a-z]"), F.lit(False))),
        ExtractorSpec("gap", lambda m: {"gap_type": V.label(V.lower(F.concat_ws(" ", m.text, m.context)), V.GAPS, "knowledge_gap"), "gap_description": F.substring(m["gap"], 1, 300), "severity": V.graded(m.context, V.GAP_SEVERITIES, "important"), "proposed_solution": m.search("solution"), "domain": V.label(m.low, V.DOMAINS)}, ("gap_type", "gap_description:50"), (0.1, 0.1), 0.6, _bonus(("proposed_solution", 0.1), ("domain", 0.1)), _long("gap"), False, False, True),
    )
}
ACTIVE = ("distance", "temporal", "permit")
#: Which extractors a document of a type gets.
RESEARCH = ("conclusion", "conflict", "data_source", "environmental", "finding", "gap", "institution", "method", "objective", "policy", "result", "species", "stakeholder")
LEGAL = ("coordinate", "distance", "environmental", "legal_reference", "penalty", "permit", "prohibition", "protected_area", "species", "temporal")
DATASET = ("data_source", "species")
ROUTES = {"research": RESEARCH, "legal": LEGAL, "dataset": DATASET}
FOUND = "category STRING, pattern INT, position INT, exact_text STRING, groups MAP<STRING, STRING>, sentence STRING, context STRING, broad STRING"


def surroundings(text: str, start: int, end: int) -> tuple[str, str, str]:
    """(sentence, context, broad context) of a match: the first sentence of the context that holds the match, else the context."""
    context = text[max(0, start - WINDOW) : end + WINDOW].strip()
    said = " ".join(text[start:end].split())
    sentence = next((s for s in sentences(context) if said in s), context)
    return sentence, context, text[max(0, start - BROAD) : end + BROAD]


def scan(text: str, language: str, categories: tuple[str, ...]) -> Iterator[tuple]:
    """The rows of ``FOUND`` of one text; matches that start in a list of references are left out."""
    forms: dict[bool, tuple[patterns.Held, list[tuple[int, int]]]] = {}
    for c in categories:
        numbers = patterns.LISTS[c].numbers
        if numbers not in forms:
            form = numbers_in_digits(text) if numbers else text
            forms[numbers] = patterns.Held(form), bibliography(form)
        held, ranges = forms[numbers]
        for i, m in patterns.LISTS[c].matches(held, language):
            if not any(s <= m.start() < e for s, e in ranges):
                yield c, i, m.start(), m[0], {k: v for k, v in m.groupdict().items() if v is not None}, *surroundings(held.text, m.start(), m.end())


def scanned(documents: DataFrame, categories: tuple[str, ...], id_col: str, text_col: str, routed: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """All matches with (id, kept columns, legal, turkish) of their documents."""
    kind = F.col("doc_type") if routed else F.lit(None).cast("string")
    spoken = documents.select(F.col(id_col), *keep, kind.alias("__kind"), F.col(text_col).alias("__t"), T.document_class(F.col(text_col)).alias("__class")).where("__t is not null and __t <> ''")
    own = [id_col, *keep]
    key = ", ".join(f"`{c}` {spoken.schema[c].dataType.simpleString()}" for c in own)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n, t, of, kind in zip(zip(*[b[c] for c in own], strict=True), b["__t"], b["__class"], b["__kind"], strict=True):
                mine = tuple(c for c in categories if c in ROUTES.get(kind, ())) if routed else categories
                turkish = of.endswith("turkish")
                rows += [(*n, of.startswith("legal"), turkish, *r) for r in scan(t, "turkish" if turkish else "english", mine)]
            yield pd.DataFrame(rows, columns=[*own, "legal", "turkish", *(x.split()[0] for x in FOUND.replace("STRING, STRING", "STRING").split(", "))])

    return spoken.mapInPandas(run, f"{key}, legal BOOLEAN, turkish BOOLEAN, {FOUND}")


def _each(categories: tuple[str, ...], of: Callable[[ExtractorSpec], Column], otherwise: Column) -> Column:
    return reduce(lambda rest, c: F.when(F.col("category") == c, of(SPECS[c])).otherwise(rest), categories, otherwise)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once per row: no filter on it is pushed below, where it would be computed
    as often as the filter names it."""
    return df.withColumn(name, F.explode(F.array(value)))


def passed(matches: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """The matches that pass the common filters, with ``marine_relevance`` of their (cleaned) sentence, ``low`` context and ``activity``."""
    yes = lambda flag: F.col("category").isin(*[c for c in categories if getattr(SPECS[c], flag)] or [""])
    text = F.col("exact_text")
    sound = ~T.is_garbled(text) & ~T.is_citation(text) & (T.coherence(text) >= COHERENT)
    rows = matches.where(sound)
    rows = rows.where(F.when(F.col("category") == "species", V.species_valid(text, F.lit(None).cast("string"))).when(F.col("category") == "policy", ~V.is_journal(text)).otherwise(True))
    rows = once(rows, "__clean", F.when(yes("clean"), T.without_references(F.col("sentence"))).otherwise(F.col("sentence")))
    rows = rows.where(~yes("drop") | F.contains("__clean", F.trim(F.regexp_replace(text, r"\s+", " "))))
    rows = rows.where(~yes("false_positives") | T.false_positive(F.col("__clean"), text).isNull())
    rows = once(rows, "marine_relevance", T.marine_relevance(F.col("__clean")))
    least = _each(categories, lambda s: F.when(F.col("legal"), s.least[0]).otherwise(s.least[1]), F.lit(0.0))
    rows = rows.where(F.col("marine_relevance") >= least).drop("__clean")
    return rows.withColumn("low", V.lower("context")).withColumn("activity", F.when(F.col("category").isin(*ACTIVE), T.activity(F.col("context"))))


RECORD = "array<struct<fields:map<string,string>,confidence:double,record_hash:string>>"


def record(spec: ExtractorSpec) -> Column:
    """The record of a match of one category as an array of one entry; of none if it is rejected. Fields are computed once."""
    m = Match()
    fields = spec.fields(m)

    def of(f: Column) -> Column:
        got = {n: f[n] for n in fields}
        extra = reduce(lambda a, b: a + F.when(b[0], b[1]).otherwise(0.0), spec.bonus(m, got), F.lit(spec.base) + F.when(m.relevance > 0.3, spec.relevance_bonus).otherwise(0.0))

        def part(key: str) -> Column:
            name, _, size = key.partition(":")
            value = m.text if name == "exact_text" else got[name]
            return F.coalesce(F.substring(value, 1, int(size)) if size else value, F.lit("None"))

        hashed = F.substring(F.md5(F.concat_ws("|", *[part(k) for k in spec.key])), 1, 16)
        one = F.array(F.struct(F.create_map(*[x for n, c in got.items() for x in (F.lit(n), c.cast("string"))]).alias("fields"), F.round(F.least(extra, F.lit(1.0)), 6).alias("confidence"), hashed.alias("record_hash")))
        return one if spec.valid is None else F.when(spec.valid(m, got), one)

    return T.let(F.struct(*[c.alias(n) for n, c in fields.items()]), of).cast(RECORD)


def extract(documents: DataFrame, categories: tuple[str, ...] = tuple(SPECS), id_col: str = "doc_id", text_col: str = "text", routed: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, category, record_hash, pattern, position, exact_text, context, fields map, confidence, marine_relevance, n_mentions).

    ``routed`` runs only the extractors of a document's type. One scan of the texts and one pass over its matches.
    """
    matches = passed(scanned(documents, categories, id_col, text_col, routed, keep), categories)
    rows = matches.withColumn("r", F.explode(_each(categories, record, F.lit(None).cast(RECORD)))).select("*", "r.*")
    first = F.min_by(F.struct("pattern", "position", "exact_text", "context", "fields", "confidence", "marine_relevance"), F.struct("pattern", "position"))
    own = [id_col, *keep, "category", "record_hash"]
    return rows.groupBy(*own).agg(first.alias("r"), F.count(F.lit(1)).alias("n_mentions")).select(*own, "r.*", "n_mentions")
