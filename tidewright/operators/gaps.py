"""Coverage gaps: rules over the knowledge store, and their ranking.

Every rule gives rows of (gap_category, gap_type, severity, subject, n_evidence). Rules that only count (``Counted``) say
what they count; each is one aggregation pass, and all of them together are one as well. Rules that ask whether a name
stands in any of many texts join the names to the word sequences of the texts on equal keys, so that no rule compares
every name with every text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.evaluation import ranked
from tidewright.operators.linking import with_type
from tidewright.operators.search import folded
from tidewright.operators.skew import cut

#: What the rules expect, their thresholds and the weights of the ranking.
EXPECTED_METHODS = ("gis_analysis", "stakeholder_analysis", "ecological_modeling", "economic_analysis", "cumulative_impact", "scenario_planning")
ESSENTIAL_DATA = ("bathymetry", "biodiversity", "fishing_effort", "socioeconomic", "oceanographic", "water_quality")
THEMES = ("conflict", "stakeholder", "species", "environmental")
ACTIVITIES = ("aquaculture", "fishing", "shipping", "tourism", "offshore_energy", "dredging", "mining", "conservation", "military")
REQUIRED_DATA = {"EIA": ("environmental", "ecological", "biodiversity"), "socioeconomic": ("socioeconomic", "economic", "social"), "bathymetric": ("bathymetry", "depth", "seabed"), "hydrographic": ("hydrographic", "current", "tide")}
SEVERITY = {"critical": 3.0, "important": 2.0, "minor": 1.0}
WEIGHT = {"integration": 1.5, "legal": 1.3, "data": 1.1, "research": 1.0}


def attribute(field: str) -> Column:
    """A field of flat metadata; blank counts as absent."""
    return F.nullif(F.trim(F.get_json_object("metadata", f"$.{field}")), F.lit(""))


def gap(df: DataFrame, category: str, kind: str, severity: str | Column, subject: str | Column, evidence: int = 1) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(F.lit(category).alias("gap_category"), F.lit(kind).alias("gap_type"), lit(severity).alias("severity"), lit(subject).alias("subject"), F.lit(evidence).alias("n_evidence"))


def _terms(spark, name: str, terms: tuple[str, ...]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(t,) for t in terms], f"{name} STRING"))


def _each(row: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(term, value) rows of one aggregated row."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), c.alias("value")) for t, c in columns.items()])).alias("r")).select("r.*")


class Counted:
    """A rule over one row of aggregates: what it counts, by name, and its gaps from that row."""

    def __init__(self, aggregates: Callable[[], dict[str, Column]], gaps: Callable[[DataFrame], DataFrame]):
        self.aggregates, self.gaps = aggregates, gaps

    def __call__(self, e: DataFrame) -> DataFrame:
        return self.gaps(e.agg(*[c.alias(n) for n, c in self.aggregates().items()]))


def of(category: str) -> Column:
    return F.col("category") == category


def method_gaps(e: DataFrame) -> DataFrame:
    """Expected methods used less than 0.3 times the average method; none at all is critical."""
    counts = e.where("category = 'method'").groupBy(F.coalesce(attribute("method_type"), F.lit("unknown")).alias("term")).agg(F.count(F.lit(1)).alias("n"))
    average = counts.agg(F.avg("n").alias("average"))
    got = _terms(e.sparkSession, "term", EXPECTED_METHODS).join(counts, "term", "left").crossJoin(F.broadcast(average))
    low = got.where(F.coalesce("n", F.lit(0)) < F.col("average") * 0.3)
    return gap(low, "research", "method_gap", F.when(F.col("n").isNull(), "critical").otherwise("important"), F.col("term"))


def geographic_gaps(e: DataFrame) -> DataFrame:
    """Protected areas named in fewer than two documents."""
    n = e.where("category = 'protected_area'").select(attribute("name").alias("name"), "document_id").where("name is not null").groupBy("name").agg(F.countDistinct("document_id").alias("n"))
    return gap(n.where("n < 2"), "research", "geographic_gap", "important", F.col("name"))


def _thematic() -> Counted:
    """Themes with fewer than five extractions."""

    def gaps(row: DataFrame) -> DataFrame:
        low = _each(row, {t: F.col(f"theme_{t}") for t in THEMES}).where("value < 5")
        return gap(low, "research", "thematic_gap", F.when(F.col("value") > 0, "important").otherwise("critical"), F.col("term"))

    return Counted(lambda: {f"theme_{t}": F.count_if(of(t)) for t in THEMES}, gaps)


def _temporal() -> Counted:
    """No temporal extraction at all; that is its own evidence."""
    return Counted(lambda: {"n_temporal": F.count_if(of("temporal"))}, lambda row: gap(row.where("n_temporal = 0"), "research", "temporal_gap", "important", "temporal", 0))


def _unregulated() -> Counted:
    """Activities that research contexts mention and no legal category has."""

    def counts() -> dict[str, Column]:
        research, legal = F.col("category").isin("method", "finding", "conflict", "stakeholder"), F.col("category").isin("prohibition", "permit", "distance", "penalty")
        own = folded(attribute("activity"))
        said = {f"said_{a}": F.max(F.when(research, F.contains(folded("context"), F.lit(a.replace("_", " "))).cast("int"))) for a in ACTIVITIES}
        return said | {f"ruled_{a}": F.max(F.when(legal, (own == a).cast("int"))) for a in ACTIVITIES}

    def gaps(row: DataFrame) -> DataFrame:
        found = _each(row, {a: (F.coalesce(F.col(f"said_{a}"), F.lit(0)) == 1) & (F.coalesce(F.col(f"ruled_{a}"), F.lit(0)) == 0) for a in ACTIVITIES}).where("value")
        return gap(found, "legal", "unregulated_activity", "critical", F.col("term"), 2)

    return Counted(counts, gaps)


thematic_gaps, temporal_gaps, unregulated_activities = _thematic(), _temporal(), _unregulated()


def plain_words(c: Column | str) -> Column:
    """Folded words of a text with single spaces between."""
    return F.trim(F.regexp_replace(folded(c), r"[^\p{L}\p{N}]+", " "))


def sequences(text: Column, lengths: Column) -> Column:
    """All runs of as many words as any of ``lengths`` says, of a text from :func:`plain_words`."""

    def of(w: Column) -> Column:
        run = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))
        return F.array_distinct(F.flatten(F.array_compact(F.transform(lengths, run))))

    return F.get(F.transform(F.array(F.split(text, " ")), of), F.lit(0))


def _runs(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """The texts' columns and, as ``name``, every run of words of ``text`` that is as long as any of the names."""
    lengths = names.agg(F.collect_set(F.size(F.split(name, " "))).alias("__n"))
    return texts.crossJoin(F.broadcast(lengths)).withColumn(name, F.explode(sequences(F.col(text), F.col("__n")))).drop("__n")


def missing_penalties(e: DataFrame) -> DataFrame:
    """Prohibited activities that no violation contains or is contained in, word for word."""
    p = e.where("category = 'prohibition'").select(plain_words(attribute("activity")).alias("p")).where("p <> ''").distinct()
    v = e.where("category = 'penalty'").select(plain_words(attribute("violation")).alias("v")).where("v <> ''").distinct()
    inside = _runs(p, "p", v, "v").join(v, "v", "left_semi").select("p")
    around = _runs(v, "v", p, "p").select("p").distinct()
    none = p.join(inside, "p", "left_anti").join(around, "p", "left_anti")
    return gap(none, "legal", "missing_penalty", "important", F.col("p"))


#: Distances of a confidence below 0.5, if any.
vague_requirements = Counted(lambda: {"n_vague": F.count_if(of("distance") & (F.col("confidence") < 0.5))}, lambda row: gap(row.where("n_vague > 0"), "legal", "vague_requirement", "important", F.col("n_vague").cast("string")))
#: Permits without an issuing authority, if any.
enforcement_gaps = Counted(lambda: {"n_unissued": F.count_if(of("permit") & attribute("issuing_authority").isNull())}, lambda row: gap(row.where("n_unissued > 0"), "legal", "enforcement_gap", "important", F.col("n_unissued").cast("string")))


def _missing_types() -> Counted:
    """Essential data types that are absent, as is any type holding their first four letters."""
    kind = lambda: folded(F.when(of("data_source"), attribute("source_type")))

    def gaps(row: DataFrame) -> DataFrame:
        none = _each(row, {t: F.coalesce(F.col(f"type_{t}"), F.lit(0)) == 0 for t in ESSENTIAL_DATA}).where("value")
        return gap(none, "data", "missing_data_type", "critical", F.col("term"))

    return Counted(lambda: {f"type_{t}": F.max(F.contains(kind(), F.lit(t[:4])).cast("int")) for t in ESSENTIAL_DATA}, gaps)


missing_data_types = _missing_types()


def _share(name: str, condition: Callable[[], Column], most: float, *kind: str) -> Counted:
    """More than a share of the data sources meet a condition."""
    return Counted(lambda: {name: F.avg(F.when(of("data_source"), condition().cast("double")))}, lambda row: gap(row.where(F.col(name) > most), *kind))


#: More than 30 % of the data sources without spatial or temporal coverage, more than half without a resolution, more
#: than 20 % restricted or proprietary.
coverage_gaps = _share("uncovered", lambda: attribute("spatial_coverage").isNull() & attribute("temporal_coverage").isNull(), 0.3, "data", "coverage_gap", "important", "coverage")
resolution_gaps = _share("unresolved", lambda: attribute("resolution").isNull(), 0.5, "data", "resolution_gap", "minor", "resolution")
access_barriers = _share("closed", lambda: F.coalesce(attribute("access_type").isin("restricted", "proprietary"), F.lit(False)), 0.2, "integration", "data_access_barrier", "important", "access")


def unprotected_species(e: DataFrame) -> DataFrame:
    """Species of three documents or more without any protection status."""
    s = e.where("category = 'species'").select(folded(attribute("species_name")).alias("name"), "document_id", attribute("protection_status").alias("status")).where("name is not null")
    n = s.groupBy("name").agg(F.countDistinct("document_id").alias("n"), F.count("status").alias("k")).where("n >= 3 and k = 0")
    return gap(n, "integration", "unprotected_important_species", "critical", F.col("name"), 2)


def _mismatch() -> Counted:
    """Requirements that permits mention and no data source type serves."""
    kind, context = lambda: folded(F.when(of("data_source"), attribute("source_type"))), lambda: folded(F.when(of("permit"), F.col("context")))
    has = lambda c, ws: F.coalesce(F.max(reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in ws]).cast("int")), F.lit(0))

    def gaps(row: DataFrame) -> DataFrame:
        found = _each(row, {t: (F.col(f"asked_{t}") == 1) & (F.col(f"served_{t}") == 0) for t in REQUIRED_DATA}).where("value")
        return gap(found, "integration", "legal_data_mismatch", "critical", F.col("term"), 2)

    return Counted(lambda: {f"asked_{t}": has(context(), w) for t, w in REQUIRED_DATA.items()} | {f"served_{t}": has(kind(), w) for t, w in REQUIRED_DATA.items()}, gaps)


legal_data_mismatch = _mismatch()
#: More than ten findings of a recommendation and fewer than five policies.
research_policy_disconnect = Counted(
    lambda: {"n_recommended": F.count_if(of("finding") & (attribute("finding_type") == "recommendation")), "n_policies": F.count_if(of("policy"))},
    lambda row: gap(row.where("n_recommended > 10 and n_policies < 5"), "integration", "research_policy_disconnect", "critical", "recommendation", 2),
)


def _unnamed(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Names that stand in none of the texts, word for word."""
    said = _runs(texts.where("text <> ''"), "text", names, "name").select("name").join(names, "name", "left_semi").distinct()
    return names.join(said, "name", "left_anti")


def method_legal_disconnect(e: DataFrame, d: DataFrame) -> DataFrame:
    """Methods of five uses or more that no legal context names."""
    m = e.where("category = 'method'").groupBy(plain_words(attribute("method_type")).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5 and name <> ''").select("name")
    t = with_type(e, d).where("doc_type = 'legal'").select(plain_words("context").alias("text"))
    return gap(_unnamed(m, t), "integration", "method_legal_disconnect", "important", F.col("name"), 2)


def unmonitored_areas(e: DataFrame) -> DataFrame:
    """Protected areas that no data source's context names."""
    a = e.where("category = 'protected_area'").select(plain_words(attribute("name")).alias("name")).where("name <> ''").distinct()
    t = e.where("category = 'data_source'").select(plain_words("context").alias("text"))
    return gap(_unnamed(a, t), "integration", "unmonitored_mpa", "critical", F.col("name"), 2)


COUNTED = (thematic_gaps, temporal_gaps, unregulated_activities, vague_requirements, enforcement_gaps, missing_data_types, coverage_gaps, resolution_gaps, legal_data_mismatch, access_barriers, research_policy_disconnect)


def all_gaps(extractions: DataFrame, documents: DataFrame) -> DataFrame:
    """The rows of all rules; those that count share one pass, whose one row is kept."""
    e, d = extractions, documents
    row = cut(e.agg(*[c.alias(n) for rule in COUNTED for n, c in rule.aggregates().items()]))
    rules = [f(e) for f in (method_gaps, geographic_gaps, missing_penalties, unprotected_species, unmonitored_areas)]
    return reduce(DataFrame.unionByName, [*rules, method_legal_disconnect(e, d), *[rule.gaps(row) for rule in COUNTED]])


def prioritized(gaps: DataFrame, recommendation: bool = True, impact: bool = True) -> DataFrame:
    """Gaps with a score of severity times weight, plus evidence, recommendation and impact; unknown kinds count 1."""
    value = lambda c, m: F.coalesce(F.element_at(F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))]), F.col(c)), F.lit(1.0))
    extra = F.least(F.col("n_evidence") * 0.1, F.lit(0.5)) + F.lit(0.2 * recommendation + 0.1 * impact)
    return gaps.withColumn("priority_score", F.round(value("severity", SEVERITY) * value("gap_category", WEIGHT) + extra, 6))


def top_gaps(scored: DataFrame, n: int) -> DataFrame:
    """The n highest scores; ties go by category, type and subject."""
    return scored.orderBy(F.col("priority_score").desc(), "gap_category", "gap_type", "subject").limit(n)


def summary(scored: DataFrame) -> DataFrame:
    """(measure, value): totals, by severity (zero-filled) and by category (zero-filled)."""
    row = scored.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY], *[F.count_if(F.col("gap_category") == c).alias(c) for c in WEIGHT])
    return _each(row, {c: F.col(c) for c in ("total", *SEVERITY, *WEIGHT)}).withColumnRenamed("term", "measure")


def matrix(gaps: DataFrame) -> DataFrame:
    """Gaps by category and severity, zero-filled."""
    return gaps.groupBy("gap_category").pivot("severity", list(SEVERITY)).agg(F.count(F.lit(1))).na.fill(0, list(SEVERITY))


def report_order(gaps: DataFrame) -> DataFrame:
    """(number, gap columns): the gaps of each category, the most severe first; ties by type and subject. Ranks are counted
    over range partitions, so that no category is ordered in one task."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "important", 1).otherwise(2)
    r = ranked(gaps.select("gap_category", "gap_type", "severity", "subject", rank.alias("__s")), "gap_category", "__s", "gap_type", "subject")
    first = r.groupBy("gap_category").agg(F.min("rank").alias("__first"))
    return r.join(F.broadcast(first), "gap_category").select((F.col("rank") - F.col("__first") + 1).cast("int").alias("number"), "gap_category", "gap_type", "severity", "subject")
