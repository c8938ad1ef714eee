"""Hand-made cases of every extractor: what it finds in either language, with which fields, and what it leaves."""

import pytest

from tidewright.operators import extraction as X

TAIL = "Bu kıyıda çok sayıda tekne bulunur ve liman her yıl biraz daha büyür. " * 12
ENGLISH_TAIL = "Vessels use the harbour and the coast throughout the year without any trouble at all. " * 12
#: id -> (text, {category: {field: value}}): every category named has to be found with these fields.
FOUND = {
    "distance_en": ("Cages must stay at least 500 metres from the coast in the bay.", {"distance": {"value": "500.0", "unit": "metre", "qualifier": "minimum", "is_range": "false"}}),
    "distance_tr": ("Kafesler kıyıdan en az 2 km uzakta, deniz üzerinde kurulur ve balıkçılığa açıktır.", {"distance": {"value": "2000.0", "unit": "metre", "qualifier": "minimum"}}),
    "distance_words": ("The buffer at sea is two hundred metres around the harbour.", {"distance": {"value": "200.0"}}),
    "distance_range": ("Vessels keep between 100 and 300 m off the marine reserve.", {"distance": {"min_value": "100.0", "max_value": "300.0", "is_range": "true"}}),
    "penalty_en": ("Illegal fishing brings a fine of €5,000 for the vessel.", {"penalty": {"penalty_type": "fine", "amount": "5000.0", "currency": "€", "violation": "Illegal fishing brings a fine"}}),
    "penalty_tr": ("Denizde izinsiz avlanan balıkçıya 500 TL idari para cezası verilir.", {"penalty": {"penalty_type": "fine", "amount": "500.0", "currency": "TL"}}),
    "prison_en": ("Poaching at sea is punished by 2 years of imprisonment for the skipper of the vessel.", {"penalty": {"penalty_type": "imprisonment", "duration": "2 years"}}),
    "temporal_en": ("Trawl fishing at sea is closed from April 15 to September 30 in this bay.", {"temporal": {"restriction_type": "date_range", "start_date": "April 15", "end_date": "September 30"}}),
    "temporal_tr": ("Balıkların üreme dönemi boyunca denizde avcılık yapılmaz.", {"temporal": {"restriction_type": "biological_period", "start_date": "üreme"}}),
    "environmental_en": ("The salinity of 38.5 ppt in the lagoon was high for the sea.", {"environmental": {"condition_type": "water_quality_salinity", "value": "38.5", "unit": "ppt"}}),
    "environmental_tr": ("Denizde tuzluluk en az 30,5 ppt olarak ölçülmüştür.", {"environmental": {"condition_type": "water_quality_salinity", "threshold_type": "minimum", "value": "30.5"}}),
    "prohibition_en": ("Within this bay trawling is prohibited, except for research vessels.", {"prohibition": {"prohibition_type": "activity_banned", "activity": "trawling", "exceptions": "for research vessels"}}),
    "prohibition_tr": ("Körfezde trol yasaktır ve kıyı boyunca denetlenir, bölgede kimse ağ atamaz.", {"prohibition": {"prohibition_type": "activity_banned", "activity": "trol", "scope": "bölgede"}}),
    "species_en": ("The bottlenose dolphin and Posidonia oceanica live near the coast.", {"species": {}}),
    "species_tr": ("Kıyıda levrek ve deniz çayırı görülür, balıkçılık sürer.", {"species": {"species_name": "levrek"}}),
    "area_en": ("Old Lighthouse Marine Reserve lies by the coast, where vessels anchor.", {"protected_area": {"area_type": "Marine Reserve", "name": "Old Lighthouse"}}),
    "area_tr": ("Gökova özel çevre koruma bölgesi, deniz ve kıyı için önemlidir.", {"protected_area": {"name": "Gökova"}}),
    "permit_en": ("An aquaculture permit is required for cages in the bay.", {"permit": {"permit_type": "aquaculture_permit"}}),
    "permit_tr": ("Denizde balıkçılık ruhsatı gerekir ve tekne kaydı şarttır, kıyıda başvurulur.", {"permit": {"permit_type": "balıkçılık_ruhsatı"}}),
    "coordinate_en": ("The corner of the sea area is at 36.5° N, 27.25° W near the coast.", {"coordinate": {"latitude": "36.5", "longitude": "-27.25", "boundary_type": "point"}}),
    "coordinate_dms": ("The port stands at 41°00'30\"N 28°58'30\"E by the sea.", {"coordinate": {"latitude": "41.008333333", "longitude": "28.975"}}),
    "law_en": ("Vessels follow Article 5 of the Law No. 1380 at sea.", {"legal_reference": {}}),
    "law_tr": ("Denizde 1380 sayılı kanun uyarınca balıkçılık düzenlenir.", {"legal_reference": {"reference_type": "law", "law_number": "1380"}}),
    "stakeholder_en": ("The port authorities are responsible for dredging of the harbour.", {"stakeholder": {"stakeholder_name": "port authorities", "role": "dredging of the harbour"}}),
    "institution_en": ("The Coastal Waters Regional Agency watches the harbour and the vessels.", {"institution": {"institution_name": "The Coastal Waters Regional Agency", "institution_type": "agency"}}),
    "conflict_en": ("A serious conflict between fishing and shipping.", {"conflict": {"activity_1": "fishing", "activity_2": "shipping", "severity": "high"}}),
    "conflict_tr": ("Denizde balıkçılık ile turizm arasında çatışma vardır, kıyı dardır.", {"conflict": {"activity_2": "turizm"}}),
    "method_en": ("We mapped vessels at sea using a survey, and used QGIS; n = 42.", {"method": {"method_type": "survey", "tools_used": "QGIS", "sample_size": "42"}}),
    "method_tr": ("Kıyıda anket çalışması yapıldı ve 40 katılımcı ile görüşüldü.", {"method": {"method_type": "survey", "sample_size": "40"}}),
    "finding_en": ("Our results show that catches near the coast increase by 25% in the bay.", {"finding": {"finding_type": "trend", "quantitative_result": "25%"}}),
    "policy_en": ("Integrated Maritime Strategy sets goals: to protect the coast and sea.", {"policy": {"policy_type": "strategy", "title": "Integrated Maritime"}}),
    "data_en": ("Maps of the sea rest on AIS data from 2010-2015 with 30 m resolution.", {"data_source": {"source_name": "AIS", "temporal_coverage": "2010-2015", "resolution": "30 m resolution"}}),
    "data_tr": ("Kıyıda uydu verisi kullanıldı ve tekneler sayıldı.", {"data_source": {"source_type": "satellite"}}),
    "objective_en": ("This study aims to map fishing grounds in the Aegean Sea. Vessels were counted.", {"objective": {"objective_type": "objective", "objective_text": "map fishing grounds in the Aegean Sea"}}),
    "objective_tr": ("Bu çalışmanın amacı kıyıdaki balıkçılığı haritalamaktır. Tekneler sayıldı.", {"objective": {"objective_type": "objective"}}),
    "result_en": ("Results indicate that 12 species of fish were lost near the port.", {"result": {"result_type": "quantitative", "quantitative_value": "12 species"}}),
    "conclusion_en": (ENGLISH_TAIL + "We conclude that the coast clearly needs a wider buffer for vessels.", {"conclusion": {"conclusion_type": "main_conclusion", "evidence_strength": "strong"}}),
    "conclusion_tr": (TAIL + "Sonuç olarak kıyıdaki balıkçılık için daha geniş bir alan ayrılmalıdır.", {"conclusion": {"conclusion_type": "main_conclusion"}}),
    "gap_en": (ENGLISH_TAIL + "There is an urgent lack of seabed records for the harbour.", {"gap": {"gap_description": "seabed records for the harbour", "severity": "critical"}}),
    "gap_tr": (TAIL + "Kıyıda veri eksikliği balıkçılık yönetimini zorlaştırır ve gelecek çalışmalar gerekir.", {"gap": {"gap_type": "data_gap"}}),
}
#: id -> (text, category that must not be found)
LEFT = {
    "year": ("The port was moved 1998 m away from the sea.", "distance"),
    "building": ("Kat yüksekliği 3 m, bina yüksekliği 12 m, ön bahçe 5 m olur.", "distance"),
    "mixed": ("The sea and the coast matter. " * 30 + "The floor height of the residential parcel is 3 m and the basement of the garage is lower.", "distance"),
    "law_date": ("10/05/2001 tarih ve 4703 sayılı metinde denizden söz edilir.", "distance"),
    "land": ("The permit of the sea front follows the zoning of 3 years.", "temporal"),
    "assessment": ("An environmental impact assessment of the port was made at sea.", "environmental"),
    "coral_sea": ("Vessels cross the wide blue coral there.", "species"),
    "lone_group": ("A whale was seen near the coast.", "species"),
    "range": ("Points at 96.5° N, 27.25° W lie in the sea.", "coordinate"),
    "generic": ("The Agency watches the harbour.", "institution"),
    "land_conflict": ("A conflict between the algorithm and the dataset at sea.", "conflict"),
    "no_figures": ("Our results show that catches near the coast increase a little in the bay.", "finding"),
    "no_quantity": ("Results indicate that fish were lost near the port.", "result"),
    "early": ("We conclude that the coast needs a buffer. " + ENGLISH_TAIL, "conclusion"),
    "early_gap": ("There is a lack of seabed records. " + ENGLISH_TAIL, "gap"),
    "references": ("The sea is deep.\nReferences\nSmith, J. 2001. Fishing is prohibited within 500 m of the coast.", "prohibition"),
    "verb": ("Coastal Plans Are Policy in the bay.", "policy"),
    "journal": ("Vessels are studied in Marine Policy each year.", "policy"),
    "empty": ("", "distance"),
    "nothing": (None, "distance"),
}


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(k, "research", t) for k, (t, _) in FOUND.items()] + [(f"left_{k}", "research", t) for k, (t, _) in LEFT.items()]
    d = spark.createDataFrame(docs, "doc_id string, doc_type string, text string")
    out: dict = {}
    for r in X.extract(d).collect():
        out.setdefault((r["doc_id"], r["category"]), []).append(r)
    return out


@pytest.mark.parametrize("name", FOUND)
def test_found(name, rows):
    for category, fields in FOUND[name][1].items():
        assert any(all(r["fields"][f] == v for f, v in fields.items()) for r in rows.get((name, category), [])), [r["fields"] for r in rows.get((name, category), [])]


@pytest.mark.parametrize("name", LEFT)
def test_left(name, rows):
    assert not rows.get((f"left_{name}", LEFT[name][1])), [r["exact_text"] for r in rows[f"left_{name}", LEFT[name][1]]]


def test_every_category_has_cases():
    assert {c for _, found in FOUND.values() for c in found} == set(X.SPECS)


def test_confidence_and_routes(spark, rows):
    assert rows["distance_en", "distance"][0]["confidence"] == 0.95 and rows["method_tr", "method"][0]["confidence"] == 0.8
    text = "Cages must stay at least 500 metres from the coast. We mapped vessels using a survey. Cages must stay at least 500 metres from the coast."
    d = spark.createDataFrame([("a", "legal", text), ("b", "research", text), ("c", None, text), ("d", "odd", text)], "doc_id string, doc_type string, text string")
    got = {(r["doc_id"], r["category"], r["n_mentions"]) for r in X.extract(d, ("distance", "method"), routed=True).collect()}
    assert got == {("a", "distance", 2), ("b", "method", 1)}
    assert X.extract(d.limit(0)).count() == 0


def test_required_strings_leave_no_match_out():
    """A folded text holds what every letter of it may match without case; patterns are skipped only where they cannot match."""
    import re
    import sys

    from tidewright.operators import patterns as P

    letters = {x for p in P.LISTS.values() for each in p.needed.values() for clauses in each for c in clauses for x in "".join(c)}
    for letter in letters:
        own = re.compile(re.escape(letter), re.I)
        assert all(P.folded(c) == letter for c in own.findall("".join(map(chr, range(sys.maxunicode + 1))))), letter
    assert P.required(r"(?P<a>\w+)\s+(?:marine\s+park|natural?\s+reserve)s?") == (frozenset({"marine", "reserve"}),)
    assert P.required(r"çat[ıi][şs]ma") == (frozenset({"çatişma", "çatisma"}),) and P.required(r"\d+\s*(?:km)?") == ()
    held = P.Held("ÇATIŞMA alanı")
    assert held.may_match(P.required(r"çat[ıi][şs]ma")) and not held.may_match(P.required("uyumsuzluk|rekabet"))


def test_longest_of_terms_as_ordered_alternatives():
    import itertools
    import re

    from tidewright.functions import text as T

    texts = ["".join(x) for x in itertools.product("ab c", repeat=6)]
    for terms in ({"a", "ab", "abc", "b c"}, {"aa", "ab a"}, {"c", "cab", "ca"}):
        ordered = re.compile("|".join(sorted(terms, key=lambda t: (-len(t), t))))
        assert all(re.findall(T.longest_of(terms), x) == ordered.findall(x) for x in texts)


def test_cleaned_sentence_is_computed_once(spark):
    from tidewright.operators import extraction as X

    matches = X.scanned(spark.createDataFrame([(1, "legal", "x")], "doc_id bigint, doc_type string, text string"), ("distance",), "doc_id", "text", False)
    plan = X.passed(matches, ("distance",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Değişik") == 1
