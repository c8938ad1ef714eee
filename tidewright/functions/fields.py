"""Fields of extracted facts, as expressions over the matched text, its groups and its context.

Most fields are one of a few labels, by the first list of terms of which any stands in a text; others are what the first
of several patterns finds in the context. The lists and patterns are fixed values; which of two languages holds is a
boolean column. A NULL text has no label but the last one, and nothing is found in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.text import JOURNALS, KEYWORDS, citation_count, coherence, is_citation, let, words_of

Rules = tuple[tuple[str, tuple[str, ...]], ...]
#: Letter case aside, in all alphabets, with the word classes of all alphabets.
ANY_CASE, CASED = "(?iuU)", "(?uU)"

#: Labels with their terms, in order; the texts are in lower case.
PENALTY_TYPES = {
    "turkish": (("imprisonment", ("hapis", "özgürlü")), ("license_revocation", ("ruhsat", "lisans", "izin", "belge")), ("activity_suspension", ("men", "yasaklan", "durdur")), ("fine", ("ceza", "para"))),
    "english": (("imprisonment", ("imprisonment", "prison", "jail")), ("license_revocation", ("revocation", "suspension", "cancellation")), ("activity_suspension", ("ban", "prohibited", "suspended")), ("fine", ("fine", "penalty"))),
}
QUALIFIERS = {
    "turkish": (("minimum", ("en az", "asgari")), ("maximum", ("en fazla", "en çok", "azami")), ("greater_than", ("fazla", "üzeri")), ("less_than", ("az", "altında")), ("minimum", ("minimum",)), ("maximum", ("maximum",))),
    "english": (("minimum", ("minimum", "at least")), ("maximum", ("maximum", "up to")), ("approximately", ("approximately", "about", "around"))),
}
DISTANCE_UNITS = (("kilometre", ("km", "kilomet")), ("metre", ("metre", "meter", "mt")), ("nautical_mile", ("mil", "deniz", "nm", "nautical")))
THRESHOLDS = {"turkish": (("minimum", ("en az", "minimum")), ("maximum", ("en fazla", "maksimum", "aşamaz", "geçemez"))), "english": (("minimum", ("minimum", "at least")), ("maximum", ("maximum", "up to", "not exceed")))}
PROHIBITIONS = {"turkish": (("activity_banned", ("yasak", "men")), ("not_permitted", ("izin verilmez",))), "english": (("activity_banned", ("prohibit", "ban")), ("not_permitted", ("not permitted", "not allowed")))}
PERMITS = {
    "turkish": (("fishing_license", ("balık", "avcı")), ("construction_permit", ("inşaat", "yapı")), ("environmental_approval", ("çevre",))),
    "english": (("fishing_license", ("fishing",)), ("construction_permit", ("construction", "development")), ("environmental_approval", ("environmental",))),
}
BOUNDARIES = {"turkish": (("point", ("köşe", "nokta")), ("line", ("çizgi", "hat")), ("polygon", ("alan", "bölge", "poligon"))), "english": (("point", ("point", "corner")), ("line", ("line",)), ("polygon", ("area", "polygon", "zone")))}
LAWS = {
    "turkish": (("law", ("kanun",)), ("regulation", ("yönetmelik",)), ("decree", ("tüzük",)), ("directive", ("tebliğ",)), ("article", ("madde", "md"))),
    "english": (("law", ("act", "law")), ("regulation", ("regulation",)), ("directive", ("directive",)), ("article", ("article", "section"))),
}
STAKEHOLDERS = {
    "turkish": (("government", ("bakanlı",)), ("ngo", ("vakıf", "dernek")), ("community", ("balıkçı", "topluluk"))),
    "english": (("government", ("ministry", "department", "agency")), ("ngo", ("foundation", "association", "organization")), ("community", ("community", "fisher"))),
}
INSTITUTIONS = {
    "turkish": (("ministry", ("bakanlı",)), ("directorate", ("müdürlü",)), ("presidency", ("başkanlı",)), ("agency", ("kurum",)), ("institute", ("enstitü",)), ("committee", ("komite",))),
    "english": (("ministry", ("ministry",)), ("department", ("department",)), ("agency", ("agency", "authority")), ("institute", ("institute",)), ("committee", ("committee", "commission"))),
}
METHODS = (
    ("survey", ("survey", "anket", "questionnaire")), ("stakeholder_interview", ("interview", "mülakat", "röportaj")), ("modeling", ("model", "modelleme")), ("gis_analysis", ("gis", "cbs", "spatial analysis")), ("field_study", ("field", "saha", "arazi")),
    ("conservation_planning_tool", ("marxan", "zonation", "maxent", "invest", "seasketch", "mimes")), ("ecosystem_based_management", ("ecosystem-based", "ecosystem based", "ebm")),
    ("participatory_method", ("participatory", "stakeholder consultation", "stakeholder engagement", "stakeholder workshop", "paydaş")), ("remote_sensing", ("remote sensing", "habitat mapping")), ("cost_benefit_analysis", ("cost-benefit", "cost benefit")),
    ("multi_criteria_analysis", ("multi-criteria", "multi criteria", "delphi")), ("scenario_analysis", ("scenario", "cumulative impact", "cumulative effect")), ("suitability_analysis", ("suitability", "overlap")), ("statistical_analysis", ("statistical", "numerical")),
    ("ebsa_assessment", ("ebsa",)), ("marine_cadastre", ("marine cadastre",)),
)
FINDINGS = (("spatial_pattern", ("spatial", "mekansal", "alan", "distribution")), ("trend", ("trend", "eğilim", "increase", "decrease", "artış", "azalış")), ("correlation", ("correlation", "korelasyon", "relationship", "ilişki")), ("recommendation", ("recommend", "öner", "suggest")))
POLICIES = (("directive", ("directive", "direktif")), ("regulation", ("regulation", "yönetmelik")), ("strategy", ("strategy", "strateji")), ("framework", ("framework", "çerçeve")), ("guideline", ("guideline",)))
SOURCES = (("satellite", ("satellite", "uydu", "satellit", "landsat", "sentinel", "modis")), ("survey", ("survey", "anket")), ("database", ("database", "veritaban")), ("remote_sensing", ("imagery", "remote sensing")))
OBJECTIVES = (("hypothesis", ("hypothes", "h1", "h2", "h3", "h4")), ("research_question", ("research question", "rq")), ("problem_statement", ("purpose", "problem", "sorun")))
CONCLUSIONS = (("management_recommendation", ("recommend", "önerilen", "tavsiye")), ("policy_implication", ("policy", "implication")))
AUDIENCES = (("policymakers", ("policy", "policymaker", "government", "regulation", "politika", "hükümet", "yönetmelik")), ("managers", ("manager", "management", "practitioner", "yönetici", "yönetim")), ("researchers", ("researcher", "future research", "scientist", "araştırmacı", "bilim insanı")))
GAPS = (("data_gap", ("data", "information", "dataset", "veri")), ("methodological_gap", ("method", "approach", "technique", "yöntem")), ("research_need", ("future", "need", "should", "gelecek")))
DOMAINS = (
    ("marine_ecology", ("ecology", "biodiversity", "species", "habitat", "ecosystem", "ekoloji", "biyoçeşitlilik", "tür", "ekosistem")), ("spatial_planning", ("spatial", "planning", "zoning", "zone", "area", "mekansal", "planlama", "zonlama")),
    ("fisheries", ("fish", "fishing", "fishery", "catch", "stock", "balık", "balıkçılık", "av")), ("climate_change", ("climate", "warming", "sea level", "temperature", "iklim", "ısınma", "deniz seviyesi")),
    ("socioeconomic", ("economic", "social", "stakeholder", "community", "livelihood", "ekonomik", "sosyal", "paydaş")), ("governance", ("governance", "policy", "regulation", "institutional", "yönetişim", "politika", "düzenleme")),
)
SEVERITIES = {
    "turkish": (("high", ("yüksek", "ciddi", "şiddetli", "önemli", "büyük")), ("medium", ("orta", "normal")), ("low", ("düşük", "az", "küçük", "sınırlı"))),
    "english": (("high", ("high", "severe", "major", "significant", "serious", "critical", "intense")), ("medium", ("medium", "moderate")), ("low", ("low", "minor", "small", "limited", "minimal"))),
}
#: Kinds of conflict by how many of their terms stand in the text; the first wins ties.
CONFLICTS = (
    ("temporal", ("season", "seasonal", "temporal", "time", "month", "winter", "summer", "spring", "autumn", "spawning period", "breeding season", "closure period", "time-sharing", "scheduling", "mevsim", "mevsimsel", "dönem", "yumurtlama", "üreme")),
    ("resource", ("stock", "resource", "carrying capacity", "biomass", "depletion", "overexploit", "overfishing", "water quality", "nutrient", "pollution", "eutrophication", "degradation", "fish stock", "stok", "kaynak", "taşıma kapasitesi", "kirlilik", "aşırı avlanma")),
    ("governance", ("jurisdiction", "authority", "institutional", "regulatory", "governance", "mandate", "competence", "coordination", "transboundary", "cross-border", "legal framework", "policy gap", "yetki", "kurumsal", "düzenleyici", "koordinasyon", "sınır ötesi")),
    ("spatial", ("space", "spatial", "area", "zone", "overlap", "displace", "displacement", "buffer", "location", "site", "territory", "co-location", "colocation", "siting", "adjacent", "alan", "bölge", "yer", "konumlandırma")),
)
RESOLUTIONS = (
    "spatial zoning", "temporal zoning", "zoning", "buffer zone", "stakeholder consultation", "stakeholder engagement", "stakeholder dialogue", "stakeholder participation", "co-location", "colocation", "seasonal restriction", "seasonal closure", "time-sharing",
    "marine spatial planning", "ecosystem-based management", "adaptive management", "integrated management", "quota system", "quota allocation", "exclusion zone", "no-take zone", "marine protected area", "spatial planning", "management plan", "negotiation",
    "mediation", "compensation", "mitigation", "separation of uses", "co-existence", "coexistence", "priority setting", "multi-use", "multi-objective",
)
CONDITIONS = (
    ("water_quality_ph", "p", ("ph",)), ("water_quality_oxygen", "pq", ("oxygen", "oksijen", "do")), ("water_quality_salinity", "pq", ("salinity", "tuzluluk")), ("water_quality", "p", ("water quality", "su kalitesi")),
    ("pollution_nutrients", "pq", ("nitrogen", "nitrat", "phosph", "fosfat", "eutrophication")), ("pollution_heavy_metals", "pq", ("metal", "heavy")), ("pollution_petroleum", "pq", ("petroleum", "petrol", "oil", "hydrocarbon", "spill")),
    ("noise", "pt", ("noise", "gürültü", "acoustic", "akustik")), ("emission", "p", ("emission", "emisyon", "discharge", "deşarj")), ("environmental_impact", "pt", ("impact", "etki", "eia", "ced", "cumulative")), ("habitat_condition", "p", ("habitat", "biodiversity")), ("pollution", "p", ("pollution", "kirlilik")),
)
TOOLS = ("ArcGIS", "QGIS", "MATLAB", "R", "Python", "SPSS", "Zonation")
RELATED_METHODS = {"english": ("survey", "interview", "GIS", "analysis", "modeling", "modelling", "sampling", "experiment", "simulation", "assessment", "monitoring"), "turkish": ("anket", "analiz", "modelleme", "örnekleme", "izleme")}
GENERIC_GROUPS = tuple(
    "whale dolphin shark turtle seal seabird bird fish coral kelp algae plankton phytoplankton zooplankton cetacean mammal invertebrate vertebrate crustacean mollusk mollusc seaweed sponge tuna cod herring sardine anchovy mackerel porpoise ray skate eel squid "
    "octopus shrimp prawn lobster crab mussel oyster clam scallop abalone".split()
)
PLACE_NAMES = ("coral sea", "whale bay", "turtle island", "dolphin coast", "seal beach", "crab island", "shark bay", "fish creek")
QUALIFYING = ("species", "population", "habitat", "abundance", "distribution", "conservation", "threatened", "endangered", "protected", "monitoring", "survey", "breeding")
#: Patterns sought in the context, by language, the first that is found.
SEARCHES: dict[str, dict[str, tuple[str, ...]]] = {
    "violation": {
        "turkish": (r"((?:ihlal|çi[ğg]ne|aykırı|yasak).*?(?:faaliyeti?|eylemi?|davranı[şs]))", r"((?:izinsiz|ruhsatsız|kaçak).*?(?:av|balık|çıkarma|inşaat))"),
        "english": (r"((?:violation|breach|infringement)\s+of\s+\w+)", r"((?:illegal|unlawful|unauthorized)\s+\w+(?:\s+\w+){0,3})"),
    },
    "legal_reference": {"turkish": (r"(\d+\s*sayılı\s*(?:kanun|yönetmelik|tüzük))",), "english": (r"((?:Act|Law|Regulation)\s+(?:No\.\s*)?\d+)",)},
    "scope": {
        "turkish": (r"(bölgede|alanda|sahada|sınırlar\s+içinde)", r"(koruma\s+alan[ıi]|özel\s+alan|yasak\s+bölge)"),
        "english": (r"(in\s+the\s+area|within\s+the\s+zone|in\s+the\s+region)", r"(protected\s+area|marine\s+reserve|conservation\s+zone)"),
    },
    "location": {"turkish": (r"(?:bölge|alan|konum|nokta|s[ıi]n[ıi]r)[\s:]+([^.;]{5,50})",), "english": (r"(?:area|zone|location|point|boundary)[\s:]+([^.;]{5,50})",)},
    "role": {"turkish": (r"(?:rolü|görev)[:\s]+([^.;]+)", r"sorumlu\s+([^.;]+)"), "english": (r"(?:role|responsibility)[:\s]+([^.;]+)", r"responsible\s+for\s+([^.;]+)")},
    "charge": {"turkish": (r"(?:yetkili|sorumlu|görevli)[:\s]+([^.;]+)",), "english": (r"(?:responsible|authorized|in\s+charge)[:\s]+([^.;]+)",)},
    "jurisdiction": {"turkish": (r"(?:bölge|alan|yetkisi)[:\s]+([^.;]+)",), "english": (r"(?:jurisdiction|area\s+of\s+authority)[:\s]+([^.;]+)",)},
    "policy_scope": {"turkish": (r"(?:kapsam|alan)[:\s]+([^.;]+)",), "english": (r"(?:scope|coverage)[:\s]+([^.;]+)",)},
    "significance": {"turkish": (r"((?:anlaml[ıi]|istatistiksel)[:\s]+[^.;]+)",), "english": (r"(significant|significance|p\s*[<>=]\s*\d+[.,]\d+)",)},
    "spatial_coverage": {"turkish": (r"((?:kapsam|alan)[:\s]+[^.;]+?(?:km²|km2|ha))",), "english": (r"((?:coverage|area)[:\s]+[^.;]+?(?:km²|km2|ha))",)},
    "solution": {
        "turkish": (r"(?:should|could|need\s+to|recommend)\s+([^.]+)", r"by\s+(?:using|applying|developing)\s+([^.]+)", r"(?:gerekli|önerilmektedir|yapılmalıdır)\s+([^.]+)"),
        "english": (r"(?:should|could|need\s+to|recommend)\s+([^.]+)", r"by\s+(?:using|applying|developing)\s+([^.]+)"),
    },
    "species_activity": {"turkish": (r"(.{0,20}(?:avlan|balıkçılık|koruma|üretim|yetiştirme).{0,20})",), "english": (r"(.{0,20}(?:fishing|hunting|protection|conservation|aquaculture|farming).{0,20})",)},
    "resolution": {
        "turkish": (r"(?:çözüm\s+olarak|çözmek\s+için|gidermek\s+amacıyla)\s+([^.;\n]{10,80})", r"(zonlama|tampon\s+bölge|mevsimsel\s+k[ıi]s[ıi]tlama|payda[şs]\s+kat[ıi]l[ıi]m[ıi])"),
        "english": (
            r"(?:through|via|using|by)\s+((?:spatial|temporal)\s+zoning|buffer\s+zones?|stakeholder\s+\w+|co-?location|seasonal\s+\w+|marine\s+spatial\s+planning|(?:adaptive|ecosystem[- ]based|integrated)\s+management|quota\s+\w+|exclusion\s+zones?|no-?take\s+zones?|negotiat\w+|mediat\w+|compensat\w+|mitigat\w+)",
        ),
    },
}
#: Patterns of lists in the context, by language.
LISTS: dict[str, dict[str, tuple[str, ...]]] = {
    "exceptions": {"turkish": (r"(?:hariç|müstesna|dışında|istisna)[\s:]+([^.;]+)", r"([^.;]+?)\s+(?:hariç|müstesna)"), "english": (r"(?:except|excluding|with\s+the\s+exception\s+of)[\s:]+([^.;]+)", r"([^.;]+?)\s+(?:are\s+)?excepted")},
    "requirements": {"turkish": (r"(?:gerekli|şart|zorunlu)\s+olan\s+([^.;]+)", r"([^.;]+?)\s+(?:sunulmal[ıi]|ibraz\s+edilmeli)"), "english": (r"(?:required|necessary|must\s+provide)\s+([^.;]+)", r"(?:shall|must)\s+(?:submit|present|provide)\s+([^.;]+)")},
    "restrictions": {"turkish": (r"(?:yasaklan(?:m[ıi][şs]|acak)|izin\s+verilme(?:z|yecek))\s*:?\s*([^.;]+)", r"([^.;]+?)\s+yasakt[ıi]r"), "english": (r"(?:prohibited|forbidden|not\s+allowed)\s*:?\s*([^.;]+)", r"no\s+([^.;]+?)\s+(?:is\s+)?(?:allowed|permitted)")},
    "responsibilities": {"turkish": (r"sorumluluk[:\s]+([^.;]+)", r"yükümlülük[:\s]+([^.;]+)"), "english": (r"responsibilit(?:y|ies)[:\s]+([^.;]+)", r"duties[:\s]+([^.;]+)")},
    "objectives": {"turkish": (r"(?:amaç|hedef)[:\s]+([^.;]+)", r"(sağlamak|korumak|geliştirmek)"), "english": (r"(?:objective|goal|aim)[:\s]+([^.;]+)", r"(to\s+ensure|to\s+protect|to\s+promote)")},
}
TITLES = {"turkish": (r"[\"“]([^\"“”]+)[\"”]", r"([A-ZÇĞIÖŞÜ][\wçğıöşü\s]+?(?:Kanunu|Yönetmeliği|Tüzüğü))"), "english": (r"[\"“]([^\"“”]+)[\"”]", r"([A-Z][\w\s]+?(?:Act|Law|Regulation))")}
AREAS = (r"((?:in|at|along|within)\s+(?:the\s+)?[A-Z][a-zA-Z\s]{2,30}(?:Sea|Ocean|Bay|Coast|Region|Island|Basin))", r"(Mediterranean|Black\s+Sea|Aegean|Marmara|Atlantic|Pacific|Indian\s+Ocean)", r"(Karadeniz|Akdeniz|Ege|Marmara|[A-ZÇĞİÖŞÜ][a-zçğıöşü]+\s+(?:Denizi|Körfezi|Kıyısı))")
QUANTITY, STATISTIC = r"(\d+(?:\.\d+)?\s*(?:%|percent|km²|ha|individuals|species))", r"((?:p\s*[<>=]\s*\d+\.\d+|r\s*=\s*\d+\.\d+|CI\s*=|SD\s*=)[^,;.)]*)"
STRENGTHS = (("strong", r"\b(?:clearly|demonstrates?|confirms?|establishes?|proves?)\b"), ("moderate", r"\b(?:suggests?|indicates?|supports?|shows?)\b"), ("speculative", r"\b(?:speculate|future|preliminary|tentative|exploratory)\b"), ("weak", r"\b(?:may|could|might|possibly|potentially)\b"))
GAP_SEVERITIES = (("critical", r"\b(?:critical|essential|urgent|crucial|fundamental)\b"), ("important", r"\b(?:important|significant|considerable|substantial|notable)\b"), ("minor", r"\b(?:minor|potential|slight|marginal|modest)\b"))
MARINE_TERMS = tuple(
    "marine maritime coastal ocean sea port harbor harbour beach shore fishery fisheries fishing aquaculture shipping navigation offshore oil gas pipeline cable dredging mining conservation mpa mpas isra isras sanctuary biodiversity ecosystem habitat species whale "
    "dolphin turtle coral seabird tourism recreation diving surfing cetacean military navy defense defence trawling deniz kıyı balık liman iskele".split()
)
#: What an activity of a conflict may not start with, hold as a word, be as its only word, or hold at all.
NO_START = tuple(f"{w} " for w in "a an the is are was were has had have do does did ve s t to of in on it we he she or if can could would should may might been being also not but so".split())
NO_WORD = tuple(
    "was were is are has have had will because although according where which that this these those based such however while when since through from into about after before during within without green red blue of at as for across collectively and or various "
    "several different other presented discussed studied observed reported described identified proposed found shown suggested indicated demonstrated considered".split()
)
NO_ONLY = tuple("uses users use areas area activities sectors sector study studies data results methods zones zone limits and or the of to in on by for at as with from time".split())
NO_MATTER = tuple(
    "dataset algorithm model parameter convergence path node robot vehicle sensor network method function variable equation objective optimization pixel layer training epoch gradient loss batch neural classifier trajectory waypoint obstacle computation complexity "
    "efficiency accuracy matlab comsol python software cost budget revenue wave current tide storm sediment erosion polymer grid stressors organisms structures introduction environment ecological quality climate rising communities".split()
) + ("sea level", "target species")


def lower(text: Column | str) -> Column:
    """Lower case; the dotted capital becomes i."""
    return F.lower(F.translate(text, "İ", "i"))


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def any_of(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether any of the terms stands in a text; false for NULL."""
    return F.coalesce(let(text, lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(t)) for t in terms])), F.lit(False))


def label(text: Column, rules: Rules, default: str | None = None) -> Column:
    """The name of the first rule of which any term stands in the (lower-case) text."""
    return let(text, lambda x: reduce(lambda rest, r: F.when(any_of(x, r[1]), r[0]).otherwise(rest), reversed(rules), F.lit(default).cast("string")))


def by_language(turkish: Column, of, rules: dict) -> Column:
    """``of`` the Turkish or English entry, as the row is."""
    return F.when(turkish, of(rules["turkish"])).otherwise(of(rules["english"]))


def labelled(text: Column, turkish: Column, rules: dict[str, Rules], default: str | None = None) -> Column:
    return by_language(turkish, lambda r: label(text, r, default), rules)


def found(text: Column, patterns: tuple[str, ...], mode: str = ANY_CASE) -> Column:
    """What the first pattern that is found captures, trimmed; NULL if none is."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, mode + p, 1)), F.lit("")) for p in patterns])


def searched(name: str, context: Column, turkish: Column) -> Column:
    """The field ``name`` of ``SEARCHES`` in a context, of 100 characters at most."""
    return F.substring(by_language(turkish, lambda p: found(context, p), SEARCHES[name]), 1, 100)


def listed(name: str, context: Column, turkish: Column, most: int) -> Column:
    """The first ``most`` entries under 100 characters of the list ``name`` of ``LISTS`` in a context."""
    every = lambda ps: F.concat(*[F.regexp_extract_all(F.coalesce(context, F.lit("")), F.lit(ANY_CASE + p), F.lit(1)) for p in ps])
    trimmed = F.transform(by_language(turkish, every, LISTS[name]), lambda x: F.trim(x))
    return F.slice(F.filter(trimmed, lambda x: (x != "") & (F.length(x) < 100)), 1, most)


def decimal(text: Column) -> Column:
    """A number with a decimal comma or point."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def amount(text: Column) -> Column:
    """A number whose commas part thousands."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def distance_unit(unit: Column) -> Column:
    """metre, kilometre, nautical_mile or (English) mile; a metre where nothing is known."""
    low = lower(unit)
    return F.when(low.isin("m", "m."), "metre").when(low.rlike("(?U)^miles?$"), "mile").otherwise(label(low, DISTANCE_UNITS, "metre"))


def qualifier(text: Column, turkish: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(None)).otherwise(labelled(lower(text), turkish, QUALIFIERS))


def penalty_type(text: Column, turkish: Column) -> Column:
    return labelled(lower(text), turkish, PENALTY_TYPES, "unspecified_penalty")


def currency(text: Column, turkish: Column) -> Column:
    """The currency in capitals, lira as TL; Turkish penalties without one are in TL."""
    up = F.replace(F.upper(text), F.lit("₺"), F.lit("TL"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.when(turkish, "TL")).when(up.rlike("L[Iİ]RA"), "TL").otherwise(up)


def condition_type(parameter: Column, pollutant: Column, kind: Column) -> Column:
    """The condition that a parameter, a pollutant and further words speak of."""
    texts = {"p": lower(F.coalesce(parameter, F.lit(""))), "q": lower(F.coalesce(pollutant, F.lit(""))), "t": lower(F.coalesce(kind, F.lit("")))}
    hit = lambda where, terms: reduce(lambda a, b: a | b, [any_of(texts[w], terms) for w in where])
    return reduce(lambda rest, r: F.when(hit(r[1], r[2]), r[0]).otherwise(rest), reversed(CONDITIONS), F.lit("environmental_condition"))


def prohibition_type(text: Column, method: Column, area: Column, turkish: Column) -> Column:
    return F.when(method.isNotNull(), "method_prohibited").when(area.isNotNull(), "area_restricted").otherwise(labelled(lower(text), turkish, PROHIBITIONS, "restriction"))


def permit_type(kind: Column, permit: Column, context: Column, turkish: Column) -> Column:
    """The kind and the permit as they are named, else by the context."""
    named = F.concat_ws("_", F.trim(kind), F.nullif(F.trim(permit), F.lit("")))
    return F.when(F.coalesce(F.trim(kind), F.lit("")) != "", named).otherwise(labelled(lower(context), turkish, PERMITS, "permit"))


def title(context: Column, turkish: Column) -> Column:
    """A quoted title or the name of a law, of 11 to 199 characters."""
    fits = lambda p: F.regexp_extract(context, CASED + p, 1)
    one = lambda ps: F.coalesce(*[F.when(F.length(F.trim(fits(p))).between(11, 199), F.trim(fits(p))) for p in ps])
    return by_language(turkish, one, TITLES)


def law_date(context: Column) -> Column:
    return found(context, (r"(\d{1,2}[/.]\d{1,2}[/.]\d{4})", r"(\d{4})"))


def conflict_type(text: Column) -> Column:
    """The kind of which most terms stand in the text; spatial if none does."""
    score = lambda terms: reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms])
    best = F.array_max(F.array(*[F.struct(score(t).alias("n"), F.lit(-i).alias("i")) for i, (_, t) in enumerate(CONFLICTS)]))
    return F.when(text.isNull(), "spatial").otherwise(let(best, lambda b: F.when(b["n"] == 0, "spatial").otherwise(F.element_at(F.array(*[F.lit(k) for k, _ in CONFLICTS]), 1 - b["i"]))))


def resolution(broad: Column, turkish: Column) -> Column:
    """How a conflict is resolved: a known strategy, else what a pattern finds."""
    known = reduce(lambda rest, s: F.when(F.contains(lower(broad), F.lit(s)), s).otherwise(rest), reversed(RESOLUTIONS), F.lit(None).cast("string"))
    return F.substring(F.when(turkish, found(broad, SEARCHES["resolution"]["turkish"])).otherwise(F.coalesce(known, found(broad, SEARCHES["resolution"]["english"]))), 1, 80)


def valid_activity(a: Column) -> Column:
    """Whether words can be an activity: short, of few plain words, no fragment of a sentence."""
    low = lower(F.trim(a))
    words = F.split(low, r"\s+")
    fragment = reduce(lambda x, y: x | y, [F.startswith(low, F.lit(s)) for s in NO_START])
    return F.coalesce(
        (F.length(a) >= 3)
        & ~((F.length(a) > 20) & ~F.contains(a, F.lit(" ")))
        & ~fragment
        & ~a.rlike(r"[\[\]()\d\r\n]|(?U)\w-\s+\w|-\s*$")
        & F.exists(words, lambda w: w.rlike(r"^\p{L}{3,}$"))
        & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in NO_WORD]))
        & (F.size(words) <= 4)
        & ~((F.size(words) == 1) & low.isin(*NO_ONLY)),
        F.lit(False),
    )


def _keywords(language: int) -> list[str]:
    return list(dict.fromkeys(k.lower() for a in KEYWORDS.values() for k in a[language]))


def longest_keyword(text: Column, turkish: Column) -> Column:
    """The longest activity keyword of the language in a (lower-case) text, the first listed of equal ones; or NULL."""

    def of(language: int) -> Column:
        held = F.filter(words_of(tuple(_keywords(language))), lambda k: F.contains(text, k))
        return F.array_max(F.transform(held, lambda k, i: F.struct(F.length(k).alias("n"), (-i).alias("i"), k.alias("k"))))["k"]

    return F.when(turkish, of(0)).otherwise(of(1))


def is_marine(text: Column, turkish: Column) -> Column:
    """Whether a text names an activity or another marine matter."""
    low = lower(text)
    return F.coalesce(longest_keyword(low, turkish).isNotNull() | any_of(low, (*MARINE_TERMS, "wind farm", "wind energy")), F.lit(False))


def plain_activity(raw: Column, sentence: Column, turkish: Column) -> Column:
    """An activity by its keyword: in the words themselves, or near them in the sentence; else its first words."""
    low, around = lower(F.trim(raw)), lower(sentence)
    at = F.instr(around, low)
    window = F.when(at > 0, F.substr(around, F.greatest(F.lit(1), at - 40), F.least(at - 1, F.lit(40)) + F.length(low) + 40))
    bare = F.regexp_replace(low, r"^(?:the|a|an|of|for|in|on|by|to|and|with|their|our|its|these|those|some|this|that)\s+", "")
    first = F.array_join(F.slice(F.split(bare, r"\s+"), 1, 3), " ")
    return F.coalesce(longest_keyword(low, turkish), longest_keyword(window, turkish), first)


def method_type(text: Column) -> Column:
    return label(lower(text), METHODS, "research_method")


def tools(context: Column) -> Column:
    """The named tools in a context, at most five; one of a single letter has to stand alone."""
    low = lower(F.coalesce(context, F.lit("")))
    return F.slice(F.filter(F.array(*[F.when(F.contains(low, F.lit(t.lower())) if len(t) > 1 else context.rlike(rf"(?U)\b{t}\b"), F.lit(t)) for t in TOOLS]), lambda t: t.isNotNull()), 1, 5)


def sample_size(context: Column) -> Column:
    return found(context, (r"(?:n\s*=\s*|sample\s+size\s*=\s*|örneklem\s*=\s*)(\d+)", r"(\d+)\s+(?:participants|respondents|katılımcı)")).try_cast("int")


def quantitative_result(text: Column) -> Column:
    return found(text, (r"(\d+(?:[.,]\d+)?%)", r"(\d+(?:[.,]\d+)?\s*(?:km²|km2|ha|hectares))", r"(p\s*[<>=]\s*\d+(?:[.,]\d+)?)"))


def year_range(context: Column) -> Column:
    """The first two years with a dash between, with a plain one."""
    return F.nullif(F.regexp_replace(F.regexp_extract(context, r"(\d{4}\s*[-–]\s*\d{4})", 1), r"\s*[-–]\s*", "-"), F.lit(""))


def resolution_of_data(context: Column) -> Column:
    return found(context, (r"(\d+\s*m\s*resolution)", r"(resolution\s+of\s+\d+\s*m)", r"(\d+\s*metre\s*çözünürlük)"))


def study_area(context: Column, turkish: Column) -> Column:
    return F.when(turkish, found(context, AREAS, CASED)).otherwise(found(context, AREAS[:2], CASED))


def result_type(context: Column) -> Column:
    return F.when(context.rlike(ANY_CASE + STATISTIC), "statistical").when(context.rlike(ANY_CASE + QUANTITY), "quantitative").when(any_of(lower(context), ("spatial", "map", "area", "region", "zone", "location")), "spatial").otherwise("qualitative")


def related_method(context: Column, turkish: Column) -> Column:
    low = lower(context)
    first = lambda terms: reduce(lambda rest, t: F.when(F.contains(low, F.lit(t.lower())), t).otherwise(rest), reversed(terms), F.lit(None).cast("string"))
    return F.when(turkish, first(RELATED_METHODS["english"] + RELATED_METHODS["turkish"])).otherwise(first(RELATED_METHODS["english"]))


def graded(context: Column, grades: tuple[tuple[str, str], ...], default: str) -> Column:
    """The first grade whose pattern is found."""
    return reduce(lambda rest, g: F.when(context.rlike(ANY_CASE + g[1]), g[0]).otherwise(rest), reversed(grades), F.lit(default))


def species_valid(text: Column, context: Column) -> Column:
    """Whether a name can be a species: two-part names are; places and lone group names without a qualifier are not."""
    low = lower(strip(text))
    lone = low.isin(*GENERIC_GROUPS) & ~any_of(lower(context), QUALIFYING)
    return F.coalesce(strip(text).rlike("^[A-Z][a-z]{2,}\\s+[a-z]{2,}\\z") | ~(low.isin(*PLACE_NAMES) | lone), F.lit(True))


def is_journal(text: Column) -> Column:
    """Whether a text is the name of a journal, its article aside."""
    return F.coalesce(F.regexp_replace(lower(strip(text)), "^(?:the |a )", "").isin(*JOURNALS), F.lit(False))


_N = r"(\d+(?:[.,]\d+)?)"
#: Forms of ranges with their two bounds, and of bounded values with what they bound; in order. Fixed values.
RANGES = (
    rf"{_N}\s*[-–—]\s*{_N}", rf"{_N}\s*(?:ilâ|ila|ile)\s*{_N}", rf"{_N}\s*(?:ile|ve)\s*{_N}\s*(?:arası|arasında)", rf"en\s+az\s+{_N}\s*[,\s]\s*en\s+(?:çok|fazla)\s+{_N}",
    rf"asgari\s+{_N}\s*[,\s]\s*azami\s+{_N}", rf"between\s+{_N}\s*(?:and|to)\s*{_N}", rf"from\s+{_N}\s*to\s*{_N}",
)
BOUNDS = (
    (rf"en\s+az\s+{_N}", "minimum"), (rf"asgari\s+{_N}", "minimum"), (rf"en\s+(?:fazla|çok)\s+{_N}", "maximum"), (rf"azami\s+{_N}", "maximum"), (rf"{_N}['ıiuü]?[yni]?[ıi]?\s*geçemez", "maximum"), (rf"{_N}['ıiuü]?[yni]?[ıi]?\s*aşamaz", "maximum"),
    (rf"at\s+least\s+{_N}", "minimum"), (rf"minimum\s+(?:of\s+)?{_N}", "minimum"), (rf"no\s+less\s+than\s+{_N}", "minimum"), (rf"at\s+most\s+{_N}", "maximum"), (rf"maximum\s+(?:of\s+)?{_N}", "maximum"), (rf"up\s+to\s+{_N}", "maximum"),
    (rf"{_N}\s+or\s+less", "maximum"), (rf"not\s+(?:to\s+)?exceed\s+{_N}", "maximum"), (rf"(?:approximately|about|around|circa|~)\s*{_N}", "approximately"), (rf"(?:yaklaşık|civarında)\s*{_N}", "approximately"),
)


def stated_range(text: Column) -> Column:
    """struct(low, high, is_range, qualifier): the bounds of the first form of range that is found, the smaller first; else
    what the first form of bound bounds, with its kind (both, if about); NULLs where neither is found."""
    said = lambda p, i: decimal(F.nullif(F.regexp_extract(text, ANY_CASE + p, i), F.lit("")))
    entry = lambda low, high, ranged, kind: F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"), F.lit(ranged).alias("is_range"), F.lit(kind).cast("string").alias("qualifier"))
    none = F.lit(None)
    forms = [let(F.array(said(p, 1), said(p, 2)), lambda x: F.when(x[0].isNotNull(), entry(F.least(x[0], x[1]), F.greatest(x[0], x[1]), True, None))) for p in RANGES]
    bound = lambda kind: lambda x: F.when(x.isNotNull(), entry(none if kind == "maximum" else x, none if kind == "minimum" else x, False, kind))
    forms += [let(said(p, 1), bound(kind)) for p, kind in BOUNDS]
    return F.coalesce(*forms, entry(none, none, False, None))


#: The filter chain: context citations that make a text doubtful, and coherence that rejects or doubts it.
MANY_CITATIONS, INCOHERENT, DOUBTFUL = 3, 0.2, 0.35


def species_weight(text: Column, context: Column) -> Column:
    """How much a species name counts: two-part names 1.5, qualified group names 0.7, names of several words 1, others 0.8."""
    low = lower(strip(text))
    return F.when(strip(text).rlike("^[A-Z][a-z]{2,}\\s+[a-z]{2,}\\z"), 1.5).when(low.isin(*GENERIC_GROUPS), 0.7).when(low.rlike(r"\S\s+\S"), 1.0).otherwise(0.8)


def filter_chain(text: Column, context: Column, category: Column) -> Column:
    """struct(valid, multiplier): whether a text passes the common filters, and what its confidence is multiplied by.

    Citations and incoherent texts are invalid, as are species that are none and policies that are journals; a context of
    many citations and a doubtful coherence lower the multiplier, which stays between 0.1 and 1.5 (0 if invalid). Tagger
    and entity rules are neutral. A NULL text is valid.
    """
    species = category == "species"
    bad = is_citation(text) | (coherence(text) < INCOHERENT) | (species & ~species_valid(text, context)) | ((category == "policy") & is_journal(text))
    weight = F.when(F.coalesce(citation_count(context), F.lit(0)) >= MANY_CITATIONS, 0.5).otherwise(1.0) * F.when(coherence(text) < DOUBTFUL, 0.6).otherwise(1.0) * F.when(species, species_weight(text, context)).otherwise(1.0)
    invalid = F.coalesce(bad, F.lit(False))
    return F.struct((~invalid).alias("valid"), F.when(invalid, 0.0).otherwise(F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.5), weight)), 6)).alias("multiplier"))
