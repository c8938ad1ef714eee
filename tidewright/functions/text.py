"""Scalar text operators as Column expressions: document class, quality, garble, citations, relevance, activities.

Word lists and patterns are fixed values. Java's expressions are written without ``\\w`` so that they mean the same in
other dialects.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.operators.search import folded

TURKISH_LETTERS = "çÇğĞıİöÖşŞüÜ"
TURKISH_SHARE = 0.02
HEAD = 5000
LEGAL = {
    "turkish": ("kanun", "yönetmelik", "tebliğ", "madde", "fıkra", "bent", "resmi gazete", "sayılı", "tarihli", "hüküm", "yasak", "müeyyide", "ceza", "idari para cezası"),
    "english": ("directive", "regulation", "article", "section", "paragraph", "pursuant to", "hereby", "shall", "whereas", "enacted", "statutory", "legislation", "provision"),
}
SCIENTIFIC = {
    "turkish": ("özet", "giriş", "yöntem", "bulgular", "sonuç", "tartışma", "kaynaklar", "çalışma", "araştırma", "analiz", "hipotez"),
    "english": ("abstract", "introduction", "methodology", "results", "discussion", "conclusion", "references", "et al", "study", "research", "findings", "analysis", "hypothesis", "significant", "p-value"),
}
MARINE = ("coast", "shore", "sea", "ocean", "marine", "maritime", "offshore", "bay", "gulf", "island", "beach", "fishing", "fisher", "aquaculture", "trawl", "cage", "port", "harbour", "harbor", "pier", "vessel", "ship", "boat", "breakwater", "navigation", "anchor", "mooring", "discharge", "reef", "depth", "seabed", "lagoon", "lighthouse")
MARINE_TURKISH = ("kıyı", "sahil", "deniz", "körfez", "koy", "ada", "balık", "avcılık", "avcılığı", "yetiştiricilik", "kafes", "trol", "liman", "iskele", "tekne", "gemi", "dalgakıran", "rıhtım", "seyir", "demirleme", "deşarj", "lagün", "derinlik", "fener")
BUILDING = ("building height", "floor height", "storey", "floor area", "plot ratio", "site coverage", "setback", "front yard", "rear yard", "side yard", "parcel", "zoning", "land use", "residential", "commercial", "construction", "foundation", "basement", "parking", "garage", "elevator")
#: Building terms that count as whole words only; the SQL of t24 and t25 does not hold them.
BUILDING_WORDS = ("story", "lot", "attic", "stairwell", "kat yüksekliği", "kat adedi", "bina yüksekliği", "bina derinliği", "bina cephesi", "bina gabarisi", "gabari", "asma kat", "ara kat", "bodrum kat", "zemin kat", "çatı katı", "teras katı", "çekme kat", "taban alanı", "inşaat alanı", "yapı alanı", "brüt alan", "emsal", "TAKS", "KAKS", "imar hakkı", "çekme mesafesi", "yapı yaklaşma", "ön bahçe", "yan bahçe", "arka bahçe", "komşu mesafe", "yol cephesi", "cephe hattı", "bina cephe", "parsel", "parsel sınır", "parsel hudut", "parsel köşe", "ifraz", "tevhid", "kadastro", "pencere", "kapı", "merdiven genişliği", "koridor genişliği", "oda yüksekliği", "tavan yüksekliği", "döşeme", "duvar kalınlığı", "balkon", "teras", "saçak", "parapet", "baca", "asansör", "otopark", "garaj", "sığınak", "kazan dairesi", "konut alanı", "ticaret alanı", "sanayi alanı", "yeşil alan", "imar planı", "imar durumu", "yapılaşma koşul", "temel", "kolon", "kiriş", "çatı", "cephe kaplama")
#: Forms that speak of a building, whatever the language.
BUILDING_PATTERNS = (r"\bkat\s+(?:yüksekliği|adedi|sayısı)\b", r"\bbina\s+(?:yüksekliği|derinliği|gabarisi)\b", r"\b(?:ön|yan|arka)\s+bahçe\b", r"\bçekme\s+mesafe", r"\bparsel\s+(?:sınır|hudut)", r"\b(?:TAKS|KAKS|emsal)\b", r"\byapı\s+(?:yaklaşma|ruhsat)", r"\b[0-9]+\s*(?:inci|nci|üncü|ncı)\s+kat\b", r"\bfloor\s+(?:height|area|ratio)\b", r"\bbuilding\s+(?:height|setback|coverage)\b", r"\b(?:front|rear|side)\s+yard\b", r"\bplot\s+(?:ratio|coverage|area)\b")
OTHER_DOMAIN = ("neural network", "deep learning", "machine learning", "path planning", "motion planning", "robot", "autonomous vehicle", "object detection", "reinforcement learning", "learning rate", "loss function")
LAW_REFERENCES = (r"(?i)(?:madde|mad\.)\s*[0-9]+", r"[0-9]+\s*sayılı\s*(?:Kanun|Yönetmelik|Tebliğ)", r"R\.?G\.?\s*[-:]\s*[0-9]+", r"[0-9]+[./][0-9]+[./][0-9]{4}\s*tarih", r"Article\s+[0-9]+", r"Section\s+[0-9]+", r"Regulation\s+(?:No\.?\s*)?[0-9]+", r"Law\s+No\.?\s*[0-9]+")
BIGRAMS = (
    "th he in er an en on at es ed or te of it is al ar st to nt ng re ha nd ou ea le se as io ne me co de ti ri ve el li ra ce la ro ta ma ic no ur ch ec "
    "da ir ak bi ka ya ba ol il si ni di ki"
).split()
INLINE_CITATIONS = (r"\([A-Z][a-z]+(?: (?:et al\.?|and|&)(?: [A-Z][a-z]+)?)?, [0-9]{4}[a-z]?\)", r"\[[0-9]+(?:[,; -]+[0-9]+)*\]", r"[A-Z][a-z]+ et al\.? \([0-9]{4}\)", r"[A-Z][a-z]+ (?:and|&) [A-Z][a-z]+ \([0-9]{4}\)")
REFERENCE_ENTRIES = (r"(?m)^[A-Z][a-z]+,\s*[A-Z]\.?\s*(?:[A-Z]\.?\s*)?\([0-9]{4}\)\.", r"(?:doi|DOI)[: ]*10\.[0-9]{4,}", r"https?://(?:dx\.)?doi\.org/10\.[0-9]{4,}", r"(?:Vol\.?|Volume) *[0-9]+.*(?:pp?\.? *[0-9]+|No\.? *[0-9]+)", r"(?:ISSN|ISBN)[ :-]*[0-9X-]+")
#: Names of journals. Fixed values.
JOURNALS = (
    "marine policy", "ocean policy", "energy policy", "food policy", "land use policy", "environmental policy", "forest policy", "ocean & coastal management", "ocean and coastal management", "marine pollution bulletin", "marine ecology progress series",
    "journal of environmental management", "ecological indicators", "environmental science & policy", "environmental modelling", "renewable and sustainable energy reviews", "renewable energy", "coastal engineering", "ocean engineering", "estuarine coastal",
    "biological conservation", "conservation biology", "nature", "science", "plos one", "frontiers in marine science",
)
#: Activity: Turkish keywords, English keywords, weight.
KEYWORDS = {
    "aquaculture": (("su ürünleri", "su ürünleri yetiştiriciliği", "yetiştiricilik", "balık çiftliği", "balık yetiştiriciliği", "balık üretimi", "midye", "istiridye", "kabuklu", "karides", "kafes", "balık kafesi", "ağ kafes", "yüzer kafes", "yetiştirme tesisi", "kuluçkahane", "marikultur", "akvakültür", "deniz yetiştiriciliği", "alabalık", "levrek", "çipura", "ton balığı", "orkinos", "yemleme", "stoklama", "hasat", "yavru balık"), ("aquaculture", "fish farm", "fish farming", "mariculture", "cage culture", "net pen", "shellfish", "mussel", "oyster", "shrimp", "hatchery", "finfish", "salmon", "sea bass", "sea bream", "trout", "tuna", "feeding", "stocking"), 4),
    "fishing": (("balıkçılık", "balıkçı", "avcılık", "su ürünleri avcılığı", "ticari balıkçılık", "kıyı balıkçılığı", "açık deniz balıkçılığı", "trol", "gırgır", "paragat", "uzatma ağı", "olta", "dalyan", "avlanma", "av sahası", "av bölgesi", "avlak", "yumurtlama alanı", "üreme alanı", "balık stoku", "kota", "av yasağı", "boy limiti", "göz açıklığı", "balıkçı barınağı", "balıkçı teknesi"), ("fishing", "fishery", "fisheries", "trawling", "trawl", "seine", "purse seine", "gillnet", "longline", "driftnet", "artisanal fishing", "commercial fishing", "recreational fishing", "catch", "quota", "stock", "overfishing", "bycatch", "spawning area", "breeding ground", "fishing ground"), 4),
    "shipping_navigation": (("denizcilik", "gemi", "seyrüsefer", "seyir", "deniz taşımacılığı", "gemi trafiği", "seyir hattı", "trafik ayrım", "TAS", "geçiş", "boğaz geçişi", "kanal", "demirleme", "demirleme alanı", "yanaşma", "kılavuzluk", "pilotaj", "römorkaj", "feribot", "ro-ro", "konteyner gemisi", "tanker", "yük gemisi"), ("shipping", "maritime transport", "navigation", "vessel", "ship", "maritime traffic", "shipping lane", "traffic separation", "TSS", "passage", "strait", "channel", "anchorage", "berthing", "pilotage", "towage", "ferry", "container ship", "tanker", "cargo ship", "bulk carrier"), 3),
    "ports_harbors": (("liman", "iskele", "rıhtım", "terminal", "yanaşma yeri", "ticari liman", "konteyner terminali", "kruvaziyer limanı", "yat limanı", "marina", "barınak", "sığınak", "dalgakıran", "mendirek", "liman tesisi", "liman havzası"), ("port", "harbor", "harbour", "terminal", "berth", "commercial port", "container terminal", "cruise terminal", "marina", "yacht harbor", "fishing harbor", "shelter", "breakwater", "jetty", "pier", "quay", "wharf"), 3),
    "tourism": (("turizm", "turistik", "rekreasyon", "kıyı turizmi", "deniz turizmi", "dalış", "tüplü dalış", "dalgıç", "şnorkel", "plaj", "kumsal", "sahil", "yüzme", "yüzme alanı", "yat", "yelken", "tekne turu", "mavi yolculuk", "su sporları", "sörf", "kano", "jet ski"), ("tourism", "coastal tourism", "marine tourism", "recreation", "diving", "scuba diving", "snorkeling", "beach", "swimming", "yacht", "yachting", "sailing", "boat tour", "cruise", "water sports", "surfing", "kayaking", "jet ski", "ecotourism", "whale watching"), 3),
    "offshore_energy": (("açık deniz rüzgar", "deniz üstü rüzgar", "rüzgar enerjisi", "rüzgar türbini", "rüzgar santrali", "dalga enerjisi", "deniz enerjisi", "yenilenebilir enerji", "enerji platformu"), ("offshore wind", "wind farm", "wind turbine", "wind energy", "wave energy", "tidal energy", "marine energy", "renewable energy", "offshore renewable", "OWEZ"), 4),
    "oil_gas": (("petrol", "doğalgaz", "doğal gaz", "hidrokarbon", "sondaj", "arama sondajı", "üretim platformu", "petrol platformu", "denizaltı boru hattı", "sismik", "TPAO"), ("oil", "gas", "petroleum", "hydrocarbon", "drilling", "exploration", "production platform", "oil platform", "subsea pipeline", "seismic survey", "offshore drilling"), 4),
    "military": (("askeri", "donanma", "savunma", "milli savunma", "TSK", "deniz kuvvetleri", "deniz üssü", "askeri bölge", "yasak bölge", "güvenlik bölgesi", "tatbikat alanı", "sahil güvenlik"), ("military", "naval", "defense", "defence", "navy", "naval base", "military zone", "restricted area", "security zone", "exercise area", "coast guard"), 5),
    "cables_pipelines": (("kablo", "denizaltı kablosu", "elektrik kablosu", "fiber optik", "boru hattı", "gaz boru hattı", "denizaltı altyapısı"), ("cable", "submarine cable", "subsea cable", "fiber optic", "pipeline", "gas pipeline", "subsea infrastructure", "interconnector", "power cable"), 3),
    "dredging_mining": (("tarama", "kum çıkarımı", "çakıl çıkarımı", "agrega", "deniz madenciliği", "dip taraması"), ("dredging", "sand extraction", "gravel extraction", "aggregate", "marine mining", "seabed mining", "deep sea mining"), 3),
    "conservation": (("koruma", "doğa koruma", "habitat koruma", "ekosistem", "biyoçeşitlilik", "nesli tehlike", "endemik", "restorasyon"), ("conservation", "protection", "habitat protection", "ecosystem", "biodiversity", "endangered", "endemic", "restoration", "rehabilitation", "marine conservation"), 3),
    "research": (("araştırma", "bilimsel", "izleme", "ölçüm", "oşinografi"), ("research", "scientific", "monitoring", "survey", "oceanography", "marine science", "study", "sampling"), 2),
}
#: Points that distances are taken from, in order, and their kinds by the first part that a term holds. Fixed values.
REFERENCE_POINTS = {
    "turkish": ("kıyı", "kıyıdan", "kıyı çizgisi", "kıyı kenar çizgisi", "sahil", "sahilden", "deniz", "denizden", "liman", "limandan", "liman sınırı", "iskele", "iskeleden", "tesis", "tesisten", "koruma alanı", "koruma alanından", "ada", "adadan"),
    "english": ("coast", "coastline", "shore", "shoreline", "high water mark", "HWM", "low water mark", "LWM", "baseline", "mean high water", "MHW", "port", "harbor", "harbour", "facility", "protected area", "MPA boundary", "island"),
}
POINT_KINDS = (("coastline", ("kıyı", "coast", "shore")), ("port", ("liman", "port")), ("protected_area", ("koruma", "protected")), ("facility", ("tesis", "facility")))
#: A journal's name between other letters' ends.
JOURNAL = r"(?:^|[^\p{L}\p{N}_])(" + "|".join(JOURNALS) + r")(?:$|[^\p{L}\p{N}_])"


def fold_term(term: str) -> str:
    return term.translate({ord("İ"): "i", ord("I"): "i", ord("ı"): "i"}).lower()


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(terms: tuple[str, ...]) -> Column:
    """The terms as a constant array."""
    return F.split(F.lit("\x01".join(terms)), "\x01")


def presence(text: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms stand in the (folded) text."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(fold_term(t))).cast("int") for t in terms])


def occurrences(text: Column, terms: tuple[str, ...]) -> Column:
    """How often the terms stand in the (folded) text, counted without overlaps, longer terms first."""
    return F.regexp_count(text, F.lit(longest_of({fold_term(t) for t in terms})))


def longest_of(terms: set[str]) -> str:
    """A pattern of the longest of the terms that begins at a place: the alternatives as a tree, so that a place is left
    at the first letter that no term has."""
    if any(re.search(r"[^\w\s/-]", t) for t in terms):
        return "(?:" + "|".join(sorted(terms, key=lambda t: (-len(t), t))) + ")"

    def tree(tails: set[str]) -> str:
        firsts = sorted({t[0] for t in tails if t})
        if not firsts:
            return ""
        each = [c + tree({t[1:] for t in tails if t[:1] == c}) for c in firsts]
        return each[0] if len(each) == 1 and "" not in tails else "(?:" + "|".join(each) + ")" + "?" * ("" in tails)

    return f"(?=[{begins(terms)}]){tree(terms)}"


def begins(terms: set[str]) -> str:
    """The first letters of terms, for a class of characters."""
    return "".join(sorted({"\\" + t[0] if t[0] in "/-" else t[0] for t in terms}))


def document_class(text: Column) -> Column:
    """legal or scientific, Turkish or English, from the first 5000 characters; "unknown" for NULL or empty text."""
    head = F.substring(text, 1, HEAD)
    turkish = F.regexp_count(head, F.lit(f"[{TURKISH_LETTERS}]")) > F.length(head) * TURKISH_SHARE
    kind = lambda low, lang: F.when(presence(low, LEGAL[lang]) >= presence(low, SCIENTIFIC[lang]), F.lit(f"legal_{lang}")).otherwise(F.lit(f"scientific_{lang}"))
    return F.when(text.isNull() | (text == ""), "unknown").otherwise(let(folded(head), lambda low: F.when(turkish, kind(low, "turkish")).otherwise(kind(low, "english"))))


def without_references(text: Column) -> Column:
    """Text without amendment marks, gazette references, dates, law numbers and year ranges; single spaces."""
    for pattern in (r"\((?:Değişik|Ek|İptal|Amended)[^)]*\)", r"(?i)R\.?G\.?[- ][0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?:[- ][0-9]{1,5})?", r"[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}", r"[0-9]{1,5} +sayılı", r"(?:19|20)[0-9]{2}[-–—](?:19|20)[0-9]{2}"):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def scan_quality(text: Column) -> Column:
    """1 less the suspicious marks per 100 characters, between 0 and 1; 0 for NULL or empty text."""
    bad = F.regexp_count(text, F.lit("[¸˘¨˙]")) + F.regexp_count(text, F.lit("[a-z][A-Z][a-z]")) + F.regexp_count(text, F.lit("[0-9][a-zA-Z][0-9]")) + 2 * F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]{25,}"))
    score = F.lit(1.0) - bad / F.greatest(F.length(text) / 100, F.lit(1.0))
    return F.when(text.isNull() | (text == ""), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def is_garbled(text: Column) -> Column:
    """Text of merged columns or boilerplate: long without punctuation, short line fragments, publisher addresses, credit statements."""
    line = F.exists(F.split(F.trim(text), "\n"), lambda x: (F.trim(x) != "") & (F.length(F.trim(x)) < 30) & ~F.trim(x).rlike("[,:-]\\z") & ~F.trim(x).rlike("^[A-Z][a-z]+ [A-Z][a-z]+\\z"))
    rules = (
        (F.length(text) > 200) & ~F.substring(text, 1, 200).rlike("[.!?;:]")
        | F.contains(F.trim(text), F.lit("\n")) & line
        | F.lower(text).rlike(r"elsevier|springer|wiley|doi\.org|https?://|www\.")
        | text.rlike("Writing *[-–] *(?:review|original|draft)|Methodology|Funding acquisition|Visualization|Validation")
    )
    return F.when(text.isNull() | (F.length(text) < 10), False).otherwise(rules)


def coherence(text: Column) -> Column:
    """Half common letter pairs, a quarter each vowel share near 0.4 and word length near 5.5; 0.5 for very short text."""
    within = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    def score(clean: Column) -> Column:
        n = F.length(clean)
        pairs = F.regexp_count(clean, F.lit("(?=" + "|".join(BIGRAMS) + ").")) / (n - 1)
        vowels = within(1 - F.abs(F.regexp_count(clean, F.lit("[aeiouöü]")) / n - 0.4) * 3)
        size = F.length(F.regexp_replace(text, r"[ \t\r\n]+", "")) / F.regexp_count(text, F.lit(r"[^ \t\r\n]+"))
        total = pairs * 0.5 + vowels * 0.25 + within(1 - F.abs(size - 5.5) / 5) * 0.25
        return F.when(text.isNull() | (F.length(text) < 10) | (n < 6), 0.5).otherwise(F.round(total, 6))

    return F.coalesce(let(F.regexp_replace(folded(text), "[^a-zğüşöç]", ""), score), F.lit(0.5))


def citation_count(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in INLINE_CITATIONS])


def is_citation(text: Column) -> Column:
    """Two inline citations of one form, an entry of a reference list, or a text that is mostly a journal's name."""
    inline = reduce(lambda a, b: a | b, [F.regexp_count(text, F.lit(p)) >= 2 for p in INLINE_CITATIONS])
    entry = reduce(lambda a, b: a | b, [text.rlike(p) for p in REFERENCE_ENTRIES])
    low = F.lower(F.trim(text))
    journal = F.length(F.regexp_extract(low, JOURNAL, 1)) > F.length(low) * 0.5
    return F.coalesce(inline | entry | journal, F.lit(False))


def building_terms(low: Column) -> Column:
    """How often building terms stand in the (folded) text."""
    terms = dict.fromkeys(fold_term(t) for t in BUILDING_WORDS)
    return occurrences(low, BUILDING) + F.regexp_count(low, F.lit(rf"(?U)(?=[{begins(set(terms))}])\b(?:{'|'.join(terms)})\b"))


def marine_relevance(text: Column) -> Column:
    """Share of marine among marine and building terms; 0.5 where there are neither."""
    counts = lambda low: F.struct(occurrences(low, MARINE + MARINE_TURKISH).alias("m"), building_terms(low).alias("b"))
    share = lambda c: F.when(c["m"] + c["b"] == 0, 0.5).otherwise(F.round(c["m"] / (c["m"] + c["b"]), 6))
    return F.when(text.isNull(), 0.5).otherwise(let(let(folded(text), counts), share))


def false_positive(text: Column, match: Column) -> Column:
    """The reason why a match is no marine statement, or NULL: rules in order."""
    forms = reduce(lambda a, b: a + b, [text.rlike(f"(?iuU){p}").cast("int") for p in BUILDING_PATTERNS])
    counts = lambda low: F.struct(occurrences(low, MARINE + MARINE_TURKISH).alias("m"), building_terms(low).alias("b"), occurrences(low, OTHER_DOMAIN).alias("o"), forms.alias("p"))
    at = F.instr(text, match)
    near = F.substr(text, F.greatest(F.lit(1), at - 50), F.length(match) + 100)
    law = reduce(lambda a, b: a | b, [near.rlike(p) for p in LAW_REFERENCES])

    def reason(c: Column) -> Column:
        return (
            F.when(text.isNull() | (text == ""), "empty")
            .when((c["o"] >= 2) & (c["m"] == 0), "other_domain")
            .when((c["b"] >= 3) & (c["m"] == 0), "building")
            .when(c["p"] >= 2, "building_patterns")
            .when((at > 0) & law, "law_reference")
            .when((2 * c["b"] + 3 * c["p"] - 4 * c["m"] > 5) & (c["m"] == 0), "score")
        )

    return let(let(folded(text), counts), reason)


def is_turkish(text: Column) -> Column:
    """Whether a single statement counts as Turkish: more than two letters that English does not have."""
    return F.regexp_count(text, F.lit("[çğışöüÇĞİŞÖÜ]")) > 2


def activity(text: Column) -> Column:
    """struct(name, confidence): the activity with the highest weighted number of keywords of the text's language; the first wins ties."""

    def best(low: Column, language: int) -> Column:
        present = lambda words: F.size(F.filter(words_of(tuple(fold_term(w) for w in dict.fromkeys(words))), lambda w: F.contains(low, w)))
        return F.array_max(F.array(*[F.struct((present(a[language]) * a[2]).alias("score"), F.lit(-i).alias("i")) for i, a in enumerate(KEYWORDS.values())]))

    def named(best: Column) -> Column:
        name = F.element_at(F.array(*[F.lit(a) for a in KEYWORDS]), 1 - best["i"])
        most = 5 * max(a[2] for a in KEYWORDS.values())
        known = best["score"] >= 2
        return F.struct(F.when(known, name).otherwise("unspecified").alias("name"), F.when(known, F.greatest(F.lit(0.4), F.least(F.lit(1.0), best["score"] / most))).otherwise(0.25).alias("confidence"))

    scored = let(folded(text), lambda low: F.when(is_turkish(text), best(low, 0)).otherwise(best(low, 1)))
    return let(scored, named)


def point_kind(term: str) -> str:
    """The kind of a point that distances are taken from."""
    return next((kind for kind, parts in POINT_KINDS if any(p in term.lower() for p in parts)), "reference_point")


def reference_point(text: Column) -> Column:
    """struct(term, kind): the word of the first listed term of the text's language that a word starts with, or NULLs."""

    def of(low: Column, language: str) -> Column:
        none = F.struct(F.lit(None).cast("string").alias("term"), F.lit(None).cast("string").alias("kind"))
        word = lambda t: F.regexp_extract(text, rf"(?iuU)\b({t}\w*)\b", 1)
        # Only terms that the text holds at all are looked for as the beginning of a word.
        one = lambda rest, t: F.when(F.contains(low, F.lit(fold_term(t))) & (word(t) != ""), F.struct(word(t).alias("term"), F.lit(point_kind(t)).alias("kind"))).otherwise(rest)
        return reduce(one, reversed(REFERENCE_POINTS[language]), none)

    # As the pattern compares letters without case: long s and the Kelvin sign too.
    return let(F.lower(F.translate(text, "İIıſ\u212a", "iiisk")), lambda low: F.when(is_turkish(text), of(low, "turkish")).otherwise(of(low, "english")))


#: Broken letters and words of scans, and what they stand for, in order. Fixed values.
MENDED = (("s¸", "ş"), ("S¸", "Ş"), ("c¸", "ç"), ("C¸", "Ç"), ("g˘", "ğ"), ("G˘", "Ğ"), ("o¨", "ö"), ("O¨", "Ö"), ("u¨", "ü"), ("U¨", "Ü"), ("i˙", "i"), ("I˙", "İ"), (r"me[ \t\r\n]*tre", "metre"), (r"ki[ \t\r\n]*lo[ \t\r\n]*met[ \t\r\n]*re", "kilometre"), (r"hek[ \t\r\n]*tar", "hektar"), (r"met[ \t\r\n]*ers?", "meters"), (r"kilo[ \t\r\n]*met", "kilomet"))
LEAST_MARINE = 5


def mended(text: Column) -> Column:
    """Text with broken letters and a few broken words joined, single blanks, and two line ends at most."""
    for pattern, right in MENDED:
        text = F.regexp_replace(text, pattern, right)
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def document_is_marine(text: Column, least: int = LEAST_MARINE) -> Column:
    """Whether marine terms of either language stand in a document often enough; false for NULL."""
    return F.coalesce(let(folded(text), lambda low: occurrences(low, MARINE + MARINE_TURKISH) >= least), F.lit(False))


def has_reference(text: Column) -> Column:
    """Whether a text holds a date, a law number or another legal reference; false for NULL."""
    return F.coalesce(text.rlike(r"[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}") | text.rlike(r"[0-9]{1,5} +sayılı") | reduce(lambda a, b: a | b, [text.rlike(p) for p in LAW_REFERENCES]), F.lit(False))
