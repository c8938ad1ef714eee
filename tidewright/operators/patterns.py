"""The Turkish and English pattern lists of extractors, as surveyed, and their scan.

A document is scanned with the lists of its own language only, each pattern on its own, so that matches of two patterns
may overlap. Patterns are in Python's dialect, whose case folding and word classes they are written for. All patterns
are fixed values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from re import _constants as sre
from re import _parser as parser

THING = r"[^,.;\[\]()\n\r<>]{3,40}"
AND = rf"(?P<activity1>[^,;.]+?)\s+and\s+(?P<activity2>{THING})"
SHORT = r"[\w\s]{3,40}?"

#: As many spellings of a piece of a pattern are followed.
SPELLINGS = 24
Clauses = tuple[frozenset[str], ...]


def folded(text: str) -> str:
    """Lower case, letter by letter, in which letters are equal that a pattern without case takes for equal."""
    return text.replace("İ", "i").lower().replace("ı", "i").replace("ſ", "s").replace("μ", "µ")


def _spelled(tree: list) -> tuple[set[str] | None, list[frozenset[str]]]:
    """All spellings of a parsed pattern if they are few (else None), and sets of which each match holds a member (folded)."""
    spellings, clauses, whole = {""}, [], True

    def flush() -> None:
        nonlocal spellings, whole
        whole = False
        if min(map(len, spellings)) > 1:
            clauses.append(frozenset(spellings))
        spellings = {""}

    def follow(more: set[str] | None) -> None:
        nonlocal spellings
        if more is None or len(more) * len(spellings) > SPELLINGS:
            flush()
        if more is not None and len(more) <= SPELLINGS:
            spellings = {a + b for a in spellings for b in more}

    for op, arg in tree:
        if op is sre.LITERAL:
            follow({folded(chr(arg))})
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            follow({folded(chr(a)) for _, a in arg})
        elif op is sre.SUBPATTERN:
            exact, inner = _spelled(arg[3])
            follow(exact)
            clauses += inner
        elif op is sre.BRANCH:
            each = [_spelled(a) for a in arg[1]]
            if all(exact is not None for exact, _ in each):
                follow(set().union(*[exact for exact, _ in each]))
            else:
                flush()
                best = [max(([frozenset(exact)] if exact and min(map(len, exact)) > 1 else []) + inner, key=lambda c: min(map(len, c)), default=None) for exact, inner in each]
                if all(best):
                    clauses.append(frozenset().union(*best))
        else:
            flush()
            if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                exact, inner = _spelled(arg[2])
                clauses += inner + ([frozenset(exact)] if exact and min(map(len, exact)) > 1 else [])
    if whole and not clauses:
        return spellings, []
    flush()
    return None, clauses


def required(pattern: str) -> Clauses:
    """Sets of strings: a folded text in which a pattern matches holds a member of each. The longest come first."""
    exact, clauses = _spelled(list(parser.parse(pattern)))
    if exact is not None and min(map(len, exact)) > 1:
        clauses = [frozenset(exact)]
    return tuple(sorted(set(clauses), key=lambda c: (-min(map(len, c)), len(c), sorted(c))))


class Held:
    """A text, and which strings it holds when folded; each is looked for once."""

    def __init__(self, text: str):
        self.text, self.low, self.known = text, folded(text), {}

    def may_match(self, clauses: Clauses) -> bool:
        """Whether the text has what a pattern requires (:func:`required`)."""
        for c in clauses:
            has = self.known.get(c)
            if has is None:
                has = self.known[c] = any(x in self.low for x in c)
            if not has:
                return False
        return True


@dataclass(frozen=True)
class Patterns:
    """``turkish`` and ``english`` hold patterns. ``head`` (characters) or ``tail`` (share) is the part of a
    document that is searched, where that is the extractor's rule. ``cased`` are the places of patterns that mind case. ``anchors`` are patterns without which the pattern of
    the same place cannot match, and ``runs`` what no match reaches beyond: only runs with the anchor are searched."""

    turkish: tuple[str, ...]
    english: tuple[str, ...]
    head: int | None = None
    tail: float | None = None
    cased: dict[str, tuple[int, ...]] = field(default_factory=dict)
    #: Number words are read as digits before the scan.
    numbers: bool = False
    anchors: dict[str, tuple[str, ...]] = field(default_factory=dict)
    runs: dict[str, str] = field(default_factory=dict)

    @cached_property
    def compiled(self) -> dict[str, tuple[list[re.Pattern], list[re.Pattern], re.Pattern | None]]:
        return {
            lang: (
                [re.compile(p, 0 if i in self.cased.get(lang, ()) else re.I) for i, p in enumerate(getattr(self, lang))],
                [re.compile(a, re.I) if a else None for a in self.anchors.get(lang, ())],
                re.compile(self.runs[lang]) if lang in self.runs else None,
            )
            for lang in ("turkish", "english")
        }

    @cached_property
    def needed(self) -> dict[str, list[Clauses]]:
        return {lang: [required(p) for p in getattr(self, lang)] for lang in ("turkish", "english")}

    def matches(self, held: Held, language: str) -> Iterator[tuple[int, re.Match]]:
        """(place of the pattern, match), in order of the patterns, then of the text. Patterns whose required strings the text lacks are not tried."""
        text = held.text
        start = int(len(text) * (1 - self.tail)) if self.tail else 0
        end = min(len(text), self.head) if self.head else len(text)
        patterns, anchors, run = self.compiled[language]
        needed = self.needed[language]
        for i, p in enumerate(patterns):
            if not held.may_match(needed[i]):
                continue
            anchor = anchors[i] if anchors else None
            if anchor is None:
                yield from ((i, m) for m in p.finditer(text, start, end))
            elif anchor.search(text, start, end):
                for r in run.finditer(text, start, end):
                    if anchor.search(text, *r.span()):
                        yield from ((i, m) for m in p.finditer(text, *r.span()))


MONTHS = "Ocak|Şubat|Mart|Nisan|May[ıi]s|Haziran|Temmuz|Ağustos|Eylül|Ekim|Kas[ıi]m|Aral[ıi]k"
ENGLISH_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
NUM = r"\d+(?:[.,]\d+)?"
DECIMAL_DEGREES = r"(?P<lat>\d{1,2}[.,]\d+)\s*[°º]?\s*(?P<lat_dir>[NS])\s*[,;]?\s*(?P<lon>\d{1,3}[.,]\d+)\s*[°º]?\s*(?P<lon_dir>[EW])"
DEGREES = (
    r"(?P<lat_deg>\d{1,2})[°º]\s*(?P<lat_min>\d{1,2})['’′]\s*(?P<lat_sec>\d{1,2}(?:[.,]\d+)?)?[\"”″]?\s*(?P<lat_dir>[NS])\s*[,;]?\s*"
    r"(?P<lon_deg>\d{1,3})[°º]\s*(?P<lon_min>\d{1,2})['’′]\s*(?P<lon_sec>\d{1,2}(?:[.,]\d+)?)?[\"”″]?\s*(?P<lon_dir>[EW])"
)
SIMPLE_DEGREES = r"(?P<lat>-?\d{1,2}[.,]\d+)\s*[,;]\s*(?P<lon>-?\d{1,3}[.,]\d+)"
WORDS_ONLY = r"[\w\s]+"

LISTS = {
    "conflict": Patterns(
        (
            r"(?P<activity1>[\w\s]+?)\s+(?:ile|ve)\s+(?P<activity2>[\w\s]+?)\s+(?:aras[ıi]nda\s+)?(?P<type>çat[ıi][şs]ma|uyumsuzluk|çeli[şs]ki|ç[aâ]k[ıi][şs]ma)",
            r"(?P<activity1>[\w\s]+?)\s+(?:ile|ve)\s+(?P<activity2>[\w\s]+?)\s+(?:aras[ıi]nda\s+)?(?P<type>rekabet|gerilim|anla[şs]mazl[ıi]k)",
            rf"(?P<activity1>{SHORT})\s+(?P<activity2>{SHORT})\s*(?:için|açısından)?\s*(?P<type>tehdit)\s+(?:ediyor|etmektedir|eder|etmekte)",
            rf"(?P<activity1>{SHORT})\s+(?P<activity2>{SHORT})\s+üzerinde\s+(?P<type>olumsuz\s+etki)",
        ),
        (
            rf"(?P<type>conflicts?|incompatibility)\s+between\s+{AND}",
            rf"(?P<activity1>[^,;.]+?)\s+(?:conflicts?|incompatible)\s+with\s+(?P<activity2>{THING})",
            rf"(?P<type>competition|rivalry)\s+between\s+{AND}",
            rf"(?P<type>tensions?|disputes?)\s+(?:between|among)\s+{AND}",
            rf"(?P<type>trade-?offs?|tradeoffs?)\s+between\s+{AND}",
            rf"(?P<type>displacement)\s+of\s+(?P<activity1>[^,;.]+?)\s+by\s+(?P<activity2>{THING})",
            rf"(?P<activity1>[^,;.]+?)\s+(?:was|were|been)\s+(?P<type>displaced)\s+by\s+(?P<activity2>{THING})",
            rf"(?P<type>overlap(?:ping)?)\s+(?:between|of)\s+{AND}",
            rf"(?P<type>competing)\s+(?:uses?|activities|interests|demands?)(?:\s+(?:such\s+as|including|like))?\s+{AND}",
            rf"(?P<activity1>{THING}?)\s+and\s+(?P<activity2>{THING}?)\s+(?:are|were|is)\s+(?P<type>incompatible|mutually\s+exclusive)",
            rf"(?P<activity1>{THING}?)\s+(?P<type>threatens?|poses?\s+(?:a\s+)?threat\s+to)\s+(?P<activity2>{THING})",
            rf"(?P<activity1>[^,;.]+?)\s+(?P<type>clash(?:es)?)\s+with\s+(?P<activity2>{THING})",
            rf"(?:negative\s+)?(?P<type>interact(?:ion|ions)|interference)\s+between\s+{AND}",
        ),
        anchors={
            "turkish": ("çat[ıi][şs]ma|uyumsuzluk|çeli[şs]ki|ç[aâ]k[ıi][şs]ma", "rekabet|gerilim|anla[şs]mazl[ıi]k", "tehdit", "olumsuz"),
            "english": ("conflict|incompatib", "conflict|incompatib", "competition|rivalry", "tension|dispute", "trade", "displacement", "displaced", "overlap", "competing", "incompatible|mutually", "threat", "clash", "interact|interference"),
        },
        runs={"turkish": r"[\w\s]+", "english": r"[^,;.]+"},
    ),
    "data_source": Patterns(
        (r"(?P<source_type>uydu|satellit|anket|veritaban[ıi]|veri\s+seti)\s*(?P<source_name>[\w\s]+?)?",),
        (
            r"(?P<source_name>Landsat|Sentinel|MODIS|Copernicus|\bAIS\b|\bVMS\b|\bGEBCO\b|\bERA5\b|\bECMWF\b|WorldClim|Bio-ORACLE|\bOBIS\b|\bGBIF\b|\bEMODnet\b|\bICES\b|SeaWiFS|OpenStreetMap|MarineTraffic|Global\s+Fishing\s+Watch)\s*(?P<source_type>data|imagery|dataset|database|products?)?",
            r"(?P<source_type>satellite|remote\s+sensing)\s+(?:imagery|data)\s+(?:from|of)\s+(?P<source_name>[A-Z][\w\s-]{2,40})",
            r"(?P<source_type>survey)\s+(?:with|of)\s+(?P<source_name>\d[\w\s,]+)",
            r"(?P<source_type>database|dataset)\s+(?:of|from|containing)\s+(?P<source_name>[A-Z][\w\s-]{3,60})",
        ),
    ),
    "method": Patterns(
        (r"\b(?P<method>anket\s+çalışması|röportaj|mülakat|modelleme\s+(?:yöntemi|çalışması)|CBS\s*analiz[i]?|GIS\s*analiz[i]?|saha\s+çal[ıi][şs]mas[ıi]|arazi\s+çal[ıi][şs]mas[ıi]|paydaş\s+(?:toplantısı|görüşmesi|katılımı))\b",),
        (
            r"(?:(?:using|through|via|conducted|performed|employed|applied|based\s+on|carried\s+out|method(?:ology)?|approach|technique|framework)\s+(?:a\s+)?)"
            r"(?P<method>survey|interviews?|questionnaires?|(?:spatial|GIS|statistical|numerical|ecosystem)\s+(?:analysis|modeling|modelling)|field\s+(?:study|survey|work)|case\s+study|stakeholder\s+(?:consultation|engagement|workshop)|"
            r"remote\s+sensing|habitat\s+mapping|cost[\s-]benefit\s+analysis|multi[\s-]criteria\s+(?:analysis|decision)|Delphi\s+(?:method|survey|process)|scenario\s+(?:analysis|planning|building)|cumulative\s+(?:impact|effect)\s+assessment)",
            r"\b(?P<method>Marxan|MaxEnt|InVEST|Zonation|MIMES|SeaSketch|EBSA\s+assessment|EBM|ecosystem[\s-]based\s+management|marine\s+cadastre|suitability\s+analysis|overlap\s+analysis|participatory\s+(?:mapping|GIS|approach))\b",
        ),
    ),
    "finding": Patterns(
        (r"(?P<finding>bulgu|sonuç|saptama|tespit|gözlem)\s*(?:[:\-]\s*)?(?P<description>[^.;]{20,200})",),
        (
            r"(?:results?\s+(?:show|indicate|demonstrate|suggest)|findings?\s+(?:show|indicate|reveal))\s+(?:that\s+)?(?P<description>[^.;]{20,200})",
            r"(?:we|this\s+study)\s+(?:found|observed|identified)\s+(?:that\s+)?(?P<description>[^.;]{20,200})",
        ),
    ),
    "objective": Patterns(
        (r"(?:bu\s+)?(?:çalışma|araştırma)(?:nın)?\s+(?:amacı|hedefi)\s+(?P<obj>[^.]+)", r"(?:amaç|hedef)\s+(?:olarak)?\s+(?P<obj>[^.]+)"),
        (
            r"(?:aim|objective|goal)s?\s+(?:of\s+)?(?:this\s+)?(?:study|research|paper)\s+(?:is|are|was|were)\s+to\s+(?P<obj>[^.]+)",
            r"(?:we|this\s+(?:study|paper|research))\s+(?:aim|seek|intend)s?\s+to\s+(?P<obj>[^.]+)",
            r"(?:purpose|goal)\s+(?:of\s+)?(?:this\s+)?(?:study|research)\s+(?:is|was)\s+(?:to\s+)?(?P<obj>[^.]+)",
            r"(?:research\s+question|RQ)\s*(?:\d+)?[:\s]+(?P<obj>[^.?]+)",
            r"(?:we\s+)?hypothesi[sz]e\s+that\s+(?P<obj>[^.]+)",
            r"(?:H\d+)\s*[:\s]+(?P<obj>[^.]+)",
        ),
        head=5000,
    ),
    "result": Patterns(
        (r"(?:sonuçlar|bulgular)\s+(?P<result>[^.]+)", r"(?:analiz\s+sonuçları)\s+(?P<result>[^.]+)"),
        (
            r"(?:results?\s+(?:show|indicate|demonstrate|reveal|suggest))\s+(?:that\s+)?(?P<result>[^.]+)",
            r"(?:we\s+found|analysis\s+(?:show|reveal)ed)\s+(?:that\s+)?(?P<result>[^.]+)",
            r"(?:significant(?:ly)?)\s+(?:increase|decrease|difference|correlation|relationship)\s+(?P<result>[^.]+)",
        ),
    ),
    "conclusion": Patterns(
        (r"(?:sonuç\s+olarak)\s+(?P<conc>[^.]+)", r"(?:önerilen|tavsiye\s+edilen)\s+(?P<conc>[^.]+)"),
        (
            r"(?:we\s+conclude|in\s+conclusion|our\s+findings\s+(?:indicate|suggest|show))\s+(?:that\s+)?(?P<conc>[^.]+)",
            r"(?:this\s+study\s+(?:concludes|demonstrates|shows))\s+(?:that\s+)?(?P<conc>[^.]+)",
            r"(?:(?:we|the\s+authors?)\s+)?recommend\s+(?:that\s+)?(?P<conc>[^.]+)",
            r"(?:policy\s*(?:makers?|implication))\s+(?:should\s+)?(?P<conc>[^.]+)",
            r"(?:management\s+(?:implication|recommendation))\s+(?P<conc>[^.]+)",
        ),
        tail=0.3,
    ),
    "gap": Patterns(
        (r"(?:eksikli[kğ]i?|yetersiz(?:li[kğ])?)\s+(?P<gap>[^.]+)", r"(?:gelecek\s+(?:çalışmalar|araştırmalar))\s+(?P<gap>[^.]+)"),
        (
            r"(?:lack\s+of|limited)\s+(?P<gap>[^.]+)",
            r"(?:no\s+(?:data|information|studies?))\s+(?:on|about|regarding)\s+(?P<gap>[^.]+)",
            r"(?:poorly|little)\s+(?:understood|known|studied)\s+(?P<gap>[^.]+)",
            r"(?:future\s+(?:research|studies?|work)\s+(?:should|need|is\s+needed))\s+(?:to\s+)?(?P<gap>[^.]+)",
            r"(?:gap\s+in|missing|absent|unavailable)\s+(?P<gap>[^.]+)",
            r"(?:more\s+(?:research|data|information)\s+(?:is|are)\s+needed)\s+(?:on|for|to)?\s*(?P<gap>[^.]+)",
        ),
        tail=0.4,
    ),
    "institution": Patterns(
        (r"(?P<name>[A-ZÇĞIÖŞÜ][\wçğıöşü\s]+?)\s*(?P<type>Bakanlı[ğg][ıi]|Müdürlü[ğg]ü|Başkanlı[ğg][ıi]|Kurumu|Enstitüsü|Komitesi)",),
        (r"(?P<name>[A-Z][\w\s]+?)\s+(?P<type>Ministry|Department|Agency|Authority|Institute|Committee|Commission)",),
        cased={"turkish": (0,), "english": (0,)},
        anchors={"turkish": ("Bakanlı|Müdürlü|Başkanlı|Kurumu|Enstitüsü|Komitesi",), "english": ("Ministry|Department|Agency|Authority|Institute|Committee|Commission",)},
        runs={"turkish": r"[\w\s]+", "english": r"[\w\s]+"},
    ),
    "distance": Patterns(
        (
            rf"(?P<qualifier>en\s+az|en\s+fazla|en\s+çok|asgari|azami|minimum|maksimum)?\s*(?P<value>{NUM})\s*(?P<unit>metre|metrelik|mt|m\.?|km|kilometre|deniz\s*mili|mil)\b",
            rf"(?P<value>{NUM})\s*(?P<unit>metre|m\.?|km)\s*['’]?\s*(?P<qualifier>[dD][eaEA]n\s+(?:fazla|az|çok)|altında|üstünde|üzerinde|ve\s+üzeri)",
            rf"(?P<min>{NUM})\s*[-–—]\s*(?P<max>{NUM})\s*(?P<unit>metre|m\.?|km)",
            rf"(?P<min>{NUM})\s*(?:ilâ|ila|ile)\s*(?P<max>{NUM})\s*(?P<unit>metre|m\.?|km)",
            rf"(?P<reference>kıyı|sahil|deniz|liman|iskele|tesis|koruma\s*alanı)(?:dan|den|[ıiuü]ndan|sınırından|çizgisinden)?\s*(?:itibaren\s+)?(?P<value>{NUM})\s*(?P<unit>metre|m\.?|km)",
            rf"(?P<value>{NUM})\s*(?P<unit>metre|m\.?)\s*(?P<depth>derinlik|derinliğe|derinliğinde|derinlikte)",
        ),
        (
            rf"(?P<qualifier>at\s+least|minimum|maximum|up\s+to|approximately|about|around)?\s*(?P<value>{NUM})\s*(?P<unit>meters?|metres?|m|km|kilometers?|kilometres?|nautical\s*miles?|nm|nmi|miles?)\b",
            rf"(?P<min>{NUM})\s*[-–to]+\s*(?P<max>{NUM})\s*(?P<unit>m|km|meters?|metres?|nm)",
            rf"(?P<kind>buffer|setback|distance)\s+(?:zone\s+)?(?:of\s+)?(?P<value>{NUM})\s*(?P<unit>m|km|meters?|metres?)",
            rf"(?:distance\s+)?(?:of\s+)?(?P<value>{NUM})\s*(?P<unit>m|km|meters?|metres?|nm)\s+(?:from\s+(?:the\s+)?)?(?P<reference>coast|shore|coastline|baseline|port|facility)",
            rf"between\s+(?P<min>{NUM})\s*(?:and|to)\s*(?P<max>{NUM})\s*(?P<unit>m|km|meters?|metres?)",
            rf"(?P<depth>depth)\s+(?:of\s+)?(?P<value>{NUM})\s*(?P<unit>m|meters?|metres?)",
        ),
        numbers=True,
    ),
    "penalty": Patterns(
        (
            rf"(?P<amount>{NUM})\s*(?P<currency>TL|Türk\s*[Ll]irası|lira|₺)\s*(?P<type>(?:para\s*)?ceza|idari\s*para\s*cezas[ıi]|para\s*cezas[ıi]|[aâ]ğ[ıi]r\s*para\s*cezas[ıi])",
            rf"(?P<min>{NUM})\s*(?:ila|ilâ|ile|-|–)\s*(?P<max>{NUM})\s*(?P<currency>TL|Türk\s*[Ll]irası|lira|₺)\s*(?:para\s*)?ceza",
            rf"(?P<duration>{NUM})\s*(?P<unit>y[ıi]l|ay|gün)\s*(?:(?:kadar|ile|ve|veya)\s+)?(?P<type>hapis|hapsi?s\s*cezas[ıi]|özgürlü[ğg]ünden\s*mahrum)",
            r"(?P<min>\d+)\s*(?:ila|ilâ|ile|-|–)\s*(?P<max>\d+)\s*(?P<unit>y[ıi]l|ay|gün)\s*(?:hapis|hapsi?s\s*cezas[ıi])",
            r"(?P<type>(?:r[uü]hsat|lisans|izin|belge)\s*(?:iptal[ıi]?|geri\s*al[ıi]n(?:mas[ıi]|[ıi]r)|kald[ıi]r[ıi]l(?:mas[ıi]|[ıi]r)))",
            r"(?P<duration>\d+)\s*(?P<unit>y[ıi]l|ay|gün)\s*(?:süre(?:yle|li)?|için)?\s*(?P<type>faaliyetten?\s*men|yasaklan(?:ma|[ıi]r)|durdur(?:ma|ul(?:ma|ur)))",
            r"(?P<type>ceza(?:land[ıi]r[ıi]l[ıi]r|ya\s*tabi\s*tutulur)|yaptırım|idari\s*yaptırım)",
        ),
        (
            rf"(?P<amount>{NUM})\s*(?P<currency>USD|EUR|GBP|dollars?|\$|€|£)\s*(?P<type>fine|penalty|civil\s+penalty|administrative\s+fine)",
            rf"(?P<type>fine|penalty)\s+of\s+(?P<currency>USD|EUR|GBP|\$|€|£)?\s*(?P<amount>{NUM})",
            rf"(?:fine|penalty)\s+(?:of\s+)?(?:from\s+|between\s+)?(?P<currency>\$|€|£|USD|EUR|GBP)?\s*(?P<min>{NUM})\s*(?:to|and|-|–)\s*(?P<currency2>\$|€|£|USD|EUR|GBP)?\s*(?P<max>{NUM})",
            rf"(?P<duration>{NUM})\s*(?P<unit>years?|months?|days?)\s*(?:of\s+)?(?P<type>imprisonment|prison|jail|incarceration)",
            r"(?:between\s+|from\s+)?(?P<min>\d+)\s*(?:to|and|-|–)\s*(?P<max>\d+)\s*(?P<unit>years?|months?|days?)\s*(?:of\s+)?(?:imprisonment|prison)",
            r"(?P<type>(?:license|permit|authorization)\s+(?:revocation|suspension|cancellation|withdrawal))",
            r"(?:revocation|suspension|cancellation|withdrawal)\s+of\s+(?P<license_type>(?:fishing\s+)?(?:license|permit|authorization))",
            r"(?P<type>ban(?:ned)?|prohibited|suspended)\s+(?:from|for)\s+(?P<duration>\d+)\s*(?P<unit>years?|months?|days?)",
        ),
        numbers=True,
    ),
    "temporal": Patterns(
        (
            rf"(?P<start>\d{{1,2}})\s*(?P<start_month>{MONTHS})\s*[-–]\s*(?P<end>\d{{1,2}})\s*(?P<end_month>{MONTHS})",
            rf"(?P<start_month>{MONTHS})\s*(?:ayları\s+)?[-–]\s*(?P<end_month>{MONTHS})",
            r"(?P<season>ilkbahar|yaz|sonbahar|k[ıi][şs])\s*(?:aylar[ıi]nda|döneminde|mevsiminde)",
            r"(?P<duration>\d+)\s*(?P<unit>gün|ay|y[ıi]l|hafta)\s*(?:süre(?:yle|li|yle|si|sine)?|boyunca)",
            r"(?:saat\s+)?(?P<start_hour>\d{1,2})[:.](?P<start_min>\d{2})\s*[-–]\s*(?P<end_hour>\d{1,2})[:.](?P<end_min>\d{2})\s*(?:aras[ıi]|saatleri)",
            r"(?P<period>üreme|göç|kuluçka|besleme|yetiştirme)\s*(?:dönemi|sezonu|mevsimi)",
            r"(?P<start_year>\d{4})\s*[-–]\s*(?P<end_year>\d{4})\s*(?:y[ıi]llar[ıi]|aras[ıi]|dönemi)",
        ),
        (
            rf"(?P<start_month>{ENGLISH_MONTHS})\s+(?P<start>\d{{1,2}})\s*[-–to]+\s*(?P<end_month>{ENGLISH_MONTHS})\s+(?P<end>\d{{1,2}})",
            rf"(?P<start_month>{ENGLISH_MONTHS})\s*(?:to|through|-|–)\s*(?P<end_month>{ENGLISH_MONTHS})",
            r"(?:during|in)\s+(?P<season>spring|summer|fall|autumn|winter)\s*(?:months|season|period)?",
            r"(?:for\s+)?(?P<duration>\d+)\s*(?P<unit>days?|months?|years?|weeks?)",
            r"(?:between|from)\s+(?P<start_hour>\d{1,2})[:.](?P<start_min>\d{2})\s*(?:and|to|-|–)\s*(?P<end_hour>\d{1,2})[:.](?P<end_min>\d{2})",
            r"(?P<period>breeding|spawning|migration|nesting|feeding)\s+(?:season|period)",
            r"(?P<start_year>\d{4})\s*[-–to]+\s*(?P<end_year>\d{4})",
            r"from\s+(?P<start>[\w\s]+?)\s+to\s+(?P<end>[\w\s]+?)(?:\s+(?:annually|yearly))?",
        ),
        anchors={"english": (None, None, None, None, None, None, None, "from")},
        runs={"english": WORDS_ONLY},
        numbers=True,
    ),
    "environmental": Patterns(
        (
            rf"(?P<parameter>pH|tuzluluk|çözünmüş\s*oksijen|sıcaklık|bulanıklık|klorofil)\s*(?:değeri|seviyesi|oranı)?\s*(?P<threshold>en\s+az|en\s+fazla|maksimum|minimum)?\s*(?P<value>{NUM})\s*(?P<unit>mg/L|ppm|ppt|°C|derece|NTU)?",
            r"(?P<parameter>su\s*kalitesi|hava\s*kalitesi|çevre\s*kirliliği|deniz\s*kirliliği|atık\s*su|gürültü\s*kirliliği|toprak\s*kirliliği)\s+(?P<type>[^.;]{5,80})",
            r"(?:çevresel\s+etki|ÇED)\s+(?P<type>[^.;]{5,80})",
            rf"(?P<value>{NUM})\s*(?P<unit>mg/L|ppm|ppb|µg/L)\s*(?P<pollutant>nitrat|fosfat|amonyak|ağır\s*metal|petrol|hidrokarbon)",
        ),
        (
            rf"(?P<parameter>pH|salinity|dissolved\s+oxygen|temperature|turbidity|chlorophyll)\s*(?:level|value)?\s*(?:of\s+)?(?P<threshold>maximum|minimum|at\s+least|up\s+to)?\s*(?P<value>{NUM})\s*(?P<unit>mg/L|ppm|ppt|°C|degrees?|NTU)?",
            r"(?P<parameter>water\s+quality|air\s+quality|noise\s+pollution|marine\s+pollution|oil\s+spill|eutrophication|ocean\s+acidification|habitat\s+degradation|biodiversity\s+loss|underwater\s+noise)\s+(?P<type>[^.;]{5,80})",
            r"(?:environmental\s+impact\s+assessment|EIA|cumulative\s+(?:impact|effect)s?)\s+(?P<type>[^.;]{5,80})",
            rf"(?P<value>{NUM})\s*(?P<unit>mg/L|ppm|ppb|µg/L)\s*(?:of\s+)?(?P<pollutant>nitrate|phosphate|ammonia|heavy\s+metals?|petroleum|hydrocarbons?)",
            rf"(?P<value>{NUM})\s*(?P<unit>dB|decibels?)\s*(?P<type>noise|sound\s+level|acoustic)",
            rf"(?P<pollutant>nitrogen|phosphorus|BOD|COD|DO|SST)\s+(?:concentration|level)\s*(?:of\s+)?(?P<value>{NUM})\s*(?P<unit>mg/L|ppm)",
            rf"(?P<parameter>water\s+quality|pollution|emission|discharge)\s*(?:must\s+not\s+exceed|shall\s+not\s+exceed|maximum\s+of)\s*(?P<value>{NUM})\s*(?P<unit>mg/L|ppm|%)",
        ),
        numbers=True,
    ),
    "prohibition": Patterns(
        (
            r"(?P<activity>avcılık|balıkçılık|av\s+ve\s+balıkçılık|trol|sürütme|dinamit|kıyı\s+doldurma|dolgu|inşaat|kazı|tahribat|atık\s+boşaltma|deşarj|çıkarma|hafriyat)\s*"
            r"(?P<prohibition>yasak(?:lanm[ıi][şs]t[ıi]r|t[ıi]r|)|yasaklanm[ıi][şs]|men\s+edilmi[şs]|men\s+olunmu[şs]|izin\s+verilmez)",
            r"(?P<activity>[\w\s]{3,80}?)\s*(?P<prohibition>yasak(?:t[ıi]r|lanm[ıi][şs]t[ıi]r)|men\s+edilmi[şs]tir|izin\s+verilmez|kabul\s+edilmez)",
            r"(?P<area>koruma\s+alan[ıi]|rezerv|sit\s+alan[ıi]|yasak\s+bölge|özel\s+alan)\s*(?:nda|nde|sında|sinde|içinde)?\s*(?P<activity>[\w\s]+?)\s*(?P<prohibition>yasakt[ıi]r|izin\s+verilmez)",
            r"(?P<method>trol|dinamit|zehir|elektrik|ağ|patlayıcı)\s*(?:ile|kullanarak|kullan[ıi]larak)?\s*(?:avlanma|balıkçılık|yakalama)\s*(?P<prohibition>yasakt[ıi]r|men\s+edilmi[şs]tir)",
        ),
        (
            r"(?P<activity>fishing|trawling|hunting|extraction|dumping|discharge|construction|dredging|mining|anchoring)\s*(?:is\s+)?(?P<prohibition>prohibited|banned|forbidden|not\s+permitted|not\s+allowed|illegal)",
            r"(?P<prohibition>prohibit(?:s|ed)?|ban(?:s|ned)?|forbid(?:s|den)?)\s+(?P<activity>[\w\s]+?)(?:\s+in|\s+from|\s+within)",
            r"no\s+(?P<activity>fishing|trawling|hunting|extraction|dumping|construction)\s*(?P<prohibition>allowed|permitted|authorized)",
            r"(?P<activity>[\w\s]+?)\s+(?:in|within)\s+(?P<area>protected\s+areas?|marine\s+reserves?|sanctuaries|conservation\s+zones?)\s*(?:is\s+)?(?P<prohibition>prohibited|banned|forbidden)",
            r"(?:fishing|hunting)\s+(?:with|using)\s+(?P<method>trawl|dynamite|poison|explosives|nets)\s*(?:is\s+)?(?P<prohibition>prohibited|banned|illegal)",
        ),
        anchors={"turkish": (None, "yasak|men|izin|kabul", "koruma|rezerv|sit|yasak|özel", None), "english": (None, "prohibit|ban|forbid", None, "protected|marine|sanctuar|conservation", None)},
        runs={"turkish": WORDS_ONLY, "english": WORDS_ONLY},
        numbers=True,
    ),
    "species": Patterns(
        (
            r"\b(?P<species>levrek|çipura|lüfer|hamsi|istavrit|kalkan|barbunya|mercan|orkinos|palamut|uskumru|sardalya|mezgit|kefal|fangri|iskorpit|ahtapot|karides|midye|istridye|kalamar|sazan|alabalık|somon|ton\s*balığı|kılıç\s*balığı|morina|pisi|dil\s*balığı|"
            r"tekir|trança|lagos|sinagrit|kolyoz|çinakop|sarıkanat|zargana|deniz\s*levreği|çupra|dülger|gelincik|karagöz)\b",
            r"\b(?P<species>yunus|fok|deniz\s+kaplumbağası|caretta\s+caretta|akdeniz\s+foku|monachus\s+monachus|deniz\s+memelisi|balin[a])\b",
            r"\b(?P<species>posidonia|posidonia\s+oceanica|deniz\s+çayırı|deniz\s+yosunu|caulerpa|cymodocea)\b",
        ),
        (
            r"\b(?P<species>sea\s+bass|gilthead\s+bream|european\s+(?:bass|anchovy|hake|eel)|atlantic\s+(?:cod|salmon|herring|mackerel|tuna|bluefin)|bluefin\s+tuna|yellowfin\s+tuna|skipjack\s+tuna|blue\s+(?:crab|mussel|shark|whale)|red\s+(?:mullet|snapper|coral)|"
            r"spiny\s+lobster|horse\s+mackerel|common\s+(?:sole|cuttlefish|dolphin)|mediterranean\s+(?:mussel|monk\s+seal)|tuna|anchovy|mackerel|sardine|mullet|grouper|seabream|bluefish|octopus|squid|shrimp|mussel|oyster|cod|salmon|herring|haddock|plaice|lobster|clam|"
            r"scallop|swordfish|hake|snapper|barracuda|wrasse|goby|whiting|turbot|sturgeon|cuttlefish|jellyfish|starfish|sea\s+urchin|sea\s+cucumber|seahorse|stingray|manta\s+ray)\b",
            r"\b(?P<species>dolphin|bottlenose\s+dolphin|common\s+dolphin|monk\s+seal|harbor\s+seal|grey\s+seal|sea\s+turtle|loggerhead\s+turtle|green\s+turtle|leatherback\s+turtle|humpback\s+whale|sperm\s+whale|fin\s+whale|blue\s+whale|minke\s+whale|"
            r"whale|porpoise|dugong|manatee|sea\s+otter|caretta\s+caretta|chelonia\s+mydas|monachus\s+monachus)\b",
            r"\b(?P<species>seabird|albatross|petrel|cormorant|gannet|puffin|tern|shearwater|guillemot|razorbill|kittiwake|skua|fulmar|osprey)\b",
            r"\b(?P<scientific_name>Posidonia\s+oceanica|Cymodocea\s+nodosa|Zostera\s+marina|Caulerpa\s+taxifolia|Caulerpa\s+cylindracea|Caretta\s+caretta|Chelonia\s+mydas|Monachus\s+monachus|Tursiops\s+truncatus|Delphinus\s+delphis|Stenella\s+coeruleoalba|"
            r"Phocoena\s+phocoena|Balaenoptera\s+physalus|Thunnus\s+thynnus|Thunnus\s+alalunga|Xiphias\s+gladius|Dicentrarchus\s+labrax|Sparus\s+aurata|Mullus\s+barbatus|Engraulis\s+encrasicolus|Sardina\s+pilchardus|Scomber\s+scombrus|Merluccius\s+merluccius|"
            r"Solea\s+solea|Mytilus\s+galloprovincialis|Crassostrea\s+gigas|Paracentrotus\s+lividus|Octopus\s+vulgaris|Hippocampus\s+(?:hippocampus|guttulatus)|Pinna\s+nobilis|Lithophaga\s+lithophaga|Corallium\s+rubrum|Cladocora\s+caespitosa)\b",
            r"\b(?P<scientific_name>Dugong\s+dugon|Halodule\s+uninervis|Halophila\s+ovalis|Thalassia\s+hemprichii|Enhalus\s+acoroides|Syringodium\s+isoetifolium|Pecten\s+maximus|Ostrea\s+edulis|Ruditapes\s+decussatus|Nephrops\s+norvegicus|Homarus\s+gammarus|"
            r"Panulirus\s+argus|Lophius\s+piscatorius|Gadus\s+morhua|Clupea\s+harengus|Pleuronectes\s+platessa|Scophthalmus\s+maximus|Carcharodon\s+carcharias|Cetorhinus\s+maximus|Prionace\s+glauca|Squalus\s+acanthias|Raja\s+clavata|Dasyatis\s+pastinaca|"
            r"Patella\s+(?:vulgata|ferruginea)|Aplysina\s+aerophoba|Epinephelus\s+(?:marginatus|aeneus)|Dentex\s+dentex|Pagrus\s+pagrus|Pagellus\s+(?:erythrinus|bogaraveo)|Diplodus\s+(?:sargus|vulgaris|annularis))\b",
            r"\b(?P<species>seagrass|posidonia|zostera|cymodocea|caulerpa|kelp|mangrove|coral|sponge|sea\s+fan|gorgonian|phytoplankton|zooplankton|benthic\s+(?:fauna|community|organisms)|cetacean|pinniped|elasmobranch)\b",
        ),
        cased={"english": (3, 4)},
        numbers=True,
    ),
    "protected_area": Patterns(
        (
            r"(?P<name>[\w\s]+?)?\s*(?P<area_type>deniz\s+koruma\s+alan[ıi]|özel\s+çevre\s+koruma\s+bölgesi|sit\s+alan[ıi]|tabiat\s+park[ıi]|milli\s+park|koruma\s+alan[ıi]|deniz\s+rezervi|özel\s+koruma\s+alan[ıi])",
            r"(?P<name>[A-ZÇĞIÖŞÜ][\wçğıöşü\s]+?)\s*(?P<designation>özel\s+çevre\s+koruma\s+bölgesi|deniz\s+koruma\s+alan[ıi]|sit\s+alan[ıi]|milli\s+park)",
            r"(?P<name>[\w\s]+?)\s*(?:alan[ıi]|bölge(?:si)?)\s*(?P<designation>koruma\s+altına\s+al[ıi]n(?:m[ıi][şs]|acak)|koruma\s+statüsü\s+veril(?:mi[şs]|ecek))",
        ),
        (
            r"(?P<name>[\w\s]+?)?\s*(?P<area_type>marine\s+protected\s+area|special\s+area\s+of\s+conservation|marine\s+reserve|national\s+park|sanctuary|conservation\s+zone|protected\s+seascape|nature\s+reserve|MPA)",
            r"(?P<name>[A-Z][\w\s]+?)\s+(?P<designation>Marine\s+Protected\s+Area|National\s+Park|Marine\s+Reserve|Sanctuary|Conservation\s+Zone)",
            r"(?:designat(?:e|ed|ion)|establish(?:ed)?)\s+(?:as\s+)?(?:a\s+)?(?P<designation>marine\s+protected\s+area|marine\s+reserve|conservation\s+zone|sanctuary)",
            r"(?P<name>[\w\s]+?)\s+(?:is|are)\s+(?:under\s+)?(?P<designation>protected|conservation)",
        ),
        cased={"turkish": (1,), "english": (1,)},
        anchors={"turkish": ("koruma|sit|park|rezerv", "koruma|sit|park", "koruma"), "english": ("protected|conservation|reserve|park|sanctuary|MPA", "Protected|Park|Reserve|Sanctuary|Zone", None, "protected|conservation")},
        runs={"turkish": WORDS_ONLY, "english": WORDS_ONLY},
        numbers=True,
    ),
    "permit": Patterns(
        (
            r"(?P<permit_type>avc[ıi]l[ıi]k|bal[ıi]kç[ıi]l[ıi]k|inşaat|yapı|çevresel|imar|tahsis|kullanım)\s*(?P<permit>ruhsat[ıi]?|lisans[ıi]?|izin|belge)(?:si)?\s*(?P<requirement>(?:al[ıi]nmal[ıi]|gerekir|zorunlu|şart))",
            r"(?P<authority>[\w\s]+?(?:Bakanlı[ğg][ıi]|Müdürlü[ğg]ü|Başkanlı[ğg][ıi]))\s*(?:ndan|nden|dan|den)?\s*(?P<permit>ruhsat|lisans|izin|belge)\s+(?:al[ıi]n(?:mal[ıi]|acak)|veril(?:ecek|meli))",
            r"(?P<requirement>izin\s+(?:verilir|al[ıi]n[ıi]r|gerekir))\s*(?:olan\s+)?(?P<permit_type>faaliyetler|işlemler|çal[ıi][şs]malar)?",
            r"(?P<permit>ruhsat|lisans|izin)\s*(?:süresi|geçerlilik\s+süresi)\s*(?P<validity>\d+\s+(?:y[ıi]l|ay|gün))",
        ),
        (
            r"(?P<permit_type>fishing|hunting|construction|environmental|development|aquaculture|marine)\s*(?P<permit>license|permit|authorization|approval)\s*(?:is\s+)?(?P<requirement>required|necessary|mandatory|shall\s+be\s+obtained)",
            r"(?P<permit>permit|license|authorization)\s+from\s+(?:the\s+)?(?P<authority>[\w\s]+?(?:Department|Agency|Ministry|Authority))",
            r"(?:must|shall|should)\s+(?:obtain|acquire|secure)\s+(?:a\s+)?(?P<permit>permit|license|authorization)",
            r"(?P<permit>permit|license)\s+(?:valid|validity)\s+(?:for|period)\s+(?P<validity>\d+\s+(?:years?|months?|days?))",
            r"requirements?\s+for\s+(?:a\s+)?(?P<permit_type>[\w\s]+?)\s+(?P<permit>permit|license)",
        ),
        anchors={"turkish": (None, "Bakanlı|Müdürlü|Başkanlı", None, None)},
        runs={"turkish": WORDS_ONLY},
        numbers=True,
    ),
    "coordinate": Patterns((DECIMAL_DEGREES, DEGREES, SIMPLE_DEGREES), (DECIMAL_DEGREES, DEGREES, SIMPLE_DEGREES)),
    "legal_reference": Patterns(
        (
            r"(?P<law_number>\d+)\s*say[ıi]l[ıi]\s*(?P<type>(?:kanun|yönetmelik|tüzük|tebli[ğg]))",
            r"(?:madde|md\.?)\s*(?P<article>\d+)",
            r"(?P<law_number>\d+)\s*say[ıi]l[ıi]\s*(?P<type>kanun|yönetmelik)(?:un|ün)?\s*(?P<article>\d+)\s*(?:inci|nci|üncü|uncu)?\s*maddesi",
        ),
        (
            r"(?P<type>Act|Law|Regulation|Directive)\s+(?:No\.\s*)?(?P<law_number>\d+)",
            r"(?P<type>Article|Section)\s+(?P<article>\d+)",
            r"(?:Article|Section)\s+(?P<article>\d+)\s+of\s+(?:the\s+)?(?P<type>Act|Law|Regulation)\s+(?:No\.\s*)?(?P<law_number>\d+)",
        ),
    ),
    "stakeholder": Patterns(
        (
            r"(?P<name>[A-ZÇĞIÖŞÜ][\wçğıöşü\s]+?)\s*(?P<type>Bakanlı[ğg][ıi]|Müdürlü[ğg]ü|Başkanlı[ğg][ıi]|Kurumu|Vakf[ıi]|Derne[ğg]i|Birli[ğg]i)",
            r"(?P<name>[\w\s]+?)\s*(?P<type>toplulu[ğg]u|yerel\s+halk|bal[ıi]kç[ıi]lar|yerel\s+topluluk)",
            r"(?P<role>paydaş|paydaşlar|ilgili\s+taraflar|yerel\s+topluluk)",
        ),
        (
            r"(?P<name>[A-Z][A-Za-z]+(?:\s+(?:of|and|for|the)\s+)?(?:[A-Z][A-Za-z]+)(?:\s+(?:of|and|for|the)\s+[A-Z]?[A-Za-z]+){0,3})\s+(?P<type>Ministry|Department|Agency|Authority|Institute|Foundation|Association|Organization)",
            r"(?P<role>local\s+(?:community|communities|fishers?|fishermen)|fishing\s+(?:community|communities|industry)|coastal\s+(?:community|communities)|indigenous\s+(?:community|communities|peoples?)|tourism\s+(?:industry|sector|operators?)|"
            r"shipping\s+(?:industry|sector|companies)|oil\s+and\s+gas\s+(?:industry|sector|companies)|offshore\s+(?:wind|energy)\s+(?:industry|sector|developers?)|environmental\s+(?:NGOs?|organizations?)|conservation\s+(?:NGOs?|organizations?)|"
            r"government\s+(?:agencies|authorities|bodies)|port\s+authorities|maritime\s+(?:industry|sector|authorities)|aquaculture\s+(?:industry|sector|farmers?)|recreational\s+(?:users?|fishers?|boaters?))",
        ),
        cased={"turkish": (0,), "english": (0,)},
        anchors={"turkish": ("Bakanlı|Müdürlü|Başkanlı|Kurumu|Vakf|Derne|Birli", "toplulu|halk|kçı|kçi|topluluk", None)},
        runs={"turkish": WORDS_ONLY},
    ),
    "policy": Patterns(
        (r"(?P<title>[A-ZÇĞIÖŞÜ][\wçğıöşü\s]+?)\s*(?P<type>Politikas[ıi]|Yönetmeli[ğg]i|Direktifi|Strateji(?:si)?|Çerçeve(?:si)?)",),
        (r"(?P<title>[A-Z][\w\s]+?)\s+(?P<type>Policy|Directive|Regulation|Strategy|Framework|Guideline)",),
        cased={"turkish": (0,), "english": (0,)},
        anchors={"turkish": ("Politikas|Yönetmeli|Direktifi|Strateji|Çerçeve",), "english": ("Policy|Directive|Regulation|Strategy|Framework|Guideline",)},
        runs={"turkish": WORDS_ONLY, "english": WORDS_ONLY},
    ),
}
