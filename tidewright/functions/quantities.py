"""Reading of distances from text: numbers in digits and words, units, ranges and other quantities."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Metres per unit, fixed values.
METRES = {"metre": 1.0, "kilometre": 1000.0, "centimetre": 0.01, "nautical_mile": 1852.0, "cable": 185.2, "foot": 0.3048, "yard": 0.9144, "fathom": 1.8288, "statute_mile": 1609.344}
UNITS = tuple(METRES)
#: Spellings of units as patterns, the longer first, fixed values.
SPELLINGS = (
    ("centimetre", r"santimetre(?:lik)?|centimet(?:re|er)s?|cm"),
    ("kilometre", r"kilomet(?:re|er)s?(?:lik)?|kms?"),
    ("statute_mile", r"statute[ _]miles?"),
    ("nautical_mile", r"nautical[ _]miles?|sea[ _]miles?|deniz[ _]mili|d\. ?mili|mil(?:i|lik)?|nmi|n\.m\.?|nm"),
    ("statute_mile", r"miles?|mi"),
    ("cable", r"cable[ _]lengths?|cables?|gomina"),
    ("fathom", r"fathoms?|kulaç"),
    ("foot", r"feet|foot|ft|ayak"),
    ("yard", r"yards?|yds?|yarda"),
    ("metre", r"met(?:re|er)s?(?:lik)?|mt\.?|m"),
)
UNIT = "|".join(f"(?P<u{i}>{p})" for i, (_, p) in enumerate(SPELLINGS))
#: Number words of English and Turkish, fixed values.
WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "bir": 1, "iki": 2, "üç": 3, "dört": 4, "beş": 5, "altı": 6, "yedi": 7, "sekiz": 8, "dokuz": 9, "on": 10, "yirmi": 20, "otuz": 30, "kırk": 40, "elli": 50, "altmış": 60, "yetmiş": 70, "seksen": 80, "doksan": 90,
}
SCALES = {"hundred": 100, "yüz": 100, "thousand": 1000, "bin": 1000, "million": 1_000_000, "milyon": 1_000_000}
PARTS = {"half": 0.5, "yarım": 0.5, "quarter": 0.25, "çeyrek": 0.25, "buçuk": 0.5}
WORD = "|".join(sorted({*WORDS, *SCALES, *PARTS}, key=len, reverse=True))
NUMBER = rf"\d+\s*/\s*\d+|\d+(?:[.,]\d+)*(?:\s+(?:{'|'.join(SCALES)})\b)?|(?:(?:a|an|one)\s+)?(?<![^\W\d_])(?:{WORD})(?:(?:\s+and)?\s+(?:{WORD})|\s+an?(?=\s))*(?![^\W\d_])"
QUANTITY = re.compile(
    rf"(?P<a>{NUMBER})\s*(?:(?:[–—-]|ile|ilâ|ila|and|to|ve|arası)\s*(?P<b>{NUMBER})\s*)?[-\s]*(?:(?P<unit>{UNIT})(?![^\W_]|[²³/^])|(?P<other>[^\W\d_][^\s,;.]*|[°%º][^\s,;.]*|[²³]))?",
    re.I,
)


@dataclass(frozen=True)
class Reading:
    """What a text says: "distance" (value, unit), "range", "other" (another quantity), "number" (no unit) or "none"."""

    kind: str
    value: float | None = None
    unit: str | None = None


def number(text: str) -> float | None:
    """A number in digits or words; a separator before exactly three digits marks thousands."""
    text = " ".join(text.lower().replace("i̇", "i").split())
    if m := re.fullmatch(r"(\d+)\s*/\s*(\d+)", text):
        return int(m[1]) / int(m[2]) if int(m[2]) else None
    if text[:1].isdigit():
        digits, _, scale = text.partition(" ")
        if re.search(r"[.,]\d{3}$", digits) or len(re.findall("[.,]", digits)) > 1:
            last = max(digits.rfind("."), digits.rfind(","))
            tail = digits[last + 1 :]
            whole = re.sub("[.,]", "", digits[:last])
            digits = whole + tail if len(tail) == 3 else f"{whole}.{tail}"
        value = float(digits.replace(",", "."))
        return value * SCALES[scale] if scale in SCALES else value
    total, current, seen = 0.0, 0.0, False
    words = [w for w in text.split() if w in WORDS or w in SCALES or w in PARTS]
    for i, w in enumerate(words):
        if w in WORDS:
            if w in ("one", "bir") and i + 1 < len(words) and words[i + 1] in PARTS:
                continue
            current += WORDS[w]
        elif w in PARTS:
            current += PARTS[w]
        elif SCALES[w] == 100:
            current = (current or 1) * 100
        else:
            total += (current or 1) * SCALES[w]
            current = 0.0
        seen = True
    return total + current if seen else None


def unit_of(text: str | None) -> str | None:
    """The unit that a unit field names, in whatever spelling."""
    if text is None:
        return None
    m = re.fullmatch(rf"\s*(?:{UNIT})\s*", text, re.I)
    return _unit(m) if m else None


def _unit(m: re.Match) -> str:
    return next(name for i, (name, _) in enumerate(SPELLINGS) if m[f"u{i}"] is not None)


def read(text: str | None) -> Reading:
    """The one distance that a text states, or what else it states."""
    if text is None or not text.strip():
        return Reading("none")
    text = text.replace("\xa0", " ").replace("İ", "i")
    distances, ranges, others, bare = [], 0, 0, []
    for m in QUANTITY.finditer(text):
        a = number(m["a"])
        if a is None:
            continue
        worded = not m["a"][0].isdigit()
        if m["unit"] is not None:
            if m["b"] is not None:
                ranges += 1
            else:
                distances.append(Reading("distance", a, _unit(m)))
        elif m["other"] is not None:
            if not worded:
                others += 1
        elif not worded:
            bare.append(Reading("number", a))
    if ranges or len({(d.value, d.unit) for d in distances}) > 1:
        return Reading("range")
    if distances:
        return distances[0]
    if others:
        return Reading("other")
    return bare[0] if len(bare) == 1 else Reading("other" if bare else "none")
