"""Operators on whole document texts that need sequential logic: sentences, number words, ranges, bibliographies, pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.quantities import PARTS, SCALES, WORDS, number
from tidewright.sources.tables import spread

#: Abbreviations that end no sentence, fixed values.
ABBREVIATIONS = frozenset("no nr st prof dr mr mrs vs etc e.g i.e cf fig tab sec art vol pp p al md mad örn bkz vb vd yy s n".split())
END = re.compile(r"([.!?]+[”’\"')»]*)\s+(?=[\"“«(]*[A-ZÇĞİÖŞÜÀ-Þ0-9])")
LEAST = 15
ARTICLE = re.compile(r"\s+(?=(?:Madde|MADDE|Article|ARTICLE)\s+\d+\s*[-–—])")
NUMBER_WORD = "|".join(sorted({*WORDS, *SCALES, *PARTS}, key=len, reverse=True))
NUMBER_RUN = re.compile(rf"(?<![^\W\d_])(?:{NUMBER_WORD})(?:(?:[\s-]+and)?[\s-]+(?:{NUMBER_WORD}))*(?![^\W\d_])", re.I)
HEADER = re.compile(r"^\s*(?:\d+\.?\s+)?(?:references|reference\s+list|bibliography|literature\s+cited|works\s+cited|kaynaklar|kaynakça|kaynak(?:lar)?\s+listesi)\s*:?\s*$", re.I | re.M)
CREDITS = re.compile(r"CRediT\s+author(?:ship)?\s+contribution|Author\s+contributions?\s*:|Declaration\s+of\s+(?:competing\s+)?interest|Acknowledgement|Data\s+availability|Funding\s*(?::|$)", re.I)
NEXT_SECTION = re.compile(r"\n\s*\d+\.\s+[A-Z]|\n\s*[A-Z][a-z]+\s+[a-z]")
DOI = re.compile(r"(?:doi|https?://doi\.org)[:/]\s*10\.\d{4,}|10\.\d{4,}/\S+", re.I)
NUMBERED = re.compile(r"\[\d{1,3}\]\s*[A-ZÇĞİÖŞÜ][a-zçğıöşü]")
AUTHOR_YEAR = re.compile(r"[A-ZÇĞİÖŞÜ][^\W\d_]+,\s*[A-Z]\.(?:(?:[A-Z]\.)?,?\s*(?:et\s+al\.?,?\s*)?(?:19|20)\d{2}[.,]|[^()\n]{0,80}\(\d{4}\))")


def sentences(text: str | None) -> list[str]:
    """Sentences of at least 15 characters; a shorter text is one sentence. NULL and blank texts have none."""
    if text is None or not text.strip():
        return []
    text = " ".join(text.split())
    if len(text) < LEAST:
        return [text]
    out = []
    for article in ARTICLE.split(text):
        last = 0
        for m in END.finditer(article):
            if m[1][0] == ".":
                at = m.start()
                while at > last and (article[at - 1] == "." or article[at - 1].isalnum()):
                    at -= 1
                if article[at : m.start()].lstrip(".").lower() in ABBREVIATIONS:
                    continue
            out.append(article[last : m.end(1)])
            last = m.end()
        out.append(article[last:])
    return [s.strip() for s in out if len(s.strip()) >= LEAST]


def numbers_in_digits(text: str | None) -> str | None:
    """Runs of number words as digits; a value of 0 stays as written."""
    if text is None:
        return None

    def digits(m: re.Match) -> str:
        value = number(m.group().replace("-", " "))
        return m.group() if not value else str(int(value)) if value == int(value) else str(value)

    return NUMBER_RUN.sub(digits, text)


def merged_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open ranges in order, those that touch or overlap joined."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def bibliography(text: str | None) -> list[tuple[int, int]]:
    """Ranges of a text that are references: from a heading, or the first dense run of entries, to the end; and credits
    and acknowledgements up to the next section (sought after 200 characters), of 3000 characters at most."""
    if not text:
        return []
    found = [(m.start(), len(text)) for m in HEADER.finditer(text)][:1]
    for m in CREDITS.finditer(text):
        end = min(m.end() + 3000, len(text))
        section = NEXT_SECTION.search(text[m.end() + 200 : end])
        found.append((m.start(), m.end() + 200 + section.start() if section else end))
    for pattern, count, width in ((DOI, 3, 2000), (NUMBERED, 5, 2000), (AUTHOR_YEAR, 5, 3000)):
        at = [m.span() for m in pattern.finditer(text)]
        found += [(at[i][0], len(text)) for i in range(len(at) - count + 1) if at[i + count - 1][1] - at[i][0] < width][:1]
    return merged_ranges(found)


def joined_pages(pages: list[str]) -> list[str]:
    """Pages whose text runs on from the page before are joined to it: the page before ends without a sentence end."""
    out: list[str] = []
    for p in pages:
        p = p.strip()
        if out and p and re.search(r"[^\W\d_,;:]$|[,;:]$", out[-1]) and p[:1].islower():
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def _mapped(df: DataFrame, id_col: str, text_col: str, function, schema: str, names: list[str]) -> DataFrame:
    slim = df.select(F.col(id_col), F.col(text_col).alias("__t"))
    key = slim.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *r) for i, t in zip(b[id_col], b["__t"], strict=True) for r in function(t)]
            yield pd.DataFrame(rows, columns=[id_col, *names])

    return spread(slim, id_col).mapInPandas(run, f"{id_col} {key}, {schema}")


def sentence_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, position, sentence) of all texts."""
    return _mapped(df, id_col, text_col, lambda t: list(enumerate(sentences(t))), "position INT, sentence STRING", ["position", "sentence"])


def bibliography_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end) of all reference ranges."""
    return _mapped(df, id_col, text_col, bibliography, "range_start INT, range_end INT", ["range_start", "range_end"])


def islands(ranges: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The same joining of ranges relationally, per key: (key, start, end) of the islands."""
    w = Window.partitionBy(key).orderBy(start, end)
    top = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("__new", F.when(top.isNull() | (F.col(start) > top), 1).otherwise(0))
    numbered = marked.withColumn("__k", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "__k").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__k")


def in_ranges(position: Column, ranges: Column) -> Column:
    """Whether a position lies in any of an array of half-open ranges struct(s, e)."""
    return F.exists(ranges, lambda r: (r["s"] <= position) & (position < r["e"]))


def page_of(position: Column, lengths: Column) -> Column:
    """The page (from 1) that holds a character position, pages being joined by two characters; NULL beyond the last."""
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).alias("page"))
    step = lambda a, n: F.when(position < a["end"], a).otherwise(F.struct((a["end"] + n + 2).cast("bigint").alias("end"), (a["page"] + 1).alias("page")))
    last = F.aggregate(lengths, start, step)
    return F.when(position < last["end"], last["page"])
