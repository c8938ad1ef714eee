"""Problem 9: per-document text statistics, and the documents that are not natural prose.

Beside counts of words, symbols, lines and common words, repetition statistics are taken: duplicate line and paragraph
shares and the share of characters covered by the most frequent word n-gram (n = 1 to 4). Blocks (paragraphs) are
told apart as prose, list, table or junk by combined rules over their lines and their own repetition (repeated lines,
repeated cells of lines, n-gram coverage against the share of different words), paragraphs that repeat an earlier one
count as junk where they are most of the text, and a document is junk as a whole if its lines or one n-gram repeat over
most of it. Otherwise a document whose characters are for the larger part not prose takes the kind with most characters.

All is one pass over whole texts in Arrow batches, without a shuffle. The common words (a fixed table of a few
hundred rows) are broadcast; their number is checked against ``MOST_COMMON_WORDS``.

Defined results: NULL and blank texts have zero counts and shares and no kind; ties between kinds go to junk, then
table, then list; repeated rows give repeated statistics; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.vocabulary import lower
from tidewright.sources.tables import spread

MOST_COMMON_WORDS = 100_000
WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*|\d+(?:[.,]\d+)*")
SYMBOLS = re.compile(r"[\W_]+")
LETTERS = re.compile(r"[^\W\d_]+")
BULLET = re.compile(r"\s*(?:[-*•·–—‣◦▪»]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+")
SENTENCE_END = re.compile(r"[^\W\d_]{2,}[”’\"')]*[.!?][”’\"')]*(?:\s|$)|[%\d°][”’\"')]*\.[”’\"')]*(?:\s|$)")
CUTS = (re.compile(r"\s*\|\s*"), re.compile(r"\t+"), re.compile(r"\s*;\s*"), re.compile(r"\s+&\s+"), re.compile(r" {2,}"), re.compile(r",(?!\s)"))
NUMBER = re.compile(r"(?:\d+(?:[.,]\d+)*\s*%?|NA|N/A|-|–|-{3,}|n|N|%|km|CPUE)")
HEX = re.compile(r"(?:[0-9a-f]{16,}\s*)+", re.I)
LEADER = re.compile(r"(.)\1{3,}\s*\d*\s*")
VOWELS = frozenset("aeiouyäöüâîûàáãåæèéêëìíïòóôõøùúıœAEIOUYÄÖÜÂÎÛÀÁÃÅÆÈÉÊËÌÍÏÒÓÔÕØÙÚIİŒ")
#: Marks that part the labels of a menu or the cells of a row.
CELL = re.compile(r"\s*[|»«·•>]\s*|\s+-\s+|\t+|\n")
PARTED = re.compile(r"[|»«·•>\t]|\s-\s")
#: Repetition: shares of characters beyond which a block or text is no prose, list or table.
REPEATED, COVERED = 0.5, 0.5
#: N-grams tell only of texts without many different lines, as the entries of a list share words.
FEW_LINES, PARTLY_REPEATED = 3, 0.3
#: A block whose commonest word covers this much and that has at most this share of different words repeats a few labels.
LABEL_COVER, LABEL_WORDS = 0.12, 0.3
#: N-gram coverage tells of a block only where at most this share of its words are different.
MOST_DIFFERENT = 0.6

STATS = (
    "n_words BIGINT, mean_word_length DOUBLE, symbol_ratio DOUBLE, lines_ending_in_punctuation DOUBLE, common_word_share DOUBLE, "
    "duplicate_line_share DOUBLE, duplicate_paragraph_share DOUBLE, top_ngram_coverage DOUBLE, prose_share DOUBLE, list_share DOUBLE, "
    "table_share DOUBLE, junk_share DOUBLE, kind STRING"
)


def _duplicates(parts: list[str]) -> float:
    """Share of the characters of ``parts`` that stand in repeats of an earlier part."""
    total = sum(map(len, parts))
    return 1 - sum(map(len, set(parts))) / total if total else 0.0


def _coverage(words: list[str], one: Counter, least: float = 0.0) -> float:
    """Largest share of word characters that one n-gram (n = 1 to 4) occurring twice or more covers; ``one`` counts the words.

    An n-gram covers at most n times what its most frequent word covers; where that stays below ``least``, longer
    n-grams are not counted, and the value is only known to be below it.
    """
    total = sum(map(len, words))
    if len(words) < 2 or not total:
        return 0.0
    best = max((times * len(w) for w, times in one.items() if times > 1), default=0)
    if 4 * best < least * total:
        return best / total
    for n in (2, 3, 4):
        if len(words) < 2 * n:
            break
        grams = Counter(zip(*[words[i:] for i in range(n)], strict=False))
        best = max(best, max((times * len("".join(gram)) for gram, times in grams.items() if times > 1), default=0))
    return min(1.0, best / total)


def _repeats(block: str, lines: list[str], words: list[str]) -> bool:
    """Whether a block only says a few labels over and over."""
    repeated = _duplicates(lines) if len(lines) > 1 else 0.0
    if repeated > REPEATED:
        return True
    if PARTED.search(block):
        cells = [c for c in CELL.split(block) if c and not NUMBER.fullmatch(c)]
        if len(cells) > 7 and _duplicates(cells) > REPEATED and sum(map(len, cells)) > 0.6 * len(block) and not _is_table(lines):
            return True
    different = len(set(words))
    if len(words) < 8 or different > MOST_DIFFERENT * len(words) or len(lines) > FEW_LINES and repeated < PARTLY_REPEATED or SENTENCE_END.search(block):
        return False
    one = Counter(words)
    return _coverage(words, one, COVERED) > COVERED or different < LABEL_WORDS * len(words) and _coverage(words, one, 4.0) > LABEL_COVER


def _is_junk(block: str, lines: list[str]) -> bool:
    dense = "".join(block.split())
    words = LETTERS.findall(block)
    letters = sum(map(len, words))
    if letters < 0.3 * len(dense):
        digits = sum(map(str.isdigit, dense))
        if letters + digits < 0.5 * len(dense):
            return True
    if sum(bool(HEX.fullmatch(x.strip())) or bool(LEADER.fullmatch(x.strip())) for x in lines) > 0.6 * len(lines):
        return True
    if len(words) >= 8:
        odd = sum(len(w) for w in words if len(w) > 3 and sum(c in VOWELS for c in w) < 0.2 * len(w))
        if odd > 0.5 * letters:
            return True
    return False


def _is_table(lines: list[str]) -> bool:
    """Rows of cells: most lines have as many cells as most others, at least three, and numbers among them."""
    rows = [x for x in lines if x.strip()]
    if len(rows) < 2:
        return False
    for cut in CUTS:
        cells = [cut.split(x.strip().strip("|")) for x in rows]
        width, times = Counter(map(len, cells)).most_common(1)[0]
        if width >= 3 and times >= 0.7 * len(rows):
            same = [c for c in cells if len(c) == width]
            numeric = sum(bool(NUMBER.fullmatch(x.strip())) for c in same for x in c)
            if numeric >= 0.25 * width * len(same):
                return True
    return False


def _is_list(lines: list[str]) -> bool:
    """Entries one per line: most lines start like an entry and none but few end a sentence."""
    if len(lines) < 2:
        return bool(lines) and bool(BULLET.match(lines[0])) and not SENTENCE_END.search(BULLET.sub("", lines[0], count=1))
    bare = [BULLET.sub("", x, count=1).strip() for x in lines]
    bullets = sum(bool(BULLET.match(x)) for x in lines)
    ends = sum(bool(SENTENCE_END.search(x)) for x in bare)
    starts = sum(x[:1].isupper() or not x[:1].isalpha() for x in bare)
    if ends > 0.15 * len(lines):
        return False
    return bullets >= 0.7 * len(lines) or (not ends and starts >= 0.85 * len(lines) and sum(len(x.split()) for x in bare) <= 8 * len(bare) and (len(lines) > 3 or not any(len(x) > 70 for x in bare)))


def _is_plain(block: str, lines: list[str], letters: int) -> bool:
    """Prose at a glance: its last line ends a sentence, it is spaced like words, mostly words, and does not start like an entry."""
    return (
        bool(SENTENCE_END.search(lines[-1], max(0, len(lines[-1]) - 24)))
        and block.count(" ") + len(lines) > 0.08 * len(block)
        and not BULLET.match(lines[0])
        and "|" not in block
        and "\t" not in block
        and letters > 0.6 * len(block)
    )


def block_kinds(text: str) -> tuple[list[tuple[str, int, str]], list[str]]:
    """(kind, characters, block) of every block, and all lower-case words; an introducing line that ends in a colon counts as prose of its own."""
    kinds, every = [], []
    for block in re.split(r"\n\s*\n", text):
        lines = [x for x in block.split("\n") if x.strip()]
        if not lines:
            continue
        if len(lines) > 1 and lines[0].rstrip().endswith(":") and len(lines[0].split()) > 3:
            kinds.append(("prose", len(lines[0]), lines[0]))
            every += WORD.findall(lower(lines[0]))
            lines = lines[1:]
        size = sum(map(len, lines))
        body = "\n".join(lines)
        words = WORD.findall(lower(body))
        every += words
        if _repeats(body, [x.strip() for x in lines], words):
            kind = "junk"
        elif _is_plain(body, lines, sum(map(len, words))):
            kind = "prose"
        else:
            kind = "junk" if _is_junk(body, lines) else "table" if _is_table(lines) else "list" if _is_list(lines) else "prose"
        kinds.append((kind, size, block.strip()))
    return kinds, every


def combined_kind(kinds: list[tuple[str, int, str]], n_lines: int, duplicate_lines: float, duplicate_paragraphs: float, coverage: float) -> tuple[str | None, Counter]:
    """(kind or None, characters by kind) from the blocks and the repetition statistics of the whole text."""
    share: Counter = Counter()
    seen: set[str] = set()
    for kind, size, block in kinds:
        if duplicate_paragraphs > REPEATED and block in seen:
            kind = "junk"
        seen.add(block)
        share[kind] += size
    few = n_lines <= FEW_LINES or duplicate_lines > PARTLY_REPEATED
    if kinds and (duplicate_lines > REPEATED or few and coverage > COVERED):
        share = Counter({"junk": sum(share.values())})
    return (max(("junk", "table", "list"), key=lambda k: share[k]) if sum(share.values()) > 2 * share["prose"] else None), share


def _measured(text: str, least: float) -> tuple:
    """(kind, characters by kind, words, their counts, lines, duplicate line and paragraph shares, n-gram coverage) of a text."""
    kinds, words = block_kinds(text)
    one = Counter(words)
    lines = [x for line in text.split("\n") if (x := line.strip())]
    repeats = _duplicates(lines), _duplicates([b for _, _, b in kinds]) if len(kinds) > 1 else 0.0, _coverage(words, one, least)
    kind, share = combined_kind(kinds, len(lines), *repeats)
    return kind, share, words, one, lines, *repeats


def statistics(text: str | None, common: frozenset[str]) -> tuple:
    """The values of ``STATS`` for one text."""
    if text is None or not text.strip():
        return (0, *[0.0] * 11, None)
    kind, share, words, one, lines, *repeats = _measured(text, 0.0)
    dense = len("".join(text.split()))
    total = sum(share.values()) or 1
    return (
        len(words),
        sum(map(len, words)) / len(words) if words else 0.0,
        (dense - len(SYMBOLS.sub("", text))) / dense,
        len([1 for x in lines if x[-1] in ".!?:;…”\"»)"]) / len(lines),
        sum([n for w, n in one.items() if w in common]) / len(words) if words else 0.0,
        *repeats,
        *[share[k] / total for k in ("prose", "list", "table", "junk")],
        kind,
    )


def document_kind(text: str | None) -> str | None:
    """The kind of ``STATS`` alone, by the same statistics."""
    return _measured(text, COVERED)[0] if text is not None and text.strip() else None


def common_word_set(common_words: DataFrame) -> frozenset[str]:
    """The words of the fixed table; more than ``MOST_COMMON_WORDS`` distinct ones are refused."""
    rows = common_words.select(F.lower("word").alias("w")).where("w is not null").distinct().limit(MOST_COMMON_WORDS + 1).collect()
    if len(rows) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    return frozenset(r[0] for r in rows)


def text_statistics(documents: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the columns of ``STATS``."""
    common = documents.sparkSession.sparkContext.broadcast(common_word_set(common_words))
    slim = documents.select(F.col(id_col), F.col(text_col).alias("__text"))
    key = slim.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in STATS.split(", ")]

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([statistics(t, common.value) for t in b["__text"]], columns=names)
            out.insert(0, id_col, b[id_col].to_numpy())
            yield out

    return spread(slim, id_col).mapInPandas(measured, f"{id_col} {key}, {STATS}")


def not_prose(documents: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind) of the documents whose text is for the larger part list, table or junk, from their statistics."""
    return text_statistics(documents, common_words, id_col, text_col).where("kind is not null").select(id_col, "kind")
