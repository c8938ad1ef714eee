"""Problem 3: text decoded with the wrong character encoding.

For every pair of an encoding a text may have been written in and one it may have been read in, the sequence that
each letter turns into is computed beforehand (also for the misreading applied twice). An Aho-Corasick automaton over
all sequences, single characters and signs of loss included, finds the spans; only matched spans are replaced, so
correct text around them stays as it is. A sequence that stands for several letters is read as the vocabulary has it.

A sequence of two or more characters, a C1 control character and U+FFFD are garble wherever they stand. A sequence of
one character that is also a letter or mark of real text counts only where the restored word is known and much more
frequent than the word as it stands; the readings of all its characters are walked together with the sorted
vocabulary, so that a word may hold any number of them. Lost letters ("?" or U+FFFD) are restored where exactly one
known word fits.

One pass over whole texts in Arrow batches after the word count of the reference texts; no text is shuffled.
Defined results: NULL and empty texts are no cases; repeated rows give repeated results; an empty vocabulary leaves
single characters alone; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.vocabulary import Vocabulary, fold
from tidewright.sources.tables import spread

#: Letters outside ASCII of Turkish, English, French, German and Spanish, Latin letters of foreign names, and the marks of printed text.
LETTERS = "ıİşŞğĞçÇöÖüÜâÂîÎûÛáÁéÉíÍóÓúÚñÑàÀèÈìÌòÒùÙêÊôÔëËïÏÿŸäÄßœŒæÆøØåÅãÃõÕðÐþÞýÝ"
MARKS = "“”‘’„–—…•«»°ºª€§·±²³µ¿¡†‡™©®\xa0"
#: Encodings a text may have been written and read in; all pairs are considered, in this order.
WRITTEN = ("utf-8", "cp1254", "cp857", "cp1252", "cp850", "iso8859-9", "mac_roman", "mac_turkish", "cp437")
READ = ("cp1252", "latin-1", "cp1254", "mac_roman", "cp850", "cp437", "cp857", "iso8859-9", "mac_turkish")
C1 = re.compile("[\x80-\x9f]")
TOKEN = re.compile(r"[^\s.,;:()“\[\]\"'«»–—/]+")
LEFT, RIGHT = re.compile(r"[^\W\d_]*$"), re.compile(r"[^\W\d_]*")
FLUSH = 200_000
LOST = re.compile(r"(?<=[^\W\d_])\?(?=[^\W\d_?])|(?<=[^\W\d_])\?+(?=[^\W\d_])")
ASKED = re.compile(r"\S*[^\W\d_]\S*\?\S*|\S*\?\S*[^\W\d_]\S*")


def _misread(char: str, written: str, read: str) -> str | None:
    """What ``char`` looks like after the pair of encodings; bytes that the second leaves open become C1 controls."""
    try:
        raw = char.encode(written)
    except UnicodeEncodeError:
        return None
    out = []
    for byte in raw:
        try:
            out.append(bytes([byte]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(byte))
    return "".join(out)


@lru_cache(1)
def garble_tables() -> tuple[dict[str, tuple[str, ...]], dict[str, tuple[str, ...]]]:
    """(sure, single): what sequences of several characters stand for, and single characters; in order of the pairs."""
    sure: dict[str, list[str]] = {}
    single: dict[str, set[str]] = {}
    for written, read in itertools.product(WRITTEN, READ):
        if written == read:
            continue
        once = {c: g for c in LETTERS + MARKS if (g := _misread(c, written, read)) not in (None, c)}
        for c, g in once.items():
            if len(g) > 1:
                sure.setdefault(g, []).append(c)
            elif C1.match(g) and c not in MARKS:
                single.setdefault(g, set()).add(c)
            elif not g.isascii() and c in LETTERS:
                single.setdefault(g, set()).add(c)
        if written == "utf-8":
            for c, g in once.items():
                parts = [_misread(x, written, read) if not x.isascii() else x for x in g]
                if None not in parts and (twice := "".join(parts)) != g:
                    sure.setdefault(twice, []).append(c)
    return {g: tuple(dict.fromkeys(c)) for g, c in sure.items()}, {g: tuple(sorted(c)) for g, c in single.items()}


class Restorer:
    """Finds and restores garbled spans of texts, given a vocabulary of folded words."""

    #: A restored word has to be this many times as frequent as the word as it stands.
    RATIO = 4

    def __init__(self, vocabulary: Vocabulary):
        self.known, self.spelling = vocabulary.n, vocabulary.spelling
        self.ordered = sorted(self.known)
        self.sure, self.single = garble_tables()
        self.automaton = ahocorasick.Automaton()
        for g in (*self.single, *self.sure, "�"):
            self.automaton.add_word(g, g)
        self.automaton.make_automaton()
        self.by_shape: dict[tuple[int, str], list[str]] | None = None
        self.cache: dict[str, str | None] = {}

    def restore(self, text: str | None) -> tuple[bool, str | None, bool]:
        """(garbled, restored text, whether nothing garbled remains)."""
        if not text:
            return False, text, True
        found = False
        if not text.isascii():
            spans = list(self.automaton.iter_long(text))
            if any(g in self.sure for _, g in spans):
                found, out, last = True, [], 0
                for end, g in spans:
                    if g in self.sure:
                        out += [text[last : end - len(g) + 1], self._reading(text, end, g)]
                        last = end + 1
                text = "".join(out) + text[last:]
                spans = list(self.automaton.iter_long(text))
            if spans:
                text, one = self._words(text)
                found = found or one
        if "?" in text:
            text, one = self._asked(text)
            found = found or one
        clean = not found or not ("�" in text or C1.search(text) or LOST.search(text))
        return found, text, clean

    def _reading(self, text: str, end: int, g: str) -> str:
        """What a sequence stands for: of several letters the one that makes the more frequent word, else the first."""
        options = self.sure[g]
        if len(options) == 1:
            return options[0]
        left, right = LEFT.search(text, 0, end - len(g) + 1)[0], RIGHT.match(text, end + 1)[0]
        return max(options, key=lambda c: (self.known.get(fold(left + c + right), 0), -options.index(c)))

    def _words(self, text: str) -> tuple[str, bool]:
        found = False

        def word(m: re.Match) -> str:
            nonlocal found
            w = m.group()
            if w.isascii():
                return w
            if w not in self.cache:
                if len(self.cache) > FLUSH:
                    self.cache.clear()
                self.cache[w] = self._word(w)
            fixed = self.cache[w]
            if fixed is None:
                return w
            found = True
            return fixed

        return TOKEN.sub(word, text), found

    def _word(self, w: str) -> str | None:
        """The word restored; itself if garbled beyond restoring; None if it is no case."""
        if "�" not in w and not any(c in self.single for c in w):
            return None
        sure = bool(C1.search(w)) or "�" in w
        core = w.rstrip("”’!?%")
        tail = w[len(core) :]
        least = 0 if sure else self.RATIO * self.known.get(fold(core), 0)
        if "�" in core:
            fits = self._fits(core, "�")
            return fits + tail if fits else w
        options = [self.single.get(c, ()) + ((c,) if not C1.match(c) else ()) if c in self.single else (c,) for c in core]
        if core != core.upper():  # inside a word that is not in capitals, small letters come first
            options = options[:1] + [tuple(sorted(o, key=str.isupper)) for o in options[1:]]
        right = self._walk(options, core, least)
        if right is not None:
            return right + tail
        if not sure:
            return None
        return "".join(o[0] if o else c for o, c in zip(options, core, strict=True)) + tail

    def _walk(self, options: list[tuple[str, ...]], core: str, least: int) -> str | None:
        """The first known word but ``core`` that takes one option a place and is more frequent than ``least``.

        Options and vocabulary are walked together: a start that no known word has is left at once, so the number of
        readings does not matter.
        """
        stack = [(0, "", "")]
        while stack:
            at, word, low = stack.pop()
            i = bisect_left(self.ordered, low)
            if i == len(self.ordered) or not self.ordered[i].startswith(low):
                continue
            if at == len(options):
                if word != core and self.known.get(low, 0) > least:
                    return word
                continue
            stack += [(at + 1, word + c, low + fold(c)) for c in reversed(options[at])]
        return None

    def _fits(self, w: str, mark: str) -> str | None:
        """``w`` with its lost letters put back, where exactly one known word fits."""
        if self.by_shape is None:
            self.by_shape = {}
            for k in self.known:
                if not k.isascii() or "i" in k:
                    self.by_shape.setdefault((len(k), k[-1]), []).append(k)
                    self.by_shape.setdefault((len(k), ""), []).append(k)
        low = fold(w)
        last = "" if low.endswith(mark) else low[-1]
        one = re.compile("".join("([^\\x00-\\x7f]|i)" if c == mark else re.escape(c) for c in low))
        fits = [k for k in self.by_shape.get((len(low), last), ()) if one.fullmatch(k)]
        if len(fits) != 1:
            return None
        right = self.spelling[fits[0]]
        if len(right) != len(w):
            return None
        first = right[0].upper() if w[0] == mark and w[1:2].isupper() else right[0]
        return "".join((first if i == 0 else x) if c == mark else c for i, (c, x) in enumerate(zip(w, right, strict=True)))

    def _asked(self, text: str) -> tuple[str, bool]:
        found = False

        def word(m: re.Match) -> str:
            nonlocal found
            w = m.group()
            core = w.strip(".,;:()“”\"'«»[]!")
            if "?" not in core:
                return w
            inner = LOST.search(core) is not None
            key = "?" + core
            if key not in self.cache:
                if len(self.cache) > FLUSH:
                    self.cache.clear()
                self.cache[key] = self._fits(core, "?")
            fits = self.cache[key]
            if not inner and fits is None:
                return w
            found = True
            return w.replace(core, fits) if fits else w

        return ASKED.sub(word, text), found


def restored(df: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary, only_found: bool = True) -> DataFrame:
    """(id, garbled BOOLEAN, restored STRING, complete BOOLEAN) of the garbled texts, or of all."""
    known = df.sparkSession.sparkContext.broadcast(vocabulary)
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))
    key = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Restorer(known.value)
        for b in batches:
            rows = [(i, *r.restore(t)) for i, t in zip(b["id"], b["__text"], strict=True)]
            yield pd.DataFrame([x for x in rows if x[1] or not only_found], columns=["id", "garbled", "restored", "complete"])

    return spread(slim, "id").mapInPandas(run, f"id {key}, garbled BOOLEAN, restored STRING, complete BOOLEAN")
