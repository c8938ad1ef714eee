"""Problem 1: noise of scanned pages.

A line that is a running header or page number is taken out, words broken by a mark at a line end are joined, words
with misread characters are replaced, and the lines are reflowed into paragraphs.

Misread words: a Levenshtein automaton whose error edges are the confusions of optical recognition (one or more
characters read as others) is intersected with a trie of the vocabulary, which gives every vocabulary word within the
allowed number of errors. Where no confusion explains an unknown word, the plain Levenshtein automaton is intersected
with the trie instead; such a candidate counts where the word holds a character that no word has, or where it is known
to stand beside the words that the unknown one stands beside. Candidates are ranked by the number of errors against
how often they stand beside their neighbours, stand elsewhere in the text, and occur at all.

Page furniture: lines that have the form of a page number or of a title with one; and lines of the form of a title that
stand on three pages or more of a document between different lines (:func:`running_titles`).

The vocabulary is bounded (``tidewright.llm.vocabulary``) and broadcast, its trie is packed into three arrays and built
once; texts are read once, whole, in Arrow batches, and only those with a line that may be a running title are
shuffled, by their id. Verdicts on words are kept per worker in a dictionary that is emptied when it is full.

Defined results: NULL stays NULL and is no case; an empty text stays empty; ties between candidates go to the more
frequent, then the alphabetically first word; repeated rows give repeated results; extra columns are ignored; an empty
table gives no rows; without a vocabulary no character counts as misread.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.vocabulary import Vocabulary, fold
from tidewright.operators.skew import cut
from tidewright.sources.tables import spread

#: What optical recognition reads (left) for what was printed (right), fixed values. Folded letters.
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("1", "l"), ("1", "i"), ("l", "t"), ("!", "i"), ("|", "l"), ("|", "i"), ("0", "o"), ("6", "ö"), ("6", "b"), ("8", "b"), ("9", "g"),
    ("5", "s"), ("$", "s"), ("@", "a"), ("4", "a"), ("3", "e"), ("†", "t"), ("+", "t"), ("7", "t"), ("b", "h"), ("h", "b"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"),
    ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("ii", "ü"), ("li", "h"), ("vv", "w"), ("w", "vv"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("fl", "fi"), ("fi", "fl"), ("nn", "m"), ("in", "m"),
    ("u¨", "ü"), ("o¨", "ö"), ("a¨", "ä"), ("c¸", "ç"), ("s¸", "ş"), ("g˘", "ğ"), ("e´", "é"), ("e`", "è"), ("a^", "â"), ("i¨", "ï"), ("n~", "ñ"), ("o´", "ó"), ("a´", "á"), ("i´", "í"), ("u´", "ú"), ("a`", "à"), ("u`", "ù"), ("o^", "ô"), ("e^", "ê"), ("i˙", "i"),
    ("f", "t"), ("t", "f"), ("q", "g"), ("g", "q"), ("y", "v"), ("v", "y"), ("o", "e"), ("a", "o"), ("o", "a"), ("n", "u"), ("u", "n"), ("ö", "o"), ("ü", "u"), ("o", "ö"), ("u", "ü"), ("s", "ş"), ("ş", "s"), ("c", "ç"), ("ç", "c"), ("g", "ğ"), ("ğ", "g"),
)
#: Confusions that single letters of real words show too; they count only where the text has other noise or the word is long.
WEAK = frozenset("f t q g y v o a n u ö ü s ş c ç ğ".split())
STRONG = tuple((s, t) for s, t in CONFUSIONS if not (len(s) == 1 and s in WEAK and t in WEAK))
#: Characters that only misread words have.
ALIEN = re.compile(r"[@†$|¨¸˘´`^~˙ﬁﬂ\d!+]")
#: Characters of wrong encodings, which are another problem's business.
FOREIGN = re.compile("[\x80-\x9fÃÅ�ƒ‡Ÿ§√≈∂∞├┼─▒╝┬ÝýÞþÐð]|ÔÇ|â[€\x80]|Â[^\\w\\s]|Ä[^\\w\\s]|ÄŸ|Äž|[^\\W\\d_]\\?[^\\W\\d_]")
#: A quick sign that a text may hold a misread character: an alien one, or a digit next to a letter.
SUSPECT = re.compile(r"[@†$|¨¸˘´`^~˙ﬁﬂ!+]|\d[^\W\d_]|[^\W\d_]\d")
PLAIN = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\s\"“”„«»()\[\]{},;:/–—…]+")
EDGE = ".!?'’‘-­¬•*_|"
BEFORE = re.compile(r"(?<![^\W\d_])([^\W\d_]+(?:-[^\W\d_]+)*),?\s+$")
AFTER = re.compile(r",?\s+([^\W\d_]+(?:-[^\W\d_]+)*)")
BREAK = re.compile(r"([^\W\d_][^\s\-­¬‐]*)([-­¬‐])[ \t\xa0]*\r?\n[ \t\xa0]*([^\W_][^\s]*)")
HEADING = re.compile(r"(?:madde|annex|article|artikel|anhang|anexo|annexe|ek|table|tablo|tabelle|tabla|tableau|bölüm|section)[ \-.]?\s*\d+\.?", re.I)
PAGE = re.compile(
    r"\W*(?:(?:sayfa|page|seite|página|pág|pag|syf|s|p)\.?\s*)\d{1,4}(?:\s*(?:/|of|von|de|sur)\s*\d{1,4})?\W*|[—–\-\[(|•·*]*\s*\d{1,4}\s*[—–\-\])|•·*]*|\d{1,4}\s*/\s*\d{1,4}",
    re.I,
)
TITLE = r"[^\W\d_][^\d|]{3,}[^\W\d_]"
HEADER = re.compile(rf"\d{{1,4}}\s*(?:\s{{2,}}|\t|\|)\s*{TITLE}|{TITLE}\s*(?:\s{{2,}}|\t|\|)\s*\d{{1,4}}|{TITLE},?\s*\d{{1,3}}\s*\(\d{{1,4}}\)(?:,?\s*\d{{1,4}}\s*[–-]\s*\d{{1,4}})?")
SMALL = frozenset("ve ile of the and de la le les du des der die das und für y el los las for in on".split())
FLUSH = 200_000
#: A line of title words only, as the engine's expressions see it: no digit, no mark at its end.
TITLE_LINE = r"(?:^|\n)[ \t]*\p{Lu}[\p{L}’'-]*(?:[ \t]+(?:(?:ve|ile|of|the|and|de|la|le|les|du|des|der|die|das|und|für|y|el|los|las|for|in|on)|\p{Lu}[\p{L}’'-]*))*[ \t]*\r?(?:\n|$)"
#: Pages of a document, and different lines after it, that make a repeated title a running header.
PAGES = 3
#: Ranking: what an error costs, in nats, and how often a pair of words has to be known to count.
ERROR_COST, LEAST_PAIRS = 6.0, 1.5


class Trie:
    """Vocabulary words in preorder: the character, the end of the subtree and the frequency (0: no word) of each node."""

    def __init__(self, words: dict[str, int]):
        chars, self.end, self.n = ["\x00"], array("L", [0]), array("L", [0])
        path, last = [0], ""
        for w in sorted(words):
            if not w:
                continue
            k = 0
            while k < len(last) and k < len(w) and last[k] == w[k]:
                k += 1
            while len(path) > k + 1:
                self.end[path.pop()] = len(chars)
            for c in w[k:]:
                path.append(len(chars))
                chars.append(c)
                self.end.append(0)
                self.n.append(0)
            self.n[path[-1]] = words[w]
            last = w
        while path:
            self.end[path.pop()] = len(chars)
        self.chars = "".join(chars)

    def child(self, node: int, c: str) -> int:
        """The child of a node by its character; 0 if there is none."""
        at, end, chars = node + 1, self.end, self.chars
        stop = end[node]
        while at < stop:
            if chars[at] == c:
                return at
            at = end[at]
        return 0

    def confused(self, token: str, errors: int, confusions: tuple[tuple[str, str], ...]) -> list[tuple[int, int, str]]:
        """(errors, frequency, word) of all words that turn into ``token`` by up to ``errors`` confusions."""
        by_first: dict[str, list[tuple[str, str]]] = {}
        for seen, true in confusions:
            by_first.setdefault(seen[0], []).append((seen, true))
        best: dict[str, tuple[int, int]] = {}
        stack = [(0, 0, 0, "")]
        while stack:
            node, at, used, word = stack.pop()
            if at == len(token):
                if self.n[node] and (word not in best or used < best[word][0]):
                    best[word] = (used, self.n[node])
                continue
            c = token[at]
            if down := self.child(node, c):
                stack.append((down, at + 1, used, word + c))
            if used < errors:
                for seen, true in by_first.get(c, ()):
                    if token.startswith(seen, at):
                        down = node
                        for x in true:
                            down = self.child(down, x)
                            if not down:
                                break
                        if down:
                            stack.append((down, at + len(seen), used + 1, word + true))
        return [(e, n, w) for w, (e, n) in best.items()]

    def within(self, token: str, distance: int) -> list[tuple[int, int, str]]:
        """(distance, frequency, word) of all words within a Levenshtein distance.

        The automaton's states are rows of the distance table, of which only the band around the diagonal is kept.
        """
        found, size, far = [], len(token), distance + 1
        stack = [(0, "", [min(i, far) for i in range(size + 1)])]
        while stack:
            node, word, row = stack.pop()
            if self.n[node] and row[size] <= distance:
                found.append((row[size], self.n[node], word))
            depth = len(word) + 1
            low, high = max(1, depth - distance), min(size, depth + distance)
            down, stop = node + 1, self.end[node]
            while down < stop:
                c = self.chars[down]
                new = [far] * (size + 1)
                new[0] = best = min(depth, far)
                for i in range(low, high + 1):
                    x = row[i - 1] + (token[i - 1] != c)
                    y = (row[i] if row[i] < new[i - 1] else new[i - 1]) + 1
                    new[i] = x = x if x < y else y
                    if x < best:
                        best = x
                if best <= distance:
                    stack.append((down, word + c, new))
                down = self.end[down]
        return found


class Cleaner:
    """Finds and repairs scan noise of texts, given a bounded vocabulary of folded words with frequencies."""

    def __init__(self, vocabulary: Vocabulary, trie: Trie | None = None):
        self.vocabulary = vocabulary
        self.known, self.spelling = vocabulary.n, vocabulary.spelling
        self.parts = {p for w in self.known for p in w.split("-")}
        self.trie = trie or trie_of(vocabulary)
        self.verdicts: dict[str, tuple[tuple[int, int, str], ...]] = {}
        self.near: dict[str, tuple[tuple[int, int, str], ...]] = {}

    # -- words ---------------------------------------------------------------------------------------------------
    def _known(self, word: str) -> bool:
        """Whether every part of the word is in the vocabulary or no word at all."""
        low = fold(word)
        if low in self.known:
            return True
        parts = re.split(r"[-’'.%°º/&=+<>#*_]+", low)
        return all(p in self.known or not p or p.isdigit() or len(p) == 1 for p in parts)

    def candidates(self, word: str) -> tuple[tuple[int, int, str], ...]:
        """(errors, frequency, word) of the vocabulary that ``word`` may be a misreading of by its characters alone."""
        return self._kept(self.verdicts, fold(word), self._candidates)

    def neighbours(self, word: str) -> tuple[tuple[int, int, str], ...]:
        """(distance, frequency, word) of the vocabulary within the plain distance of an unknown word."""
        return self._kept(self.near, fold(word), lambda w: self.trie.within(w, 1 if len(w) < 9 else 2))

    @staticmethod
    def _kept(kept: dict, low: str, find) -> tuple[tuple[int, int, str], ...]:
        got = kept.get(low)
        if got is None:
            if len(kept) > FLUSH:
                kept.clear()
            got = kept[low] = tuple(sorted(find(low), key=lambda x: (x[0], -x[1], x[2])))
        return got

    def _candidates(self, low: str) -> list[tuple[int, int, str]]:
        if self._known(low):
            return []
        letters = sum(map(str.isalpha, low))
        if not letters:
            return []
        stem, tail = low, ""
        for cut in ("’", "'"):
            if cut in low:
                stem, tail = low.split(cut, 1)
                if stem in self.known or len(stem) < 3:
                    stem, tail = tail, ""
        alien = bool(ALIEN.search(stem))
        if len(stem) < 3 and not alien:
            return []
        errors = 1 if len(stem) < 4 else 2 if len(stem) < 9 else 3
        found = self.trie.confused(stem, errors, STRONG)
        if not found and (alien or len(stem) > 5):
            found = [x for x in self.trie.confused(stem, min(errors, 2), CONFUSIONS) if alien or x[0] == 1 or len(stem) > 8]
        if not found and alien and letters >= 3 and letters > len(stem) // 2:
            found = self.trie.within(stem, 1 if len(stem) < 6 else 2)
        return found

    def number(self, word: str) -> str | None:
        """A number with letters read for digits, put right."""
        if re.fullmatch(r"[\dOoIlSB]+(?:[.,][\dOoIlSB]+)*", word) and sum(map(str.isdigit, word)) * 2 >= sum(map(str.isalnum, word)) and not word.isalpha() and re.search("[OoIlSB]", word):
            return word.translate(str.maketrans("OoIlSB", "001158"))
        return None

    def words(self, text: str) -> tuple[str, int]:
        """(text with misread words replaced, how many were)."""
        if not SUSPECT.search(text) and self.parts.issuperset(PLAIN.findall(fold(text))):
            return text, 0
        n = 0
        out, last = [], 0
        for m in TOKEN.finditer(text):
            raw = m.group()
            if fold(raw) in self.known:
                continue
            word = raw.strip(EDGE) if not ALIEN.search(raw) else raw.rstrip(".!?'’‘-•*_").lstrip("'’‘-•*_")
            if not word or self._known(word) or self._foreign(text, m):
                continue
            right = self.number(word)
            if right is None:
                best = self._ranked(word, text, m)
                if best is None:
                    continue
                right = _cased(word, self.spelling.get(best, best))
            if right == word:
                continue
            n += 1
            at = m.start() + raw.index(word)
            out += [text[last:at], right]
            last = at + len(word)
        return ("".join(out) + text[last:], n) if n else (text, 0)

    @staticmethod
    def _foreign(text: str, m: re.Match) -> bool:
        """Whether the run of characters around a token holds signs of a wrong encoding."""
        start = max(text.rfind(" ", 0, m.start()), text.rfind("\n", 0, m.start())) + 1
        end = min((i for i in (text.find(" ", m.end()), text.find("\n", m.end())) if i >= 0), default=len(text))
        return FOREIGN.search(text, start, end) is not None

    def _ranked(self, word: str, text: str, m: re.Match) -> str | None:
        """The vocabulary word that a token most likely stands for, or None."""
        found = self.candidates(word)
        if len(found) == 1:
            return found[0][2]
        sure = bool(found)
        if not sure:
            # Letters alone: a name or a rare word, unless a near word is known to stand just here.
            if not word.isalpha() or len(word) < 4 or not (found := self.neighbours(word)):
                return None
        left, right = self._beside(text, m)
        around: set[str] | None = None
        best: tuple[float, int, int, str] | None = None
        for errors, n, w in found:
            a, b = self.vocabulary.evidence(left, w), self.vocabulary.evidence(w, right)
            if not sure and (min(a, b) if word[0].isupper() else max(a, b)) < LEAST_PAIRS:
                continue
            if around is None:
                around = set(map(fold, TOKEN.findall(text)))
            score = ERROR_COST * errors - math.log1p(a) - math.log1p(b) - 0.5 * math.log1p(n) - 3.0 * (w in around)
            if best is None or (score, errors, -n, w) < best:
                best = (score, errors, -n, w)
        return best[3] if best else None

    @staticmethod
    def _beside(text: str, m: re.Match) -> tuple[str | None, str | None]:
        """The folded words before and after a token, where only white space or a comma parts them."""
        a, b = BEFORE.search(text, max(0, m.start() - 80), m.start()), AFTER.match(text, m.end())
        return fold(a[1]) if a else None, fold(b[1]) if b else None

    # -- lines ---------------------------------------------------------------------------------------------------
    def is_furniture(self, lines: list[str], i: int, uneven: bool, titles: frozenset[str] = frozenset()) -> bool:
        """Whether a line is a running header or page number.

        ``uneven``: the text's white space was tampered with; ``titles``: the running titles of its document.
        """
        line = lines[i].strip()
        if not line or HEADING.fullmatch(line):
            return False
        if line in titles:
            return True
        if not any(map(str.isdigit, line)):
            return False
        if line.isdigit():
            beside = max((len(lines[j]) for j in (i - 1, i + 1) if 0 <= j < len(lines)), default=0)
            return len(line) < 5 and not uneven and beside >= 25
        if PAGE.fullmatch(line):
            return True
        if HEADER.fullmatch(line):
            title = re.sub(r"[\d|(),–-]", " ", line).split()
            return all(w[0].isupper() or fold(w) in SMALL for w in title)
        return False

    def is_broken(self, left: str, mark: str, right: str) -> bool:
        """Whether a mark at a line end breaks a word, rather than belonging to a compound."""
        if right[0].isdigit() or left[-1:].isdigit():
            return False
        if mark != "-":
            return True
        a, b = left.rsplit("-", 1)[-1], right.rstrip(".,;:!?)”’\"'")
        a, b = fold(a), fold(re.split(r"[-’']", b)[0])
        if a + b in self.known:
            return True
        if f"{a}-{b}" in self.known or f"{fold(left)}-{fold(right.strip('.,;:!?)'))}" in self.known:
            return False
        return not (a in self.known and b in self.known and len(a) > 2 and len(b) > 2)

    def clean(self, text: str | None, titles: frozenset[str] = frozenset()) -> tuple[str | None, int, int, int]:
        """(repaired text, furniture lines, broken words, misread words)."""
        if not text:
            return text, 0, 0, 0
        furniture = broken = 0
        if "\n" in text:
            lines = re.split(r"\r?\n", text)
            if len([x for x in lines if x.strip()]) > 1:
                uneven = re.search(r"\t|\xa0|\S {2}(?! )\S", text) is not None
                out = [i for i in range(len(lines)) if self.is_furniture(lines, i, uneven, titles)]
                furniture = len(out)
            if furniture:
                text = without(lines, set(out))

            def join(m: re.Match) -> str:
                nonlocal broken
                left, mark, right = m.groups()
                if self.is_broken(left, mark, right):
                    broken += 1
                    return left + right
                return f"{left}{mark}{right}"

            while True:
                before = broken
                text = BREAK.sub(join, text)
                if broken == before:
                    break
        text, misread = self.words(text)
        return reflow(text), furniture, broken, misread


def without(lines: list[str], out: set[int]) -> str:
    """The other lines; a sentence or word that the page furniture stood in goes on without a blank line."""
    keep: list[str] = []
    gone = False
    for i, line in enumerate(lines):
        if i in out:
            gone = True
        elif not gone:
            keep.append(line)
        elif line.strip():
            before = len(keep)
            while before and not keep[before - 1].strip():
                before -= 1
            if before and not re.search(r"[.!?:;…][”’\"')»]*\s*$", keep[before - 1]) and line.lstrip()[:1].islower():
                del keep[before:]
            elif i - 1 not in out and keep and keep[-1].strip():
                keep.append("")
            keep.append(line)
            gone = False
    return "\n".join(keep)


def reflow(text: str) -> str:
    """Lines joined into paragraphs; blank lines part them, and headings of articles, annexes and tables keep their line."""
    if "\n" not in text:
        return text.strip()
    paragraphs = []
    for block in re.split(r"\r?\n[ \t]*\r?\n", text):
        out = ""
        for line in block.splitlines():
            line = line.strip()
            if line:
                out += ("\n" if out and HEADING.fullmatch(out.rsplit("\n", 1)[-1]) else " " if out else "") + line
        if out:
            paragraphs.append(out)
    return "\n\n".join(paragraphs)


def _cased(word: str, right: str) -> str:
    """``right`` (folded) in the letter case of ``word``."""
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(map(str.isupper, letters)):
        return right.upper()
    return right[:1].upper() + right[1:] if letters and word[0].isupper() else right


def trie_of(vocabulary: Vocabulary) -> Trie:
    """The trie of the vocabulary's words but compounds."""
    return Trie({w: n for w, n in vocabulary.n.items() if "-" not in w})


#: The last cleaner of a worker process, by the vocabulary it was made for.
_CLEANERS: dict[str, Cleaner] = {}


def share(spark, vocabulary: Vocabulary):
    """What the workers need, to be broadcast once: a key, the vocabulary and its trie."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, vocabulary, trie_of(vocabulary)))


def _cleaner(shared) -> Cleaner:
    key, vocabulary, trie = shared.value
    if key not in _CLEANERS:
        _CLEANERS.clear()
        _CLEANERS[key] = Cleaner(vocabulary, trie)
    return _CLEANERS[key]


def running_titles(df: DataFrame, id_col: str, fields: tuple[str, ...], document_col: str, page_col: str) -> DataFrame:
    """(id, titles): the lines of each record that run through its document.

    Such a line has the form of a title and stands on ``PAGES`` pages or more of the document, before as many different
    lines; copies of a passage therefore make none. A NULL page counts for none, and a NULL document has no titles. Only texts with a line of that form are read and only such lines
    are shuffled; they are counted after a map-side combine, so that a document may hold any share of the rows.
    """
    has = may_hold_titles(fields)
    key = df.schema[id_col].dataType.simpleString()
    slim = df.where(has).select(F.col(id_col).alias("id"), F.col(document_col).cast("string").alias("d"), F.col(page_col).cast("string").alias("p"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in range(len(fields)):
                for k, d, p, t in zip(b["id"], b["d"], b["p"], b[f"f{i}"], strict=True):
                    if isinstance(t, str) and "\n" in t:
                        rows = [x.strip() for x in t.splitlines() if x.strip()]
                        out += [(k, d, p, x, (rows[j + 1] if j + 1 < len(rows) else rows[j - 1])[:40]) for j, x in enumerate(rows) if is_title(x)]
            yield pd.DataFrame(out, columns=["id", "d", "p", "line", "next"])

    seen = cut(slim.mapInPandas(lines, f"id {key}, d STRING, p STRING, line STRING, next STRING"))
    pages = seen.where("p is not null").select("d", "line", "p").distinct().groupBy("d", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PAGES)
    beside = seen.select("d", "line", "next").distinct().groupBy("d", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PAGES)
    running = pages.select("d", "line").join(beside.select("d", "line"), ["d", "line"])
    return seen.join(running, ["d", "line"]).groupBy("id").agg(F.collect_set("line").alias("titles"))


def may_hold_titles(fields: tuple[str, ...]) -> Column:
    """Whether any of the texts has several lines and one of them the form of a title."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.col(f), F.lit("\n")) & F.col(f).rlike(TITLE_LINE), F.lit(False)) for f in fields])


def is_title(line: str) -> bool:
    """Whether a line is made of capitalised and small words only, without digits and marks at its end."""
    words = line.split()
    return 0 < len(words) < 12 and line[0].isupper() and line[-1].isalpha() and all(w[0].isupper() and w.replace("-", "").replace("’", "").replace("'", "").isalpha() or w in SMALL for w in words)


def cleaned(df: DataFrame, id_col: str, fields: tuple[str, ...], vocabulary: Vocabulary, only_found: bool = True, document_col: str | None = None, page_col: str | None = None) -> DataFrame:
    """(id, field, repaired, n_furniture, n_broken, n_misread): one row per noisy field of each record, or per field.

    Running titles are looked for where the columns of the document and the page are given.
    """
    shared = share(df.sparkSession, vocabulary)
    slim = df.select(F.col(id_col).alias("__id"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    key = slim.schema["__id"].dataType.simpleString()
    none = F.lit(None).cast("array<string>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = _cleaner(shared)
        for b in batches:
            rows = []
            titles = [frozenset() if x is None else frozenset(x) for x in b["titles"]]
            for i, name in enumerate(fields):
                for k, t, own in zip(b["__id"], b[f"f{i}"], titles, strict=True):
                    got = c.clean(t, own)
                    if not only_found or got[1] or got[2] or got[3]:
                        rows.append((k, name, *got))
            yield pd.DataFrame(rows, columns=["id", "field", "repaired", "n_furniture", "n_broken", "n_misread"])

    schema = f"id {key}, field STRING, repaired STRING, n_furniture INT, n_broken INT, n_misread INT"
    if document_col is None or page_col is None:
        return spread(slim.withColumn("titles", none), "__id").mapInPandas(run, schema)
    has = may_hold_titles(tuple(f"f{i}" for i in range(len(fields))))
    titles = running_titles(df, id_col, fields, document_col, page_col).withColumnRenamed("id", "__id")
    some = slim.where(has).join(titles.hint("shuffle_hash"), "__id", "left")
    rest = slim.where(~has).withColumn("titles", none)
    return spread(rest, "__id").mapInPandas(run, schema).unionByName(some.mapInPandas(run, schema))
