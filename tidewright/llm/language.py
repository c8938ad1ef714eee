"""Problem 6: languages of documents, of their paragraphs and of mixed-language segments, with confidences.

Character n-gram models of the languages give each unit (sentence or line) a likelihood per language. Expectation
maximisation then estimates a text's language proportions from its units, and a penalised likelihood selects the set
of languages: one whose removal costs less than the penalty is removed. Paragraphs take the language of most of their
characters under the posterior. Contexts take the same way: the set of languages that expectation maximisation keeps
says whether they are in one language or pass from one to another, and the posterior of their units in what order.

Where every unit has the same best language, that language alone has the highest likelihood of all sets and shares
(each unit's likelihood under any mixture is at most that of its best language), so it is taken without iterating. All
other texts of a batch are iterated together, as arrays.

The models are fitted on a bounded sample of documents (about ``SAMPLE`` texts, chosen by the hash of the id), started from
the fixed table of common words; everything else covers whole texts of all rows. Names have no language: capitalised
words inside a sentence and species names are not read.

Defined results: NULL, blank and nameless texts have no language (NULL, confidence 0); ties go to the first language
in alphabetical order of code; repeated rows give repeated results; extra columns are ignored; empty tables give no
rows; a label that names no known language counts as unknown.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.encoding import Restorer
from tidewright.llm.quality import MOST_COMMON_WORDS, document_kind
from tidewright.llm.scan_noise import FOREIGN
from tidewright.llm.vocabulary import Vocabulary, lower
from tidewright.operators.skew import cut, skew_join
from tidewright.sources.tables import bounded_sample, spread

NAMES = {"de": "german", "en": "english", "es": "spanish", "fr": "french", "tr": "turkish"}
CODES = tuple(sorted(NAMES))
SAMPLE = 2000
#: Nats a further language, or a change of language, has to be worth.
PENALTY = 12.0
#: Nats by which the best language of a text has to lead.
LEAST = 4.0
UNIT = re.compile(r"(?<=[.!?;:])[”’\"')»]*\s+(?=[\"“«(‘]*[A-ZÀ-ÞĞİŞ0-9])|\n\s*\n")
WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)?")
SMALL = re.compile(r"(?<![^\W\d_])[a-zß-öø-ÿığşœ][^\W\d_]*(?:[’'][^\W\d_]+)?")
FIRST = re.compile(r"\W*([^\W\d_]+(?:[’'][^\W\d_]+)?)")
SPECIES = re.compile(r"\b[A-Z][a-z]{4,}(?:us|ops|ina|ella|ia|is|ria)\s+[a-z]{3,}(?:us|a|um|is|os)\b")
#: Log-probability of a letter that follows a letter as never seen.
FLOOR = -9.0
ROUNDS = 3


def read_words(unit: str) -> list[str]:
    """The words of a unit that have a language: no species names and, but for the first, no capitalised words.

    A unit written in capitals or title case is read whole.
    """
    if SPECIES.search(unit):
        unit = SPECIES.sub(" ", unit)
    small = SMALL.findall(unit)
    about = unit.count(" ") + 1
    if about > 3:
        if len(small) < 0.3 * about:
            words = WORD.findall(unit)
            if len(words) > 3 and len(small) < 0.25 * len(words):
                return [lower(w) for w in words]
        first = FIRST.match(unit)
        if first and first[1][0].isupper():
            small.append(lower(first[1]))
    return small


class Model:
    """Interpolated character trigram models of the languages, and a cache of word likelihoods."""

    def __init__(self, grams: dict[str, dict[str, float]]):
        self.grams = grams
        self.cache: dict[str, tuple[float, ...]] = {}

    @classmethod
    def fit(cls, words: dict[str, Counter]) -> Model:
        """From word counts per language code."""
        grams = {}
        for code in CODES:
            three: Counter = Counter()
            two: Counter = Counter()
            one: Counter = Counter()
            for w, n in words.get(code, Counter()).items():
                s = f" {w} "
                for i in range(1, len(s)):
                    three[s[max(0, i - 2) : i + 1]] += n
                    two[s[i - 1 : i + 1]] += n
                    one[s[i]] += n
            history: Counter = Counter()
            before: Counter = Counter()
            for g, n in three.items():
                history[g[:-1]] += n
            for g, n in two.items():
                before[g[:-1]] += n
            total = sum(one.values()) or 1
            back = {g: 0.8 * n / before[g[0]] + 0.2 * one[g[1]] / total for g, n in two.items()}
            logs = {g: math.log(0.8 * n / history[g[:-1]] + 0.2 * back[g[-2:]]) for g, n in three.items()}
            for g, x in back.items():
                logs.setdefault("\n" + g, math.log(0.2 * x))
            grams[code] = logs
        return cls(grams)

    def word(self, w: str) -> tuple[float, ...]:
        """Log-likelihood per language, relative to the best and bounded below; kept for the next time."""
        if len(self.cache) > 300_000:
            self.cache.clear()
        s = f" {w} "
        total = []
        for code in CODES:
            logs = self.grams[code]
            total.append(sum(logs.get(s[max(0, i - 2) : i + 1]) or logs.get("\n" + s[i - 1 : i + 1], FLOOR) for i in range(1, len(s))))
        top = max(total)
        got = self.cache[w] = tuple(max(x - top, -12.0) for x in total)
        return got

    def likelihood_of(self, words: list[str]) -> tuple[float, ...]:
        cache, word = self.cache, self.word
        return tuple(map(sum, zip(*[cache.get(w) or word(w) for w in words], strict=True)))

    def likelihood(self, unit: str) -> tuple[tuple[float, ...], int]:
        """(log-likelihood per language relative to the best of each word, number of words read)."""
        words = read_words(unit)
        return (self.likelihood_of(words), len(words)) if words else ((0.0,) * len(CODES), 0)


Unit = tuple[tuple[float, ...], int]
ROUNDS_OF_EM, CLOSE = 12, 1e-4


def mixtures(texts: list[list[Unit]]) -> list[tuple[list[float], np.ndarray]]:
    """(proportions, posterior per unit) of each text, by expectation maximisation over its penalised set of languages.

    A unit is (log-likelihoods, characters); proportions are of characters. The set starts with all languages; the one
    of the least share is left out as long as that costs at most ``PENALTY`` nats. All texts are iterated at once.
    """
    k, n = len(CODES), len(texts)
    if not n:
        return []
    sizes = np.array([len(t) for t in texts])
    owner, starts = np.repeat(np.arange(n), sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    logs = np.array([ll for t in texts for ll, _ in t]).reshape(-1, k)
    weight = np.array([c for t in texts for _, c in t], float)
    total = np.maximum(np.add.reduceat(weight, starts), 1.0)

    def maximise(alive: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(likelihood, shares, posterior) of the texts ``which``; other rows are left undefined."""
        share = alive / alive.sum(1, keepdims=True)
        value, post = np.zeros(n), np.zeros_like(logs)
        active = np.zeros(n, bool)
        active[which] = True
        for _ in range(ROUNDS_OF_EM):
            rows = np.flatnonzero(active[owner])
            if not len(rows):
                break
            with np.errstate(divide="ignore"):
                both = logs[rows] + np.log(share[owner[rows]])
            top = both.max(1, keepdims=True)
            e = np.exp(both - top)
            z = e.sum(1, keepdims=True)
            post[rows] = e / z
            seen = np.zeros(n)
            np.add.at(seen, owner[rows], (top + np.log(z))[:, 0])
            new = np.zeros((n, k))
            np.add.at(new, owner[rows], post[rows] * weight[rows, None])
            new /= total[:, None]
            value[active] = seen[active]
            moved = np.abs(new - share).max(1)
            share[active] = new[active]
            active &= moved >= CLOSE
        return value, share, post

    alive = np.ones((n, k))
    value, share, post = maximise(alive, np.arange(n))
    going = np.arange(n)
    while len(going):
        going = going[alive[going].sum(1) > 1]
        if not len(going):
            break
        low = np.where(alive[going] > 0, share[going], np.inf).argmin(1)
        fewer = alive.copy()
        fewer[going, low] = 0
        v, s, p = maximise(fewer, going)
        better = value[going] - v[going] <= PENALTY
        going = going[better]
        alive[going], value[going], share[going] = fewer[going], v[going], s[going]
        took = np.isin(owner, going)
        post[took] = p[took]
    return [(share[i].tolist(), post[starts[i] : starts[i] + sizes[i]]) for i in range(n)]


def mixture(units: list[Unit]) -> tuple[list[float], list[list[float]]]:
    """:func:`mixtures` of one text."""
    share, post = mixtures([units])[0]
    return share, post.tolist()


def posteriors(texts: list[list[Unit]]) -> list[list[list[float]]]:
    """The posterior of every unit of every text; texts without units have none."""
    out: list[list[list[float]]] = []
    mixed = []
    for i, units in enumerate(texts):
        best = [ll.index(max(ll)) for ll, _ in units]
        if len(set(best)) < 2:
            out.append([[float(j == b) for j in range(len(CODES))] for b in best])
        else:
            mixed.append(i)
            out.append([])
    for i, (_, post) in zip(mixed, mixtures([texts[i] for i in mixed]), strict=True):
        out[i] = post.tolist()
    return out


def _units(text: str | None, model: Model) -> tuple[list[Unit], list[int], int]:
    """(units with their characters, paragraph of each, number of paragraphs) of a document."""
    if text is None or not text.strip():
        return [], [], 0
    units, owner = [], []
    paragraphs = re.split(r"\n[ \t]*\n\s*", text.strip())
    for i, p in enumerate(paragraphs):
        for u in UNIT.split(p):
            ll, n = model.likelihood(u)
            if n:
                units.append((ll, len(u)))
                owner.append(i)
    return units, owner, len(paragraphs)


def documents_languages(texts: list[str | None], model: Model) -> list[tuple[str | None, float, list[tuple[str | None, float]]]]:
    """(main language code, confidence, (code, confidence) per paragraph) of each text."""
    cut = [_units(t, model) for t in texts]
    return [_document(*c, post) for c, post in zip(cut, posteriors([c[0] for c in cut]), strict=True)]


def document_languages(text: str | None, model: Model) -> tuple[str | None, float, list[tuple[str | None, float]]]:
    """:func:`documents_languages` of one text."""
    return documents_languages([text], model)[0]


def _document(units: list[Unit], owner: list[int], n_paragraphs: int, posterior: list[list[float]]) -> tuple[str | None, float, list[tuple[str | None, float]]]:
    if not units:
        return None, 0.0, [(None, 0.0)] * n_paragraphs
    total = [sum(x) for x in zip(*[ll for ll, _ in units], strict=True)]
    per = defaultdict(lambda: [0.0] * len(CODES))
    evidence = defaultdict(lambda: [0.0] * len(CODES))
    whole = [0.0] * len(CODES)
    for (ll, n), p, i in zip(units, posterior, owner, strict=True):
        for j in range(len(CODES)):
            per[i][j] += p[j] * n
            evidence[i][j] += ll[j]
            whole[j] += p[j] * n
    parts = []
    for i in range(n_paragraphs):
        if i not in per:
            parts.append((None, 0.0))
            continue
        j = max(range(len(CODES)), key=lambda x: (per[i][x], -x))
        lead = evidence[i][j] - max(e for x, e in enumerate(evidence[i]) if x != j)
        clear = lead > LEAST or per[i][j] > 0.9 * sum(per[i]) and lead > 0
        parts.append((CODES[j] if clear else None, per[i][j] / sum(per[i]) if clear else 0.0))
    j = max(range(len(CODES)), key=lambda x: (whole[x], -x))
    if len(units) < 4 and total[j] - max(t for x, t in enumerate(total) if x != j) < LEAST:
        return None, 0.0, parts
    return CODES[j], whole[j] / sum(whole), parts


def contexts_languages(texts: list[str | None], model: Model) -> list[list[tuple[str, float]]]:
    """Per short text its language, or its two languages in order, with confidences; [] where none is clear."""
    cut = [[x for u in UNIT.split(t.strip()) if (x := model.likelihood(u))[1]] if t is not None and t.strip() else [] for t in texts]
    return [_context(units, post) for units, post in zip(cut, posteriors(cut), strict=True)]


def context_languages(text: str | None, model: Model) -> list[tuple[str, float]]:
    """:func:`contexts_languages` of one text."""
    return contexts_languages([text], model)[0]


def _context(units: list[Unit], posterior: list[list[float]]) -> list[tuple[str, float]]:
    """One language, or the two between which the posterior changes; a second needs more than two words on either side."""
    if not units:
        return []
    k = range(len(CODES))
    kept = [j for j in k if sum(p[j] for p in posterior) > 1e-3]
    if len(kept) > 1:
        head, tail = [0.0] * len(CODES), [sum(p[j] for p in posterior) for j in k]
        top: tuple[float, int, int, int] | None = None
        for i, p in enumerate(posterior[:-1]):
            head, tail = [h + x for h, x in zip(head, p, strict=True)], [t - x for t, x in zip(tail, p, strict=True)]
            a, b = max(kept, key=lambda j: (head[j], -j)), max(kept, key=lambda j: (tail[j], -j))
            if a != b and (top is None or head[a] + tail[b] > top[0] + 1e-9):
                top = (head[a] + tail[b], i + 1, a, b)
        if top is not None:
            _, at, a, b = top
            if sum(n for _, n in units[:at]) > 2 and sum(n for _, n in units[at:]) > 2:
                return [(CODES[a], _confidence(units[:at], a)), (CODES[b], _confidence(units[at:], b))]
    total = [sum(ll[j] for ll, _ in units) for j in k]
    best = max(k, key=lambda j: (total[j], -j))
    second = max(total[j] for j in k if j != best)
    if total[best] - second < LEAST:
        return []
    return [(CODES[best], _confidence(units, best))]


def _confidence(units: list[tuple[tuple[float, ...], int]], j: int) -> float:
    total = [sum(ll[x] for ll, _ in units) for x in range(len(CODES))]
    return 1 / sum(math.exp(min(700, t - total[j])) for t in total)


def fit(documents: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", labels: tuple[str, str] = ("language", "lang"), sample: int = SAMPLE) -> Model:
    """The models from about ``sample`` texts: units are labelled where label and common words agree, then by the models."""
    common: dict[str, set[str]] = defaultdict(set)
    given = common_words.where("word is not null and lang is not null").select("lang", "word").distinct().limit(MOST_COMMON_WORDS + 1).collect()
    if len(given) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    for r in given:
        if r["lang"] in NAMES:
            common[r["lang"]].add(lower(r["word"]))
    known = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"), F.col(labels[0]).alias("__l0"), F.col(labels[1]).alias("__l1"))
    rows = bounded_sample(known, "__id", sample).collect()
    units = [(w, label_code(r["__l0"], r["__l1"])) for r in rows for u in UNIT.split(r["__t"]) if len(w := read_words(u)) > 3]
    model = None
    for _ in range(ROUNDS):
        words: dict[str, Counter] = {c: Counter({w: 20 for w in common[c]}) for c in CODES}
        for u, label in units:
            if model is None:
                score, code = max((sum(w in common[c] for w in u), c) for c in CODES)
                if label is not None and score > 1 and score == sum(w in common[label] for w in u) or score > 0.3 * len(u):
                    words[label if label is not None else code].update(u)
            else:
                ll = model.likelihood_of(u)
                first, second = sorted(ll, reverse=True)[:2]
                if first - second > LEAST:
                    words[CODES[ll.index(first)]].update(u)
        model = Model.fit(words)
    return model


#: Spellings of labels, fixed values: the code, the English name and the language's own name.
LABELS = {"de": ("de", "german", "deutsch", "ger", "deu"), "en": ("en", "english", "eng"), "es": ("es", "spanish", "español", "spa"), "fr": ("fr", "french", "français", "fra", "fre"), "tr": ("tr", "turkish", "türkçe", "tur")}


def label_code(language: str | None, lang: str | None) -> str | None:
    """The code that a label names in whatever spelling, or None."""
    for label in (lang, language):
        if label:
            low = lower(label).strip()
            for code, spellings in LABELS.items():
                if low in spellings or low.split("-")[0].split("_")[0] == code:
                    return code
    return None


def label_documents(documents: DataFrame, model: Model, id_cols: tuple[str, ...] = ("doc_id", "id"), text_col: str = "text", labels: tuple[str, str] = ("language", "lang")) -> DataFrame:
    """(id columns, labelled, main, confidence, junk, parts array<struct<code,confidence>>) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    slim = documents.select(*id_cols, F.col(text_col).alias("__text"), F.col(labels[0]).alias("__l0"), F.col(labels[1]).alias("__l1"))
    ids = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[list(id_cols)].copy()
            rows = []
            found = documents_languages(b["__text"].tolist(), shared.value)
            for t, l0, l1, (main, confidence, parts) in zip(b["__text"], b["__l0"], b["__l1"], found, strict=True):
                rows.append((label_code(l0, l1), main, confidence, document_kind(t) == "junk", [{"code": c, "confidence": x} for c, x in parts]))
            for i, c in enumerate(("labelled", "main", "confidence", "junk", "parts")):
                out[c] = [r[i] for r in rows]
            yield out

    return spread(slim, id_cols[0]).mapInPandas(run, f"{ids}, labelled STRING, main STRING, confidence DOUBLE, junk BOOLEAN, parts ARRAY<STRUCT<code:STRING,confidence:DOUBLE>>")


def label_contexts(texts: DataFrame, model: Model, id_col: str = "id", text_col: str = "context", owner_col: str = "document_id") -> DataFrame:
    """(id, owner, first, first_confidence, second, second_confidence): one language of each text, or two in order."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    slim = texts.select(F.col(id_col).alias("id"), F.col(owner_col).alias("owner"), F.col(text_col).alias("__text"))
    key = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mend = Restorer(Vocabulary({})).restore
        for b in batches:
            rows = []
            found = contexts_languages([mend(t)[1] if t and FOREIGN.search(t) else t for t in b["__text"]], shared.value)
            for i, o, pair in zip(b["id"], b["owner"], found, strict=True):
                got = [*pair, (None, None), (None, None)]
                rows.append((i, o, *got[0], *got[1]))
            yield pd.DataFrame(rows, columns=["id", "owner", "first", "first_confidence", "second", "second_confidence"])

    return spread(slim, "id").mapInPandas(run, f"id {key}, owner STRING, first STRING, first_confidence DOUBLE, second STRING, second_confidence DOUBLE")


def _name(code: str):
    return F.element_at(F.create_map(*[F.lit(x) for c in CODES for x in (c, NAMES[c])]), F.col(code))


def all_languages(documents: DataFrame, extractions: DataFrame, common_words: DataFrame) -> DataFrame:
    """(source_table, record_id, segment, language, confidence, is_case) of every document, paragraph and context.

    Segment 0 is the whole, k the k-th paragraph of a document or the first and second part of a mixed context.
    ``is_case``: the label of a document is missing or wrong; a paragraph or context differs from the document's main
    language; a context is mixed. Documents of junk are no cases.
    """
    model = fit(documents, common_words)
    docs = cut(label_documents(documents, model))
    doc = F.col("doc_id").cast("string").alias("record_id")
    table = lambda name: F.lit(name).alias("source_table")
    good = ~F.col("junk")
    whole = docs.where("main is not null").select(
        table("documents"), doc, F.lit(0).cast("bigint").alias("segment"), _name("main").alias("language"), "confidence", (good & ~F.col("labelled").eqNullSafe(F.col("main"))).alias("is_case")
    )
    parts = docs.select("doc_id", "main", "junk", F.posexplode("parts").alias("__k", "p")).select("*", F.col("p.code").alias("__code")).where("__code is not null")
    parts = parts.select(table("documents"), doc, (F.col("__k") + 1).cast("bigint").alias("segment"), _name("__code").alias("language"), F.col("p.confidence").alias("confidence"), (good & (F.col("__code") != F.col("main"))).alias("is_case"))
    mains = docs.where("main is not null and not junk").groupBy(F.col("id").alias("owner")).agg(F.min("main").alias("main"))
    contexts = cut(label_contexts(extractions, model).where("first is not null"))
    owned = skew_join(contexts, mains, "owner", "left")
    one = owned.where("second is null").select(
        table("extractions"), F.col("id").cast("string").alias("record_id"), F.lit(0).cast("bigint").alias("segment"), _name("first").alias("language"), F.col("first_confidence").alias("confidence"), F.coalesce(F.col("first") != F.col("main"), F.lit(False)).alias("is_case")
    )
    two = contexts.where("second is not null").select(
        F.col("id").cast("string").alias("record_id"),
        F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("segment"), F.col(c).alias("code"), F.col(f"{c}_confidence").alias("confidence")) for k, c in ((1, "first"), (2, "second"))])).alias("s"),
    ).select("record_id", "s.*")
    two = two.select(table("extractions"), "record_id", "segment", _name("code").alias("language"), "confidence", F.lit(True).alias("is_case"))
    return whole.unionByName(parts).unionByName(one).unionByName(two)
