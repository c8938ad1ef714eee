"""Word counts of a corpus, and the vocabulary with word neighbourhoods that operators broadcast.

A word is kept if it occurs at least ``least_count`` times, whatever the size of the corpus. What is broadcast is
bounded: a corpus with more than ``MOST_WORDS`` such words is refused, and asks for a larger ``least_count``. Pairs of
neighbouring words are counted in a table of ``CELLS`` hashed cells, whose size is fixed; what a cell holds beyond the
mean of all cells is a pair's evidence, so that a full table gives none rather than a wrong one.

Counting covers all texts in one pass; it is pre-aggregated per batch of texts before the one shuffle of (key, count).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.skew import cut
from tidewright.sources.tables import spread

WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
FLUSH = 300_000
MOST_WORDS = 2_000_000
CELLS, BLOCK = 1 << 21, 1 << 13
#: Starts the keys of pair cells, which no word holds.
PAIR = "\x00"


def fold(text: str) -> str:
    """Lower case, with dotted and dotless i of either case as one letter."""
    return lower(text.replace("I", "i").replace("ı", "i"))


def lower(text: str) -> str:
    """Lower case; the dotted capital becomes i."""
    text = text.replace("İ", "i").lower()
    return text.replace("̇", "") if "̇" in text else text


def cell(first: str, second: str) -> int:
    """The cell of a pair of folded words."""
    return xxhash.xxh32_intdigest(f"{first} {second}") % CELLS


class Vocabulary:
    """Folded words with their frequencies, the spelling that each is mostly written in, and counts of pairs by cell."""

    def __init__(self, counts: dict[str, int], pairs: np.ndarray | None = None):
        self.n: dict[str, int] = {}
        best: dict[str, tuple[int, str]] = {}
        for word, n in counts.items():
            low = fold(word)
            self.n[low] = self.n.get(low, 0) + n
            if low not in best or (n, word) > best[low]:
                best[low] = (n, word)
        self.spelling = {low: word for low, (_, word) in best.items()}
        self.pairs = pairs
        self.mean = float(pairs.mean()) if pairs is not None else 0.0

    def evidence(self, first: str | None, second: str | None) -> float:
        """How often two folded words stand side by side, beyond what any pair's cell holds; 0 without pairs."""
        if self.pairs is None or first is None or second is None:
            return 0.0
        return max(0.0, float(self.pairs[cell(first, second)]) - 2 * self.mean)


def word_counts(texts: DataFrame, text_col: str, id_col: str, pairs: bool = False) -> DataFrame:
    """(word, n): lower-case words, hyphenated compounds whole, of all texts; NULL texts count nothing.

    With ``pairs`` there are also rows for the cells of neighbouring (folded) words, keyed by ``PAIR`` and the cell.
    """

    def rows(c: Counter, p: Counter) -> pd.DataFrame:
        cells: Counter = Counter()
        for (a, b), n in p.items():
            cells[cell(fold(a), fold(b))] += n
        return pd.DataFrame({"word": [*c, *(f"{PAIR}{k}" for k in cells)], "n": [*c.values(), *cells.values()]})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, p = Counter(), Counter()
        for b in batches:
            for t in b["__text"]:
                if t is not None:
                    words = WORDS.findall(lower(t))
                    c.update(words)
                    if pairs:
                        p.update(zip(words, words[1:], strict=False))
            if len(c) + len(p) > FLUSH:
                yield rows(c, p)
                c, p = Counter(), Counter()
        if c:
            yield rows(c, p)

    slim = texts.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return spread(slim, "__id").mapInPandas(counted, "word STRING, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))


def bounded_vocabulary(counts: DataFrame, least_count: int = 2, most_words: int | None = None) -> Vocabulary:
    """The words of ``counts`` that occur ``least_count`` times or more, with the pairs if they were counted.

    More than ``most_words`` (``MOST_WORDS``) of them are refused; the counts are computed once.
    """
    most_words = most_words or MOST_WORDS
    counts = cut(counts)
    kept = counts.where((F.col("n") >= least_count) & ~F.col("word").startswith(PAIR)).limit(most_words + 1).collect()
    if len(kept) > most_words:
        raise ValueError(f"more than {most_words} words occur {least_count} times or more: ask for a larger least_count")
    at = F.substring("word", 2, 20).cast("int")
    cells = counts.where(F.col("word").startswith(PAIR)).select(F.floor(at / BLOCK).cast("int").alias("block"), (at % BLOCK).alias("at"), "n")

    def packed(b: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(BLOCK, np.uint32)
        out[b["at"].to_numpy()] = np.minimum(b["n"].to_numpy(), 0xFFFFFFFF)
        return pd.DataFrame({"block": [b["block"].iloc[0]], "cells": [out.tobytes()]})

    blocks = cells.groupBy("block").applyInPandas(packed, "block INT, cells BINARY").collect()  # CELLS / BLOCK rows at most
    pairs = np.zeros(CELLS, np.uint32) if blocks else None
    for r in blocks:
        pairs[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["cells"], np.uint32)
    return Vocabulary({r["word"]: r["n"] for r in kept}, pairs)
