"""Problem 7: evaluation passages inside training text, found by latent semantic retrieval.

Documents and items are cut into overlapping passages of ``WINDOW`` words. Their TF-IDF matrix (words hashed to
``DIMS`` columns; passage counts over all documents) is reduced by a distributed randomised SVD, every passage of every
document is projected and held against the item passages by cosine, and the pairs above ``COSINE`` are checked: a run
of ``RUN`` equal words, or a passage whose longest common subsequence with the item has three quarters of its words.
A run of equal words counts whatever its cosine: all runs of the items are looked up in every document.

Sizes: items are searched ``ITEMS_A_PASS`` at a time, each lot in one pass over the documents, so that what a task holds
does not grow with their number; cosines are taken against ``ITEM_BLOCK`` item passages at once. The basis is DIMS x
RANK numbers, fitted on a bounded sample of documents (``FIT_DOCUMENTS``) and of items (``FIT_ITEMS``); every document
is searched whole, without a shuffle of texts.

Defined results: NULL and empty texts leak nothing; an item of fewer than RUN words leaks as a passage only; repeated
documents each report their items; repeated items each are reported; extra columns are ignored; empty tables give no
rows; case, punctuation and white space are disregarded, dotted and dotless i are one letter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.vocabulary import fold
from tidewright.sources.tables import bounded_sample, spread

WINDOW, STRIDE, RUN, SHARE = 24, 8, 12, 0.75
DIMS, RANK, BLOCK = 1 << 14, 64, 1 << 10
#: Bounds of a word's weight: a few very frequent or very rare words must not decide a cosine by themselves.
IDF = (1.0, 4.0)
COSINE = 0.4
FIT_DOCUMENTS, FIT_ITEMS = 4000, 4000
ITEMS_A_PASS, ITEM_BLOCK = 20_000, 8192
TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(fold(text)) if text else []


def column(word: str, seen: dict[str, int]) -> int:
    """The hashed column of a word; ``seen`` keeps the answers and is emptied when full."""
    d = seen.get(word)
    if d is None:
        if len(seen) > 500_000:
            seen.clear()
        d = seen[word] = xxhash.xxh32_intdigest(word) % DIMS
    return d


def starts(n: int) -> range:
    """Where the passages of a text of n words start."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else range(0)


def passages(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) of all passages over concatenated texts of the given sizes."""
    which, low, high, at = [], [], [], 0
    for i, n in enumerate(sizes):
        s = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else np.zeros(0, int)
        which.append(np.full(len(s), i))
        low.append(s + at)
        high.append(np.minimum(s + WINDOW, n) + at)
        at += n
    cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return cat(which), cat(low), cat(high)


def summed(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` over [low, high), high > low: added up once between all edges, then over the edges."""
    if not len(rows) or not len(low):
        return np.zeros((len(low), rows.shape[1]))
    edges = np.unique(np.concatenate([low, high]))
    inner = edges[edges < len(rows)]
    total = np.zeros((len(edges) + (len(inner) == len(edges)), rows.shape[1]))
    np.cumsum(np.add.reduceat(rows, inner, axis=0), axis=0, out=total[1 : len(inner) + 1])
    return total[np.searchsorted(edges, high)] - total[np.searchsorted(edges, low)]


def normed(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def hashes(columns: np.ndarray) -> np.ndarray:
    """A hash of every RUN columns in a row, of at least RUN columns."""
    h = np.zeros(len(columns) - RUN + 1, np.uint64)
    for j in range(RUN):
        h = h * np.uint64(0x9E3779B97F4A7C15) + columns[j : len(columns) - RUN + 1 + j].astype(np.uint64) + np.uint64(1)
    return h


def _columns(texts: list[list[str]], seen: dict[str, int]) -> np.ndarray:
    return np.array([seen.get(w) or column(w, seen) for t in texts for w in t], np.int64)


def passage_counts(documents: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, int]:
    """(documents with each column, number of documents), over all documents."""
    slim = documents.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, seen = np.zeros(DIMS, np.int64), 0, {}
        for b in batches:
            for t in b["__text"]:
                if t:
                    n += 1
                    total[[*{column(w, seen) for w in tokens(t)}]] += 1
        if n:
            yield pd.DataFrame({"d": np.append(np.flatnonzero(total), -1), "n": np.append(total[total > 0], n)})

    rows = spread(slim, "__id").mapInPandas(counted, "d INT, n BIGINT").groupBy("d").agg(F.sum("n").alias("n")).collect()  # at most DIMS + 1
    df, n = np.zeros(DIMS), 0
    for r in rows:
        if r["d"] < 0:
            n = r["n"]
        else:
            df[r["d"]] = r["n"]
    return df, n


def _gathered(frame: DataFrame, text_col: str, weights: np.ndarray, basis: np.ndarray, square: bool) -> np.ndarray:
    """A'A basis (or, if ``square``, (A basis)'(A basis)) for the normed TF-IDF passages A of the texts, summed over tasks."""
    shared = frame.sparkSession.sparkContext.broadcast((weights.astype(np.float32), basis.astype(np.float32)))
    k = basis.shape[1]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, q = shared.value
        out = np.zeros((k if square else DIMS, k))
        seen: dict[str, int] = {}
        for b in batches:
            for t in b[text_col]:
                words = tokens(t)
                if not words:
                    continue
                c = _columns([words], seen)
                _, low, high = passages([len(c)])
                size = np.sqrt(np.maximum(summed((w[c] ** 2)[:, None], low, high), 1e-9))
                z = summed(w[c][:, None] * q[c], low, high) / size
                if square:
                    out += z.T @ z
                else:
                    z /= size
                    spread_z = np.zeros((len(c) + 1, k))
                    np.add.at(spread_z, low, z)
                    np.add.at(spread_z, high, -z)
                    np.add.at(out, c, w[c][:, None] * np.cumsum(spread_z, axis=0)[:-1])
        step = k if square else BLOCK
        yield pd.DataFrame({"block": range(len(out) // step), "sums": [out[i : i + step].astype(np.float32).tobytes() for i in range(0, len(out), step)]})

    def added(block: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in block["sums"])
        return pd.DataFrame({"block": [block["block"].iloc[0]], "sums": [total.astype(np.float32).tobytes()]})

    rows = frame.mapInPandas(part, "block INT, sums BINARY").groupBy("block").applyInPandas(added, "block INT, sums BINARY").collect()
    out = np.zeros((k if square else DIMS, k))
    step = k if square else BLOCK
    for r in rows:
        out[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["sums"], np.float32).reshape(step, k)
    return out


def latent_basis(documents: DataFrame, items: list[str], idf: np.ndarray, id_col: str, text_col: str) -> np.ndarray:
    """DIMS x RANK word vectors: randomised SVD with one power step over the sampled documents and all items."""
    spark = documents.sparkSession
    sample = bounded_sample(documents.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__id", FIT_DOCUMENTS)
    texts = sample.select("__text").unionByName(spark.createDataFrame([(t,) for t in items], "__text STRING"))
    texts = texts.repartition(min(16, spark.sparkContext.defaultParallelism))
    start = np.random.default_rng(7).standard_normal((DIMS, RANK))
    q, _ = np.linalg.qr(_gathered(texts, "__text", idf, start, False))
    gram = _gathered(texts, "__text", idf, q, True)
    values, vectors = np.linalg.eigh(gram)
    return (q @ vectors[:, np.argsort(values)[::-1]]) * idf[:, None]


@dataclass
class Items:
    """The evaluation items, prepared for the search and the checks."""

    ids: list[int]
    words: list[list[str]]
    vectors: np.ndarray
    owner: np.ndarray
    masks: list[dict[str, int]] = field(default_factory=list)
    runs: dict[tuple[str, ...], set[int]] = field(default_factory=dict)
    columns: np.ndarray | None = None
    hashes: np.ndarray | None = None
    shortest: int = 0

    @classmethod
    def of(cls, rows: list[tuple[int, str]], basis: np.ndarray) -> Items:
        words = [tokens(t) for _, t in rows]
        c = _columns(words, {})
        which, low, high = passages(list(map(len, words)))
        new = cls([i for i, _ in rows], words, normed(summed(basis[c], low, high)).astype(np.float32), which)
        for w in words:
            mask: dict[str, int] = {}
            for i, x in enumerate(w):
                mask[x] = mask.get(x, 0) | 1 << i
            new.masks.append(mask)
            for i in range(len(w) - RUN + 1):
                new.runs.setdefault(tuple(w[i : i + RUN]), set()).add(len(new.masks) - 1)
        new.shortest = min(map(len, words))
        new.columns = np.zeros(DIMS, bool)
        new.columns[c] = True
        edges = np.concatenate([[0], np.cumsum(list(map(len, words)))])
        new.hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *[hashes(c[i:j]) for i, j in zip(edges, edges[1:], strict=False) if j - i >= RUN]]))
        return new

    def nearest(self, rows: np.ndarray, texts: np.ndarray, least: float) -> dict[int, dict[int, float]]:
        """By text, the items with a passage at least so close to one of the text's, with the best cosine; in blocks."""
        keys, found = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for at in range(0, len(rows), 2048):
            for low in range(0, len(self.vectors), ITEM_BLOCK):
                close = rows[at : at + 2048] @ self.vectors[low : low + ITEM_BLOCK].T
                hit = np.flatnonzero(close.max(1) >= least)
                close = close[hit]
                i, j = np.nonzero(close >= least)
                keys.append(texts[at + hit[i]] * len(self.words) + self.owner[low + j])
                found.append(close[i, j])
        key, value = np.concatenate(keys), np.concatenate(found)
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        best: dict[int, dict[int, float]] = {}
        if len(first):
            for k, x in zip(key[first].tolist(), np.maximum.reduceat(value, first).tolist(), strict=True):
                best.setdefault(k // len(self.words), {})[k % len(self.words)] = x
        return best

    def runs_of(self, columns: np.ndarray, sizes: list[int], words: list[list[str]]) -> dict[int, set[int]]:
        """The items whose runs each text of a batch holds: hashes of RUN columns tell where, the words themselves whether."""
        found: dict[int, set[int]] = {}
        if len(columns) < RUN or not len(self.hashes):
            return found
        h = hashes(columns)
        near = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[near] == h)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        texts = np.searchsorted(edges, at, "right") - 1
        for d, i in zip(texts.tolist(), (at - edges[texts]).tolist(), strict=True):
            if i + RUN <= sizes[d] and (own := self.runs.get(tuple(words[d][i : i + RUN]))):
                found.setdefault(d, set()).update(own)
        return found

    def longest_common(self, k: int, words: list[str]) -> int:
        """Length of the longest common subsequence of item k and ``words``, bit-parallel."""
        n, mask = len(self.words[k]), self.masks[k]
        v = full = (1 << n) - 1
        for w in words:
            u = v & mask.get(w, 0)
            v = ((v + u) | (v - u)) & full
        return n - v.bit_count()

    def longest_run(self, k: int, words: list[str]) -> int:
        """Length of the longest run of equal words of item k and ``words``, if at least RUN."""
        own, best = self.words[k], 0
        for i in range(len(words) - RUN + 1):
            if k in self.runs.get(tuple(words[i : i + RUN]), ()):
                for j in range(len(own) - RUN + 1):
                    if own[j : j + RUN] == words[i : i + RUN]:
                        m = RUN
                        while j + m < len(own) and i + m < len(words) and own[j + m] == words[i + m]:
                            m += 1
                        best = max(best, m)
        return best

    def share_in_order(self, k: int, words: list[str]) -> float:
        """Largest share of item k that stands in order in one passage of ``words``, a little longer than the item."""
        size = len(self.words[k])
        long = max(size, int(size / SHARE))
        step = max(1, size // 8)
        near = [w in self.masks[k] for w in words]
        share = 0.0
        for s in range(0, max(1, len(words) - long + step), step):
            if sum(near[s : s + long]) >= SHARE * size:
                share = max(share, self.longest_common(k, words[s : s + long]) / size)
        return share

    def check(self, candidates: set[int], runs: set[int], words: list[str], columns: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(item, longest run, share in order) of the items that a document's words hold, of its candidates and runs."""
        total = np.concatenate([[0], np.cumsum(self.columns[columns])])
        # A passage that holds three quarters of any item has a stretch as long as the shortest item's that is as dense.
        long = min(len(words), int(self.shortest / SHARE) + 1)
        dense = (total[long:] - total[:-long]).max() >= SHARE * self.shortest * 0.9 if long else False
        if not runs and not dense:
            return
        have = set(words)
        for k in sorted(candidates | runs):
            own = self.words[k]
            share = self.share_in_order(k, words) if sum(w in have for w in own) >= SHARE * len(own) else 0.0
            if k in runs or share >= SHARE:
                yield k, self.longest_run(k, words) if k in runs else 0, share


def leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", cosine: float = COSINE) -> DataFrame:
    """(id, item_id, cosine, longest_run, share_in_order) of every document and the items it holds."""
    spark = documents.sparkSession
    slim = documents.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = f"{id_col} {slim.schema[id_col].dataType.simpleString()}, item_id BIGINT, cosine DOUBLE, longest_run INT, share_in_order DOUBLE"
    given = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("__id"), F.col(item_text).alias("__text"))
    lots = -(-given.count() // ITEMS_A_PASS)
    counts, n = passage_counts(documents, id_col, text_col)
    if not lots or not n:
        return spark.createDataFrame([], schema)
    idf = np.log((n + 1) / (counts + 0.5)).clip(*IDF)
    fit = [r["__text"] for r in bounded_sample(given, "__id", FIT_ITEMS).collect() if tokens(r["__text"])]
    basis = latent_basis(documents, fit, idf, id_col, text_col).astype(np.float32)
    found = None
    for lot in range(lots):
        mine = given.where(F.pmod(F.xxhash64("__id"), F.lit(lots)) == lot).orderBy("__id", "__text")
        rows = [(r[0], r[1]) for r in mine.collect() if tokens(r[1])]  # about ITEMS_A_PASS
        if rows:
            part = _search(slim, Items.of(rows, basis), basis, id_col, schema, cosine)
            found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def _search(slim: DataFrame, items: Items, basis: np.ndarray, id_col: str, schema: str, cosine: float) -> DataFrame:
    """The leaks of one lot of items, which is broadcast with the basis."""
    shared = slim.sparkSession.sparkContext.broadcast((basis, items))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, own = shared.value
        seen: dict[str, int] = {}
        for b in batches:
            out = []
            for first in range(0, len(b), 256):
                part = b.iloc[first : first + 256]
                words = [tokens(t) for t in part["__text"]]
                sizes = list(map(len, words))
                which, low, high = passages(sizes)
                if not len(which):
                    continue
                columns = _columns(words, seen)
                rows_of = normed(summed(vectors[columns], low, high)).astype(np.float32)
                keys = part[id_col].to_numpy()
                best = own.nearest(rows_of, which, cosine)
                runs = own.runs_of(columns, sizes, words)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                for d in best.keys() | runs.keys():
                    top = best.get(d, {})
                    for k, run, share in own.check(set(top), runs.get(d, set()), words[d], columns[edges[d] : edges[d + 1]]):
                        near = top.get(k)
                        if near is None:
                            near = (rows_of[which == d] @ own.vectors[own.owner == k].T).max()
                        out.append((keys[d], own.ids[k], float(near), run, share))
            yield pd.DataFrame(out, columns=[id_col, "item_id", "cosine", "longest_run", "share_in_order"])

    found = spread(slim, id_col).mapInPandas(search, schema)
    return found.groupBy(id_col, "item_id").agg(F.max("cosine").alias("cosine"), F.max("longest_run").alias("longest_run"), F.max("share_in_order").alias("share_in_order"))
