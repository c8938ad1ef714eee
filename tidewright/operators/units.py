"""Problem 5: the same quantity recorded in different units, converted to metres.

Every source (device) is a chain of records in the order of their ids, with the unit as hidden state of a hidden Markov
model; the Viterbi path decides the unit of every record. What it weighs is the log value against the source's smooth
underlying level, how often the source switches units, and the unit that is stated, if any: a statement is evidence of
its unit, stronger in the text (``WRONG_TEXT`` is how often one is taken to be wrong) than in the unit field
(``WRONG_FIELD``), so that a field that the series plainly contradicts is put right. Level, spread and switching rate
are each source's own, from all its stated records; a source with few takes what all sources have.

A source may hold any share of the rows, so chains are cut into blocks of ``BLOCK`` ids, and nothing depends on where:
the smooth level is a linear recurrence, whose summary per block is a pair of numbers, and the forward pass of a block is
a max-plus matrix from its entering to its leaving state. Both combine associatively, so the summaries of ``FAN`` blocks
are combined to one, and so on up a tree; the top gives each group, and down the tree each block, its entering level
and its entering and leaving states. No task holds more than ``FAN`` summaries of a source at once. The result is that
of one Viterbi run over the whole chain.

Defined results: rows without a value in any field, with a range or with another quantity have no metres; NULL sources
form one chain; ties go to the unit listed first; repeated rows give repeated results; extra columns are ignored; an
empty table gives no rows; a value of zero or below tells nothing of its unit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.quantities import METRES, UNITS, read, unit_of
from tidewright.operators.skew import LEAST, SHARE, cut, skew_join
from tidewright.sources.tables import spread

BLOCK, FAN = 4096, 256
SMOOTH = 0.2
#: How often a stated unit is wrong: in the text, in the unit field.
WRONG_TEXT, WRONG_FIELD = 1e-9, 1e-4
#: Degrees of freedom of the values around the level: outliers are common. Bounds of the spread in nats, and of staying.
FREEDOM, LEAST_SPREAD, STAY = 4.0, 0.25, (0.2, 0.99)
#: Spreads from the median beyond which a stated value moves the level no further.
REACH = 2.0
#: Records of a source that weigh as much as all sources together.
PRIOR = 4.0
#: Spreads between the quartiles of a normal distribution.
QUARTILES = 1.349
LOGS = np.log(np.array([METRES[u] for u in UNITS]))
K = len(UNITS)
UNKNOWN_LEVEL = math.log(300.0)


def observation(value: str | None, unit: str | None, text: str | None) -> tuple[float | None, str | None, str, bool]:
    """(value, stated unit, what is stated, whether the text states the unit): the text holds over the fields; a value
    field may carry its own unit."""
    return *_observed(value, unit, text), read(text).kind == "distance"


def _observed(value: str | None, unit: str | None, text: str | None) -> tuple[float | None, str | None, str]:
    said = read(text)
    if said.kind == "distance":
        return said.value, said.unit, "distance"
    if said.kind in ("range", "other"):
        return None, None, said.kind
    if said.kind == "number":
        return said.value, unit_of(unit), "distance"
    own = read(value)
    if own.kind == "distance":
        return own.value, own.unit, "distance"
    if own.kind == "number":
        plain = value.strip().replace("\xa0", " ")
        number = float(plain) if plain.replace(".", "", 1).isdigit() and plain.count(".") == 1 and not plain.split(".")[1][2:3] else own.value
        if unit is None or not unit.strip(" -–—?") or unit.strip().lower() in ("n/a", "none", "null"):
            return number, None, "distance"
        known = unit_of(unit)
        return (number, known, "distance") if known else (None, None, "other")
    return None, None, own.kind


def levels(values: np.ndarray, stated: np.ndarray, level: float, low: float = -math.inf, high: float = math.inf) -> np.ndarray:
    """The smooth level before each row of an ordered block, moved by the stated rows, given that before the block.

    Rows count as ``low`` at least and ``high`` at most, so that wrong statements move the level little.
    """
    out = np.empty(len(values))
    for i, (v, k) in enumerate(zip(values.tolist(), stated.tolist(), strict=True)):
        out[i] = level
        if k >= 0 and v > 0:
            level += SMOOTH * (min(max(math.log(v) + LOGS[k], low), high) - level)
    return out


def level_map(values: np.ndarray, stated: np.ndarray, low: float = -math.inf, high: float = math.inf) -> tuple[float, float]:
    """(a, b): a block turns an entering level x into a x + b."""
    a, b = 1.0, 0.0
    for v, k in zip(values.tolist(), stated.tolist(), strict=True):
        if k >= 0 and v > 0:
            a, b = a * (1 - SMOOTH), b * (1 - SMOOTH) + SMOOTH * min(max(math.log(v) + LOGS[k], low), high)
    return a, b


def emissions(values: np.ndarray, stated: np.ndarray, texts: np.ndarray, level: np.ndarray, spread_: float) -> np.ndarray:
    """Log-likelihood of each row under each unit; ``stated`` holds unit numbers (-1 for none), ``texts`` whether the text states it."""
    out = np.zeros((len(values), K))
    good = values > 0
    z = (np.log(values[good])[:, None] + LOGS - level[good][:, None]) / spread_
    out[good] = -(FREEDOM + 1) / 2 * np.log1p(z**2 / FREEDOM)
    said = np.flatnonzero(stated >= 0)
    wrong = np.where(texts[said], WRONG_TEXT, WRONG_FIELD)
    out[said] += np.log(wrong / (K - 1))[:, None]
    out[said, stated[said]] += np.log((1 - wrong) * (K - 1) / wrong)
    return out


@lru_cache(100_000)
def switching(stay: float) -> np.ndarray:
    """Log-probability of each unit after each."""
    m = np.full((K, K), math.log((1 - stay) / (K - 1)))
    np.fill_diagonal(m, math.log(stay))
    return m


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: the best score from each state before ``a`` to each after ``b``."""
    return (a[:, :, None] + b[None]).max(1)


def transfer(e: np.ndarray, switch: np.ndarray) -> np.ndarray:
    """Max-plus matrix of an ordered block from its emissions."""
    m = switch + e[0]
    for row in e[1:]:
        m = (m[:, :, None] + switch[None]).max(1) + row
    return m


def decode(e: np.ndarray, switch: np.ndarray, enter: int, leave: int) -> list[int]:
    """Viterbi path of an ordered block between two states; a negative ``enter`` is the start of the chain."""
    score = e[0] + (switch[enter] if enter >= 0 else -math.log(K))
    back = []
    for row in e[1:]:
        both = score[:, None] + switch
        back.append(both.argmax(0))
        score = both.max(0) + row
    path = [leave if leave >= 0 else int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def through(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """The leaving state of each block of a group between two states; negative ones are the ends of the chain.

    Row K of the first matrix of a chain holds the scores from its start.
    """
    score, back = matrices[0][enter if enter >= 0 else K], []
    for m in matrices[1:]:
        both = score[:, None] + m[:K]
        back.append(both.argmax(0))
        score = both.max(0)
    path = [leave if leave >= 0 else int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of equal keys over sorted batches, as arrays by column; a run may pass from one batch to the next."""
    carry: pd.DataFrame | None = None
    for b in batches:
        b = b if carry is None else pd.concat([carry, b], ignore_index=True)
        if not len(b):
            continue
        columns = {c: b[c].to_numpy() for c in b.columns}
        change = np.zeros(len(b) - 1, bool)
        for k in keys:
            change |= columns[k][1:] != columns[k][:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist()]
        for low, high in zip(edges, edges[1:], strict=False):
            yield {c: x[low:high] for c, x in columns.items()}
        carry = b.iloc[edges[-1] :]
    if carry is not None and len(carry):
        yield {c: carry[c].to_numpy() for c in carry.columns}


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a key in one partition, one after the other in the given order."""
    return df.repartition(*keys).sortWithinPartitions(*order)


#: A chain's rows, and its blocks with all that a block needs beside its rows.
KEYS = ["source", "block"]


def _up(df: DataFrame, column: str, combine: Callable[[list[list[float]]], list[float]]) -> DataFrame:
    """One level up the tree: the summaries of ``FAN`` blocks combined to that of their group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(r["source"][0], r["up"][0], combine(r[column].tolist())) for r in runs(batches, ["source", "up"])]
        yield pd.DataFrame(rows, columns=[*KEYS, column])

    grouped = df.withColumn("up", F.floor(F.col("block") / FAN))
    return in_order(grouped, ["source", "up"], ["source", "up", "block"]).mapInPandas(run, f"source STRING, block BIGINT, {column} ARRAY<DOUBLE>")


def _down(df: DataFrame, above: DataFrame | None, column: str, given: str, share: Callable[[list[list[float]], list[float]], list[list[float]]]) -> DataFrame:
    """One level down: what is given to a group (None: the whole chain) shared among its blocks."""
    grouped = df.withColumn("up", F.floor(F.col("block") / FAN) if above is not None else F.lit(0))
    if above is not None:
        grouped = grouped.join(above.select("source", F.col("block").alias("up"), F.col(given).alias("__given")), ["source", "up"])
    else:
        grouped = grouped.withColumn("__given", F.col("__start") if "__start" in df.columns else F.array(F.lit(-1.0), F.lit(-1.0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in runs(batches, ["source", "up"]):
            got = share(r[column].tolist(), list(r["__given"][0]))
            yield pd.DataFrame({"source": r["source"], "block": r["block"], given: got})

    slim = grouped.select("source", "up", "block", column, "__given")
    return in_order(slim, ["source", "up"], ["source", "up", "block"]).mapInPandas(run, f"source STRING, block BIGINT, {given} ARRAY<DOUBLE>")


def _sweep(blocks: DataFrame, column: str, given: str, n_blocks: int, combine: Callable, share: Callable) -> DataFrame:
    """(source, block, given): summaries combined up the tree, and shares handed down to every block."""
    floors = [blocks]
    while n_blocks > FAN:
        floors.append(cut(_up(floors[-1].select(*KEYS, column), column, combine)))
        n_blocks = -(-n_blocks // FAN) + 1
    top = floors[-1]
    if "__start" in blocks.columns and len(floors) > 1:
        top = top.join(blocks.select("source", "__start").distinct(), "source")
    out = _down(top, None, column, given, share)
    for below in reversed(floors[:-1]):
        out = _down(below.select(*KEYS, column), out, column, given, share)
    return out


def _combined_maps(maps: list[list[float]]) -> list[float]:
    a, b = 1.0, 0.0
    for x, y in maps:
        a, b = a * x, b * x + y
    return [a, b]


def _levels_through(maps: list[list[float]], given: list[float]) -> list[list[float]]:
    level, out = given[0], []
    for a, b in maps:
        out.append([level])
        level = a * level + b
    return out


def _matrix(flat: list[float]) -> np.ndarray:
    return np.asarray(flat, float).reshape(-1, K)


def _combined_matrices(rows: list[list[float]]) -> list[float]:
    """The product of matrices of K states and, below them, the scores from the start of the chain."""
    m = _matrix(rows[0])
    for x in rows[1:]:
        m = times(m, _matrix(x)[:K])
    return m.ravel().tolist()


def _states_through(rows: list[list[float]], given: list[float]) -> list[list[float]]:
    enter, leave = int(given[0]), int(given[1])
    path = through([_matrix(x) for x in rows], enter, leave)
    return [[float(a), float(b)] for a, b in zip([enter, *path[:-1]], path, strict=True)]


def unit_states(df: DataFrame, id_col: str = "id", source_col: str = "source_file", value_col: str = "value", unit_col: str = "unit", text_col: str = "exact_text") -> DataFrame:
    """(id, kind, value, stated_unit, unit, metres): the decoded unit and the metres of every record; NULL where no one distance is stated."""
    slim = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(value_col).cast("string").alias("v"), F.col(unit_col).alias("u"), F.col(text_col).alias("t"))
    key = slim.schema["id"].dataType.simpleString()

    def observed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [observation(*(x if isinstance(x, str) else None for x in r)) for r in zip(b["v"], b["u"], b["t"], strict=True)]
            yield pd.DataFrame({"id": b["id"], "source": b["source"], "value": [r[0] for r in rows], "stated_unit": [r[1] for r in rows], "kind": [r[2] for r in rows], "in_text": [r[3] for r in rows]})

    seen = cut(spread(slim, "id").mapInPandas(observed, f"id {key}, source STRING, value DOUBLE, stated_unit STRING, kind STRING, in_text BOOLEAN"))
    factors = F.create_map(*[x for u, f in METRES.items() for x in (F.lit(u), F.lit(f))])
    number = F.coalesce(F.array_position(F.array(*[F.lit(u) for u in UNITS]), F.col("stated_unit")) - 1, F.lit(-1)).cast("int")
    source = F.coalesce("source", F.lit("")).alias("source")
    chain = seen.where("kind = 'distance' and value is not null").select("id", source, "value", number.alias("stated"), "in_text")

    logs = seen.where("kind = 'distance' and stated_unit is not null and value > 0").select(source, F.log(F.col("value") * F.element_at(factors, F.col("stated_unit"))).alias("x"))
    quartiles = F.percentile_approx("x", [0.25, 0.5, 0.75], 10_000)
    every = logs.agg(quartiles.alias("a")).select(F.coalesce(F.col("a")[1], F.lit(UNKNOWN_LEVEL)).alias("a_level"), F.coalesce((F.col("a")[2] - F.col("a")[0]) / QUARTILES, F.lit(1.0)).alias("a_spread"))
    own = logs.groupBy("source").agg(F.count("x").alias("n"), quartiles.alias("q")).crossJoin(F.broadcast(every))
    around = F.greatest((F.col("n") * (F.col("q")[2] - F.col("q")[0]) / QUARTILES + PRIOR * F.col("a_spread")) / (F.col("n") + PRIOR), F.lit(LEAST_SPREAD))
    own = cut(own.select("source", F.col("q")[1].alias("level"), around.alias("spread")))
    none = every.first()
    own = own.select("source", F.col("level").alias("own_level"), F.col("spread").alias("own_spread"))
    place = F.floor(F.col("id") / BLOCK)
    sizes = chain.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    # A source of few records is one block; the ids of others part them into blocks, numbered from the first.
    few = F.col("n") <= BLOCK
    sources = cut(
        sizes.join(own, "source", "left").select(
            "source", "n", "first", F.when(few, 1).otherwise(F.col("last") - F.col("first") + 1).alias("width"), F.coalesce("own_level", F.lit(none["a_level"])).alias("start"), F.coalesce("own_spread", F.lit(max(none["a_spread"], LEAST_SPREAD))).alias("spread")
        )
    )
    total = sources.agg(F.sum("n"), F.max("width")).first()
    hot = [r[0] for r in sources.where((F.col("n") > LEAST) & (F.col("n") > SHARE * (total[0] or 0))).select("source").collect()]  # at most 1 / SHARE
    chain = skew_join(chain, sources, "source", hot=hot).withColumn("block", F.when(F.col("width") == 1, 0).otherwise(place - F.col("first")))
    chain = chain.withColumn("low", F.col("start") - REACH * F.col("spread")).withColumn("high", F.col("start") + REACH * F.col("spread")).drop("n", "first")
    chain = cut(chain)

    # Each block's level map, and how often the unit stays between stated neighbours.
    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for r in runs(batches, KEYS):
            said = r["stated"][r["stated"] >= 0]
            rows.append((r["source"][0], r["block"][0], list(level_map(r["value"], r["stated"], float(r["low"][0]), float(r["high"][0]))), max(0, len(said) - 1), int((said[1:] == said[:-1]).sum())))
        yield pd.DataFrame(rows, columns=[*KEYS, "map", "pairs", "same"])

    blocks = cut(in_order(chain, KEYS, [*KEYS, "id"]).mapInPandas(summaries, "source STRING, block BIGINT, map ARRAY<DOUBLE>, pairs BIGINT, same BIGINT"))
    moves = blocks.groupBy("source").agg(F.sum("pairs").alias("pairs"), F.sum("same").alias("same"))
    usual = moves.agg(F.coalesce(F.sum("same") / F.nullif(F.sum("pairs"), F.lit(0)), F.lit(0.9)).alias("a_stay"))
    stay = (F.col("same") + PRIOR * F.col("a_stay")) / (F.col("pairs") + PRIOR)
    moves = moves.crossJoin(F.broadcast(usual)).select("source", F.least(F.greatest(stay, F.lit(STAY[0])), F.lit(STAY[1])).alias("stay"))
    numbered = blocks.join(sources.select("source", F.array("start").alias("__start")), "source").select("source", "block", "map", "__start")
    entering = _sweep(numbered, "map", "level", total[1] or 0, _combined_maps, _levels_through)
    rows = skew_join(chain, moves, "source", hot=hot)
    short = rows.where("width = 1").withColumn("level", F.col("start"))
    long = cut(rows.where("width > 1").join(entering.select("source", "block", F.col("level")[0].alias("level")), KEYS))

    def scored(r: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        level = levels(r["value"], r["stated"], *(float(r[c][0]) for c in ("level", "low", "high")))
        return emissions(r["value"], r["stated"], r["in_text"].astype(bool), level, float(r["spread"][0])), switching(float(r["stay"][0]))

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for r in runs(batches, KEYS):
            e, switch = scored(r)
            start = _start_scores(e, switch) if r["block"][0] == 0 else np.full(K, -np.inf)
            out.append((r["source"][0], r["block"][0], np.vstack([transfer(e, switch), start]).ravel().tolist()))
        yield pd.DataFrame(out, columns=[*KEYS, "m"])

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, found = [], []
        for r in runs(batches, KEYS):
            e, switch = scored(r)
            ids += r["id"].tolist()
            found += decode(e, switch, int(r["ends"][0][0]), int(r["ends"][0][1]))
            if len(ids) > 10_000:
                yield pd.DataFrame({"id": ids, "unit": [UNITS[k] for k in found]})
                ids, found = [], []
        yield pd.DataFrame({"id": ids, "unit": [UNITS[k] for k in found]})

    summary = cut(in_order(long, KEYS, [*KEYS, "id"]).mapInPandas(matrices, "source STRING, block BIGINT, m ARRAY<DOUBLE>"))
    ends = _sweep(summary, "m", "ends", total[1] or 0, _combined_matrices, _states_through)
    both = short.withColumn("ends", F.array(F.lit(-1.0), F.lit(-1.0))).unionByName(long.join(ends, KEYS))
    states = in_order(both, KEYS, [*KEYS, "id"]).mapInPandas(decoded, f"id {key}, unit STRING").distinct()
    metres = F.col("value") * F.element_at(factors, F.col("unit"))
    return seen.join(states, "id", "left").select("id", "kind", "value", "stated_unit", "unit", F.bround(F.round(metres, 6)).cast("bigint").alias("metres"))


def _start_scores(e: np.ndarray, switch: np.ndarray) -> np.ndarray:
    """The best score to each leaving state of the first block of a chain."""
    score = e[0] - math.log(K)
    for row in e[1:]:
        score = (score[:, None] + switch).max(0) + row
    return score
