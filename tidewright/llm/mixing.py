"""Problem 8: combine sources so that each holds its target share of all tokens.

The mixture is a schedule of slots, each for one block of equally many tokens. Slot i belongs to the source in
whose interval of the cumulative target shares the i-th golden-ratio point lies; such points are of low discrepancy,
so any stretch of the schedule holds nearly the target shares. A source's documents, shuffled anew by a hash for each
repetition, are laid end to end; their token offsets cut them into blocks, and the r-th block of a source goes to the
r-th of its slots.

The size of the mixture is the largest at which no source is used more than its ``max_repeats`` times. Offsets and
ranks are prefix sums in two levels (within buckets of bounded size, then over buckets), so that no source, however
large, is ordered in one task; texts are only read to be counted and never shuffled.

Defined results: NULL or empty texts have no tokens and are left out, as are sources without a target; a target without
documents, or with a share or cap of 0 or NULL, contributes nothing, and the others keep their proportions; repeated
rows are documents of their own; ties of the shuffle go by document id; extra columns are ignored; empty tables give an
empty mixture.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.skew import cut
from tidewright.sources.tables import spread

#: The published pattern of the byte-level vocabulary, a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BUCKET_ROWS = 4000
#: Tokens of a block, whatever the size of the mixture.
BLOCK_TOKENS = 256
GOLDEN = 0.6180339887498949


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("source",), path: str = RANKS) -> DataFrame:
    """(id, kept columns, n_tokens) of every document with tokens; whole texts, in Arrow batches."""
    slim = documents.select(id_col, *keep, F.col(text_col).alias("__text")).where("__text is not null and __text <> ''")
    schema = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in (id_col, *keep))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = encoding(path).encode_ordinary
        for b in batches:
            out = b[[id_col, *keep]].copy()
            out["n_tokens"] = [len(count(t)) for t in b["__text"]]
            yield out

    return spread(slim, id_col).mapInPandas(counted, f"{schema}, n_tokens BIGINT")


def plan(counts: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, total_tokens: int | None = None) -> list[dict]:
    """Per source of the (fixed, small) target table: tokens, documents, share among the sources that have any, blocks."""
    sizes = counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = [r.asDict() for r in F.broadcast(wanted).join(sizes, "source", "left").orderBy("source").collect()]
    usable = [r for r in rows if r["tokens"] and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
    weight = sum(r["target_share"] for r in usable)
    for r in rows:
        r["share"] = r["target_share"] / weight if r in usable else 0.0
    most = min((r["max_repeats"] * r["tokens"] / r["share"] for r in usable), default=0)
    size = min(most, total_tokens) if total_tokens else most
    for r in rows:
        r["block"] = block_tokens
        r["slots"] = int(size // block_tokens) if size >= block_tokens else int(size > 0)
        r["size"] = size
    return rows


def schedule(spark, rows: list[dict]) -> DataFrame:
    """(slot, source, rank): the source of every slot and how many slots the source had before."""
    n = rows[0]["slots"] if rows else 0
    u = F.col("slot") * F.lit(GOLDEN)
    u = u - F.floor(u)
    source = F.lit(None).cast("string")
    edge = 1.0
    for r in sorted((r for r in rows if r["share"] > 0), key=lambda r: r["source"], reverse=True):
        edge -= r["share"]
        source = F.when(u < edge + r["share"], F.lit(r["source"])).otherwise(source) if source is not None else F.lit(r["source"])
    slots = spark.range(n).select(F.col("id").alias("slot"), source.alias("source"), (F.col("id") / BUCKET_ROWS).cast("bigint").alias("__b"))
    counts = slots.groupBy("source", "__b").agg(F.count(F.lit(1)).alias("__n"))
    above = counts.select("source", "__b", F.coalesce(F.sum("__n").over(Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__above"))
    within = F.row_number().over(Window.partitionBy("source", "__b").orderBy("slot")) - 1
    return slots.withColumn("__in", within).join(above, ["source", "__b"]).select("slot", "source", (F.col("__above") + F.col("__in")).alias("rank"))


def mixture(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, block_tokens: int = BLOCK_TOKENS, total_tokens: int | None = None) -> DataFrame:
    """(slot, source, id, repetition, n_tokens): which documents stand in which slot of the mixture."""
    spark = documents.sparkSession
    counts = cut(token_counts(documents, id_col, text_col, ("source",), path))
    rows = plan(counts, targets, block_tokens, total_tokens)
    if not rows or not rows[0]["size"]:
        return spark.createDataFrame([], f"slot BIGINT, source STRING, {id_col} {counts.schema[id_col].dataType.simpleString()}, repetition INT, n_tokens BIGINT")
    small = spark.createDataFrame(
        [(r["source"], r["tokens"], max(1, -(-r["documents"] // BUCKET_ROWS)), min(r["max_repeats"], int(r["share"] * r["size"] // r["tokens"]) + 2)) for r in rows if r["share"] > 0],
        "source STRING, __total BIGINT, __buckets BIGINT, __epochs INT",
    )
    laid = counts.join(F.broadcast(small), "source").withColumn("repetition", F.explode(F.sequence(F.lit(0), F.col("__epochs") - 1)))
    laid = laid.withColumn("__h", F.xxhash64(F.col(id_col), F.col("repetition"))).withColumn("__b", F.pmod(F.col("__h"), F.col("__buckets")))
    parts = ["source", "repetition"]
    sums = laid.groupBy(*parts, "__b").agg(F.sum("n_tokens").alias("__n"))
    above = sums.select(*parts, "__b", F.coalesce(F.sum("__n").over(Window.partitionBy(*parts).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__above"))
    inside = Window.partitionBy(*parts, "__b").orderBy("__h", id_col).rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.withColumn("__in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(above, [*parts, "__b"])
    offset = F.col("repetition") * F.col("__total") + F.col("__above") + F.col("__in")
    placed = placed.select("source", id_col, F.col("repetition").cast("int").alias("repetition"), "n_tokens", F.floor(offset / F.lit(rows[0]["block"])).alias("rank"))
    return schedule(spark, rows).join(placed, ["source", "rank"]).select("slot", "source", id_col, "repetition", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_documents, most_used, max_repeats) of a mixture."""
    used = mixed.groupBy("source", id_col).agg(F.count(F.lit(1)).alias("__k"), F.sum("n_tokens").alias("__n"))
    got = used.groupBy("source").agg(F.sum("__n").alias("n_tokens"), F.sum("__k").alias("n_documents"), F.max("__k").alias("most_used"))
    total = got.agg(F.sum("n_tokens").alias("__all"))
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        wanted.join(got, "source", "left")
        .crossJoin(F.broadcast(total))
        .select("source", "target_share", F.coalesce(F.col("n_tokens") / F.col("__all"), F.lit(0.0)).alias("actual_share"), zero("n_tokens"), zero("n_documents"), zero("most_used"), "max_repeats")
    )
