"""Problem 2: records that are identical but for formatting.

Every normalized (field name, value) pair is hashed, the hashes are combined with a commutative sum (a multiset
hash, so that neither field order nor attribute order matters and nothing is sorted), rows are grouped by the
128-bit fingerprint, and the members of each group are held against its kept record, field by field.

Normalization and hashing run in Arrow batches. Only the fingerprints of all rows are counted, pre-aggregated on the
map side. Smallest ids are found by hashing too: per batch, then per fingerprint. Only texts whose id passes a filter of
the members' ids (one hashed bit each, of a table of at most ``FILTER_WORDS`` words; a full table passes more, never
less) are shuffled. All joins are hash joins. Members of a group that holds a large share of the rows are verified
against a broadcast copy of its one kept record (``skew_join``).

Defined results: NULL equals only NULL; a text of only punctuation and white space equals an empty one but not NULL;
unreadable JSON is compared as its text; repeated ids, which the data model excludes, count as one record; columns
not named are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.metadata import metadata_pairs
from tidewright.llm.vocabulary import fold
from tidewright.operators.skew import LEAST, SHARE, cut, skew_join
from tidewright.sources.tables import spread

FLUSH = 500_000
#: Letters that upper case writes as two, those two.
DOUBLE = (("ß", "ss"), ("ẞ", "ss"), ("ﬁ", "fi"), ("ﬂ", "fl"))
APART = re.compile(r"(?<=\d)(?:[\W_]{2,}|\s)(?=\d)")
MARKS = re.compile(r"(?<!\d)[\W_]+|[\W_]+(?!\d)")


def normalized_text(text: str | None) -> str | None:
    """Letters and numbers only, in one case; a single mark directly between two digits stays, numbers stay apart."""
    if text is None:
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        for old, new in DOUBLE:
            text = text.replace(old, new)
    return MARKS.sub("", APART.sub("\x01", fold(text)))


def _attributes(text: str | None) -> Counter | None:
    """The multiset of (name, value) pairs; a readable value counts by its JSON type too."""
    if text is None:
        return None
    pairs = metadata_pairs(text)
    if pairs is None:
        return Counter({("", "".join(text.split())): 1})
    return Counter((name, repr(value)) for name, value in pairs)


def fingerprint(exact: list, texts: list, attributes: list) -> bytes:
    """Sum of the 128-bit hashes of all (field, value) pairs, modulo 2 to the 128."""
    h = xxhash.xxh3_128_intdigest
    total = 0
    for i, value in enumerate(exact):
        total += h(f"e{i}\x00{value!r}")
    for i, value in enumerate(texts):
        total += h(f"t{i}\x00" + ("\x02" if value is None else value))
    for i, value in enumerate(attributes):
        if value is None:
            total += h(f"a{i}\x02")
        else:
            for (name, one), n in value.items():
                total += n * h(f"a{i}\x00{name}\x00{one}")
            total += h(f"a{i}\x01{sum(value.values())}")
    return (total % (1 << 128)).to_bytes(16, "big")


#: Words of 64 bits in the filter of ids, at most; and bits per id below that.
FILTER_WORDS, BITS = 1 << 21, 16


def _smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The smallest id of each fingerprint, over all batches of a task."""
    least: dict[bytes, object] = {}
    for b in batches:
        for f, i in zip(b["__f"], b["kept_id"], strict=True):
            if f not in least or i < least[f]:
                least[f] = i
        if len(least) > FLUSH:
            yield pd.DataFrame({"__f": list(least), "kept_id": list(least.values())})
            least = {}
    yield pd.DataFrame({"__f": list(least), "kept_id": list(least.values())})


def _least_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """As :func:`_smallest`, for a task that holds all rows of its fingerprints."""
    least: dict[bytes, object] = {}
    for b in batches:
        for f, i in zip(b["__f"], b["kept_id"], strict=True):
            if f not in least or i < least[f]:
                least[f] = i
    yield pd.DataFrame({"__f": list(least), "kept_id": list(least.values())})


def with_ids(df: DataFrame, id_col: str, ids: DataFrame, n: int) -> DataFrame:
    """The rows of ``df`` whose id may be one of ``ids`` (about ``n`` values): all that are, and few others."""
    words = 1024
    while words < FILTER_WORDS and words * 64 < n * BITS:
        words *= 2
    h = F.xxhash64(F.col(id_col))
    place, bit = F.pmod(F.shiftright(h, 6), F.lit(words)).alias("__w"), F.expr(f"shiftleft(1L, cast(xxhash64(`{id_col}`) & 63L as int))")
    table = ids.select(place, bit.alias("__b")).groupBy("__w").agg(F.bit_or("__b").alias("__bits"))
    return df.withColumn("__w", place).join(F.broadcast(table), "__w").where(F.col("__bits").bitwiseAND(bit) != 0).drop("__w", "__bits")


def _plain(value: object) -> object:
    return None if value is None or value is pd.NA or value != value else value


def format_copies(
    df: DataFrame,
    id_col: str = "id",
    exact: tuple[str, ...] = ("document_id", "category", "page_number"),
    texts: tuple[str, ...] = ("exact_text", "context"),
    attributes: tuple[str, ...] = ("metadata",),
) -> DataFrame:
    """(kept_id, copy_id): for each group of records equal but for formatting, every id but the smallest."""
    n_exact, n_texts, n_attributes = len(exact), len(texts), len(attributes)
    n = n_exact + n_texts + n_attributes
    # Exact fields travel as strings: their equality is that of the typed values.
    raw = df.select(F.col(id_col).alias("__id"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate([*exact, *texts, *attributes])])
    key_type = raw.schema["__id"].dataType.simpleString()

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            columns = [[_plain(v) for v in b[f"c{i}"]] for i in range(n)]
            prints = [
                fingerprint(list(row[:n_exact]), [normalized_text(t) for t in row[n_exact : n_exact + n_texts]], [_attributes(a) for a in row[n_exact + n_texts :]])
                for row in zip(*columns, strict=True)
            ]
            yield pd.DataFrame({"__id": b["__id"], "__f": prints})

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [True] * len(b)
            for i in range(n):
                form = (lambda x: x) if i < n_exact else normalized_text if i < n_exact + n_texts else _attributes
                for j, (k, m) in enumerate(zip(b[f"c{i}"], b[f"m{i}"], strict=True)):
                    k, m = _plain(k), _plain(m)
                    good[j] = good[j] and (k == m or form(k) == form(m))
            yield b.loc[good, ["kept_id", "copy_id"]]

    keyed = cut(spread(raw, "__id").mapInPandas(hashed, f"__id {key_type}, __f binary"))
    groups = keyed.groupBy("__f").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    hot = [r[0] for r in groups.where((F.col("__n") > LEAST) & (F.col("__n") > SHARE * keyed.count())).select("__f").collect()]  # at most 1 / SHARE
    member = cut(skew_join(keyed, groups.select("__f"), "__f", hot=hot))
    pair = f"__f binary, kept_id {key_type}"
    least = member.select("__f", F.col("__id").alias("kept_id")).mapInPandas(_smallest, pair).repartition("__f").mapInPandas(_least_ids, pair)
    ids = cut(skew_join(member, least, "__f", hot=hot).select("kept_id", "__id").distinct())
    n_members = ids.count()
    texts = cut(with_ids(raw, "__id", ids, n_members).join(ids.hint("shuffle_hash"), "__id"))
    kept = texts.where("__id = kept_id").drop("__id")
    copies = texts.where("__id <> kept_id").select("kept_id", F.col("__id").alias("copy_id"), *[F.col(f"c{i}").alias(f"m{i}") for i in range(n)])
    held = skew_join(copies, kept, "kept_id")
    return held.mapInPandas(verified, f"kept_id {key_type}, copy_id {key_type}")


def collapse(df: DataFrame, id_col: str = "id", **options: tuple[str, ...]) -> DataFrame:
    """One row per distinct record: its kept id and ``n_copies``, how many records it stands for (itself included)."""
    pairs = format_copies(df, id_col, **options)
    tagged = pairs.select(F.col("kept_id").alias(id_col), F.lit(1).alias("__c"), F.lit(0).alias("__gone")).unionByName(
        pairs.select(F.col("copy_id").alias(id_col), F.lit(0).alias("__c"), F.lit(1).alias("__gone"))
    )
    every = df.select(id_col, F.lit(0).alias("__c"), F.lit(0).alias("__gone")).unionByName(tagged)
    counts = every.groupBy(id_col).agg(F.sum("__c").alias("__c"), F.max("__gone").alias("__gone"))
    return counts.where("__gone = 0").select(id_col, (F.col("__c") + 1).alias("n_copies"))
