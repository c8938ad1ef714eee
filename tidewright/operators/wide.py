"""Problem 4: entity-attribute-value rows into one typed row per entity.

``combineByKey`` keeps one register per entity, a slot per column. A cell is encoded to its column's type as soon as it
is read; two cells for one slot are merged by an associative and commutative rule (a value before none, then the
smaller one), so duplicates are resolved on the map side and only registers are shuffled, also for an entity that holds
a large share of the rows. Python's merger spills registers to disk when memory runs short.

Defined results: a value that is NULL, blank, stands for "missing" or does not convert to its type is an empty cell; an
entity without any cell, a NULL entity and unreadable metadata give no row, or a row of empty cells if ``keep_empty``;
attributes outside the schema are ignored; repeated rows change nothing; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

from pyspark.rdd import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.metadata import metadata_pairs

#: Entities per shuffle partition: some hundred bytes of register each.
PARTITION_ENTITIES = 200_000
#: Attributes by category, STRING unless given. Fixed values.
CATEGORIES: dict[str, dict[str, str]] = {
    category: dict((x.split(":") + ["string"])[:2] for x in columns.split())
    for category, columns in {
        "distance": "activity value:double unit qualifier reference_point is_range:boolean",
        "species": "species_name scientific_name protection_status",
        "penalty": "penalty_type amount:double currency violation duration",
        "method": "method_type tools_used sample_size:int",
        "legal_reference": "reference_type law_number:int article_number:int title",
        "coordinate": "latitude:double longitude:double coordinate_system",
        "temporal": "restriction_type start_date end_date activity",
        "permit": "permit_type issuing_authority activity",
        "protected_area": "area_type name designation",
        "conflict": "conflict_type activity_1 activity_2 severity",
        "data_source": "source_type source_name temporal_coverage resolution:double",
        "prohibition": "prohibition_type activity scope",
        "environmental": "condition_type value:double unit",
        "stakeholder": "stakeholder_name stakeholder_type role",
        "objective": "objective_type objective_text study_area",
        "gap": "gap_type gap_description severity",
        "finding": "finding_type quantitative_result:double significance:boolean",
    }.items()
}
#: Texts that only stand for a missing value, fixed values.
MISSING = frozenset(("", "-", "--", "–", "—", "?", ".", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "unknown", "missing", "not available", "not specified", "unspecified", "yok", "bilinmiyor", "belirtilmemiş", "boş"))
TRUE = frozenset(("true", "yes", "y", "t", "1", "evet", "doğru", "var"))
FALSE = frozenset(("false", "no", "n", "f", "0", "hayır", "hayir", "yanlış", "yanlis", "yok"))
APART = re.compile(r"[\W_]+")
NUMBER = re.compile(r"[+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?")
GROUPED = re.compile(r"[+-]?\d{1,3}(?:,\d{3})+\.\d+|[+-]?\d{1,3}(?:\.\d{3})+,\d+|[+-]?\d{1,3}(?:[.,]\d{3}){2,}")


def attribute_key(name: str) -> str:
    """The letters and digits of an attribute's name in lower case: the same for every way of parting its words."""
    return APART.sub("", name.replace("İ", "i").lower())


def to_string(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    text = " ".join(str(value).split())
    return None if text.lower() in MISSING else text


def to_double(value: object) -> float | None:
    if value is None or isinstance(value, (bool, list)):
        return None
    if isinstance(value, str):
        text = value.strip().replace("−", "-")
        if GROUPED.fullmatch(text):
            decimal = text[max(text.rfind("."), text.rfind(","))]
            whole = len(set(re.findall("[.,]", text))) == 1
            text = re.sub("[.,]", "", text) if whole else text.replace("," if decimal == "." else ".", "").replace(",", ".")
        if not NUMBER.fullmatch(text):
            return None
        value = text.replace(",", ".")
    try:
        number = float(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return number if math.isfinite(number) else None


def to_int(value: object) -> int | None:
    number = to_double(value)
    return int(number) if number is not None and number == int(number) and abs(number) < 2**31 else None


def to_boolean(value: object) -> bool | None:
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return bool(value) if value in (0, 1) else None
    if isinstance(value, str):
        text = value.strip().replace("İ", "i").lower()
        return True if text in TRUE else False if text in FALSE else None
    return None


ENCODERS = {"string": to_string, "double": to_double, "int": to_int, "boolean": to_boolean}


def merged(a: object, b: object) -> object:
    """One of two cells: a value before none, then the smaller; associative and commutative."""
    if a is None:
        return b
    return a if b is None else min(a, b)


def wide_rows(cells: RDD, n_slots: int, partitions: int | None = None) -> RDD:
    """(entity, register) of (entity, (slot, encoded value)) rows; registers are lists with a place per slot."""

    def create(cell: tuple[int, object]) -> list:
        register = [None] * n_slots
        register[cell[0]] = cell[1]
        return register

    def merge_value(register: list, cell: tuple[int, object]) -> list:
        register[cell[0]] = merged(register[cell[0]], cell[1])
        return register

    def merge_registers(a: list, b: list) -> list:
        for i, x in enumerate(b):
            if x is not None:
                a[i] = merged(a[i], x)
        return a

    return cells.combineByKey(create, merge_value, merge_registers, partitions)


def wide_schema(categories: dict[str, dict[str, str]] = CATEGORIES) -> dict[str, str]:
    """The union of all categories' columns, which agree in type."""
    columns: dict[str, str] = {}
    for own in categories.values():
        for name, kind in own.items():
            if columns.setdefault(name, kind) != kind:
                raise ValueError(f"two types for {name}")
    return columns


def wide_table(df: DataFrame, id_col: str = "id", category_col: str = "category", metadata_col: str = "metadata", categories: dict[str, dict[str, str]] = CATEGORIES) -> DataFrame:
    """One row per entity with (id, category, typed columns of all categories); NULL where its category has no such column."""
    columns = wide_schema(categories)
    slot = {name: i + 1 for i, name in enumerate(columns)}  # slot 0 holds the category
    own = {c: {attribute_key(name): (slot[name], ENCODERS[kind]) for name, kind in cols.items()} for c, cols in categories.items()}
    names: dict[str, str] = {}

    def cells(rows: Iterable) -> Iterator[tuple[object, tuple[int, object]]]:
        for entity, category, metadata in rows:
            slots = own.get(category)
            if slots is None or entity is None:
                continue
            yield entity, (0, category)
            for name, value in metadata_pairs(metadata) or ():
                if len(names) > 100_000:
                    names.clear()
                low = names.get(name)
                if low is None:
                    low = names[name] = attribute_key(name)
                if low in slots:
                    at, encode = slots[low]
                    cell = encode(value)
                    if cell is not None:
                        yield entity, (at, cell)

    slim = df.select(F.col(id_col), F.col(category_col), F.col(metadata_col)).where(F.col(metadata_col).isNotNull())
    partitions = max(df.sparkSession.sparkContext.defaultParallelism, slim.count() // PARTITION_ENTITIES)
    rdd = slim.rdd.map(tuple)
    rows = wide_rows(rdd.mapPartitions(cells), len(columns) + 1, partitions).map(lambda kv: (kv[0], *kv[1]))
    kinds = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
    schema = T.StructType([T.StructField("extraction_id", slim.schema[id_col].dataType), T.StructField("category", T.StringType()), *[T.StructField(n, kinds[k]) for n, k in columns.items()]])
    return df.sparkSession.createDataFrame(rows, schema, verifySchema=False)


def category_table(wide: DataFrame, category: str, categories: dict[str, dict[str, str]] = CATEGORIES) -> DataFrame:
    """The rows and columns of one category."""
    return wide.where(F.col("category") == category).select("extraction_id", *categories[category])


def filled_cells(wide: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(extraction_id, attribute): one row for each non-NULL cell."""
    columns = list(columns or wide_schema())
    names = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return wide.select("extraction_id", F.explode(names).alias("attribute"))
