"""The pN_ queries of the operators in the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.operators.units import unit_states
from tidewright.operators.wide import CATEGORIES, FALSE, MISSING, TRUE, filled_cells, wide_schema, wide_table
from tidewright.sources.tables import table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return filled_cells(wide_table(table(spark, sf, "extractions")))


def p4_wide(spark: SparkSession, sf: str) -> DataFrame:
    return wide_table(table(spark, sf, "extractions"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    found = unit_states(table(spark, sf, "validate_distance")).where("metres is not null")
    return found.selectExpr("cast(id as bigint) as id", "metres").distinct()


def p5_units(spark: SparkSession, sf: str) -> DataFrame:
    return unit_states(table(spark, sf, "validate_distance"))


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p4_wide, p5_found, p5_units)}


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(values))


_COLUMNS = ", ".join(f"('{c}', '{name}', '{kind}')" for c, columns in CATEGORIES.items() for name, kind in columns.items())
#: The cells of the wide table: (id, category, attribute, want, kind, v) of all readable pairs that are columns.
#: Numbers with both separators do not occur in the tables; the operator's tests cover them.
_CELLS = f"""with j as (select id, category, try_cast(metadata as json) as m from extractions where metadata is not null),
        u as (select id, category, case when json_type(m) = 'VARCHAR' then try_cast(m ->> '$' as json) else m end as m from j),
        f as (select id, category, case when json_type(m) = 'OBJECT' and json_array_length(to_json(json_keys(m))) = 1 and json_keys(m)[1] = 'fields' then m -> '$.fields' else m end as m from u),
        o as (select id, category, m, unnest(json_keys(m)) as n from f where json_type(m) = 'OBJECT'),
        a as (select id, category, unnest(from_json(m, '["JSON"]')) as e from f where json_type(m) = 'ARRAY'),
        p as (select id, category, n, m -> ('$."' || n || '"') as v from o
            union all select id, category, case when json_type(e) = 'OBJECT' then e ->> '$.attribute' else e ->> '$[0]' end, case when json_type(e) = 'OBJECT' then e -> '$.value' else e -> '$[1]' end from a),
        t as (select id, category, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') as attribute, json_type(v) as kind, trim(v ->> '$', ' ') as v from p),
        c as (select t.id, t.kind, t.v, x.attribute, x.kind as want from t join (values {_COLUMNS}) x(category, attribute, kind) on t.category = x.category and t.attribute = replace(x.attribute, '_', '') where v is not null and t.kind <> 'NULL')"""
_NUM = "case when kind <> 'BOOLEAN' then try_cast(replace(v, ',', '.') as double) end"
_TYPED = {
    "string": f"case when lower(v) not in ({_list(MISSING)}) then regexp_replace(v, '\\s+', ' ', 'g') end",
    "double": _NUM,
    "int": f"case when {_NUM} = floor({_NUM}) then ({_NUM})::int end",
    "boolean": f"case when kind = 'BOOLEAN' then v = 'true' when lower(v) in ({_list(TRUE)}) then true when lower(v) in ({_list(FALSE)}) then false end",
}


def _wide() -> str:
    cells = ", ".join(f"min(case when attribute = '{n}' then {_TYPED[k]} end) as {n}" for n, k in wide_schema().items())
    return f"""{_CELLS}, w as (select id, {cells} from c group by id)
        select e.id as extraction_id, e.category, w.* exclude (id) from (select id, category from extractions where metadata is not null and category in ({_list(CATEGORIES)})) e left join w on e.id = w.id"""


ORACLES = {
    "p4_wide": _wide(),
    "p4_found": f"""{_CELLS}
        select distinct id as extraction_id, attribute from c where case want when 'string' then lower(v) not in ({_list(MISSING)})
            when 'boolean' then kind = 'BOOLEAN' or lower(v) in ({_list(TRUE | FALSE)})
            when 'double' then kind <> 'BOOLEAN' and try_cast(replace(v, ',', '.') as double) is not null
            else kind <> 'BOOLEAN' and try_cast(replace(v, ',', '.') as double) = floor(try_cast(replace(v, ',', '.') as double)) end""",
}
