import json
import random

import pytest

from tidewright.operators import wide

SCHEMA = "id string, category string, metadata string, extraction_id string, attribute string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def cells(spark, rows):
    return {tuple(r) for r in wide.filled_cells(wide.wide_table(table(spark, rows))).collect()}


def test_layouts_spellings_and_types(spark):
    rows = [
        ("a", "distance", '{"activity": "x", "value": "1,5", "Is Range": "evet", "referencePoint": " r "}'),
        ("b", "method", '[{"attribute": "SAMPLE_SIZE", "value": "12.0"}, {"attribute": "tools-used", "value": "n/a"}]'),
        ("c", "finding", '[["significance", 0], ["quantitative_result", "see text"]]'),
        ("d", "permit", json.dumps(json.dumps({" Permit Type ": "y", "activity": None}))),
        ("e", "gap", '{"fields": {"gapType": "z", "other": "ignored"}}'),
    ]
    got = {r["extraction_id"]: r for r in wide.wide_table(table(spark, rows)).collect()}
    assert (got["a"]["value"], got["a"]["is_range"], got["a"]["reference_point"]) == (1.5, True, "r")
    assert (got["b"]["sample_size"], got["b"]["tools_used"]) == (12, None)
    assert (got["c"]["significance"], got["c"]["quantitative_result"]) == (False, None)
    assert (got["d"]["permit_type"], got["d"]["activity"]) == ("y", None)
    assert got["e"]["gap_type"] == "z"


def test_nulls_broken_empty_and_repeated(spark):
    rows = [("a", "species", None), (None, "species", '{"species_name": "x"}'), ("b", None, '{"species_name": "x"}'), ("c", "species", "{broken"), ("d", "species", '"text"'), ("e", "unknown", '{"species_name": "x"}')]
    assert cells(spark, rows) == set()
    assert cells(spark, []) == set()
    twice = [("f", "species", '{"species_name": "x", "speciesName": "", "SPECIES_NAME": null}')] * 3
    assert cells(spark, twice) == {("f", "species_name")}
    long = "y" * 200_000
    assert cells(spark, [("g", "species", json.dumps({"species_name": long}))]) == {("g", "species_name")}


def test_hot_entity_against_brute_force(spark):
    rng = random.Random(1)
    names = list(wide.CATEGORIES["coordinate"])
    rows = [("hot" if rng.random() < 0.4 else f"e{rng.randrange(50)}", "coordinate", json.dumps({rng.choice(names): rng.choice(["1", "-", None, "2,5", "x"])})) for _ in range(3000)]
    want = {(e, n) for e, _, m in rows for n, v in json.loads(m).items() if wide.ENCODERS[wide.CATEGORIES["coordinate"][n]](v) is not None}
    assert cells(spark, rows) == want


@pytest.mark.parametrize(("value", "want"), [("1.234,5", 1234.5), ("1,234.5", 1234.5), ("1.234.567", 1234567.0), ("13,0", 13.0), ("-2", -2.0), ("1e3", 1000.0), ("12 m", None), (True, None), ("nan", None), ([1], None), ("", None), (10**400, None)])
def test_double(value, want):
    assert wide.to_double(value) == want


def test_merge_is_commutative_and_associative():
    values = [None, "a", "b", "c"]
    for a in values:
        for b in values:
            assert wide.merged(a, b) == wide.merged(b, a)
            for c in values:
                assert wide.merged(wide.merged(a, b), c) == wide.merged(a, wide.merged(b, c))


def test_attribute_spellings():
    """However the words of a name are parted, and whatever its case, it is one attribute."""
    for name in ("activity_1", "activity1", "Activity 1", "ACTIVITY-1", "activity.1", "Activity_1"):
        assert wide.attribute_key(name) == "activity1"
    for name in ("law_number", "lawNumber", "LAW NUMBER", "Law-Number", "lawnumber"):
        assert wide.attribute_key(name) == "lawnumber"
    assert len({wide.attribute_key(n) for n in wide.wide_schema()}) == len(wide.wide_schema())


def test_cells_of_numbered_names(spark):
    df = spark.createDataFrame([("a", "conflict", '{"activity1": "x", "Activity2": "y"}', "", "")], SCHEMA)
    assert {r["attribute"] for r in wide.filled_cells(wide.wide_table(df)).collect()} == {"activity_1", "activity_2"}
