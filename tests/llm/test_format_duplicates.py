import itertools
import json
import random

import pytest

from tidewright.llm import format_duplicates as fd

SCHEMA = "id string, document_id string, category string, page_number int, exact_text string, context string, metadata string, kept_id string, c0 string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def found(spark, rows):
    return {tuple(r) for r in fd.format_copies(table(spark, rows)).collect()}


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Kıyı ÇİZGİSİ", "kiyi çizgisi", True),
        ("1.000 m", "1.000m", True),
        ("1.000 m", "1,000 m", False),
        ("1 2", "12", False),
        ("1. 2", "1.2", False),
        ("1  2", "1, 2", True),
        ("a-b", "a b", True),
        ("çay", "cay", False),
        ("STRASSE", "straße", True),
        ("İ", "i̇", True),
        ("“x”\t y", "x y", True),
        ("", "...", True),
        (None, "", False),
        (None, None, True),
    ],
)
def test_normalized_text(a, b, same):
    assert (fd.normalized_text(a) == fd.normalized_text(b)) == same


def test_groups(spark):
    m1, m2 = '{"a": 1, "b": "x"}', '{"b" : "x","a":1}'
    rows = [
        ("x3", "d", "c", 1, "Text one", "ctx", m1), ("x1", "d", "c", 1, "TEXT  one.", "(ctx)", m2), ("x2", "d", "c", 2, "text one", "ctx", m1), ("x4", "d", "c", 1, "text one", "ctx", '{"a": 1, "b": "y"}'),
        ("x5", None, None, None, None, None, None), ("x6", None, None, None, None, None, None), ("x7", None, None, None, "", None, None), ("x8", "d", "c", 1, "t", "c", "{broken"), ("x9", "d", "c", 1, "T", "c", "{ broken"),
    ]
    assert found(spark, rows) == {("x1", "x3"), ("x5", "x6"), ("x8", "x9")}
    assert found(spark, []) == set()
    kept = {tuple(r) for r in fd.collapse(table(spark, rows)).collect()}
    assert ("x1", 2) in kept and ("x2", 1) in kept and len(kept) == 6


def test_repeated_rows_and_long_texts(spark):
    long = "word " * 50_000
    rows = [("a", "d", "c", 1, long, "c", None), ("b", "d", "c", 1, long.upper(), "c", None), ("b", "d", "c", 1, long.upper(), "c", None)]
    assert found(spark, rows) == {("a", "b")}


def brute(rows):
    def key(r):
        pairs = None if r[6] is None else tuple(sorted(map(repr, json.loads(r[6]).items())))
        return (*r[1:4], fd.normalized_text(r[4]), fd.normalized_text(r[5]), pairs)

    out = set()
    for _, g in itertools.groupby(sorted(rows, key=lambda r: repr(key(r))), key=lambda r: repr(key(r))):
        ids = sorted(r[0] for r in g)
        out |= {(ids[0], i) for i in ids[1:]}
    return out


def test_hot_group_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fd, "LEAST", 100)
    rng = random.Random(7)

    def row(i):
        hot = rng.random() < 0.4
        text = "same text" if hot else " ".join(rng.choice("abc") for _ in range(4))
        items = [("k", 1), ("l", None if hot else rng.randrange(2))]
        rng.shuffle(items)
        dress = rng.choice([str.upper, str.title, lambda s: s.replace(" ", " \t"), lambda s: f"“{s}”."])
        return (f"x{i:05}", "d", "c", 1, dress(text), dress("ctx"), json.dumps(dict(items)))

    rows = [row(i) for i in range(1500)]
    assert found(spark, rows) == brute(rows)


def test_sql_oracle(spark, small):
    import duckdb

    from tidewright.llm import queries

    con = duckdb.connect()
    con.execute(f"create view extractions as select * from '{small}/extractions.parquet'")
    want = set(con.execute(queries.P2_FOUND).fetchall())
    assert want and {tuple(r) for r in queries.p2_found(spark, small).collect()} == want
