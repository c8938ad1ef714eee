import json

from tidewright.sources import ingest


def test_result_layouts(spark, tmp_path):
    item = {"exact_text": "Zostera", "context": "c", "page_number": 2, "confidence": 0.5, "species_name": "Z"}
    files = {
        "keyed.json": {"filename": "a.pdf", "doc_type": "legal", "extractions": {"species": [item, item], "methods": item}},
        "flat.json": {"extractions": [item | {"category": "mpas"}, item]},
        "top.json": {"filename": "b.pdf", "species": [item], "extractions": {}},
        "broken.json": None,
    }
    for name, data in files.items():
        (tmp_path / name).write_text("{broken" if data is None else json.dumps(data))
    rows = ingest.result_files(spark, str(tmp_path)).collect()
    got = sorted((r["filename"], r["category"], r["page_number"], r["confidence"]) for r in rows)
    assert got == sorted([("a.pdf", "species", 2, 0.5)] * 2 + [("a.pdf", "method", 2, 0.5), ("flat.json", "protected_area", 2, 0.5), ("flat.json", "uncategorised", 2, 0.5), ("b.pdf", "species", 2, 0.5)])
    assert all(json.loads(r["metadata"]) == {"species_name": "Z"} for r in rows)


def test_annotated_csv(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('﻿id,exact_text,is_correct\n1,"two\nlines, ""quoted""",y\n2,,n\n', encoding="utf-8")
    rows = ingest.annotated_csv(spark, str(p)).collect()
    assert [tuple(r) for r in rows] == [("1", 'two\nlines, "quoted"', "y"), ("2", None, "n")]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "x,\n\"y\""), (2, None, None)], "id int, tags array<string>, t string")
    ingest.write_csv(df, str(tmp_path / "csv"))
    back = {r["id"]: r for r in ingest.annotated_csv(spark, str(tmp_path / "csv")).collect()}
    assert back["1"]["tags"] == '["a","b"]' and back["1"]["t"] == 'x,\n"y"'
    ingest.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    ingest.write_store({"extractions": spark.createDataFrame([("a", "c1")], "id string, category string")}, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store/extractions.parquet")).first()["category"] == "c1"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.txt").write_text("hello")
    assert ingest.text_files(spark, str(tmp_path / "d")).first()["text"] == "hello"
    assert "<table>" in ingest.html_report([("a", 3), ("b", 0)]) and ingest.html_report([])


def test_stream_ingest_is_once(spark, tmp_path):
    from tidewright.streaming.ingest import ingest as stream

    docs = spark.createDataFrame([(1, "The salinity of 3.5 ppt was read at the pier. Anchoring is prohibited in the No-Take Zone of X.", "legal")], "doc_id bigint, text string, doc_type string")
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream(spark, str(tmp_path / "in"), docs.schema.simpleString()[7:-1].replace(":", " "), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    facts = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out"))
    assert facts.count() == facts.select("fact").distinct().count() > 1
