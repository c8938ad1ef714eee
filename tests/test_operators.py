import datetime
import random

from pyspark.sql import functions as F

from tidewright.functions import documents as D
from tidewright.functions import text as T
from tidewright.operators import evaluation, gaps, linking, skew, store


def test_skew_join_equals_join(spark):
    rng = random.Random(2)
    left = spark.createDataFrame([(rng.choice([None, "hot", "hot", "hot", *"abc"]), i) for i in range(4000)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "k string, v int")
    assert skew.hot_keys(left, "k", 0.3, 100) == ["hot"]
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right, "k", how).collect()), key=repr)
        assert sorted(map(tuple, skew.skew_join(left, right, "k", how, hot=["hot"]).collect()), key=repr) == want
        assert sorted(map(tuple, skew.skew_join(left, right, "k", how).collect()), key=repr) == want
    assert skew.skew_join(left.limit(0), right, "k").count() == 0


def test_upsert_and_references(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, v int, p string")
    new = spark.createDataFrame([("a", 1, "z"), ("c", None, "w")], "k string, v int, p string")
    assert {tuple(r) for r in store.upsert(old, new, ["k"], "v").collect()} == {("a", 1, "z"), ("b", 5, "y"), ("c", None, "w")}
    links = spark.createDataFrame([("7", "3", "t", 0.9), ("3", "7", "t", 0.5), ("3", "3", "t", 1.0), ("1", "2", "t", None)], "extraction1_id string, extraction2_id string, link_type string, confidence double")
    assert {tuple(r) for r in store.insert_cross_references(links).collect()} == {("3", "7", "t", 0.9, 2), ("1", "2", "t", None, 1)}


def test_token_overlap_against_brute_force(spark):
    rng = random.Random(4)
    words = ["harbour", "lagoon", "seabed", "survey", "archive", "of", "the", "series"]
    make = lambda n: [(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))), str(i)) for i in range(n)]
    a, b = make(40), make(40)
    df = lambda rows: spark.createDataFrame(rows, "text string, id string").groupBy("text").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    for least in (1, 2, 3):
        got = {(r["text_1"], r["text_2"], r["n_shared"]) for r in linking.token_overlap(df(a), df(b), 4, least, 0.5).collect()}
        long = lambda t: {w for w in t.split() if len(w) > 4}
        want = {(x, y, len(long(x) & long(y))) for x, _ in a for y, _ in b if len(long(x) & long(y)) >= least}
        assert got == want


def test_scores(spark):
    g = spark.createDataFrame([("integration", "t", "critical", "s", 2), ("integration", "t", "important", "s", 2), ("research", "t", "important", "s", 1)], "gap_category string, gap_type string, severity string, subject string, n_evidence int")
    assert [r["priority_score"] for r in gaps.prioritized(g).orderBy(F.desc("priority_score")).collect()] == [5.0, 3.5, 2.4]


def test_wilson(spark):
    low, high = evaluation.wilson(F.lit(1.0), F.lit(9.0))
    r = spark.range(1).select(F.round(low, 3), F.round(high, 3)).first()
    assert tuple(r) == (0.701, 1.0)


def test_ranked_is_a_global_rank(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(50), f"d{i}") for i in range(500)]
    got = {r["d"]: r["rank"] for r in evaluation.ranked(spark.createDataFrame(rows, "n int, d string"), "n", "d").collect()}
    assert got == {d: i for i, (_, d) in enumerate(sorted(rows))}


def test_sentences_and_numbers():
    assert D.sentences("Under Law No. 12 the Office keeps it. It holds for all of the coast. Yes.") == ["Under Law No. 12 the Office keeps it.", "It holds for all of the coast."]
    assert D.sentences("short") == ["short"] and D.sentences(None) == [] and D.sentences("  ") == []
    assert D.numbers_in_digits("at least two thousand five hundred metres") == "at least 2500 metres"
    assert D.numbers_in_digits("iki yüz elli metre ve yarım mil") == "250 metre ve 0.5 mil"
    assert D.numbers_in_digits(None) is None and D.numbers_in_digits("someone tonight") == "someone tonight"


def test_ranges_and_pages(spark):
    assert D.merged_ranges([(5, 10), (1, 3), (9, 12), (3, 4)]) == [(1, 4), (5, 12)]
    assert D.merged_ranges([]) == []
    r = spark.createDataFrame([("k", 5, 10), ("k", 1, 3), ("k", 9, 12), ("k", 3, 4), (None, 1, 2)], "k string, s int, e int")
    assert {tuple(x) for x in D.islands(r, "k", "s", "e").collect()} == {("k", 1, 4), ("k", 5, 12), (None, 1, 2)}
    assert D.joined_pages(["the plan was", "adopted.", "Next page."]) == ["the plan was adopted.", "Next page."]
    row = spark.sql("select array(10, 5) as l, array(named_struct('s', 1, 'e', 4)) as r")
    pages = [row.select(D.page_of(F.lit(p), F.col("l"))).first()[0] for p in (0, 11, 12, 18, 19)]
    assert pages == [1, 1, 2, 2, None]
    assert [row.select(D.in_ranges(F.lit(p), F.col("r"))).first()[0] for p in (0, 1, 4)] == [False, True, False]


def test_bibliography():
    text = "Body text.\nReferences\n[1] Aa. [2] Bb."
    assert D.bibliography(text) == [(text.index("References"), len(text))] or D.bibliography(text)[0][1] == len(text)
    dois = " ".join(f"10.1234/a{i}" for i in range(4))
    assert D.bibliography("x " + dois)[0][0] == 2
    assert D.bibliography(None) == [] and D.bibliography("plain") == []


def test_text_scalars(spark):
    df = spark.createDataFrame([("The vessel and the boat near a storey",), ("nothing here",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(F.round(T.marine_relevance(F.col("t")), 4)).collect()] == [0.6667, 0.5, 0.5, 0.5]
    assert [r[0] for r in df.select(T.document_class(F.col("t"))).collect()][2:] == ["unknown", "unknown"]
    assert [r[0] for r in df.select(T.is_citation(F.col("t"))).collect()] == [False] * 4
    q = spark.createDataFrame([("c¸ok g˘u¨zel",), ("fine",)], "t string").select(T.scan_quality(F.col("t"))).collect()
    assert q[0][0] == 0.0 and q[1][0] == 1.0


def test_event_stream(spark, tmp_path):
    from tidewright.streaming.ingest import event_counts

    ts = [datetime.datetime(2024, 1, 1, h) for h in (1, 1, 2, 9)]
    rows = spark.createDataFrame([(t, "a", 1.0) for t in ts], "ts timestamp, event_type string, value double")
    rows.write.parquet(str(tmp_path / "in"))
    assert {r["n"] for r in event_counts(rows).collect()} == {1, 2}
    q = event_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(n) from counts").first()[0] >= 3


def test_parsers(spark):
    from tidewright.functions import parsers as P

    t = ["1.400 m", "at least 1,5 km", "between 500 and 100 m", "10–20", "none", None, "1.234.567", "41°00'30\"N 28°58'30\"W", "59.100 TL", "14 ay", "2 years"]
    df = spark.createDataFrame([(x,) for x in t], "t string")
    c = F.col("t")
    assert [r[0] for r in df.select(P.number(c)).collect()] == [1400.0, 1.5, 500.0, 10.0, None, None, 1234567.0, 41.0, 59100.0, 14.0, 2.0]
    r = P.number_range(c)
    assert [tuple(x) for x in df.select(r["low"], r["high"], r["is_range"]).collect()][1:4] == [(1.5, 1.5, False), (100.0, 500.0, True), (10.0, 20.0, True)]
    assert [r[0] for r in df.select(P.qualifier(c)).collect()][:2] == [None, "minimum"]
    assert tuple(df.select(P.latitude(c), P.longitude(c)).collect()[7]) == (41.008333, -28.975)
    assert df.select(P.currency(c)).collect()[8][0] == "TL"
    assert [r[0] for r in df.select(P.months(c)).collect()][-2:] == [14.0, 24.0]


def test_greedy_matching_against_brute_force(spark):
    from tidewright.operators import matching

    rng = random.Random(9)
    make = lambda p: [(" ".join(sorted({rng.choice("abcdef") for _ in range(rng.randrange(1, 5))})), f"{p}{i:03}") for i in range(25)]

    def classes(rows):
        return spark.createDataFrame(rows, "text string, id string").groupBy("text").agg(F.min("id").alias("id"), F.count("*").alias("n"))

    def first(rows):
        out = {}
        for t, i in rows:
            out[t] = min(out.get(t, i), i)
        return sorted((i, t) for t, i in out.items())

    a, b = make("f"), make("t")
    free, want = dict(first(b)), set()
    for _, t in first(a):
        sims = [(-round(len(set(t.split()) & set(u.split())) / len(set(t.split()) | set(u.split())), 9), j, u) for j, u in free.items()]
        sims = sorted(s for s in sims if -s[0] >= 0.5)
        if sims:
            want.add((t, sims[0][2]))
            del free[sims[0][1]]
    got = {(r["found_text"], r["true_text"]) for r in matching.greedy_matches(classes(a), classes(b), 0.5).collect()}
    assert got == want


def test_classifier(spark):
    from tidewright.operators import matching

    rows = [("good harbour rule", 1.0)] * 40 + [("bad garbled row", 0.0)] * 40
    df = spark.createDataFrame(rows, "text string, label double")
    model = matching.quality_classifier(df)
    assert model.transform(df).where("prediction = label").count() == 80
    assert matching.quality_classifier(df.limit(20)) is None


def test_activities_of_the_whole_dictionary(spark):
    texts = {
        "The gillnet and the longline were counted": ("fishing", 0.4),
        "Salmon, oyster and hatchery: mariculture": ("aquaculture", 0.64),
        "naval base of the navy": ("military", 0.6),
        "offshore drilling for petroleum": ("oil_gas", 0.48),
        "The status of the agreement": ("unspecified", 0.25),
        "balıkçı barınağı için düzenleme": ("fishing", 0.4),
        "midye üretimi için kafes açıldı": ("aquaculture", 0.4),
        "doğalgaz araması için sondaj yapıldı": ("oil_gas", 0.4),
        None: ("unspecified", 0.25),
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.activity(F.col("t")).alias("a")).collect()
    assert {r["t"]: (r["a"]["name"], round(r["a"]["confidence"], 4)) for r in got} == texts


def test_gap_names_of_any_length(spark):
    area, deed = "Grand Old North Harbour Mouth Marine Reserve of Saint Anne", "anchoring of any boat over the old eel grass beds at night"
    rows = [
        ("1", "protected_area", f'{{"name": "{area}"}}', ""),
        ("2", "protected_area", '{"name": "Far Bay"}', ""),
        ("3", "data_source", "{}", f"A survey of {area} in 1999"),
        ("4", "prohibition", f'{{"activity": "{deed}"}}', ""),
        ("5", "penalty", f'{{"violation": "{deed}"}}', ""),
        ("6", "prohibition", '{"activity": "night fishing"}', ""),
        *[(f"m{i}", "method", '{"method_type": "rapid visual census of all the fishes"}', "") for i in range(5)],
        ("7", "permit", "{}", "A rapid visual census of all the fishes is needed"),
    ]
    e = spark.createDataFrame([(*r, "d") for r in rows], "id string, category string, metadata string, context string, document_id string")
    d = spark.createDataFrame([("d", "legal")], "id string, doc_type string")
    assert [r["subject"] for r in gaps.unmonitored_areas(e).collect()] == ["far bay"]
    assert [r["subject"] for r in gaps.missing_penalties(e).collect()] == ["night fishing"]
    assert gaps.method_legal_disconnect(e, d).count() == 0


def test_building_statements(spark):
    cases = {
        "Kat yüksekliği 3 m, ön bahçe 5 m olur": "building_patterns",
        "The floor height and the front yard by the sea": "building_patterns",
        "Pencere ile balkon ve otopark düzenlenir": "building",
        "The plot ratio of a parcel": "score",
        "TAKS ve garaj hesabı": "score",
        "Deniz kıyısında emsal değer": None,
        "kapılar ve temelinde": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", T.false_positive(F.col("t"), F.lit("zzz"))).collect()} == cases
    share = {r[0]: r[1] for r in df.select("t", T.marine_relevance(F.col("t"))).collect()}
    assert share["Pencere ile balkon ve otopark düzenlenir"] == 0.0 and share["kapılar ve temelinde"] == 0.5


def test_bibliography_runs_and_credits():
    entries = " ".join(f"[{i}] Aa title." for i in range(6))
    text = f"Body. {entries} Last entry without a number."
    assert D.bibliography(text) == [(6, len(text))]
    years = "Body. " + " ".join(f"Smith, J.{c}., 2010. Title." for c in "ABCDE") + " End."
    assert D.bibliography(years) == [(6, len(years))]
    dois = "Body. doi:10.1234/a doi:10.1234/b doi:10.1234/c and the rest"
    assert D.bibliography(dois) == [(6, len(dois))]
    credits = "Body.\nAcknowledgement\n" + "We thank all. " * 20 + "\n5. Results\nThe sea."
    assert D.bibliography(credits) == [(6, credits.index("\n5. Results"))]
    assert D.bibliography("Body.\n7. References\nx")[0][0] == 6


def test_similar_pairs_against_brute_force(spark):
    import random

    from tidewright.operators import matching

    rng = random.Random(6)
    text = lambda: " ".join(["the"] + rng.sample(["a1", "b2", "c3", "d4", "e5", "f6", "g7", "h8"], rng.randrange(1, 8)))
    left, right = [(f"l{i}", text()) for i in range(60)], [(f"r{i}", text()) for i in range(60)]
    sets = lambda t: set(t.split())
    for threshold in (0.5, 0.8, 1.0):
        want = {(a, b) for a, x in left for b, y in right if len(sets(x) & sets(y)) / len(sets(x) | sets(y)) >= threshold - 1e-9}
        got = matching.similar_pairs(spark.createDataFrame(left, "id string, text string"), spark.createDataFrame(right, "id string, text string"), threshold)
        assert {(r["id_1"], r["id_2"]) for r in got.collect()} == want


def test_page_of(spark):
    from pyspark.sql import functions as F

    from tidewright.functions import documents as D

    rows = spark.createDataFrame([(p, [5, 0, 3]) for p in (0, 6, 7, 8, 9, 13, 14, 99)], "p int, n array<int>")
    assert [r[0] for r in rows.select(D.page_of(F.col("p"), F.col("n"))).collect()] == [1, 1, 2, 2, 3, 3, None, None]


def test_citations_and_reference_points(spark):
    from pyspark.sql import functions as F

    from tidewright.functions import text as T

    texts = {"Marine Policy 12": True, "a study in Marine Policy that goes on and on": False, "Smith, J. (2001). On reefs": True, "plain text of the sea": False}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.is_citation(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == texts
    points = {"200 m from the coastline there": ("coastline", "coastline"), "beside the harbours of old": ("harbours", "reference_point"), "by the port of old": ("port", "port"), "kıyıdan 200 m uzakta, dışında ölçülür": ("kıyıdan", "coastline"), "support of the airport": (None, None), "near the island": ("island", "reference_point")}
    rows = spark.createDataFrame([(t,) for t in points], "t string").select("t", T.reference_point(F.col("t")).alias("r")).collect()
    assert {r["t"]: (r["r"]["term"], r["r"]["kind"]) for r in rows} == points


def test_stated_ranges(spark):
    from pyspark.sql import functions as F

    from tidewright.functions import fields as V

    cases = {
        "100-500 m": (100.0, 500.0, True, None), "between 500 and 100 m": (100.0, 500.0, True, None), "en az 200, en çok 800 metre": (200.0, 800.0, True, None), "85 ile 115 metre arası": (85.0, 115.0, True, None), "asgari 2,5 azami 4 mil": (2.5, 4.0, True, None),
        "at least 30 m": (30.0, None, False, "minimum"), "up to 40 m": (None, 40.0, False, "maximum"), "12 or less": (None, 12.0, False, "maximum"), "yaklaşık 7 km": (7.0, 7.0, False, "approximately"), "500'ı geçemez": (None, 500.0, False, "maximum"), "no number": (None, None, False, None),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", V.stated_range(F.col("t")).alias("r")).collect()
    assert {r["t"]: tuple(r["r"]) for r in rows} == cases


def test_filter_chain(spark):
    from pyspark.sql import functions as F

    from tidewright.functions import fields as V

    cases = {
        ("Posidonia oceanica", "meadows", "species"): (True, 1.5), ("whale", "seen here", "species"): (False, 0.0), ("whale", "a population there", "species"): (True, 0.7), ("sea bass", "seen", "species"): (True, 1.0), ("Coral Sea", "seen", "species"): (False, 0.0),
        ("Marine Policy", "cited", "policy"): (False, 0.0), ("the harbour and the coast", "[1] and [2] and [3]", "gap"): (True, 0.5), ("xqztwvkbnmpqrstvxqztwvkbnmpq", "x", "gap"): (False, 0.0), (None, None, "gap"): (True, 1.0),
    }
    rows = spark.createDataFrame(list(cases), "t string, c string, k string").select("t", "c", "k", V.filter_chain(F.col("t"), F.col("c"), F.col("k")).alias("r")).collect()
    assert {(r["t"], r["c"], r["k"]): tuple(r["r"]) for r in rows} == cases


def test_legal_research_search_spells_out_no_pairs(spark):
    """Against brute force, with copies, ties, several passes and blocks of one row; the plan holds no row per shared word."""
    import pyarrow as pa

    from tidewright.operators import matching

    rng = random.Random(11)
    vocabulary = ["harbour", "lagoon", "seabed", "survey", "archive", "fishing", "İSTANBUL", "ısıtma", "of", "coastal"]
    types = {"L": "legal", "R": "research", "D": "dataset", "N": None}
    rows = [(f"x{i:04d}", rng.choice("LRRDN"), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 8))) or None, rng.choice(vocabulary)) for i in range(300)]
    e = spark.createDataFrame(rows, "id string, document_id string, exact_text string, context string")
    d = spark.createDataFrame(list(types.items()), "id string, doc_type string")
    low = lambda t: {w for w in t.translate(str.maketrans("İIı", "iii")).lower().split() if len(w) > 5}
    sets = [(i, types[t], low(f"{a or ''} {b}")) for i, t, a, b in rows]
    want = set()
    for i, t, w in sets:
        if t == "legal" and int(i[1:]) % 3 == 0:
            links = [(-len(w & v), j) for j, u, v in sets if u == "research" and len(w & v) >= 3]
            if links:
                want.add((i, len(links), min(links)[1], -min(links)[0]))
    assert len(want) > 5
    for lot in (4, 1000):
        found = matching.legal_research_search(e, d, step=3, lot=lot)
        assert {(r["id"], r["n_links"], r["best_id"], r["n_shared"]) for r in found.collect()} == want
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    batch = pa.RecordBatch.from_pydict({"w": [["a", "b"], ["a", "b"], ["c"]], "id": ["1", "2", "3"], "n": pa.array([1, 2, 5], pa.int64())})
    for cells in (1, 2, 1000):
        got = [r for b in matching.most_shared([("q", ["b", "a", "z"]), ("p", ["c"]), ("o", ["y"])], 1, cells)(iter([batch])) for r in b.to_pylist()]
        assert got == [{"id": "q", "n_links": 3, "best_id": "1", "n_shared": 2}, {"id": "p", "n_links": 5, "best_id": "3", "n_shared": 1}]
