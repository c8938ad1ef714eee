import random

import pytest

from tidewright.llm import language, leakage, mixing
from tidewright.sources.tables import table

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark, small):
    return language.fit(table(spark, DATA, "documents"), table(spark, DATA, "common_words"))


TEXTS = {
    "en": "The council keeps the register of fishing for the district and nobody knows how the lagoons respond.",
    "tr": "Kurul yazılı olarak uygun görmedikçe bu bölgede demirleme yapılamaz ve kayıtlar ilçede saklanır.",
    "de": "Das Amt überwacht die Gewässer, sobald die Baggerung beginnt, obwohl die Meinungen auseinandergehen.",
    "fr": "Les pêcheurs signalent un conflit entre la plongée et le mouillage le long du chenal depuis des années.",
    "es": "Los vecinos describen un conflicto entre el buceo y la pesca de arrastre a lo largo del litoral.",
}


def test_languages(model):
    for code, text in TEXTS.items():
        main, confidence, parts = language.document_languages(text, model)
        assert main == code and confidence > 0.9 and parts[0][0] == code
        assert language.context_languages(text, model)[0][0] == code
    mixed = "\n\n".join([TEXTS["en"], TEXTS["en"], TEXTS["fr"]])
    main, _, parts = language.document_languages(mixed, model)
    assert main == "en" and [c for c, _ in parts] == ["en", "en", "fr"]
    assert [c for c, _ in language.context_languages(TEXTS["tr"] + " " + TEXTS["de"], model)] == ["tr", "de"]
    for empty in (None, "", "  ", "Branucerus marata", "12 34"):
        assert language.context_languages(empty, model) == []
    assert language.document_languages(None, model) == (None, 0.0, [])


def test_held_out_accuracy(spark, model):
    """The labels are wrong for some documents; agreement with them has to be as high as their quality allows."""
    rows = table(spark, "/root/testdata/sf0.001", "documents").select("text", "language", "lang").collect()
    known = [(language.document_languages(r["text"], model)[0], language.label_code(r["language"], r["lang"])) for r in rows]
    known = [(a, b) for a, b in known if a and b]
    assert sum(a == b for a, b in known) > 0.85 * len(known)


@pytest.mark.parametrize(("language_name", "code", "want"), [("ENGLISH", None, "en"), ("unknown", "und", None), (None, None, None), ("Türkçe", None, "tr"), (None, "de-AT", "de"), ("klingon", "xx", None)])
def test_labels(language_name, code, want):
    assert language.label_code(language_name, code) == want


def test_mixture_proportions():
    k = len(language.CODES)
    unit = lambda j: tuple(0.0 if i == j else -40.0 for i in range(k))
    share, post = language.mixture([(unit(1), 30), (unit(1), 30), (unit(3), 40)])
    assert abs(share[1] - 0.6) < 1e-3 and abs(share[3] - 0.4) < 1e-3 and post[2][3] > 0.99
    weak = tuple(0.0 if i == 3 else -3.0 for i in range(k))
    assert language.mixture([(unit(1), 90), (weak, 10)])[0][1] > 0.99


def test_leaks_against_brute_force(spark):
    d, i = table(spark, DATA, "documents"), table(spark, DATA, "eval_items")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, i).collect()}
    rows = [(r["item_id"], leakage.tokens(r["text"])) for r in i.collect()]
    own = leakage.Items.of([(k, " ".join(w)) for k, w in rows], __import__("numpy").ones((leakage.DIMS, 2)))
    want = set()
    for r in d.select("doc_id", "text").collect():
        words = leakage.tokens(r["text"])
        have = set(words)
        for k, (item, w) in enumerate(rows):
            if len(have & set(w)) > 4 and (own.longest_run(k, words) >= leakage.RUN or own.share_in_order(k, words) >= leakage.SHARE):
                want.add((r["doc_id"], item))
    assert want and len(got & want) >= 0.9 * len(want) and got <= want


def test_planted_runs_are_found_whatever_their_cosine(spark):
    """Runs of twelve item words at random places of all documents: every one is found."""
    rng = random.Random(11)
    items = [(r["item_id"], r["text"]) for r in table(spark, DATA, "eval_items").collect()]
    docs, planted = [], set()
    for r in table(spark, DATA, "documents").where("text is not null").select("doc_id", "text").collect():
        words, (item, text) = r["text"].split(" "), rng.choice(items)
        own = text.split()
        at, i = rng.randrange(len(words) + 1), rng.randrange(max(1, len(own) - 14))
        if len(leakage.tokens(" ".join(own[i : i + 14]))) >= leakage.RUN:
            planted.add((r["doc_id"], item))
            docs.append((r["doc_id"], " ".join([*words[:at], *own[i : i + 14], *words[at:]])))
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), table(spark, DATA, "eval_items")).collect()}
    assert len(planted) > 500 and planted <= got


def test_items_in_lots(spark, monkeypatch):
    """Many items are searched in several passes, with the same result."""
    d, i = table(spark, DATA, "documents"), table(spark, DATA, "eval_items")
    want = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, i).collect()}
    monkeypatch.setattr(leakage, "ITEMS_A_PASS", 60)
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 37)
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, i).collect()} == want


def test_leak_edges(spark):
    words = [f"w{i}" for i in range(60)]
    item = " ".join(words[:40])
    docs = [
        (1, "alpha beta " * 50 + item.upper().replace(" ", ", ") + " gamma" * 40), (2, " ".join(words[5:17])), (3, " ".join(words[5:16])), (4, " ".join("other" if i % 5 == 0 else w for i, w in enumerate(words[:40]))),
        (5, None), (6, ""), (7, "unrelated text about lagoons"), (8, item), (8, item), (9, "x " * 30000 + item),
    ]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, i).collect()} == {(1, 1), (2, 1), (4, 1), (8, 1), (9, 1)}
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_longest_common_subsequence():
    rng = random.Random(3)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    import numpy as np

    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 30))] for _ in range(2))
        own = leakage.Items.of([(1, " ".join(a))], np.ones((leakage.DIMS, 2)))
        assert own.longest_common(0, b) == lcs(a, b)


def test_mixture(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["big"] * 8 + ["mid"] * 3 + ["small"]), "word " * rng.randrange(20, 200), 1) for i in range(900)] + [(1000, None, "x", 1), (1001, "other", "x", 1), (1002, "big", None, 1), (1003, "big", "", 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string, n_tokens int")
    t = spark.createDataFrame([("big", 0.5, 3), ("mid", 0.3, 2), ("small", 0.2, 4), ("none", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(d, t)
    rows = mixed.collect()
    assert len({(r["doc_id"], r["repetition"]) for r in rows}) == len(rows)
    got = {r["source"]: r for r in mixing.shares(mixed, t).collect()}
    for s in ("big", "mid", "small"):
        assert abs(got[s]["actual_share"] - got[s]["target_share"]) < 0.01
        assert got[s]["most_used"] <= got[s]["max_repeats"]
    assert got["small"]["most_used"] == 4 and got["none"]["n_tokens"] == 0 and "other" not in got
    assert sorted((r["doc_id"], r["slot"]) for r in mixing.mixture(d, t).collect()) == sorted((r["doc_id"], r["slot"]) for r in rows)
    assert mixing.mixture(d.limit(0), t).count() == 0 and mixing.mixture(d, t.limit(0)).count() == 0


def test_token_round_trip():
    e = mixing.encoding(mixing.RANKS)
    for text in TEXTS.values():
        assert e.decode(e.encode_ordinary(text)) == text
