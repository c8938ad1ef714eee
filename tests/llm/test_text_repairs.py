import random

import pytest

from tidewright.llm import encoding, quality, scan_noise
from tidewright.llm.vocabulary import Vocabulary, bounded_vocabulary, fold, word_counts

WORDS = "the harbour lagoon of survey multi-criteria analysis kıyı yönetmeliğin için şehir değişikliği için deniz çayırı sayılı kanun madde über die gewässer vessels must keep at least metres from cage site penalty light house lighthouse"
VOCABULARY = Vocabulary({w: 10 for w in WORDS.split()})


@pytest.fixture(scope="module")
def cleaner():
    return scan_noise.Cleaner(VOCABULARY)


@pytest.mark.parametrize(
    ("text", "repaired", "counts"),
    [
        ("the har-\nbour of the lagoon", "the harbour of the lagoon", (0, 1, 0)),
        ("the har\xad\r\n  bour", "the harbour", (0, 1, 0)),
        ("the har¬\nbour", "the harbour", (0, 1, 0)),
        ("multi-\ncriteria analysis", "multi-criteria analysis", (0, 0, 0)),
        ("the h@rbour", "the harbour", (0, 0, 1)),
        ("tbe surveу", None, (0, 0, 1)),
        ("vesse1s rnust keep", "vessels must keep", (0, 0, 2)),
        ("yu¨netmeliğin", None, (0, 0, 1)),
        ("Tbe lagoon", "The lagoon", (0, 0, 1)),
        ("THE LAG00N", "THE LAGOON", (0, 0, 1)),
        ("the vessels must keep at least\n— 365 —\nmetres from the harbour", "the vessels must keep at least metres from the harbour", (1, 0, 0)),
        ("the vessels must keep at least\nCoastal Notes   12\nmetres", "the vessels must keep at least metres", (1, 0, 0)),
        ("the vessels must keep\nAnnals of Lagoon Policy, 24 (4)\nmetres", "the vessels must keep metres", (1, 0, 0)),
        ("the vessels\nPage 3 of 9\nmust keep", "the vessels must keep", (1, 0, 0)),
        ("Madde 12\nthe harbour", "Madde 12\nthe harbour", (0, 0, 0)),
        ("Table 3\nthe lagoon", "Table 3\nthe lagoon", (0, 0, 0)),
        ("the harbour\nof the lagoon", "the harbour of the lagoon", (0, 0, 0)),
        ("the Zzyzx harbour", "the Zzyzx harbour", (0, 0, 0)),
        ("", "", (0, 0, 0)),
        (None, None, (0, 0, 0)),
        ("12", "12", (0, 0, 0)),
    ],
)
def test_clean(cleaner, text, repaired, counts):
    got = cleaner.clean(text)
    if repaired is not None:
        assert got[0] == repaired
    assert got[1:] == counts or repaired is None and sum(got[1:]) >= 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_complete():
    rng = random.Random(1)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))): 1 for _ in range(300)}
    trie = scan_noise.Trie(words)
    for _ in range(60):
        token = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
        for k in (0, 1, 2):
            assert {w for _, _, w in trie.within(token, k)} == {w for w in words if distance(token, w) <= k}


def test_confusions_are_complete():
    rng = random.Random(2)
    words = [w for w in VOCABULARY.n if "-" not in w]
    trie = scan_noise.Trie(dict.fromkeys(words, 1))
    for _ in range(200):
        w = rng.choice(words)
        fits = [(s, t) for s, t in scan_noise.STRONG if t in w]
        if fits:
            s, t = rng.choice(fits)
            assert w in {x for _, _, x in trie.confused(w.replace(t, s, 1), 1, scan_noise.STRONG)}


def test_cleaned_table(spark):
    df = spark.createDataFrame([("a", "the har-\nbour", None, "x"), ("b", None, "fine", "x"), ("a", "the har-\nbour", None, "x")], "id string, t string, u string, field string")
    rows = scan_noise.cleaned(df, "id", ("t", "u"), VOCABULARY).collect()
    assert [(r["id"], r["field"], r["repaired"]) for r in rows] == [("a", "t", "the harbour")] * 2
    assert scan_noise.cleaned(df.limit(0), "id", ("t",), VOCABULARY).count() == 0


def test_misread_letters_outside_the_confusions(spark):
    """One plain edit of a word is put right where the word is known beside its neighbours; unknown names stay."""
    corpus = ["Vessels leave the harbour entrance by night.", "The harbour entrance is narrow.", "A new regulation applies to the survey of eels.", "This regulation applies to the survey of crabs."]
    known = bounded_vocabulary(word_counts(spark.createDataFrame(list(enumerate(corpus)), "id int, t string"), "t", "id", pairs=True), 1)
    c = scan_noise.Cleaner(known)
    assert c.clean("the hxrbour entrance")[0] == "the harbour entrance"
    assert c.clean("the regvlation applies to the surwey of")[0] == "the regulation applies to the survey of"
    assert c.clean("the regulaton applies, the surrvey of")[0] == "the regulation applies, the survey of"
    assert c.clean("Mr Hxrbour spoke")[3] == 0 and c.clean("a hxrbour")[3] == 0


def test_running_titles(spark):
    """A title that stands on three pages between different lines is furniture; in copies of one passage it is not."""
    rows = [(i, "d1", i, f"vessels must keep\nCoastal Notes of the Lagoon\nat least {i} metres from harbour {i}", None) for i in range(4)]
    rows += [(10 + i, "d2", i, "vessels must keep\nCoastal Notes\nat least metres", None) for i in range(4)]
    rows += [(20, "d1", 9, "vessels\nLight House\nkeep", None), (21, None, 1, "A\nB", None), (22, "d1", None, "Coastal Notes of the Lagoon\nx", None), (23, "d1", 1, None, None)]
    df = spark.createDataFrame(rows, "id int, document_id string, page int, t string, titles string")
    got = {r["id"]: r["repaired"] for r in scan_noise.cleaned(df, "id", ("t",), VOCABULARY, document_col="document_id", page_col="page").collect()}
    assert got == {i: f"vessels must keep at least {i} metres from harbour {i}" for i in range(4)} | {22: "x"}
    assert scan_noise.cleaned(df.limit(0), "id", ("t",), VOCABULARY, document_col="document_id", page_col="page").count() == 0


def test_page_break_inside_a_sentence(cleaner):
    assert cleaner.clean("vessels must keep the har-\n\n— 12 —\n\nbour of the lagoon")[0] == "vessels must keep the harbour of the lagoon"
    assert cleaner.clean("vessels must keep\n\nPage 3\n\nat least\n\nThe harbour")[0] == "vessels must keep at least\n\nThe harbour"
    title = " ".join(["Annals of the Lagoon and Harbour Survey"] * 4)
    assert cleaner.clean(f"vessels must keep\n{title}   12\nat least")[0] == "vessels must keep at least"


@pytest.mark.parametrize(("written", "read"), [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("cp1254", "latin-1"), ("cp857", "latin-1"), ("cp1254", "cp1252")])
def test_encoding_round_trip(written, read):
    restore = encoding.Restorer(VOCABULARY).restore
    clean = "kıyı yönetmeliğin için şehir değişikliği deniz çayırı sayılı kanun"
    garbled = " ".join("".join(encoding._misread(c, written, read) or c for c in w) for w in clean.split())
    assert garbled != clean
    assert restore(garbled) == (True, clean, True)
    assert restore(clean) == (False, clean, True)
    if written == "utf-8":
        twice = "".join(encoding._misread(c, written, read) if not c.isascii() else c for c in garbled)
        if read in ("cp1252", "latin-1"):
            assert restore(twice)[1] == clean


def test_encoding_mixed_and_lost():
    v = Vocabulary({w: 5 for w in "ýlmer þorvind sayılı kanun için über".split()})
    restore = encoding.Restorer(v).restore
    assert restore("Ýlmer ve Þorvind için “sayılı”")[0] is False
    assert restore("say?lı kanun") == (True, "sayılı kanun", True)
    assert restore("say�lı kanun") == (True, "sayılı kanun", True)
    assert restore("q�x")[0] is True and restore("q�x")[2] is False
    assert restore("Is it so? Yes.")[0] is False
    assert restore("correct ü beside Ã¼ber")[1] == "correct ü beside über"
    assert restore(None) == (False, None, True) and restore("") == (False, "", True)


def test_many_ambiguous_letters():
    """A word may hold any number of characters that stand for several letters."""
    v = Vocabulary({"ş" * 14: 5, "şişşşşşşşşşşşş" * 3: 5})
    restore = encoding.Restorer(v).restore
    assert restore("þ" * 14) == (True, "ş" * 14, True)
    assert restore("þiþþþþþþþþþþþþ" * 3) == (True, "şişşşşşşşşşşşş" * 3, True)
    assert restore("þ" * 2000)[0] is False


def test_vocabulary(spark):
    df = spark.createDataFrame([(1, "Sea sea SEA lagoon multi-part"), (2, None), (3, "")], "id int, t string")
    counts = {r["word"]: r["n"] for r in word_counts(df, "t", "id").collect()}
    assert counts == {"sea": 3, "lagoon": 1, "multi-part": 1}
    assert set(bounded_vocabulary(word_counts(df, "t", "id")).n) == {"sea"}
    with_pairs = bounded_vocabulary(word_counts(df, "t", "id", pairs=True), 1)
    assert with_pairs.evidence("sea", "sea") > 1.9 and with_pairs.evidence("sea", "lagoon") > 0.9 and with_pairs.evidence("lagoon", "sea") == 0.0
    with pytest.raises(ValueError):
        bounded_vocabulary(word_counts(df, "t", "id"), 1, most_words=2)
    assert bounded_vocabulary(word_counts(df.limit(0), "t", "id")).n == {}
    assert fold("ISPARTA") == fold("ısparta") == "isparta"


PROSE = "The buffer around the harbour was widened to 200 m. Nobody objected to it, although local views differ.\nIt holds for every district."


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (PROSE, None),
        ("\n".join(f"* Species name{i}" for i in range(12)), "list"),
        ("\n".join(f"{i}) Harbour – Place{i}" for i in range(12)), "list"),
        ("\n".join(f"Place{i} | fishing | {i}.5 | {i}" for i in range(12)), "table"),
        ("\n".join(f"Place{i},fishing,{i}.5,{i}" for i in range(12)), "table"),
        ("\n".join(f"Place{i}\tfishing\t{i}.5\t{i}" for i in range(12)), "table"),
        ("lorem " * 80, "junk"),
        ("{}[]|<>~^%$#@ " * 30, "junk"),
        ("xtqcgyl kfllh rp jtkchg mndfdqgdgkm rrkldfc mnmftlgjjs kcnvv qqwrt dqmhqqxx", "junk"),
        ("\n".join(f"{i:032x}" for i in range(10, 30)), "junk"),
        (" | ".join("Home Archive Print Contact Login".split() * 8), "junk"),
        ("........ 12\n________ 14\n~~~~~~~~ 19", "junk"),
        (" | ".join("Accueil Nous Écrire Panier Boutique".split() * 8), "junk"),
        ("\n".join("Kahvaltı Öğle Akşam".split() * 9), "junk"),
        ("\n\n".join([PROSE] * 6), "junk"),
        ("buy it now " * 40 + "and good.", "junk"),
        (PROSE.upper(), None),
        (PROSE + "\n\n- A thing\n- Other", None),
        ("", None),
        (None, None),
        ("   \n ", None),
    ],
)
def test_kinds(text, kind):
    assert quality.document_kind(text) == kind


def test_statistics(spark):
    docs = spark.createDataFrame([(1, "The sea. The sea.\nThe sea. The sea.", "x"), (2, None, "x"), (3, "", "x")], "doc_id bigint, text string, kind string")
    common = spark.createDataFrame([("en", "the"), (None, None)], "lang string, word string")
    rows = {r["doc_id"]: r for r in quality.text_statistics(docs, common).collect()}
    assert rows[1]["n_words"] == 8 and rows[1]["common_word_share"] == 0.5 and rows[1]["duplicate_line_share"] == 0.5 and rows[1]["lines_ending_in_punctuation"] == 1.0
    assert rows[2]["n_words"] == 0 and rows[2]["kind"] is None and rows[3]["top_ngram_coverage"] == 0.0
    assert quality.not_prose(docs.limit(0), common).count() == 0
