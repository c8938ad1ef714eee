import math
import random

import numpy as np
import pandas as pd
import pytest

from tidewright.functions.quantities import read
from tidewright.operators import units

SCHEMA = "id int, source_file string, value string, unit string, exact_text string, metres string"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("en az yarım deniz mili", ("distance", 0.5, "nautical_mile")),
        ("half a nautical mile", ("distance", 0.5, "nautical_mile")),
        ("7.600 cm", ("distance", 7600.0, "centimetre")),
        ("1,400 metre", ("distance", 1400.0, "metre")),
        ("0,75 kilometre", ("distance", 0.75, "kilometre")),
        ("410m", ("distance", 410.0, "metre")),
        ("23 thousand metres", ("distance", 23000.0, "metre")),
        ("3 bin metre", ("distance", 3000.0, "metre")),
        ("bin beş yüz metrelik", ("distance", 1500.0, "metre")),
        ("two hundred and fifty meters", ("distance", 250.0, "metre")),
        ("5\xa0mil", ("distance", 5.0, "nautical_mile")),
        ("4.75 statute miles", ("distance", 4.75, "statute_mile")),
        ("6 cable lengths", ("distance", 6.0, "cable")),
        ("55 m2", ("other", None, None)),
        ("12 km²", ("other", None, None)),
        ("250 knots", ("other", None, None)),
        ("217 days", ("other", None, None)),
        ("105 – 235 m", ("range", None, None)),
        ("85 ile 115 metre arası", ("range", None, None)),
        ("between 45 and 185 m", ("range", None, None)),
        ("yeterli mesafe", ("none", None, None)),
        ("", ("none", None, None)),
        (None, ("none", None, None)),
        ("440", ("number", 440.0, None)),
    ],
)
def test_read(text, want):
    r = read(text)
    assert (r.kind, r.value, r.unit) == want


def test_fields_and_text(spark):
    rows = [
        (1, "a", "10.0", "Metre", None, "x"), (2, "a", "50.0", "nautical_mile", "50 metres", "x"), (3, "a", "1/2", "nautical_mile", None, "x"), (4, "a", None, "metre", "safe distance", "x"),
        (5, None, "450 metrelik", None, None, "x"), (6, "a", "55.0", "metre", "55 m2", "x"), (7, "a", None, None, None, "x"), (8, "a", "6.2", "metre", "about 6.2 kms", "x"), (9, "a", "500.0", "metre", "safe distance", "x"), (9, "a", "500.0", "metre", "safe distance", "x"),
    ]
    got = {r["id"]: r["metres"] for r in units.unit_states(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 10, 2: 50, 3: 926, 4: None, 5: 450, 6: None, 7: None, 8: 6200, 9: 500}
    assert units.unit_states(spark.createDataFrame([], SCHEMA)).count() == 0


def test_unit_from_level(spark):
    rows = [(i, "dev", f"{500 + i}.0", "metre", None, "") for i in range(1, 40)] + [(40, "dev", "510.0", None, None, ""), (41, "dev", "0.52", "", None, ""), (42, "dev", "0.51", "-", None, "")]
    got = {r["id"]: r["unit"] for r in units.unit_states(spark.createDataFrame(rows, SCHEMA)).where("id >= 40").collect()}
    assert got[40] == "metre" and got[41] in ("kilometre", "nautical_mile") and got[42] == got[41]


def viterbi(e, switch):
    score, back = e[0] - math.log(units.K), []
    for row in e[1:]:
        both = score[:, None] + switch
        back.append(both.argmax(0))
        score = both.max(0) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(score.max())


def score_of(path, e, switch):
    return e[0, path[0]] - math.log(units.K) + sum(switch[a, b] + e[i + 1, b] for i, (a, b) in enumerate(zip(path, path[1:], strict=False)))


def chain(rng, n):
    values = np.array([math.exp(rng.gauss(5, 2)) for _ in range(n)])
    stated = np.array([rng.choice([-1, -1, 0, 1]) for _ in range(n)])
    return values, stated, np.array([rng.random() < 0.5 for _ in range(n)])


def test_blocks_are_one_chain():
    """A chain cut anywhere, with the shipped constants, has the levels and the best score of the whole one."""
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(3, 60)
        values, stated, texts = chain(rng, n)
        switch = units.switching(0.8)
        whole = units.emissions(values, stated, texts, units.levels(values, stated, 5.5), 0.7)
        cuts = [0, *sorted(rng.sample(range(1, n), 2)), n]
        parts, level = [], 5.5
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = units.levels(values[a:b], stated[a:b], level)
            parts.append(units.emissions(values[a:b], stated[a:b], texts[a:b], own, 0.7))
            x, y = units.level_map(values[a:b], stated[a:b])
            level = x * level + y
        assert np.allclose(np.vstack(parts), whole)
        matrices = [np.vstack([units.transfer(e, switch), units._start_scores(e, switch)]) for e in parts]
        for grouped in (matrices, [units._matrix(units._combined_matrices([m.ravel().tolist() for m in matrices[:2]])), matrices[2]]):
            leave = units.through(grouped, -1, -1)
        ends = units.through(matrices[:2], -1, leave[0]) + [leave[1]]
        path = [k for e, i, o in zip(parts, [-1, *ends[:-1]], ends, strict=True) for k in units.decode(e, switch, i, o)]
        assert np.isclose(score_of(path, whole, switch), viterbi(whole, switch)[1])


def test_cutting_changes_nothing(spark, monkeypatch):
    """Chains of many blocks, up a tree of several floors, come out as in one block."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        unit = rng.choice(["metre", "kilometre", None, "nautical_mile"])
        metres = math.exp(rng.gauss(6, 0.3))
        rows.append((i, rng.choice(["a", "a", None]), f"{metres / units.METRES[unit or 'metre']:.2f}", unit, None, ""))
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted((r["id"], r["unit"] or "", r["metres"]) for r in units.unit_states(df).collect())
    monkeypatch.setattr(units, "BLOCK", 16)
    monkeypatch.setattr(units, "FAN", 4)
    assert sorted((r["id"], r["unit"] or "", r["metres"]) for r in units.unit_states(df).collect()) == want


def test_missing_and_wrong_units(spark):
    """Rows whose unit was taken away or falsified come out in the unit they were written in."""
    rng = random.Random(9)
    rows, hidden, wrong = [], {}, {}
    for i in range(6000):
        source = f"s{i % 5}"
        unit = "kilometre" if (i // 100) % 3 == 0 else "metre"
        metres = math.exp(rng.gauss(4.0 + i % 5, 0.35))
        shown = unit
        if rng.random() < 0.1:
            hidden[i], shown = metres, None
        elif rng.random() < 0.02:
            wrong[i], shown = metres, "metre" if unit == "kilometre" else "kilometre"
        rows.append((i, source, f"{metres / units.METRES[unit]:.4f}", shown, None, ""))
    got = {r["id"]: r["metres"] for r in units.unit_states(spark.createDataFrame(rows, SCHEMA)).collect()}
    for planted, least in ((hidden, 0.95), (wrong, 0.9)):
        right = sum(abs(got[i] - m) <= 0.01 * m + 1 for i, m in planted.items())
        print(len(planted), right / len(planted))
        assert right >= least * len(planted)


def test_runs_pass_over_batches():
    batches = [pd.DataFrame({"k": list("aab"), "v": [1, 2, 3]}), pd.DataFrame({"k": list("bbc"), "v": [4, 5, 6]}), pd.DataFrame({"k": [], "v": []})]
    assert [(r["k"][0], r["v"].tolist()) for r in units.runs(iter(batches), ["k"])] == [("a", [1, 2]), ("b", [3, 4, 5]), ("c", [6])]
