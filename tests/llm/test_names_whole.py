"""Names: the refinement of common suffixes loses no pair, and long names are compared."""

import itertools
import random

from sievemill.llm import names
from sievemill.llm.names import organisations, same_organisation


def test_common_suffixes_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(names, "COMMON", 1)
    rows = [("Nell Kodrenovi Security", ["nell", "kodrenovi"], "security"), ("Eleanor Kodrenovi", ["eleanor", "kodrenovi"], ""), ("Tony Kodrenovi Foods", ["tony", "kodrenovi"], "foods"), ("Zed Kodrenovi", ["zed", "kodrenovi"], "")]
    known = spark.createDataFrame(rows, "company string, core array<string>, line string")
    got = {(r["company_a"], r["company_b"], r["line_a"], r["line_b"], *r["core_a"], *r["core_b"]) for r in names._candidates(known).collect()}
    ordered = sorted(rows)
    want = {(a[0], b[0], a[2], b[2], *a[1], *b[1]) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if a[2] == b[2] or "" in (a[2], b[2])}
    assert got == want


def test_name_without_line_meets_its_organisation(spark, monkeypatch):
    monkeypatch.setattr(names, "COMMON", 1)
    found = {r["company"]: r["organisation"] for r in organisations(spark.createDataFrame([("Nell Kodrenovi Security",), ("Eleanor Kodrenovi",)], "company string")).collect()}
    assert len(found) == 2 and len(set(found.values())) == 1


LONG = "gakitru mosuzu kodreno jasiti huvemel trelogo zibreta".split()


def test_long_names():
    slips = ["gaktiru", "mosuzu", "kodreno", "jasiti", "huvemel", "trelogo", "zibretta"]
    assert same_organisation(LONG, LONG[::-1]) == "full"
    assert same_organisation(LONG, slips[::-1]) == "full"
    assert same_organisation(LONG, ["g", *LONG[1:]]) == "initial"
    assert same_organisation(LONG, [*LONG[:-1], "bavufin"]) is None
    assert same_organisation(LONG, [*LONG[:5], "trelogozibreta"]) == "full"


def test_assignment_by_brute_force():
    draw = random.Random(1)
    for n in (1, 2, 3, 4, 5) * 40:
        gain = [[draw.choice([None, draw.randint(-9, 9)]) for _ in range(n)] for _ in range(n)]
        sums = [sum(cells) for p in itertools.permutations(range(n)) if None not in (cells := [gain[i][p[i]] for i in range(n)])]
        assert names._assigned(gain) == max(sums, default=None)


def test_initial_of_a_name_without_line(spark):
    rows = [("Gakitru Mosuzu",), ("G. Mosuzu",), ("Bavu Ropili",), ("Bovi Ropili",), ("B. Ropili",)]
    found = {r["company"]: r["organisation"] for r in organisations(spark.createDataFrame(rows, "company string")).collect()}
    assert found["G. Mosuzu"] == found["Gakitru Mosuzu"]
    assert len({found[c] for c in ("Bavu Ropili", "Bovi Ropili", "B. Ropili")}) == 3
