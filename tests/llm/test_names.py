"""Spellings of organisations."""

import itertools

import pytest

from sievemill.llm.names import LINES, lcs, line_of_business, organisations, same_organisation, spelling_pairs, tokens_of

GROUPS = [
    ["Gakitru Mosuzu Security", "Gakitru-Mosuzu Security", "GakitruMosuzu Security", "GAKITRU MOSUZU SECURITY", "Gakitru Mosuzu Sec. Ltd", "G. Mosuzu Security", "Mosuzu Gakitru Security", "Security, Gakitru Mosuzu", "The Gákitru  Mosuzu Security", "Gaktiru Mosuuzu Security"],
    ["Frederick Kodreno & Jasiti Mobility", "Fritz Kodreno & Jasiti Mob.", "Frederick Kodreno and Jasiti Mobility GmbH", "F. Kodreno & Jasiti Mobility", "Kodreno, Frederick & Jasiti Mobility", "Kodreno & Jasiti Mobility (Frederick)"],
    ["Kukeji Huvemel Logistics", "Kukeji Huvemel Logist. LLC"], ["Kukeji Huvemel Robotics", "Kukeji Huvmel Robotics"],
    ["Nufizu Dusafi Biosciences", "Nufizu Dusafi"], ["Trelogo Zibreta Foods", "Trelogo Zibreta Fds", "Trelogo Zibreta Foods - Jobs"],
]
ALONE = ["Kukeji Huvemel", "Bavufin Ropili Analytics"]


def test_groups(spark):
    rows = [(n, "x") for g in GROUPS for n in g] + [(n, "x") for n in ALONE] + [(None, "x"), ("", "x"), ("  ", "x"), ("&&", "x"), (GROUPS[0][0], "y")]
    found = {}
    for r in organisations(spark.createDataFrame(rows, "company string, part string")).collect():
        found.setdefault(r["organisation"], set()).add(r["company"])
    assert sorted(map(sorted, (v for v in found.values() if len(v) > 1))) == sorted(map(sorted, GROUPS))


def test_pairs(spark):
    boards = spark.createDataFrame([(n,) for n in GROUPS[2]], "company string")
    jobs = spark.createDataFrame([(n,) for n in GROUPS[3] + [GROUPS[2][0]]], "company string")
    got = {tuple(r) for r in spelling_pairs(boards, jobs).collect()}
    assert got == {p for g in (GROUPS[2], GROUPS[3]) for p in itertools.combinations(sorted(g), 2)}


@pytest.mark.parametrize(("name", "line"), [("A B Prtg", "printing"), ("Xa Yb Anlytcs Inc", "analytics"), ("Xa Yb Labs", "laboratories"), ("Xa Yb Intl", "international"), ("Gakitru Mosuzu", ""), ("Xadre Ybbro Roboitcs", "robotics")])
def test_lines(name, line):
    assert line_of_business(tokens_of(name), LINES)[0] == line


def test_lcs_by_definition():
    def slow(a, b):
        return 0 if not a or not b else slow(a[1:], b[1:]) + 1 if a[0] == b[0] else max(slow(a[1:], b), slow(a, b[1:]))

    for a, b in itertools.product(["", "abc", "acbd", "babac", "dda"], repeat=2):
        assert lcs(a, b) == slow(a, b)


def test_different_first_names():
    assert same_organisation(["robert", "kodreno", "jasiti"], ["anthony", "kodreno", "jasiti"]) is None
    assert same_organisation(["bob", "kodreno", "jasiti"], ["robert", "kodreno", "jasiti"]) == "full"
    assert same_organisation(["g", "mosuzu"], ["gakitru", "mosuzu"]) == "initial"
