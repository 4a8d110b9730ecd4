"""Groups of duplicates and their survivors."""

from datetime import datetime

from sievemill.llm.survivor import best_of_groups, duplicate_groups, golden_records, truth_discovery

T = [datetime(2025, 1, d) for d in range(1, 9)]
ROWS = [
    ("a", "b", T[3], 5, T[0]), ("b", None, T[2], 1, T[1]), ("c", "b", None, 9, T[2]),
    ("d", "gone", T[4], 3, T[3]), ("e", "gone", T[4], 7, T[4]), ("f", "f", T[0], 1, T[0]), ("g", None, T[0], 1, T[0]), ("h", "only", T[1], 2, T[0]),
    ("i", "j", T[5], 4, None), ("j", "i", T[5], 4, None), ("k", "", T[0], 1, T[0]), ("l", "a", T[2], 1, T[1]), (None, "a", T[0], 1, T[0]),
]


def _jobs(spark):
    return spark.createDataFrame(ROWS * 2, "id string, duplicateof string, firstseen timestamp, fitscore long, checked timestamp")


def test_groups(spark):
    got = {r["id"]: r["group_id"] for r in duplicate_groups(_jobs(spark)).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "l": "a", "d": "d", "e": "d", "i": "i", "j": "i"}


def test_best(spark):
    pay = spark.createDataFrame([("a",), ("b",), ("l",), ("j",), ("i",), ("zz",)], "id string")
    got = {tuple(r) for r in best_of_groups(_jobs(spark), pay).collect()}
    # b and l tie on firstseen and score; b and l tie on checked too; unknown checks come last.
    assert got == {("a", "b", "b"), ("d", "e", ""), ("i", "i", "i")}


def test_truth_follows_the_reliable(spark):
    """Two sources that agree elsewhere outvote two that do not, object by object."""
    claims = []
    for i in range(20):
        claims += [(f"o{i}", "f", "right", "good1"), (f"o{i}", "f", "right", "good2"), (f"o{i}", "f", "right", "good3"), (f"o{i}", "f", f"wrong{i}", "bad1"), (f"o{i}", "f", f"wrong{i}", "bad2")]
    claims += [("x", "f", "lie", "bad1"), ("x", "f", "lie", "bad2"), ("x", "f", "truth", "good1"), ("y", "f", "b", "good1"), ("y", "f", "a", "good1"), ("z", "f", None, "good1")]
    got = {r["object"]: r["value"] for r in truth_discovery(spark.createDataFrame(claims, "object string, field string, value string, source string")).collect()}
    assert got["x"] == "truth" and got["y"] == "a" and "z" not in got
    assert all(got[f"o{i}"] == "right" for i in range(20))


def test_golden(spark):
    rows = [("a", "s1", "Engineer", None), ("b", "s2", "Engineer", " "), ("c", "s3", "Enginer", "Oslo")]
    jobs = spark.createDataFrame(rows, "id string, source string, title string, location string")
    groups = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a")], "id string, group_id string")
    assert [tuple(r) for r in golden_records(jobs, groups, ["title", "location"]).collect()] == [("a", "Engineer", "Oslo")]
