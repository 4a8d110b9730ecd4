"""Locations to places."""

import random

from sievemill.llm.places import named_places, osa, posting_places, repaired_tokens
from sievemill.session import table
from tests.conftest import SMALL

PLACES = [
    (1, "Lannowick", "NY", "New York", "US", "United States"), (2, "Lannowick", "ME", "Maine", "US", "United States"), (3, "Mount Tolliscombe", "BY", "Bavaria", "DE", "Germany"),
    (4, "Dröthampton", "OR", "Oregon", "US", "United States"), (5, "Gompestone", "MH", "Maharashtra", "IN", "India"), (6, "Fort Knindovale", "SCT", "Scotland", "GB", "United Kingdom"), (7, "Fort Knindocross", "CO", "Colorado", "US", "United States"),
]
CASES = {
    "Lannowick, NY": [1], "Lannowick, Maine": [2], "Lannowick": [1, 2], "Lannwick , New York": [1], "lannowick, me": [2], "US-ME-Lannowick": [2], "LANNOWICK OR REMOTE": [1, 2],
    "Mt. Tolliscombe": [3], "Bavaria / Mount Tolliscobme": [3], "Drothampton or remote": [4], "dröthampton, or": [4], "India: Maharashtra; Gomepstone": [5], "Gompestone (Maharashtra, IN)": [5], "Gompestone, IN": [5],
    "Ft. Knindovale": [6], "Fort Knindocorss, CO": [7], "Lannowick, NY | Gompestone, MH": [1, 5], "Downtown Knindovale HQ": [6],
    "New York": [], "Remote - US": [], "Fort Somewhere, CO": [], "Stulliwick, NY": [], "Tolliscombe, Scotland": [], "Lannowick, Texas": [1, 2], "Lannowick, Scotland": [], "2 Locations": [],
}


def _places(spark):
    return spark.createDataFrame(PLACES, "place_id int, city string, region_code string, region string, country_code string, country string")


def test_cases(spark):
    df = spark.createDataFrame([(k,) for k in CASES] + [(None,), ("",), ("  ",), ("Lannowick",)], "location string")
    got = {r["location"]: sorted(r["place_ids"]) for r in named_places(df, _places(spark)).collect()}
    assert got == CASES


def test_ids(spark):
    rows = [("a", "Lannowick, NY"), ("a", "Lannowick, NY"), ("b", "Nowhere"), ("c", None), ("d", " "), (None, "Lannowick, NY"), ("e", "Lannowick")]
    got = sorted(tuple(r) for r in posting_places(spark.createDataFrame(rows, "id string, location string"), _places(spark)).collect())
    assert got == [("a", 1), ("b", -1), ("e", 1), ("e", 2)]


def test_repair_is_complete(spark):
    """The forms with letters left out miss no pair within the slips."""
    random.seed(5)
    words = sorted({"".join(random.choices("abcd", k=random.randint(5, 9))) for _ in range(40)})
    tokens = sorted({"".join(random.choices("abcd", k=random.randint(4, 9))) for _ in range(300)} | set(words[:3]))
    got = {(r["token"], r["word"]) for r in repaired_tokens(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    slips = lambda w: 2 if len(w) >= 7 else 1
    want = {(t, w) for t in tokens for w in words if (t == w if t in words else osa(t, w, 2) <= slips(w) and len(t) >= 4)}
    assert got == want


def test_slips_planted_into_listed_names(spark):
    """Of names with one slip each, all must still name the place."""
    random.seed(6)
    places = table(spark, SMALL, "places").collect()
    rows = []
    for p in places:
        c = p["city"]
        i = random.randrange(len(c) - 5, len(c) - 1)
        slip = random.choice([c[:i] + c[i + 1 :], c[:i] + c[i] + c[i:], c[:i] + c[i + 1] + c[i] + c[i + 2 :]])
        rows.append((str(p["place_id"]), f"{slip}, {p['region']}"))
    got = {r["id"]: r["place_id"] for r in posting_places(spark.createDataFrame(rows, "id string, location string"), table(spark, SMALL, "places")).collect()}
    assert sum(got[i] == int(i) for i, _ in rows) / len(rows) > 0.98
