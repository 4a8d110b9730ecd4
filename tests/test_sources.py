"""Paged reading, the feeds' own rules over fallback paths, and files that cannot be read."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievemill.functions import html, text, urls
from sievemill.operators import keyed, matching, selection
from sievemill.sources import aggregators, feeds, files, paging


def pages(rows, size, first=0, step=None, wrap=lambda page, n: page, views=("",)):
    """What a platform would give for ``rows`` in pages, and the places that were asked for."""
    asked = []

    def fetch(view, at):
        asked.append((view, at))
        n = (int(at) - first) // (step or size)
        page = rows[n * size : (n + 1) * size]
        return wrap(page, len(rows)) if view in views else None

    return fetch, asked


def test_offsets_up_to_the_last_page():
    rows = [{"id": i, "name": f"n{i}"} for i in range(450)]
    fetch, asked = pages(rows, 100, wrap=lambda p, n: {"totalFound": n, "content": p})
    assert [r["id"] for r in paging.walk(paging.PAGING["smartrecruiters"], fetch)] == list(range(300)) and len(asked) == 3
    fetch, asked = pages(rows[:130], 100, wrap=lambda p, n: {"totalFound": n, "content": p})
    assert len(list(paging.walk(paging.PAGING["smartrecruiters"], fetch))) == 130 and len(asked) == 2


def test_searches_drop_repeats():
    def fetch(view, at):
        rows = [{"bulletFields": ["a"]}, {"bulletFields": [], "externalPath": "b"}, {"title": "c"}, {}] if view == "data" else [{"title": "b", "externalPath": "b"}, {"title": "d"}]
        return {"total": len(rows), "jobPostings": rows if at == "0" else []}

    got = [r.get("title") for r in paging.walk(paging.PAGING["workday"], fetch)]
    assert got == [None, None, "c", "d"]


def test_pages_of_links_end_on_nothing_new():
    same = [{"url": f"u{i}"} for i in range(50)]
    assert len(list(paging.walk(paging.PAGING["icims"], lambda view, at: same))) == 50
    assert len(list(paging.walk(paging.PAGING["icims"], lambda view, at: same[:39]))) == 39


def test_numbered_pages_and_tests_of_fields():
    rows = [{"id": i, "status": "Open" if i % 2 else "closed"} for i in range(120)]
    fetch, asked = pages(rows, 50, first=1, step=1, wrap=lambda p, n: {"count": n, "data": p})
    assert [r["id"] for r in paging.walk(paging.PAGING["hireology"], fetch)] == list(range(1, 120, 2)) and [a for _, a in asked] == ["1", "2", "3"]
    dover = {"0": {"results": [{"id": 1}, {"id": 2, "is_sample": True}, {"id": 3, "is_published": False}], "next": "x"}, "300": {"results": [{"id": 4}], "next": None}}
    assert [r["id"] for r in paging.walk(paging.PAGING["dover"], lambda view, at: dover.get(at))] == [1, 4]


def test_two_empty_pages_end_a_walk():
    held = {"0": [{"id": 1}], "1": [], "2": [{"id": 2}, {"id": 1}], "3": [], "4": [], "5": [{"id": 9}]}
    assert [r["id"] for r in paging.walk(paging.PAGING["successfactors"], lambda view, at: {"jobSearchResult": held[at]})] == [1, 2]


def test_two_orders_reach_what_one_does_not():
    rows = [{"reqid": i} for i in range(3000)]
    views = {"lastupdated desc": rows, "title asc": rows[::-1]}
    fetch = lambda view, at: {"JobsCount": len(rows), "Jobs": {"Job": views[view][(int(at) - 1) * 50 : int(at) * 50]}}
    assert len({r["reqid"] for r in paging.walk(paging.PAGING["brassring"], fetch)}) == 3000


def test_details_are_read_last():
    read = []

    def fetch(view, at):
        if view == "detail":
            read.append(at)
            return {"requisitionDescription": f"d{at}"}
        return {"meta": {"totalNumber": 2}, "jobRequisitions": [{"itemID": "1", "requisitionTitle": "Data Engineer"}, {"itemID": "2", "requisitionTitle": "Cook"}]}

    got = list(paging.walk(paging.PAGING["adp"], fetch, title="data"))
    assert got == [{"itemID": "1", "requisitionTitle": "Data Engineer", "requisitionDescription": "d1"}] and read == ["1"]


def test_boards_fail_alone(spark, tmp_path):
    root = str(tmp_path)
    for token, body in (("a/b", json.dumps({"totalFound": 1, "content": [{"id": 1}]})), ("bad", "{")):
        path = paging.page_path(root, "smartrecruiters", token, "", "0")
        __import__("os").makedirs(path.rsplit("/", 1)[0])
        open(path, "w").write(body)
    boards = spark.createDataFrame([("smartrecruiters", t, "Acme") for t in ("a/b", "bad", "none")] + [("nowhere", "x", "Acme"), (None, "x", "Acme")], "kind string, token string, company string")
    got = {(r["kind"], r["token"]): (r["ok"], r["payload"]) for r in paging.read_boards(boards, lambda kind, token: paging.recorded(root, kind, token)).collect()}
    assert got == {("smartrecruiters", "a/b"): (True, '[{"id": 1}]'), ("smartrecruiters", "bad"): (False, None), ("smartrecruiters", "none"): (True, "[]"), ("nowhere", "x"): (False, None)}


# (kind, item, expected columns): payloads as delivered, through fallback paths.
RULES = [
    ("lever", {"id": "1", "text": "T", "salaryRange": {"min": 50, "max": 60, "currency": "EUR"}, "categories": {"location": "Bonn"}, "applyUrl": "https://x.example/a"}, {"salary": "50–60 EUR", "location": "Bonn", "applyurl": "https://x.example/a"}),
    ("lever", {"id": "2", "text": "T", "salaryRange": {"max": 60}, "hostedUrl": "https://x.example/a"}, {"salary": None, "location": "Not listed"}),
    ("pinpoint", {"id": 3, "title": "T", "url": "https://x.example/a", "compensation": "$5", "compensation_visible": True, "location": {"city": "Leeds", "province": "Yorks"}, "workplace_type": "onsite"}, {"salary": "$5", "location": "Leeds, Yorks", "workplace": "onsite", "published": None}),
    ("pinpoint", {"id": 3, "title": "T", "url": "https://x.example/a", "compensation": "$5", "compensation_visible": False}, {"salary": None}),
    ("paylocity", {"JobId": 7, "JobTitle": "T", "LocationName": "Main Plant", "JobLocation": {"City": "Oslo", "State": "OS"}, "IsInternal": False, "IsRemote": True}, {"location": "Main Plant (Oslo, OS)", "workplace": "remote"}),
    ("paylocity", {"JobId": 7, "JobTitle": "T", "LocationName": "Oslo", "JobLocation": {"City": "Oslo West", "State": "OS"}, "IsInternal": False}, {"location": "Oslo West, OS"}),
    ("paylocity", {"JobId": 7, "JobTitle": "T", "LocationName": "Main Plant", "IsInternal": False}, {"location": "Main Plant"}),
    ("zoho", {"link": "https://x.example/6", "title": "T", "description": "<p>Location: Oslo &amp; Bonn</p><p>Remote: no</p>"}, {"location": "Oslo & Bonn", "id": "zoho:tok:https://x.example/6", "applyurl": "https://x.example/6"}),
    ("careerplug", {"url": "https://x.example/6", "title": "Data Engineer in St. Paul, MN 55101", "ld": {"datePosted": "2025-01-02", "description": "<b>x</b>"}}, {"title": "Data Engineer", "location": "St. Paul, MN 55101", "descriptiontext": "x"}),
    ("careerplug", {"url": "https://x.example/6", "ld": {"title": "Cook"}}, {"title": "Cook", "location": "Not listed"}),
    ("workable", {"id": 4, "title": "T", "location": {"city": "Oslo", "country": "Norway"}, "shortlink": "https://x.example/4", "published_on": "2025-01-02", "workplace": "hybrid", "description_html": "<i>d</i>"}, {"location": "Oslo, Norway", "workplace": "hybrid", "descriptiontext": "d", "applyurl": "https://x.example/4"}),
    ("ukg", {"Id": 5, "Title": "T", "Locations": [{"LocalizedDescription": "Plant 5"}], "BriefDescription": "b"}, {"location": "Plant 5", "descriptiontext": "b"}),
    ("adp", {"clientRequisitionID": 6, "requisitionTitle": "T", "requisitionLocations": [{"address": {"cityName": "Oslo", "countrySubdivisionLevel1": {"codeValue": "OS"}}}]}, {"id": "adp:tok:6", "location": "Oslo, OS"}),
    ("phenom", {"reqId": 8, "title": "T", "city": "Oslo", "country": "Norway", "salaryRange": "1-2"}, {"id": "phenom:tok:8", "location": "Oslo, Norway", "salary": "1-2"}),
    ("dover", {"id": 9, "title": "T", "locations": [{"location_option": {"display_name": "Oslo"}}]}, {"location": "Oslo"}),
    ("hireology", {"id": 9, "name": "T", "status": "Open", "locations": [{"city": "Oslo", "state": "OS"}], "career_site_url": "http://x.example"}, None),
    ("bamboohr", {"id": 9, "title": "T", "location": "Oslo", "url": "https://x.example/4", "createdDate": "2025-01-02"}, {"title": "T", "location": "Oslo", "published": datetime(2025, 1, 2)}),
    ("breezy", {"url": "https://x.example/4", "title": "T", "location": {"name": "Oslo", "is_remote": True}, "published_at": "2025-01-02"}, {"id": "breezy:tok:https://x.example/4", "location": "Oslo", "workplace": "remote"}),
]


def test_rules_of_the_feeds_one_by_one_and_together(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = "n int, kind string, item string, payload string, company string, token string, checked timestamp"
    df = spark.createDataFrame([(n, kind, json.dumps(item), json.dumps([item]), f"c{n}", "tok", datetime(2025, 1, 5)) for n, (kind, item, _) in enumerate(RULES)] + [(99, "nowhere", "{}", "[{}]", "c99", "tok", None)], schema)
    together = {r["company"]: r.asDict() for r in feeds.normalise_all(df).collect()}
    for n, (kind, _, want) in enumerate(RULES):
        alone = [r.asDict() for r in feeds.normalise(df.where(F.col("n") == n), kind).collect()]
        assert alone == ([together[f"c{n}"]] if f"c{n}" in together else [])
        assert (want is None) == (not alone)
        if want:
            assert {k: alone[0][k] for k in want} == want, kind
    assert "c99" not in together


def test_gathered_lists(spark):
    now = F.lit("2025-01-05 00:00:00").cast("timestamp")
    many = json.dumps([{"legal": "x"}] + [{"position": f"T{i}", "url": "u", "description": "<p>" + "d" * 3000} for i in range(150)] )
    rows = aggregators.aggregator_rows(spark.createDataFrame([(many,), ("{broken",), (None,)], "payload string"), "remoteok", now).collect()
    assert len(rows) == 100 and all(len(r["description"]) == 2000 and r["location"] == "Remote" and r["company"] == "" for r in rows)
    lists = [(json.dumps({"jobs": [{"role": "R", "title": "T", "applyUrl": "a", "datePosted": "2025-01-02"}, {"company": "c"}]}),), (json.dumps([{"title": "T", "url": "u"}]),)]
    got = {(r["title"], r["url"], str(r["published"])[:10]) for r in aggregators.aggregator_rows(spark.createDataFrame(lists, "payload string"), "landedjobs", now).collect()}
    assert got == {("R", "a", "2025-01-02"), ("T", "u", "2025-01-05")}
    assert len(aggregators.REPOSITORIES) == 16


@pytest.mark.parametrize(("body", "want"), [('{"a": 1}', [1]), ('[{"a": 1}, {"a": 2}]', [1, 2]), ("{broken", []), ("", []), ("[]", []), ("7", [])])
def test_read_or_empty(spark, tmp_path, body, want):
    (tmp_path / "s.json").write_text(body)
    assert sorted(r["a"] for r in files.read_or_empty(spark, str(tmp_path / "s.json"), "a int").collect()) == want


def test_gapless_shards():
    assert files.gapless(["a", "b", "c", "d"], {"a", "b", "d"}.__contains__) == ["a", "b"]


def test_containment_against_all_pairs(spark):
    names = ["acme foods", "acme", "x", "", "zedfoods and more", "foods", "a" * 50]
    rows = ["acme foods", "foods", "ods", "acme  ", "", "me fo", "xx", "aaaaaaaaaa", "zedfoods and more!"]
    df, listed = spark.createDataFrame([(r,) for r in [*rows, None]], "c string"), spark.createDataFrame([(n,) for n in [*names, None]], "n string")
    held = {r["c"] for r in matching.contained_in(df, listed, F.col("c"), "n").collect()}
    assert held == {r for r in rows if any(r in n for n in names)}
    assert {r["c"] for r in matching.contained_in(df, listed, F.col("c"), "n", anti=True).collect()} == {*rows, None} - held


def test_rotation_and_yields(spark, tmp_path):
    path = str(tmp_path / "state")
    assert [selection.next_rotation(spark, path, 3) for _ in range(5)] == [0, 1, 2, 0, 1]
    a = spark.createDataFrame([("x", 2, 3), ("y", 1, 0)], "boardkey string, checks bigint, found bigint")
    b = spark.createDataFrame([("x", 2, 1), ("z", 1, 4)], "boardkey string, checks bigint, found bigint")
    assert {tuple(r) for r in selection.merged_yield(a, b).collect()} == {("x", 4, 4, 1.0), ("y", 1, 0, 0.0), ("z", 1, 4, 4.0)}


def test_ties_repeat(spark):
    rows = [("k", 1, f"v{i}") for i in range(40)]
    picked = {tuple(keyed.last_wins(spark.createDataFrame(rows[i:] + rows[:i], "k string, n int, v string").repartition(3), ["k"], "n").first()) for i in (0, 7, 20)}
    assert len(picked) == 1


@pytest.mark.parametrize(("said", "want"), [("3-5 years", (3, 5)), ("7+ years", (7, 9)), ("minimum 2 years", (2, 4)), ("4 years of experience", (4, 6)), ("5 to 8 years", (5, 8)), ("none", (None, None)), (None, (None, None))])
def test_experience(spark, said, want):
    assert tuple(spark.createDataFrame([(said,)], "t string").select(text.experience_range(F.col("t")).alias("r")).first()["r"]) == want


def test_tokens_and_labels(spark):
    df = spark.createDataFrame([("careerpage", "https://a.example/jobs", True), ("careerpage", "acme", False), ("lever", "acme", True), ("lever", "jobs", False), ("workday", "a.wd1.example/x/robots.txt", False), ("workday", "a/b", True), ("lever", None, False)], "k string, t string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", urls.usable_token(F.col("k"), F.col("t")).alias("got")).collect())
    labels = {"Cook in Oslo, OS": ("Cook", "Oslo, OS"), "Cook in Oslo, OS 12345": ("Cook", "Oslo, OS 12345"), "Cook": ("Cook", None), " Cook in oslo ": ("Cook in oslo", None)}
    got = {r["l"]: (r["x"]["title"], r["x"]["place"]) for r in spark.createDataFrame([(x,) for x in labels], "l string").select("l", html.label_title(F.col("l")).alias("x")).collect()}
    assert got == labels
