"""Core operators against brute force, and their odd cases."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievemill.functions import html, text, urls
from sievemill.operators import keyed, matching, selection, snapshot_merge
from sievemill.operators.components import connected_components
from sievemill.operators.near_titles import NEAR, STOP_WORDS, canonical, near_pairs
from sievemill.operators.skew import salted_join
from sievemill.session import table
from sievemill.sources import feeds, files, replay
from sievemill.streaming import sweeps
from tests.conftest import SMALL


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    random.seed(seed)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(60)] + [(1000, 1001 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges + [(None, 3), (4, None)], "a int, b int")).collect()}
    assert got == components([(a, b) for a, b in edges if a != b])


def test_components_without_edges(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_salted_join(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 7}") for i in range(900)] + [(1000, None), (1001, "none")]
    big = spark.createDataFrame(rows, "id int, k string")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), (None, 4)], "k string, v int")
    for how in ("inner", "left"):
        got = salted_join(big, small, "k", how, spread_by="id", one_in=10).select("id", "k", "v")
        want = big.join(small, "k", how).select("id", "k", "v")
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_hot_rows_are_spread(spark):
    big = spark.range(4000).select(F.col("id"), F.lit("hot").alias("k"))
    joined = salted_join(big, spark.createDataFrame([("hot", 1)], "k string, v int"), "k", spread_by="id")
    assert joined.count() == 4000


def test_first_and_last_wins(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), (None, 1, "z"), (None, 2, "w"), ("", 3, "v"), ("", 4, "u")]
    df = spark.createDataFrame(rows, "k string, n int, v string")
    assert {(r["k"], r["v"]) for r in keyed.first_wins(df, ["k"], [F.col("n")]).collect()} == {("a", "y"), (None, "z"), ("", "v")}
    assert {(r["k"], r["v"]) for r in keyed.last_wins(df, ["k"], "n").collect()} == {("a", "x"), (None, "w"), ("", "u")}
    assert sorted(r["v"] for r in keyed.first_wins(df, ["k"], [F.col("n")], keep_blank=True).collect()) == ["u", "v", "w", "y", "z"]
    once = keyed.first_wins(df, ["k"], [F.col("n")])
    assert keyed.first_wins(once, ["k"], [F.col("n")]).exceptAll(once).count() == 0


def test_numbers_and_batches(spark):
    df = spark.createDataFrame([(f"{i:03d}",) for i in random.sample(range(100), 100)], "k string")
    got = {r["k"]: r["p"] for r in keyed.number_rows(df, [F.col("k")], "p").collect()}
    assert got == {f"{i:03d}": i for i in range(100)}
    seen, offset = set(), 0
    for _ in range(4):
        batch = keyed.circular_batch(df, [F.col("k")], offset, 30).collect()
        seen |= {r["k"] for r in batch}
        offset = batch[0]["next_offset"]
    assert len(seen) == 100 and offset == 20


def test_slices_cover_every_board_once(spark):
    boards = table(spark, SMALL, "boards").withColumn("from_extra", F.lit(False)).dropDuplicates(["boardkey"])
    none = spark.createDataFrame([], "boardkey string")
    chosen = [selection.tiers(boards, none, 5, i).where("tier = 'slice'").select("boardkey").collect() for i in range(5)]
    assert sorted(r["boardkey"] for c in chosen for r in c) == sorted(r["boardkey"] for r in boards.select("boardkey").collect())


def test_hash_by_definition(spark):
    keys = ["greenhouse:stripe", "", "a", "lever:x-y_z.9"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").coalesce(1).select(text.numeric_hash(F.col("k"))).collect()]

    def plain(k):
        h = 0
        for c in k:
            h = (h * 31 + ord(c)) % 2**32
        return h

    assert got == [plain(k) for k in keys] and got[0] == 2787386474


def _cosine(a, b):
    import re
    from collections import Counter

    def vector(t):
        w = [x for x in re.findall(r"\w{2,}", t.lower()) if x not in STOP_WORDS]
        return Counter(w + [f"{x} {y}" for x, y in zip(w, w[1:])])

    x, y = vector(a), vector(b)
    n = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y[k] for k, v in x.items()) / n if n else 0.0


def test_near_titles_against_all_pairs(spark):
    random.seed(2)
    words = "senior data engineer platform lead analyst growth billing the of".split()
    rows = [(f"j{i}", random.choice(["Acme & Co", "ACME and co", "Beta"]), random.choice(["Austin, TX", "Austin, Texas", "Oslo"]), " ".join(random.choices(words, k=random.randint(1, 6))), datetime(2025, 1, 1 + i % 20), i % 5) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, company string, location string, title string, firstseen timestamp, fitscore int")
    got = components([(r["a"], r["b"]) for r in near_pairs(df).collect()])
    place = lambda r: (text_company(r[1]), "oslo" if r[2] == "Oslo" else "austin texas")
    want = components([(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and place(a) == place(b) and _cosine(a[3], b[3]) >= NEAR - 1e-9])
    assert got == want
    heads = {r["id"]: r["duplicateof"] for r in canonical(df).collect()}
    by = {}
    for i, c in want.items():
        by.setdefault(c, []).append(i)
    facts = {r[0]: (r[4], -r[5], r[0]) for r in rows}
    assert heads == {i: min(m, key=facts.get) for m in by.values() for i in m if i != min(m, key=facts.get)}


def text_company(name):
    return "acme and co" if "cme" in name.lower() else "beta"


def test_theta_join_refuses_long_lists(spark):
    rows = spark.createDataFrame([("acme",)], "c string")
    names = spark.range(20).select(F.col("id").cast("string").alias("n"))
    with pytest.raises(ValueError, match="at most 10"):
        matching.contained_in(rows, names, F.col("c"), "n", bound=10)


def test_as_of_and_range(spark):
    random.seed(4)
    left = [(i, random.choice("ab"), random.randrange(100)) for i in range(80)]
    right = [(random.choice("ab"), t, t * 10) for t in random.sample(range(100), 20)]
    got = {r["i"]: r["as_of_v"] for r in matching.as_of(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, rt int, v int"), "k", "t", "rt", "v").collect()}
    assert got == {i: max(((rt, v) for rk, rt, v in right if rk == k and rt <= t), default=(0, None))[1] for i, k, t in left}
    spans = [(n, a, a + random.randint(1, 60)) for n, a in enumerate(random.sample(range(300), 25))]
    points = [(i, random.randrange(-5, 400)) for i in range(120)]
    hit = {(r["i"], r["n"]) for r in matching.range_join(spark.createDataFrame(points, "i int, x long"), spark.createDataFrame(spans, "n int, lo long, hi long"), "x", "lo", "hi", 17).collect()}
    assert hit == {(i, n) for i, x in points for n, lo, hi in spans if lo <= x < hi}


def test_merge_is_idempotent(spark):
    now = F.lit("2025-01-03 00:00:00").cast("timestamp")
    t = datetime(2025, 1, 2)
    old = spark.createDataFrame([("a", "k1", t), ("b", "k2", t), ("c", "k2", t - timedelta(days=5)), (None, "k2", t)], "id string, boardkey string, checked timestamp")
    new = spark.createDataFrame([("a", "k1", t), ("a", "k1", t), ("d", "k1", t)], "id string, boardkey string, checked timestamp")
    ok = spark.createDataFrame([("k1",)], "boardkey string")
    once = snapshot_merge.merged(new, old, ok, now)
    assert {(r["id"], r["stale"]) for r in once.collect()} == {("a", False), ("d", False), ("b", True)}
    again = snapshot_merge.merged(new, once.drop("stale"), ok, now)
    assert again.exceptAll(once).count() == 0 == once.exceptAll(again).count()


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://boards.greenhouse.io/Acme/jobs/1", ("greenhouse", "acme")), ("https://ats.rippling.com/api/v1/board/beta/jobs", ("rippling", "beta")), ("https://ats.rippling.com/beta/jobs", ("rippling", "beta")),
        ("https://acme.wd5.myworkdayjobs.com/Careers/job/x", ("workday", "acme.wd5.myworkdayjobs.com/acme/careers")), ("https://acme.wd5.myworkdayjobs.com/wday/x", None), ("https://my_co.recruitee.com/o/x", ("recruitee", "my_co")),
        ("https://x.fa.us2.oraclecloud.com/hcmUI/en/sites/CX_1/job/3", ("oracle", "x.fa.us2.oraclecloud.com/cx_1")), ("https://careers-acme.icims.com/jobs/5/x/job", ("icims", "careers-acme.icims.com")), ("https://careers-acme.icims.com/about", None),
        ("https://jobs.lever.co/login", None), ("https://jobs.lever.co/", None), ("ftp://jobs.lever.co/acme", None), ("https://acme.jobs.personio.de/job/1", ("personio", "acme")), ("nonsense", None), (None, None),
    ],
)
def test_boards_of_urls(spark, url, want):
    r = spark.createDataFrame([(url,)], "u string").select(urls.board_of_url(F.col("u")).alias("b")).first()["b"]
    assert (tuple(r) if r else None) == want


def test_pages():
    page = "<a href='/1'>Data <b>Engineer</b></a> in <i>Austin, TX</i> <a href=\"https://x.example/2\">Remote role &amp; more</a> Remote - US <a href='/1'>Again</a><a href='/3'>Apply now</a><a href='/4'>ab</a>"
    assert html.links_of(page, "https://y.example/z") == [("Data Engineer", "https://y.example/1", "Austin, TX"), ("Remote role & more", "https://x.example/2", "Remote - US")]
    assert html.links_of(None) == html.links_of("") == []
    assert json.loads(html.balanced_json('x = {"a":"}\\"{", "b":[1,{"c":2}]} tail', "x =")) == {"a": '}"{', "b": [1, {"c": 2}]}
    assert html.balanced_json("x = {never", "x =") is None and html.balanced_json("nothing", "x") is None
    assert html.balanced_json('y [1,"]"] z', "y") == '[1,"]"]'
    ld = '<script type="application/ld+json">{"@graph":[{"@type":["JobPosting"],"title":"A"},{"@type":"Person"}]}</script><script type="application/ld+json">{broken</script>'
    assert [json.loads(x)["title"] for x in html.job_postings(ld)] == ["A"]


DELIVERED = {
    "ashby": ({"id": "1", "title": "T", "location": {"name": "Oslo"}, "applyUrl": "https://x.example/1", "isRemote": True, "publishedAt": "2025-01-02T00:00:00Z"}, ("ashby:tok:1", "T", "Oslo", "remote")),
    "lever": ({"id": "2", "text": "T", "categories": {"allLocations": ["Oslo", "Bonn"]}, "hostedUrl": "https://x.example/2", "createdAt": 1735776000000, "workplaceType": "Hybrid"}, ("lever:tok:2", "T", "Oslo; Bonn", "hybrid")),
    "smartrecruiters": ({"id": "3", "name": "T", "location": {"city": "Oslo", "country": "no", "remote": False}, "releasedDate": "2025-01-02T00:00:00Z"}, ("smartrecruiters:tok:3", "T", "Oslo, no", None)),
    "workable": ({"shortcode": "4", "title": "T", "city": "Oslo", "country": "Norway", "url": "https://x.example/4", "created_at": "2025-01-02", "telecommuting": "true"}, ("workable:tok:4", "T", "Oslo, Norway", "remote")),
    "brassring": ({"Questions": [{"QuestionName": "JobTitle", "Value": " T "}, {"QuestionName": "formtext12", "Value": ""}, {"QuestionName": "city", "Value": "Oslo"}, {"QuestionName": "reqid", "Value": "5"}, {"QuestionName": "lastupdated", "Value": "2-Jan-2025"}]}, ("brassring:tok:5", "T", "Oslo", None)),
    "zoho": ({"guid": "6", "title": "T", "link": "https://x.example/6", "pubDate": "Thu, 02 Jan 2025 00:00:00 GMT"}, ("zoho:tok:6", "T", "Not listed", None)),
    "paylocity": ({"JobId": 7, "JobTitle": "T", "JobLocation": {"City": "Oslo", "State": "OS"}, "IsInternal": False, "PublishedDate": "2025-01-02T00:00:00"}, ("paylocity:tok:7", "T", "Oslo, OS", None)),
}


@pytest.mark.parametrize("kind", sorted(DELIVERED))
def test_feeds(spark, kind):
    item, want = DELIVERED[kind]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.createDataFrame([(json.dumps(x), "acme", "tok", datetime(2025, 1, 5)) for x in (item, {}, [])] + [(None, "acme", "tok", None)], "item string, company string, token string, checked timestamp")
    rows = feeds.normalise(df, kind).collect()
    assert [(r["id"], r["title"], r["location"], r["workplace"]) for r in rows] == [want]
    assert str(rows[0]["published"]).startswith("2025-01-02")


def test_dropped_rows(spark):
    bad = [("oracle", {"Id": "1", "Title": "T", "Language": "de"}), ("paylocity", {"JobId": 1, "JobTitle": "T"}), ("hireology", {"id": 1, "name": "T", "status": "closed"}), ("greenhouse", {"id": 1, "title": "T", "absolute_url": "http://x.example"}), ("greenhouse", {"id": 1, "title": " ", "absolute_url": "https://x.example"})]
    for kind, item in bad:
        df = spark.createDataFrame([(json.dumps(item), "acme", "tok", datetime(2025, 1, 5))], "item string, company string, token string, checked timestamp")
        assert feeds.normalise(df, kind).count() == 0


def test_replay_pushes_the_kind_down(spark, tmp_path):
    for kind in ("lever", "ashby", "zoho"):
        (tmp_path / kind).mkdir()
        for i in range(3):
            (tmp_path / kind / f"b{i}.json").write_text(json.dumps({"company": "Acme", "payload": [{"id": i}]}))
    (tmp_path / "ashby" / "bad.json").write_text("{")
    load = lambda push=False: spark.read.format("boards_replay").option("path", str(tmp_path)).option("boardsPerPartition", 2).option("pushFilters", push).load()
    replay.register(spark)
    df = load()
    assert df.count() == 10 and df.where("not ok").count() == 1
    assert df.where("kind = 'lever'").union(df).groupBy("kind").count().count() == 3
    one = load(True).where("kind = 'lever'")
    assert one.count() == 3 and one.rdd.getNumPartitions() == 2
    assert load(True).where("kind in ('lever', 'zoho') and ok").count() == 6


def test_files(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('Company_Name,Board_URL,Board_Slug\n"A, ""B""",https://jobs.lever.co/Ab,\n\n"x\ny",,Zed\n')
    rows = files.directory(spark, str(path), least=2).collect()
    assert {(r["company"], r["kind"], r["token"]) for r in rows} == {('A, "B"', "lever", "ab"), ("x\ny", "", "zed")}
    with pytest.raises(ValueError, match="fewer"):
        files.directory(spark, str(path), least=3)
    assert files.read_or_empty(spark, str(tmp_path / "no.json"), "a int").count() == 0


def test_streams(spark, tmp_path):
    base = datetime(2025, 1, 1)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for n, rows in enumerate([[("a", base), ("b", base + timedelta(hours=1))], [("a", base + timedelta(hours=30))], [("c", base + timedelta(hours=40))], [("c", base + timedelta(hours=41))], [("a", base)]]):
        spark.createDataFrame(rows, "id string, checked timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time

        time.sleep(1.1)  # files are taken in the order of their times
    stream = sweeps.stream_of(spark, str(tmp_path / "in"))
    sweeps.write_batches(sweeps.first_seen(stream, hours=36), str(tmp_path / "out"), str(tmp_path / "state"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert all(r["firstseen"] == base for r in rows if r["id"] == "a")
    assert {r["id"] for r in rows if r["stale"]} == {"b"}
    # The same files again: the checkpoint is the cursor, nothing is written twice.
    sweeps.write_batches(sweeps.first_seen(sweeps.stream_of(spark, str(tmp_path / "in")), hours=36), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_stream_equals_batch(spark, tmp_path):
    stream = sweeps.stream_of(spark, f"{SMALL}/events.parquet")
    sweeps.write_batches(sweeps.once(stream, "event_id", "ts", "1 hour"), str(tmp_path / "a"), str(tmp_path / "as"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == table(spark, SMALL, "events").select("event_id").distinct().count()
    sweeps.write_batches(sweeps.sessions(sweeps.stream_of(spark, f"{SMALL}/events.parquet"), "ts", "user_id", "1 hour", "30 minutes"), str(tmp_path / "b"), str(tmp_path / "bs"))
    assert spark.read.parquet(str(tmp_path / "b")).count() > 0


def test_budget():
    now = [0.0]
    assert sweeps.within_budget(lambda: now.__setitem__(0, now[0] + 400), 1.0, clock=lambda: now[0]) == 8
    assert sweeps.within_budget(lambda: None, 0.01, clock=lambda: now[0]) == 0


def test_plans(spark):
    """Small sides are broadcast, filters and columns reach the scan."""
    jobs, boards = table(spark, SMALL, "jobs"), table(spark, SMALL, "boards")
    plan = jobs.where("fitscore > 50").select("id").join(boards.select(F.col("boardkey").alias("id")), "id", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(fitscore,50)" in plan and "Broadcast" in plan
    from sievemill.plans import problems

    changes = problems.p3_found(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert changes.count("Exchange hashpartitioning") == 2 and "CartesianProduct" not in changes and "BroadcastNestedLoopJoin" not in changes


def test_without_llm():
    """The core imports nothing of the optional subpackage."""
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "sievemill"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "sievemill.llm" not in path.read_text(), path
