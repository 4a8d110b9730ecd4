"""Pay texts of several amounts, long numbers and units of the table; spans of the tz database."""

import zoneinfo
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest

from sievemill.functions.pay_text import read_pay
from sievemill.operators.timestamps import _offset_spans
from sievemill.operators.units import further_amounts, pay_per_year
from tests.conftest import SMALL

SEVERAL = {
    "2 openings: $100,000 - $120,000": (100_000, 120_000, 1), "$90,000; OTE $150,000 - $180,000": (90_000, 90_000, 2), "$50/hr, $60/hr, $70/hr": (50, 50, 2), "Ref 4711, 85k EUR": (85, 85, 1),
    "team of 12, hybrid 3 days, pays 60000 to 70000 USD a year": (60_000, 70_000, 1), "10 000 000 000 000 000 000 000 JPY": (1e22, 1e22, 0), "$1": (1, 1, 0),
}


@pytest.mark.parametrize("text", sorted(SEVERAL))
def test_several_amounts(text):
    p = read_pay(text)
    assert (p.low, p.high, p.further) == SEVERAL[text]


def test_long_pay_texts():
    assert read_pay("$ 1 - " * 20_000).further > 10_000
    assert read_pay("1 " * 50_000 + "USD").stated
    assert read_pay("9" * 5_000 + " USD").low == float("inf")


def test_units_of_the_table(spark):
    rows = [("a", "50,000 SEK", None, None), ("b", "2000 per fortnight", None, None), ("c", "$50k, later $60k", None, None), ("d", "9" * 400 + " USD", None, None), ("e", "9" * 25 + " USD", None, None), (None, "$5", None, None), ("f", None, None, None)]
    jobs = spark.createDataFrame(rows, "id string, salary string, salarymin bigint, salarymax bigint")
    more = spark.createDataFrame([("SEK", "currency", 0.1), ("fortnight", "period", 26.0), (" ", "currency", 1.0), (None, "scale", 2.0)], "unit string, kind string, factor double")
    units = spark.read.parquet(f"{SMALL}/pay_units.parquet").select("unit", "kind", "factor").unionByName(more)
    got = {r["id"]: (r["usd_year_min"], r["usd_year_max"]) for r in pay_per_year(jobs, units).collect()}
    assert got == {"a": (5_000, 5_000), "b": (52_000, 52_000), "c": (50_000, 50_000)}
    assert [tuple(r) for r in further_amounts(jobs, units).collect()] == [("c", "$50k, later $60k", 1)]


@pytest.mark.parametrize("name", ["America/Recife", "Asia/Gaza", "Europe/London", "Australia/Lord_Howe", "Africa/Casablanca", "Pacific/Apia", "America/New_York"])
def test_spans_day_by_day(name):
    """Every noon of two centuries lies in the span of its offset, and spans follow each other."""
    spans = next(_offset_spans(iter([pd.DataFrame({"zone": [name]})]), 1900, 2100))
    zone, epoch = zoneinfo.ZoneInfo(name), datetime(1970, 1, 1, tzinfo=timezone.utc)
    assert (spans["utc_to"].to_numpy()[:-1] == spans["utc_from"].to_numpy()[1:]).all()
    bounds, offsets = spans["utc_from"].to_numpy(), spans["offset_s"].to_numpy()
    at = [int((datetime(1900, 1, 1, 12, tzinfo=timezone.utc) - epoch).total_seconds()) + 86400 * i for i in range(365 * 200)]
    for s, k in zip(at, bounds.searchsorted(at, side="right") - 1, strict=True):
        assert offsets[k] == int((epoch + timedelta(seconds=s)).astimezone(zone).utcoffset().total_seconds())
