"""Every problem's query on empty tables and on tables with nulls, odd texts, copies and clashing columns."""

import pytest

from sievemill.llm.queries import QUERIES, SQL
from tests.conftest import SMALL
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    compare(spark, SMALL, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty_tables, name):
    df = QUERIES[name](spark, empty_tables)
    assert df.count() == 0 or name == "p9_shares"


def _added(row):
    return any(isinstance(v, str) and (v.startswith("zz-") or v.strip() == "" or len(v) > 1000) or isinstance(v, int) and not isinstance(v, bool) and v < -1 for v in row)


@pytest.mark.parametrize("name", ["p1_found", "p5_found", "p5_groups", "p6_found", "p7_found", "p7_openings", "p8_found", "p10_found"])
def test_rough(spark, rough_tables, name):
    want = {tuple(r) for r in QUERIES[name](spark, SMALL).collect()}
    got = [tuple(r) for r in QUERIES[name](spark, rough_tables).collect()]
    # p5's pay_id is '' where no member states pay; ids below -1 and 'zz-' were added.
    kept = [r for r in got if not (name.startswith("p5") and str(r[0]).startswith("zz-")) and not (not name.startswith("p5") and _added(r)) and r[0] != -1]
    assert set(kept) == want and len(kept) == len(want)


@pytest.mark.parametrize("name", ["p5_golden", "p9_mixed", "p9_shares", "p10_shares", "p10_statistics"])
def test_rough_runs(spark, rough_tables, name):
    assert QUERIES[name](spark, rough_tables).count() > 0
