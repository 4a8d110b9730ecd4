"""Whole jobs: what a narrower query would leave out is there."""

from __future__ import annotations

import os
import re
from collections import Counter
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.parquet as pq

from sievemill.plans import pipeline
from sievemill.plans.registry import QUERIES
from sievemill.streaming import sweeps
from tests.conftest import SMALL


def test_range_join_takes_all_orders(spark, tmp_path):
    first = datetime(1992, 1, 1)
    orders = [(k, first + timedelta(days=k % 3)) for k in range(1, 8)]  # no key is a multiple of 50
    events = [(i, datetime(2024, 1, 1, 5) + timedelta(hours=7 * i)) for i in range(12)]
    pq.write_table(pa.table({"o_orderkey": [k for k, _ in orders], "o_orderdate": pa.array([at for _, at in orders], pa.timestamp("us"))}), tmp_path / "orders.parquet")
    pq.write_table(pa.table({"event_id": [i for i, _ in events], "ts": pa.array([at for _, at in events], pa.timestamp("us"))}), tmp_path / "events.parquet")
    moved = [(i, at - events[0][1] + min(o for _, o in orders)) for i, at in events]
    want = sorted((i, k) for i, at in moved for k, day in orders if day <= at < day + timedelta(days=1))
    assert len(want) > 12
    assert sorted(tuple(r) for r in QUERIES["x02_range_join"](spark, str(tmp_path)).collect()) == want


def _postings(tmp_path):
    sources = ["greenhouse", "workday", "jazzhr", "personio", "paylocity", "rippling", "careerpage", None]
    rows = [{"id": f"{s}-{i}", "source": s, "title": f"Title {i}", "location": "Oslo", "company": "Acme", "firstseen": datetime(2025, 11, 1), "checked": datetime(2025, 11, 9)} for k, s in enumerate(sources) for i in range(2 + 100 * k)]
    rows += [rows[0] | {"title": "Another"}, rows[0] | {"id": "blank", "title": " "}, rows[0] | {"id": None}]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "jobs.parquet")
    return {s: 2 + 100 * k for k, s in enumerate(sources)}


def test_normalise_takes_every_platform(spark, tmp_path):
    have = _postings(tmp_path)
    got = {r["source"]: (r["normalised"], r["without_feed"]) for r in QUERIES["n27_normalise_all"](spark, str(tmp_path)).collect()}
    assert got == {s: (0, n) if s in ("careerpage", None) else (n, 0) for s, n in have.items()}


def test_replay_takes_every_posting(spark, tmp_path):
    from sievemill.sources.feeds import FEEDS

    have = _postings(tmp_path)
    got = {r["kind"]: (r["failed"], r["n"], r["without_feed"]) for r in QUERIES["s01_replay_whole"](spark, str(tmp_path)).collect()}
    want = {k: (1, have.get(k, 0), 0) for k in FEEDS} | {s: (0, 0, have[s]) for s in ("careerpage", None)}
    assert got == want


def _instant(text):
    """Microseconds since 1970 by Python, and whether it can tell."""
    s = (text or "").strip()
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    if re.fullmatch(r"\d{1,18}", s):
        n = int(s)
        return (n * 1_000_000 if n < 100_000_000_000 else n * 1000) if n <= 9 * 10**15 else None, True
    if not re.match(r"\d{4}-\d{2}-\d{2}", s):
        return None, True
    try:
        at = datetime.fromisoformat(s)
    except ValueError:
        return None, bool(re.fullmatch(r"[\d-]{10}([T ][\d:.]+)?", s))  # names of zones are Spark's own
    return ((at if at.tzinfo else at.replace(tzinfo=timezone.utc)) - epoch) // timedelta(microseconds=1), True


def test_instants_of_all_published_values(spark, tmp_path):
    stored = {x for (x,) in spark.read.parquet(f"{SMALL}/jobs.parquet").select("published").distinct().collect()}
    values = stored | {"2025-10-25T15:38:37.744Z", "2025-03-19 13:46:54-0700", "2025-05-25T22:50:45+05:30", "2024-03-10 00:19", "2025-02-30", "123456789012345678", "1725455388", "n/a", None}
    pq.write_table(pa.table({"published": pa.array(sorted(values, key=str), pa.string())}), tmp_path / "jobs.parquet")
    got = {r["published"]: r["epoch_us"] for r in QUERIES["f10_iso_instant"](spark, str(tmp_path)).collect()}
    assert got.keys() == values
    want = {v: _instant(v) for v in values}
    assert {v: got[v] for v in values if want[v][1]} == {v: at for v, (at, told) in want.items() if told}
    assert sum(at is not None and "-" in (v or "") for v, at in got.items()) > 20


def _split(folder, name, rows):
    """Rows as files of one row each, delivered in this order."""
    os.makedirs(folder / f"{name}.parquet")
    for i, row in enumerate(rows):
        path = folder / f"{name}.parquet" / f"part-{i}.parquet"
        pq.write_table(pa.Table.from_pylist([row]), path)
        os.utime(path, (1_700_000_000 + 10 * i,) * 2)


def test_streams_of_several_files_in_any_order(spark, tmp_path):
    day = datetime(2024, 1, 1, 12)
    order = [9, 2, 5, 2, 9]
    _split(tmp_path, "events", [{"event_id": i, "ts": day + timedelta(days=k), "event_type": "view"} for i, k in enumerate(order)])
    _split(tmp_path, "sweep_jobs", [{"id": "a" if k != 5 else "b", "checked": day + timedelta(days=k)} for k in order])
    want = {(datetime(2024, 1, 1) + timedelta(days=k), "view", n) for k, n in Counter(order).items()}
    assert {tuple(r) for r in QUERIES["t12_stream_windows_whole"](spark, str(tmp_path)).collect()} == want
    assert {tuple(r) for r in QUERIES["t12_stream_windows"](spark, str(tmp_path)).collect()} == {w for w in want if w[0].day != 10}
    at = {(r["id"], r["firstseen"], r["checked"]) for r in QUERIES["t09_stream_first_seen"](spark, str(tmp_path)).collect()}
    assert at == {("a", day + timedelta(days=2), day + timedelta(days=9)), ("b", day + timedelta(days=5), day + timedelta(days=5))}


def test_first_checks_that_no_watermark_orders(spark, tmp_path):
    day, none = datetime(2025, 1, 1), None
    rows = [("a", day), ("a", none), ("a", datetime(1970, 1, 1)), ("n", none), ("n", none), ("old", datetime(1969, 5, 5)), ("a", datetime(9999, 12, 31)), ("far", datetime(2300, 1, 1)), ("", day), (none, day)]
    pq.write_table(pa.table({"id": pa.array([k for k, _ in rows], pa.string()), "checked": pa.array([at for _, at in rows], pa.timestamp("us"))}), tmp_path / "sweep_jobs.parquet")
    got = {tuple(r) for r in QUERIES["t09_stream_first_seen"](spark, str(tmp_path)).collect()}
    assert got == {("a", datetime(1970, 1, 1), datetime(9999, 12, 31)), ("n", none, none), ("old", datetime(1969, 5, 5), datetime(1969, 5, 5)), ("far", datetime(2300, 1, 1), datetime(2300, 1, 1)), ("", day, day)}


def test_state_of_ids_lies_in_groups(spark, tmp_path):
    """Python is called by group of ids, not by id, and an id leaves its group alone."""
    base = datetime(2025, 1, 1)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ids = [f"id-{i}" for i in range(3 * sweeps.GROUPS)]
    sweep = {0: ids, 30: ids[::2], 60: ids[::4], 61: ["new"]}  # hours: ids
    os.makedirs(tmp_path / "in")
    for n, (hour, seen) in enumerate(sweep.items()):
        path = tmp_path / "in" / f"part-{n}.parquet"
        pq.write_table(pa.table({"id": seen, "checked": pa.array([base + timedelta(hours=hour)] * len(seen), pa.timestamp("us", "UTC"))}), path)
        os.utime(path, (1_700_000_000 + 10 * n,) * 2)
    rows = sweeps.first_seen(sweeps.stream_of(spark, str(tmp_path / "in")), hours=36)
    query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(states) <= sweeps.GROUPS
    got = Counter((r["id"], r["firstseen"], r["checked"], r["stale"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    live = Counter((i, base if hour < 61 else base + timedelta(hours=61), base + timedelta(hours=hour), False) for hour, seen in sweep.items() for i in seen)
    assert got == live + Counter((i, base, base, True) for i in ids if i not in ids[::2])


def test_many_files_share_few_batches(spark, tmp_path, monkeypatch):
    """Each batch writes the state it touches anew, so their number must not grow with the files."""
    day, order = datetime(2024, 1, 1, 12), [k * 7 % 34 for k in range(34)]
    _split(tmp_path, "sweep_jobs", [{"id": f"id-{k % 5}", "checked": day + timedelta(days=k)} for k in order])
    monkeypatch.setattr(pipeline, "_folder", lambda spark: str(tmp_path / "out"))
    got = Counter(tuple(r) for r in QUERIES["t09_stream_first_seen"](spark, str(tmp_path)).collect())
    assert got == Counter((f"id-{i}", day + timedelta(days=i), day + timedelta(days=max(range(i, 34, 5)))) for i in range(5))
    assert 2 <= len([x for x in os.listdir(tmp_path / "out" / "rows") if x.startswith("batch=")]) <= 16
    assert [sweeps.files_a_batch(spark, str(tmp_path / "sweep_jobs.parquet"), n) for n in (1, 5, 33, 34, 99)] == [34, 7, 2, 1, 1]
