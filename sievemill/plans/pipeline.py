"""Queries of the sweep's pipeline: selection, merge, sinks and streams."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions.urls import board_key
from sievemill.operators import selection, snapshot_merge
from sievemill.plans.registry import QUERIES, query
from sievemill.plans.relational import _HASH, _KEY, _SWEEP, _latest, _of_last
from sievemill.plans.sourcing import _folder
from sievemill.session import table
from sievemill.sources import sinks
from sievemill.streaming import sweeps

_NOW = "2025-11-07 08:00:00"


def _now() -> Column:
    return F.lit(_NOW).cast("timestamp")


def _ok(board_statuses: DataFrame) -> DataFrame:
    last = board_statuses.agg(F.max("sweep_no").alias("sweep_no"))
    return board_statuses.where("ok").join(F.broadcast(last), "sweep_no").select(board_key(F.col("type"), F.col("token")).alias("boardkey")).distinct()


_OK = f"(SELECT DISTINCT {_KEY} AS boardkey FROM board_statuses WHERE ok AND sweep_no = (SELECT max(sweep_no) FROM board_statuses))"
_OLD = f"(SELECT * FROM {_SWEEP.format(1)} p WHERE checked > TIMESTAMP '{_NOW}' - INTERVAL 36 HOUR AND p.boardkey NOT IN (SELECT boardkey FROM {_OK}))"


@query("boards", "jobs", sql=f"""
SELECT boardkey, token, CASE WHEN from_extra THEN 'extra' WHEN boardkey IN (SELECT boardkey FROM jobs GROUP BY 1 HAVING max(firstseen) >= TIMESTAMP '2025-11-08 00:00:00') THEN 'hot' ELSE 'slice' END AS tier FROM boards
WHERE from_extra OR boardkey IN (SELECT boardkey FROM jobs GROUP BY 1 HAVING max(firstseen) >= TIMESTAMP '2025-11-08 00:00:00') OR {_HASH} % 16 = 5""")
def t03_tiered_selection(boards: DataFrame, jobs: DataFrame) -> DataFrame:
    hot = selection.hot_boards(jobs, F.lit("2025-11-09 00:00:00").cast("timestamp"), 1)
    return selection.tiers(boards, hot, 16, 5).where("tier is not null").select("boardkey", "token", "tier")


@query("sweep_jobs", "board_statuses", sql=f"SELECT id, true AS stale FROM {_OLD}")
def t04_survivors(sweep_jobs: DataFrame, board_statuses: DataFrame) -> DataFrame:
    return snapshot_merge.survivors(_latest(sweep_jobs, 1), _ok(board_statuses), _now()).select("id", "stale")


def _cut(sweep_jobs: DataFrame, back: int) -> DataFrame:
    rows = _latest(sweep_jobs, back, "boardkey", "title", "firstseen").select("id", "boardkey", "title", "checked", "firstseen")
    return rows.withColumn("firstseen", F.col("firstseen").try_cast("timestamp"))


@query("sweep_jobs", "board_statuses", sql=f"""
WITH c AS (SELECT id, title, checked FROM {_SWEEP.format(0)}), m AS (SELECT id, title, checked, false AS stale FROM c UNION ALL SELECT id, title, checked, true FROM {_OLD} WHERE id NOT IN (SELECT id FROM c))
SELECT stale, count(*) AS n, max(checked) AS checked FROM m GROUP BY stale""")
def t01_merge(sweep_jobs: DataFrame, board_statuses: DataFrame) -> DataFrame:
    """A sweep's rows and the survivors of the one before, a fresh row before a stale one (J03, T04, D07)."""
    both = snapshot_merge.merged(_cut(sweep_jobs, 0), _cut(sweep_jobs, 1), _ok(board_statuses), _now())
    return both.groupBy("stale").agg(F.count(F.lit(1)).alias("n"), F.max("checked").alias("checked"))


@query("sweep_jobs", sql=f"""
SELECT c.id, coalesce(CAST(CAST(p.firstseen AS TIMESTAMPTZ) AS TIMESTAMP), CAST(CAST(c.firstseen AS TIMESTAMPTZ) AS TIMESTAMP), c.checked) AS firstseen
FROM {_SWEEP.format(0)} c LEFT JOIN {_SWEEP.format(1)} p USING (id)""")
def t05_first_seen(sweep_jobs: DataFrame) -> DataFrame:
    return snapshot_merge.carried(_cut(sweep_jobs, 0), _cut(sweep_jobs, 1), "firstseen", previous_first=True, fallback=F.col("checked")).select("id", "firstseen")


@query("sweep_jobs", sql=f"SELECT c.id, coalesce(CAST(CAST(c.firstseen AS TIMESTAMPTZ) AS TIMESTAMP), CAST(CAST(p.firstseen AS TIMESTAMPTZ) AS TIMESTAMP)) AS firstseen FROM {_SWEEP.format(0)} c LEFT JOIN {_SWEEP.format(1)} p USING (id)")
def t06_current_first(sweep_jobs: DataFrame) -> DataFrame:
    return snapshot_merge.carried(_cut(sweep_jobs, 0), _cut(sweep_jobs, 1), "firstseen").select("id", "firstseen")


@query("sweep_jobs", "jobs", sql=f"""
SELECT c.id, CASE WHEN c.firstseen IS NOT NULL THEN least(CAST(CAST(c.firstseen AS TIMESTAMPTZ) AS TIMESTAMP), r.at) END AS firstseen
FROM {_SWEEP.format(0)} c LEFT JOIN (SELECT id, min(firstseen) AS at FROM jobs GROUP BY 1) r USING (id)""")
def t07_repaired(sweep_jobs: DataFrame, jobs: DataFrame) -> DataFrame:
    return snapshot_merge.repaired(_cut(sweep_jobs, 0), jobs.select("id", F.col("firstseen").alias("at")), "firstseen", "at").select("id", "firstseen")


@query("sweep_jobs", sql=f"""
SELECT id, CASE WHEN NOT (starts_with(boardkey, 'workday:') AND CAST(CAST(firstseen AS TIMESTAMPTZ) AS TIMESTAMP) < TIMESTAMP '{_NOW}' - INTERVAL 30 DAY) OR firstseen IS NULL OR boardkey IS NULL THEN CAST(CAST(firstseen AS TIMESTAMPTZ) AS TIMESTAMP) END AS firstseen FROM {_SWEEP.format(0)}""")
def t08_clamped(sweep_jobs: DataFrame) -> DataFrame:
    return snapshot_merge.clamped(_cut(sweep_jobs, 0), "firstseen", _now(), 30, F.col("boardkey").startswith("workday:")).select("id", "firstseen")


@query("jobs", sql="SELECT DISTINCT id, CASE WHEN checked > firstseen THEN firstseen ELSE checked END AS checked FROM jobs")
def t08_clamped_to_first(jobs: DataFrame) -> DataFrame:
    """An instant no later than the first sight."""
    return snapshot_merge.clamped_to(jobs.select("id", "checked", "firstseen"), "checked", F.col("firstseen")).select("id", "checked").distinct()


@query("sweep_jobs", sql=f"""
WITH c AS (SELECT id, CAST(CAST(firstseen AS TIMESTAMPTZ) AS TIMESTAMP) AS f FROM {_SWEEP.format(0)}), p AS (SELECT id, CAST(CAST(firstseen AS TIMESTAMPTZ) AS TIMESTAMP) AS f FROM {_SWEEP.format(1)})
SELECT c.id, c.f IS DISTINCT FROM p.f AS reassessed FROM c LEFT JOIN p USING (id)""")
def t12_reassessed(sweep_jobs: DataFrame) -> DataFrame:
    """Postings whose first sight changed since the sweep before, which are assessed again."""
    was = _cut(sweep_jobs, 1).select("id", F.col("firstseen").alias("was"))
    return _cut(sweep_jobs, 0).join(was, "id", "left").select("id", (~F.col("firstseen").eqNullSafe(F.col("was"))).alias("reassessed"))


@query("events", sql="SELECT hour(ts) % 4 AS slot, count(*) AS n FROM events GROUP BY 1")
def t11_rotation_slot(events: DataFrame) -> DataFrame:
    return events.groupBy(sweeps.rotation_slot(F.col("ts"), 4).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query("board_statuses", "boards", sql=f"""
WITH s AS (SELECT DISTINCT type, token FROM board_statuses)
SELECT type, token FROM s WHERE NOT EXISTS (SELECT 1 FROM boards b WHERE b.type = s.type AND b.token = s.token AND b.from_extra)""")
def k06_merge_discovered(board_statuses: DataFrame, boards: DataFrame) -> DataFrame:
    """The boards of the last sweep as found, those of the sweeps before as known."""
    marked = _of_last(board_statuses)
    known = marked.where("not is_last").dropDuplicates(["type", "token"])
    return sinks.merge_discovered(known, marked.where("is_last"), boards.where("from_extra")).select("type", "token")


def t03_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Three sweeps of a rotation by five whose cursor lies in a file: the boards each of them visits."""
    boards, state = table(spark, d, "boards"), os.path.join(_folder(spark), "state")
    none = spark.createDataFrame([], "boardkey string")
    out = None
    for sweep in range(3):
        chosen = selection.tiers(boards.withColumn("from_extra", F.lit(False)), none, 5, selection.next_rotation(spark, state, 5)).where("tier = 'slice'")
        part = chosen.groupBy(F.lit(sweep).alias("sweep")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("boardkey").alias("boards"))
        out = part if out is None else out.unionByName(part)
    return out


def t02_budget(spark: SparkSession, d: str) -> DataFrame:
    """Sweeps repeated within an hour of a clock of its own that each of them moves by 400 seconds: every
    one reads the table and adds what it saw to the sums of those before (T02, A11)."""
    statuses, clock, seen = table(spark, d, "board_statuses"), [0.0], []

    def sweep() -> None:
        row = statuses.where(F.col("sweep_no") % 8 == len(seen) % 8).agg(F.count(F.lit(1)).alias("boards"), F.coalesce(F.sum(F.col("matched").cast("bigint")), F.lit(0)).alias("jobs")).first()
        before = seen[-1] if seen else (0, 0, 0)
        seen.append((before[0] + 1, before[1] + row["boards"], before[2] + row["jobs"]))
        clock[0] += 400

    sweeps.within_budget(sweep, 1.0, clock=lambda: clock[0])
    return spark.createDataFrame(seen, "iteration bigint, boards bigint, jobs bigint")


def k02_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot written as Parquet, JSON and coverage, and read back from JSON."""
    jobs = table(spark, d, "jobs")
    out = _folder(spark)
    sinks.write_snapshot(jobs.drop("descriptiontext"), jobs.agg(F.count(F.lit(1)).alias("jobs")), out)
    again = spark.read.schema(jobs.drop("descriptiontext").schema).json(f"{out}/jobs_json")
    return again.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


def k07_rescored(spark: SparkSession, d: str) -> DataFrame:
    """A version with an added column written beside the old one and read again."""
    out = os.path.join(_folder(spark), "version=2")
    table(spark, d, "jobs").withColumn("band", F.when(F.col("fitscore") >= 70, "high").otherwise("rest")).write.parquet(out)
    return spark.read.parquet(out).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def t02_stream_sweeps(spark: SparkSession, d: str) -> DataFrame:
    """Micro-batches of the snapshots' files, each written under its number (T01, T09, T10)."""
    out = _folder(spark)
    table(spark, d, "sweep_jobs")  # pins the session to UTC
    sweeps.write_batches(sweeps.stream_of(spark, f"{d}/sweep_jobs.parquet"), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").groupBy("sweep_no").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


def t09_stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """State by id with a time to live: the first check is frozen, ids not checked for 36 hours leave.

    The files of a table may come in any order, so the lateness is the span of the checks. Rows that no
    watermark orders (no check, or one outside 1970 to 2262) come from the table, beside the stream. Each
    micro-batch reads the state it touches and writes it anew, so many files share a batch and the cost
    does not grow as files times ids."""
    out, path = _folder(spark), f"{d}/sweep_jobs.parquet"
    every = table(spark, d, "sweep_jobs").where("id is not null").select("id", "checked")
    first, end = (F.lit(at).cast("timestamp") for at in ("1970-01-01", "2262-01-01"))
    ordered = (F.col("checked") > first) & (F.col("checked") < end)
    beside = every.where(F.col("checked").isNull() | (F.col("checked") <= first) | (F.col("checked") >= end))
    ends = every.where(ordered).agg(F.min(F.unix_seconds("checked")).alias("a"), F.max(F.unix_seconds("checked")).alias("b")).first()
    late = f"{ends['b'] - ends['a'] + 1 if ends['a'] is not None else 0} seconds"
    stream = sweeps.stream_of(spark, path, sweeps.files_a_batch(spark, path)).where(ordered)
    sweeps.write_batches(sweeps.first_seen(stream, hours=snapshot_merge.KEEP_HOURS, late=late), f"{out}/rows", f"{out}/state")
    rows = spark.read.parquet(f"{out}/rows").select("id", "firstseen", "checked").unionByName(beside.select("id", F.col("checked").alias("firstseen"), "checked"))
    return rows.groupBy("id").agg(F.min("firstseen").alias("firstseen"), F.max("checked").alias("checked"))


def t12_stream_windows_whole(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of event time, those open at the end included. The files of a table may come in any
    order, so no row is late: each batch gives the windows it changed, whose last count is their greatest."""
    out = _folder(spark)
    table(spark, d, "events")
    sweeps.write_batches(sweeps.windowed_counts(sweeps.stream_of(spark, f"{d}/events.parquet"), "ts", "event_type", None, "1 day"), f"{out}/rows", f"{out}/state", "update")
    return spark.read.parquet(f"{out}/rows").groupBy("window_start", "event_type").agg(F.max("n").alias("n"))


def t12_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows that an hour of lateness has closed at the end, as this report's SQL has it."""
    last = table(spark, d, "events").agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("closed"))
    windows = t12_stream_windows_whole(spark, d).join(F.broadcast(last), F.col("window_start") + F.expr("INTERVAL 1 DAY") <= F.col("closed"))
    return windows.select("window_start", "event_type", "n")


for _f in (t03_rotation, t02_budget, k02_snapshot, k07_rescored, t02_stream_sweeps, t09_stream_first_seen, t12_stream_windows, t12_stream_windows_whole):
    QUERIES[_f.__name__] = _f

from sievemill.plans.registry import SQL  # noqa: E402

SQL["t03_rotation"] = f"SELECT sweep, count(*) AS n, count(DISTINCT boardkey) AS boards FROM boards, (SELECT CAST(unnest([0, 1, 2]) AS INT) AS sweep) WHERE {_HASH} % 5 = sweep GROUP BY sweep"
SQL["t02_budget"] = """
WITH i AS (SELECT unnest(range(8)) AS k), s AS (SELECT k, count(sweep_no) AS boards, coalesce(sum(matched), 0) AS jobs FROM i LEFT JOIN board_statuses ON sweep_no % 8 = k GROUP BY k)
SELECT k + 1 AS iteration, CAST(sum(boards) OVER (ORDER BY k) AS BIGINT) AS boards, CAST(sum(jobs) OVER (ORDER BY k) AS BIGINT) AS jobs FROM s"""
SQL["k02_snapshot"] = "SELECT source, count(*) AS n, count(DISTINCT id) AS ids FROM jobs GROUP BY source"
SQL["k07_rescored"] = "SELECT CASE WHEN fitscore >= 70 THEN 'high' ELSE 'rest' END AS band, count(*) AS n FROM jobs GROUP BY 1"
SQL["t02_stream_sweeps"] = "SELECT sweep_no, count(*) AS n, count(DISTINCT id) AS ids FROM sweep_jobs GROUP BY sweep_no"
SQL["t09_stream_first_seen"] = "SELECT id, min(checked) AS firstseen, max(checked) AS checked FROM sweep_jobs WHERE id IS NOT NULL GROUP BY id"
# Append output holds back the windows that the watermark has not closed: those that end after the last event less an hour.
SQL["t12_stream_windows"] = "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL"
SQL["t12_stream_windows_whole"] = "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL"
