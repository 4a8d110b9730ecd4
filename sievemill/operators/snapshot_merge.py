"""Merging a sweep's postings with the previous snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.operators.keyed import first_wins

#: Hours for which rows of boards that failed, or were not polled, survive.
KEEP_HOURS = 36


def survivors(previous: DataFrame, ok_boards: DataFrame, now: Column, hours: int = KEEP_HOURS) -> DataFrame:
    """Previous rows of boards without success in this sweep, checked within ``hours``, marked stale."""
    young = previous.where(F.col("checked") > now - F.make_dt_interval(hours=F.lit(hours)))
    return young.join(ok_boards.select("boardkey").distinct(), "boardkey", "left_anti").withColumn("stale", F.lit(True))


def merged(current: DataFrame, previous: DataFrame, ok_boards: DataFrame, now: Column, hours: int = KEEP_HOURS) -> DataFrame:
    """Current rows and survivors, one row an id: a fresh row before a stale one, then the latest check."""
    both = current.withColumn("stale", F.lit(False)).unionByName(survivors(previous, ok_boards, now, hours).select(*current.columns, "stale"))
    return first_wins(both.where("id is not null"), ["id"], [F.col("stale").cast("int"), -F.unix_micros("checked")])


def carried(rows: DataFrame, previous: DataFrame, field: str, *, previous_first: bool = False, fallback: Column | None = None) -> DataFrame:
    """``field`` from this row or from the previous one of the id, whichever of the two comes first."""
    before = previous.where("id is not null").groupBy("id").agg(F.min(field).alias("__before"))
    order = [F.col("__before"), F.col(field)] if previous_first else [F.col(field), F.col("__before")]
    return rows.join(before, "id", "left").withColumn(field, F.coalesce(*order, *([fallback] if fallback is not None else []))).drop("__before")


def repaired(rows: DataFrame, repairs: DataFrame, field: str, repair: str) -> DataFrame:
    """``field`` replaced by the date of a repair list where that is earlier; null fields stay null."""
    better = repairs.groupBy("id").agg(F.min(repair).alias("__repair"))
    return rows.join(better, "id", "left").withColumn(field, F.when(F.col(field).isNotNull(), F.least(field, "__repair"))).drop("__repair")


def clamped(rows: DataFrame, field: str, now: Column, days: int, only: Column) -> DataFrame:
    """``field`` null where ``only`` holds and it is older than ``days`` days."""
    return rows.withColumn(field, F.when(~(F.coalesce(only, F.lit(False)) & F.coalesce(F.col(field) < now - F.make_dt_interval(F.lit(days)), F.lit(False))), F.col(field)))


def clamped_to(rows: DataFrame, field: str, latest: Column) -> DataFrame:
    """``field`` no later than ``latest``; null stays null."""
    return rows.withColumn(field, F.when(F.col(field) > latest, latest).otherwise(F.col(field)))
