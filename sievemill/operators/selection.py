"""Choosing the boards of a sweep: extras, hot ones, and a rotating slice of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions.text import numeric_hash
from sievemill.functions.urls import board_key
from sievemill.sources.files import read_or_empty


def hot_boards(jobs: DataFrame, now: Column, days: int) -> DataFrame:
    """Boards with a posting first seen within ``days``."""
    return jobs.groupBy("boardkey").agg(F.max("firstseen").alias("last_seen")).where(F.col("last_seen") >= now - F.make_dt_interval(F.lit(days))).select("boardkey")


def tiers(boards: DataFrame, hot: DataFrame, slices: int, index: int) -> DataFrame:
    """The boards with ``tier``: extra, hot, slice, or null for those not in this sweep.

    The slice of a board is a hash of its key, so ``slices`` sweeps visit every board; written as a
    partition column it prunes the scan of the directory.
    """
    marked = boards.join(hot.select("boardkey").distinct().withColumn("__hot", F.lit(True)), "boardkey", "left")
    mine = numeric_hash(F.col("boardkey")) % slices == index % slices
    return marked.withColumn("tier", F.when(F.col("from_extra"), "extra").when(F.col("__hot"), "hot").when(mine, "slice")).drop("__hot")


def board_yield(statuses: DataFrame) -> DataFrame:
    """Per board the checks, the postings found and their ratio."""
    key = board_key(F.col("type"), F.col("token"))
    per = statuses.groupBy(key.alias("boardkey")).agg(F.count(F.lit(1)).alias("checks"), F.sum(F.coalesce(F.col("matched").cast("bigint"), F.lit(0))).alias("found"))
    return per.withColumn("yield", F.col("found") / F.col("checks"))


def merged_yield(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """The yields of ``old`` with the checks and postings of ``fresh`` added: sums of both, so a sweep is
    merged without reading those before it."""
    per = old.select("boardkey", "checks", "found").unionByName(fresh.select("boardkey", "checks", "found")).groupBy("boardkey").agg(F.sum("checks").alias("checks"), F.sum("found").alias("found"))
    return per.withColumn("yield", F.col("found") / F.col("checks"))


def next_rotation(spark: SparkSession, path: str, slices: int) -> int:
    """The slice of this sweep; the next one is written to ``path``, a file that the writer's commit makes
    whole. Without a file, or with one that cannot be read, the rotation starts at 0."""
    state = read_or_empty(spark, path, "rotationIdx bigint").first()
    index = (state["rotationIdx"] or 0) % slices if state else 0
    spark.createDataFrame([((index + 1) % slices,)], "rotationIdx bigint").coalesce(1).write.mode("overwrite").json(path)
    return index


def by_yield(boards: DataFrame, yields: DataFrame) -> DataFrame:
    """The boards, best yield first (0 for unknown ones), then by key; a distributed sort."""
    known = yields.select("boardkey", "yield")
    return boards.join(known, "boardkey", "left").withColumn("yield", F.coalesce("yield", F.lit(0.0))).orderBy(F.desc("yield"), "boardkey", "token")
