"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.operators.keyed import upsert


def write_snapshot(jobs: DataFrame, coverage: DataFrame, path: str) -> None:
    """The postings as Parquet and JSON (null fields left out) and the coverage beside them; the writers'
    commit makes each of them whole or absent."""
    jobs.write.mode("overwrite").parquet(f"{path}/jobs")
    jobs.write.mode("overwrite").option("ignoreNullFields", True).json(f"{path}/jobs_json")
    coverage.write.mode("overwrite").json(f"{path}/coverage")


def merge_discovered(previous: DataFrame, found: DataFrame, directory: DataFrame) -> DataFrame:
    """Previous and new boards, the new ones first, without those of the directory."""
    keys = ["type", "token"]
    return upsert(previous.select("company", *keys), found.select("company", *keys).dropDuplicates(keys), keys).join(directory.select(*keys), keys, "left_anti")


def without_nulls(rows: DataFrame) -> DataFrame:
    """Each row as JSON without its null fields."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("json"))
