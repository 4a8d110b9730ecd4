"""Directories, lists, maps and archives in files."""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.functions.urls import kind_of_csv, last_segment


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """RFC 4180 with a header: quotes doubled inside quotes, line breaks inside fields, headers lower-case
    and trimmed; blank rows are dropped, missing columns are '', as are short rows' fields."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    names = {c: c.strip().lower() for c in df.columns}
    df = df.toDF(*names.values())
    filled = [F.coalesce(F.trim(F.regexp_replace(F.col(c), "\r", "")), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    return df.select(*filled).where(F.concat_ws("", *columns) != "")


def directory(spark: SparkSession, path: str, least: int = 1000) -> DataFrame:
    """(company, kind, token) of a primary directory; raises if it has fewer rows than ``least``."""
    rows = read_csv(spark, path, ["company_name", "ats_vendor", "board_url", "board_slug"])
    if rows.limit(least).count() < least:
        raise ValueError(f"the directory has fewer than {least} rows")
    token = F.when(F.col("board_slug") != "", F.col("board_slug")).otherwise(last_segment(F.col("board_url")))
    return rows.select(F.col("company_name").alias("company"), kind_of_csv(F.col("board_url"), F.col("ats_vendor")).alias("kind"), F.lower(token).alias("token")).where("token is not null")


def union_lists(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON lists of many files with ``list_no``; a file that is missing is skipped."""
    parts = [read_or_empty(spark, p, schema).withColumn("list_no", F.lit(i)) for i, p in enumerate(paths)]
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema + ", list_no int")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file of one list or object, or no rows where it is missing, empty or broken."""
    try:
        text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    except AnalysisException:
        return spark.createDataFrame([], schema)
    kind = T.StructType.fromDDL(schema)
    rows = F.when(F.col("t").startswith("["), F.from_json("t", T.ArrayType(kind))).otherwise(F.array(F.from_json("t", kind)))
    return text.where(F.try_parse_json("t").isNotNull() & F.col("t").rlike(r"^[\[{]")).select(F.explode(rows).alias("r")).where("r is not null").select("r.*")


def sharded_map(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id, value, shard): JSON objects of several files as one map; a later file wins, missing ones are skipped."""
    parts = []
    for i, path in enumerate(paths):
        try:
            whole = spark.read.text(path, wholetext=True)
        except AnalysisException:
            continue
        parts.append(whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "value"), F.lit(i).alias("shard")))
    if not parts:
        return spark.createDataFrame([], "id string, value string, shard int")
    return functools.reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.max_by("value", "shard").alias("value"), F.max("shard").alias("shard"))


def gapless(paths: list[str], exists) -> list[str]:
    """The shards up to the first one that is not there."""
    out: list[str] = []
    for path in paths:
        if not exists(path):
            break
        out.append(path)
    return out


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of an archive's index; broken lines are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, guid, pubDate, description) of the items of feeds in XML, tolerant of unescaped text."""
    from sievemill.functions.text import decode_xml

    page = spark.read.text(path, wholetext=True)
    items = page.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), 1)).alias("item"))
    return items.select(*[decode_xml(F.regexp_extract("item", rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1)).alias(t) for t in ("title", "link", "guid", "pubDate", "description")])


def comment_tree(payload: Column) -> Column:
    """First lines and texts of the children of a thread."""
    children = F.from_json(F.get_json_object(payload, "$.children"), "array<struct<id:bigint,author:string,text:string>>")
    return F.filter(children, lambda c: F.coalesce(c["text"], F.lit("")) != "")
