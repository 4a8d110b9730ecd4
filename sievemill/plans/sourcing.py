"""Queries of the sources: envelopes, normalisers of every platform, files and archives."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemill.functions.text import collapse
from sievemill.plans.registry import QUERIES, SQL, query
from sievemill.session import cut, map_batches, table
from sievemill.sources import aggregators, feeds, files, paging, replay, sinks

_PLAIN = r"trim(regexp_replace(title, '[\s\x{00A0}]+', ' ', 'g'))"
_NUMBER = {kind: f"n{i:02d}_{kind}" for i, kind in enumerate(feeds.FEEDS, 1)}


def _payload(kind: str) -> Column:
    """A posting as the platform would deliver it."""
    when = {"iso": F.date_format("firstseen", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "relative": F.lit("3 days ago"), "day_first": F.date_format("firstseen", "d/M/yyyy"), "rfc": F.date_format("firstseen", "EEE, dd MMM yyyy HH:mm:ss '+0000'")}[feeds.FEEDS[kind].dated]
    return feeds.as_delivered(kind, F.md5("id"), F.col("title"), F.coalesce("location", F.lit("")), F.concat(F.lit("https://x.example/"), F.md5("id")), when)


def _envelope(item: Column) -> Column:
    return F.concat(F.lit('{"total":1,"jobs":['), item, F.lit("]}"))


def _payloads(jobs: DataFrame, kind: str) -> DataFrame:
    """The postings as the platform would deliver them, one payload a row, in an envelope."""
    rows = jobs.where("id is not null and title is not null").select("id", "title", "location", "firstseen", "checked", "company").distinct()
    return rows.select(F.lit("acme/site").alias("token"), "company", "checked", _envelope(_payload(kind)).alias("payload"))


def _of_their_feeds(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, kind, company, checked, item): each titled posting once, as its own source would deliver it; and
    (source, without_feed): the numbers of the postings whose source has no feed, or is null."""
    known = F.coalesce(F.col("source").isin(*feeds.FEEDS), F.lit(False))
    titled = jobs.where(F.col("id").isNotNull() & (collapse(F.col("title")) != ""))
    fields = ("title", "location", "firstseen", "checked", "company")
    once = titled.where(known).groupBy("id", "source").agg(F.min(F.struct(*fields)).alias("p")).select("id", "source", "p.*")
    item = F.coalesce(*[F.when(F.col("source") == k, _payload(k)) for k in feeds.FEEDS])
    lacking = titled.where(~known).groupBy("source").agg(F.count_distinct("id").alias("without_feed"))
    return once.select("id", F.col("source").alias("kind"), "company", "checked", item.alias("item")), lacking


def _add_feed(kind: str) -> None:
    feed = feeds.FEEDS[kind]
    native = "concat('https://x.example/', md5(id))" if feed.native[0] == (feed.url or ("",))[0] else "title" if feed.native[0] == "title" else "md5(id)"
    published = {"iso": "date_trunc('second', firstseen)", "rfc": "date_trunc('second', firstseen)", "relative": "checked - INTERVAL 3 DAY", "day_first": "date_trunc('day', firstseen)"}[feed.dated] if feed.published else "NULL"
    if kind == "workday":
        native = "md5(id)"
    place = "CASE WHEN trim(coalesce(location, ''), ' ') = '' THEN 'Not listed' ELSE location END" if feed.location else "'Not listed'"
    if feed.location and feed.location[0][0].endswith("[*]"):
        place = "CASE WHEN trim(coalesce(location, ''), ' ') = '' THEN 'Not listed' ELSE trim(location, ' ') END"
    if feed.location and feed.location[0][0].startswith("["):
        place = "CASE WHEN trim(coalesce(location, ''), ' ') = '' THEN 'Not listed' ELSE trim(location, ' ') END"

    def run(spark: SparkSession, d: str) -> DataFrame:
        payloads = _payloads(table(spark, d, "jobs"), kind)
        items = payloads.select("company", "token", "checked", F.explode(feeds.unwrap(F.col("payload"))).alias("item"))
        return feeds.normalise(items, kind).select("id", "title", "location", "published").distinct()

    QUERIES[_NUMBER[kind]] = run
    SQL[_NUMBER[kind]] = f"""
SELECT DISTINCT concat('{kind}:acme/site:', {native}) AS id, {_PLAIN} AS title, {place} AS location, CAST({published} AS TIMESTAMP) AS published
FROM jobs WHERE id IS NOT NULL AND {_PLAIN} <> ''"""


for _kind in feeds.FEEDS:
    _add_feed(_kind)


@query("jobs", sql="SELECT DISTINCT id, 1 + (length(id) % 9) AS n FROM jobs")
def s37_envelopes(jobs: DataFrame) -> DataFrame:
    """A list under each of the keys a platform may use, bare, or nested in the first item."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), 1 + F.length("id") % 9), lambda i: F.concat(F.lit('{"i":'), i.cast("string"), F.lit("}"))), ","), F.lit("]"))
    kind = F.length("id") % (len(feeds.ENVELOPES) + 2)
    payload = F.when(kind == 0, listed).when(kind == 1, F.concat(F.lit('{"items":[{"requisitionList":'), listed, F.lit("}]}")))
    for i, key in enumerate(feeds.ENVELOPES):
        payload = payload.when(kind == i + 2, F.concat(F.lit(f'{{"other":1,"{key}":'), listed, F.lit("}")))
    return jobs.select("id").distinct().select("id", F.size(feeds.unwrap(payload)).alias("n"))


_LISTED = ", ".join(f"'{k}'" for k in feeds.FEEDS)
_TITLED = f"SELECT DISTINCT id, source, coalesce(source IN ({_LISTED}), false) AS known FROM jobs WHERE id IS NOT NULL AND {_PLAIN} <> ''"


@query("jobs", sql=f"SELECT source, count_if(known) AS normalised, count_if(NOT known) AS without_feed FROM ({_TITLED}) GROUP BY source")
def n27_normalise_all(jobs: DataFrame) -> DataFrame:
    """Payloads of every platform in one table, each by its own projection; the postings of sources without a
    feed are counted as such."""
    rows, lacking = _of_their_feeds(jobs)
    payloads = rows.select("kind", F.lit("acme/site").alias("token"), "company", "checked", _envelope(F.col("item")).alias("payload"))
    done = feeds.normalise_all(payloads).select("id", "source").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("normalised"))
    return done.withColumn("without_feed", F.lit(0).cast("bigint")).unionByName(lacking.withColumn("normalised", F.lit(0).cast("bigint")))


@query("boards", sql="SELECT DISTINCT company, type, token FROM boards WHERE company IS NOT NULL")
def n28_json_without_nulls(boards: DataFrame) -> DataFrame:
    """Rows to JSON without null fields and back."""
    rows = boards.where("company is not null").select("company", "type", "token", F.lit(None).cast("string").alias("nothing"))
    back = F.from_json("json", "company string, type string, token string")
    return sinks.without_nulls(rows).where("json not like '%nothing%'").select(back.alias("b")).select("b.*").distinct()


def _folder(spark: SparkSession, mounted: bool = False) -> str:
    """A new folder beside the checkpoints, which all executors share. Files that are written without Spark
    need it to be a mounted path, and anything else is refused rather than put on one machine."""
    from sievemill.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/recorded-{uuid.uuid4().hex}"
    if not mounted:
        return folder
    path = re.sub(r"^file:/*(?=/)", "", folder)
    if "://" in path or not os.path.isabs(path):
        raise RuntimeError(f"{folder} is no mounted path")
    os.makedirs(path)
    return path


def _recorded(text: str, name: str, spark: SparkSession) -> str:
    path = os.path.join(_folder(spark, mounted=True), name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


_CSV = 'Company_Name ,ATS_Vendor,Board_URL,Board_Slug\r\n"Acme, ""Big"" Foods",Other,https://boards.greenhouse.io/acme,\r\n,,,\r\nBeta,Lever,https://jobs.lever.co/beta-co?x=1,\r\n"Two\nLines",Ashby,,gamma\r\nShort,Workday\r\n'


def s32_csv(spark: SparkSession, d: str) -> DataFrame:
    """Quotes, line breaks inside fields, blank and short rows."""
    return files.read_csv(spark, _recorded(_CSV, "directory.csv", spark), ["company_name", "ats_vendor", "board_url", "board_slug"])


def s33_directory(spark: SparkSession, d: str) -> DataFrame:
    return files.directory(spark, _recorded(_CSV, "directory.csv", spark), least=3)


def s34_json_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of several files, one of them missing."""
    here = _recorded(json.dumps([{"company": "A", "type": "lever", "token": "a"}, {"company": "B", "type": "ashby", "token": "b"}]), "boards.json", spark)
    return files.union_lists(spark, [here, here + ".missing"], "company string, type string, token string")


def s35_read_or_empty(spark: SparkSession, d: str) -> DataFrame:
    return files.read_or_empty(spark, "/nowhere/state.json", "nextOffset bigint, rotationIdx bigint")


def s36_sharded_map(spark: SparkSession, d: str) -> DataFrame:
    one, two = _recorded('{"a":"1","b":"2"}', "map.json", spark), _recorded('{"b":"3"}', "map-1.json", spark)
    return files.sharded_map(spark, [one, two, two + ".missing"])


def s31_index_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an archive's index, a broken one among them, to boards."""
    from sievemill.functions.urls import board_of_url

    path = _recorded('{"url":"https://jobs.lever.co/acme/1","status":"200"}\n{broken\n{"url":"https://beta.recruitee.com/o/2","status":"200"}\n', "index.jsonl", spark)
    rows = files.json_lines(spark, path, "url string, status string")
    return rows.select(board_of_url(F.col("url")).alias("b")).select("b.*")


def s25_rss(spark: SparkSession, d: str) -> DataFrame:
    page = "<rss><channel><item><title><![CDATA[A & B]]></title><link>https://x.example/1</link><guid>1</guid><pubDate>Wed, 13 Aug 2025 08:48:15 +0530</pubDate><description>&lt;p&gt;Location: Oslo&lt;/p&gt;</description></item></channel></rss>"
    return files.rss_items(spark, _recorded(page, "feed.xml", spark))


def s27_thread(spark: SparkSession, d: str) -> DataFrame:
    """The children of a thread with the first line of each."""
    text = json.dumps({"id": 1, "children": [{"id": 2, "author": "ann", "text": "Acme | Engineer | Remote<p>We ..."}, {"id": 3, "author": "bob", "text": None}]})
    page = spark.createDataFrame([(text,)], "payload string")
    rows = page.select(F.explode(files.comment_tree(F.col("payload"))).alias("c")).select("c.*")
    return rows.withColumn("first_line", collapse(F.regexp_extract("text", r"(?s)^(.*?)(?:<p>|\n|$)", 1)))


def s01_replay(spark: SparkSession, d: str) -> DataFrame:
    """Every platform's recorded payloads through the data source and the normalisers (S01-S30).

    Two boards a platform are recorded, one of them broken: it becomes a status row and the other is read.
    """
    root = _folder(spark, mounted=True)
    for kind in feeds.FEEDS:
        os.makedirs(os.path.join(root, kind))
        with open(os.path.join(root, kind, "bad.json"), "w") as f:
            f.write("{")
    at = F.lit("2025-11-01 00:00:00").cast("timestamp")
    sample = spark.range(1).select(F.lit("a1").alias("id"), F.lit("Data Engineer").alias("title"), F.lit("Oslo").alias("location"), at.alias("firstseen"), at.alias("checked"), F.lit("Acme").alias("company"))
    made = None
    for kind in feeds.FEEDS:
        part = _payloads(sample, kind).withColumn("kind", F.lit(kind))
        made = part if made is None else made.unionByName(part)
    for r in made.collect():  # the recorded fixture of one posting a platform, not the data
        with open(os.path.join(root, r["kind"], "acme%2Fsite.json"), "w") as f:
            json.dump({"company": r["company"], "payload": json.loads(r["payload"])}, f)
    replay.register(spark)
    read = spark.read.format("boards_replay").option("path", root).load()
    good = feeds.normalise_all(read.where("ok").withColumn("checked", at)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    status = read.groupBy("kind").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))
    return status.join(good, F.col("kind") == F.col("source"), "left").select("kind", "ok", "failed", F.coalesce("n", F.lit(0)).alias("n"))


#: Postings in one recorded file.
_PAGE = 200


def _record(rows: DataFrame, root: str) -> None:
    """(id, kind, company, item) as files <root>/<kind>/, a page of postings each, written by the executors.
    A task done twice writes the same names, each file whole."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, kind, page, held, files = TaskContext.get().partitionId(), None, 0, [], 0

        def flush() -> int:
            if not held:
                return 0
            name = os.path.join(root, kind, f"acme%2Fsite-{part}-{page}.json")
            with open(f"{name}.{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
                f.write(f'{{"payload": [{",".join(held)}]}}')
            os.replace(f.name, name)
            return 1

        for pdf in batches:
            for k, item in zip(pdf["kind"], pdf["item"], strict=True):
                if k != kind or len(held) == _PAGE:
                    files, page, held = files + flush(), page + 1, []
                    kind = k
                held.append(item)
        yield pd.DataFrame({"files": [files + flush()]})

    rows.repartition("id").sortWithinPartitions("kind", "id").select("kind", "item").mapInPandas(write, "files bigint").agg(F.sum("files")).collect()


def s01_replay_whole(spark: SparkSession, d: str) -> DataFrame:
    """All postings, recorded under their platforms in pages, through the data source and the normalisers; one
    broken board a platform. Postings of sources without a feed are counted as such."""
    root = _folder(spark, mounted=True)
    for kind in feeds.FEEDS:
        os.makedirs(os.path.join(root, kind))
        with open(os.path.join(root, kind, "bad.json"), "w") as f:
            f.write("{")
    rows, lacking = _of_their_feeds(table(spark, d, "jobs"))
    _record(rows, root)
    replay.register(spark)
    read = cut(spark.read.format("boards_replay").option("path", root).load())
    at = F.lit("2025-11-09 00:00:00").cast("timestamp")
    good = feeds.normalise_all(read.where("ok").withColumn("checked", at)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    status = read.groupBy("kind").agg(F.count_if(~F.col("ok")).alias("failed"))
    none = F.lit(0).cast("bigint")
    found = status.join(good, F.col("kind") == F.col("source"), "left").select("kind", "failed", F.coalesce("n", none).alias("n"), none.alias("without_feed"))
    return found.unionByName(lacking.select(F.col("source").alias("kind"), none.alias("failed"), none.alias("n"), "without_feed"))


SQL["s01_replay_whole"] = f"""
WITH t AS ({_TITLED}), feeds AS (SELECT unnest([{_LISTED}]) AS kind)
SELECT kind, 1 AS failed, count(id) AS n, 0 AS without_feed FROM feeds LEFT JOIN t ON source = kind GROUP BY kind
UNION ALL SELECT source, 0, 0, count(*) FROM t WHERE NOT known GROUP BY source"""


_BOARDS = ("smartrecruiters", "workday", "recruitee")


def _record_pages(spark: SparkSession, jobs: DataFrame, root: str) -> DataFrame:
    """The postings of paged platforms as recorded pages of their boards, written by the executors; the boards."""
    rows = jobs.where(F.col("source").isin(*_BOARDS) & F.col("id").isNotNull() & F.col("boardkey").isNotNull() & F.col("title").isNotNull()).select("source", "boardkey", "id", "title").distinct()
    views = F.when(F.col("source") == "workday", F.array_compact(F.array(*[F.when(F.contains(F.lower("title"), F.lit(w)), F.lit(w)) for w in ("data", ".net")]))).otherwise(F.array(F.lit("")))
    sized = rows.withColumn("view", F.explode(views)).withColumn("n", F.row_number().over(Window.partitionBy("source", "boardkey", "view").orderBy("id")) - 1)
    size = F.when(F.col("source") == "workday", 20).otherwise(100)
    paged = sized.withColumn("at", (F.floor(F.col("n") / size) * size).cast("int"))
    totals = sized.groupBy("source", "boardkey", "view").agg(F.count(F.lit(1)).alias("total"))
    pages = paged.groupBy("source", "boardkey", "view", "at").agg(F.to_json(F.collect_list(F.struct("id", "title", F.col("id").alias("externalPath")))).alias("rows")).join(totals, ["source", "boardkey", "view"])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                path = paging.page_path(root, r.source, r.boardkey, r.view, str(r.at))
                os.makedirs(os.path.dirname(path), exist_ok=True)
                held = f"{path}.{uuid.uuid4().hex}"
                with open(held, "w", encoding="utf-8") as f:
                    f.write(f'{{"totalFound": {r.total}, "total": {r.total}, "content": {r.rows}, "jobPostings": {r.rows}}}')
                os.replace(held, path)
            yield pd.DataFrame({"pages": [len(pdf)]})

    map_batches(pages, write, "pages bigint").agg(F.sum("pages")).collect()
    return rows.select(F.col("source").alias("kind"), F.col("boardkey").alias("token"), F.lit("Acme").alias("company")).distinct()


def s04_paged(spark: SparkSession, d: str) -> DataFrame:
    """Boards read page by page: up to a platform's last page, two searches of another with repeats dropped
    (S04, S14), and a platform without a rule as a failure."""
    root = _folder(spark, mounted=True)
    boards = _record_pages(spark, table(spark, d, "jobs"), root)
    read = paging.read_boards(boards, lambda kind, token: paging.recorded(root, kind, token))
    return read.select("kind", "token", "ok", F.coalesce(F.size(F.from_json("payload", "array<string>")), F.lit(0)).alias("n"))


SQL["s04_paged"] = """
WITH j AS (SELECT DISTINCT source, boardkey, id, title FROM jobs WHERE source IN ('smartrecruiters', 'workday', 'recruitee') AND id IS NOT NULL AND boardkey IS NOT NULL AND title IS NOT NULL),
v AS (SELECT *, '' AS v FROM j WHERE source = 'smartrecruiters' UNION ALL SELECT *, 'data' FROM j WHERE source = 'workday' AND contains(lower(title), 'data') UNION ALL SELECT *, '.net' FROM j WHERE source = 'workday' AND contains(lower(title), '.net')),
n AS (SELECT *, row_number() OVER (PARTITION BY boardkey, v ORDER BY id) AS nth FROM v),
t AS (SELECT boardkey, id FROM n WHERE nth <= CASE v WHEN 'data' THEN 100 WHEN '.net' THEN 40 ELSE 300 END)
SELECT source AS kind, b.boardkey AS token, source <> 'recruitee' AS ok, count(DISTINCT t.id) AS n FROM (SELECT DISTINCT source, boardkey FROM j) b LEFT JOIN t ON t.boardkey = b.boardkey GROUP BY ALL"""


@query("jobs", sql="""
SELECT DISTINCT trim(title) AS title, coalesce(company, '') AS company, CASE WHEN trim(coalesce(location, '')) = '' THEN 'Remote' ELSE location END AS location,
  CASE WHEN coalesce(salarymin, 0) <> 0 THEN concat('$', salarymin, '-$', coalesce(CAST(salarymax AS VARCHAR), '')) ELSE '' END AS salary, date_trunc('second', firstseen) AS published FROM jobs WHERE trim(title) <> ''""")
def s28_remote_list(jobs: DataFrame) -> DataFrame:
    """Each posting in a list of its own behind the row that describes it, as the remote list has it (N26)."""
    item = F.struct(F.trim("title").alias("position"), "company", "location", F.col("salarymin").alias("salary_min"), F.col("salarymax").alias("salary_max"), F.date_format("firstseen", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.lit("<p>x</p>").alias("description"))
    payloads = jobs.where("trim(title) <> ''").select(F.concat(F.lit('[{"legal":"terms"},'), F.to_json(item), F.lit("]")).alias("payload"))
    return aggregators.aggregator_rows(payloads, "remoteok", F.lit(None).cast("timestamp")).select("title", "company", "location", "salary", "published").distinct()


@query("jobs", sql="""
SELECT DISTINCT coalesce(nullif(trim(role), ''), trim(title)) AS title, coalesce(company, '') AS company, CASE WHEN trim(coalesce(location, '')) = '' THEN '' ELSE location END AS location, coalesce(CASE WHEN trim(salary) <> '' THEN salary END, '') AS salary, coalesce(applyurl, '') AS url FROM jobs
WHERE coalesce(nullif(trim(role), ''), trim(title), '') <> ''""")
def s29_gathered_lists(jobs: DataFrame) -> DataFrame:
    """Lists bare and under 'jobs', the role before the title and the address to apply before the other (N26)."""
    item = F.struct(F.trim("role").alias("role"), F.trim("title").alias("title"), "company", "location", "salary", F.when(F.length("id") % 2 == 0, F.col("applyurl")).alias("applyUrl"), F.when(F.length("id") % 2 != 0, F.col("applyurl")).alias("url"))
    payload = F.when(F.length("title") % 2 == 0, F.concat(F.lit("["), F.to_json(item), F.lit("]"))).otherwise(F.concat(F.lit('{"jobs":['), F.to_json(item), F.lit("]}")))
    return aggregators.aggregator_rows(jobs.select(payload.alias("payload")).where("payload is not null"), "landedjobs", F.lit(None).cast("timestamp")).select("title", "company", "location", "salary", "url").distinct()


for _f in (s04_paged, s01_replay, s01_replay_whole, s25_rss, s27_thread, s31_index_lines, s32_csv, s33_directory, s34_json_lists, s35_read_or_empty, s36_sharded_map):
    QUERIES[_f.__name__] = _f
