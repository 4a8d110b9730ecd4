"""Queries of joins, aggregations, order and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.dates import iso_instant
from sievemill.functions.text import core_name, core_words, normal_company, token_guesses
from sievemill.functions.urls import board_key
from sievemill.operators import keyed, matching, selection
from sievemill.operators.components import connected_components
from sievemill.operators.near_titles import canonical, near_pairs
from sievemill.operators.skew import salted_join
from sievemill.plans.registry import query

_NORMAL = "trim(regexp_replace(replace(lower(coalesce(company, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_LIST = "trim(regexp_replace(lower(coalesce(company, '')), '[^a-z0-9]+', ' ', 'g'))"
_LEGAL = "['inc','llc','corp','corporation','company','co','ltd','plc','group','holdings','holding','technologies','technology','systems','system','international','global','industries','enterprises','the','and','of']"
_CORE = f"array_to_string(list_filter(string_split({_NORMAL}, ' '), lambda w: w <> '' AND NOT list_contains({_LEGAL}, w)), ' ')"
_KEY = "concat(type, ':', lower(coalesce(token, '')))"


def _latest(sweep_jobs: DataFrame, back: int, *columns: str) -> DataFrame:
    """The rows of the sweep ``back`` places before the last one, one an id; of all columns or some."""
    nos = sweep_jobs.agg(F.array_sort(F.collect_set("sweep_no")).alias("nos")).select(F.element_at("nos", -1 - back).alias("sweep_no"))
    lean = sweep_jobs.select("sweep_no", "id", "checked", *[c for c in columns if c not in ("sweep_no", "id", "checked")]) if columns else sweep_jobs
    return keyed.first_wins(lean.join(F.broadcast(nos), "sweep_no"), ["id"], [-F.unix_micros("checked")])


_SWEEP = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY checked DESC, firstseen, title) AS rn FROM sweep_jobs WHERE sweep_no = (SELECT sweep_no FROM (SELECT DISTINCT sweep_no FROM sweep_jobs ORDER BY 1 DESC LIMIT 1 OFFSET {}))) WHERE rn = 1)"""


@query("sweep_jobs", sql=f"SELECT c.id, coalesce(p.title, c.title) AS title, p.id IS NOT NULL AS known FROM (SELECT DISTINCT id, title FROM {_SWEEP.format(0)}) c LEFT JOIN {_SWEEP.format(1)} p ON p.id = c.id")
def j01_previous_by_id(sweep_jobs: DataFrame) -> DataFrame:
    now, before = _latest(sweep_jobs, 0, "title"), _latest(sweep_jobs, 1, "title")
    prior = before.select("id", F.col("title").alias("was"), F.lit(True).alias("known"))
    return now.select("id", "title").join(prior, "id", "left").select("id", F.coalesce("was", "title").alias("title"), F.coalesce("known", F.lit(False)).alias("known"))


@query("jobs", "boards", sql="""
SELECT id, least(published_at, repair_at) AS at FROM (SELECT DISTINCT id, boardkey, firstseen AS published_at FROM jobs) j
LEFT JOIN (SELECT boardkey, min(firstseen) AS repair_at FROM jobs WHERE boardkey IN (SELECT boardkey FROM boards) GROUP BY 1) r USING (boardkey)""")
def j02_repair_if_earlier(jobs: DataFrame, boards: DataFrame) -> DataFrame:
    repair = jobs.join(boards.select("boardkey"), "boardkey", "left_semi").groupBy("boardkey").agg(F.min("firstseen").alias("repair_at"))
    return salted_join(jobs.select("id", "boardkey", "firstseen").distinct(), repair, "boardkey", "left", spread_by="id").select("id", F.least("firstseen", "repair_at").alias("at"))


@query("jobs", "board_statuses", sql=f"""
SELECT DISTINCT id FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM board_statuses s WHERE s.sweep_no = (SELECT max(sweep_no) FROM board_statuses) AND s.ok AND {_KEY.replace('type', 's.type').replace('token', 's.token')} = j.boardkey)""")
def j03_boards_without_success(jobs: DataFrame, board_statuses: DataFrame) -> DataFrame:
    last = board_statuses.agg(F.max("sweep_no").alias("sweep_no"))
    ok = board_statuses.where("ok").join(F.broadcast(last), "sweep_no").select(board_key(F.col("type"), F.col("token")).alias("boardkey")).distinct()
    return jobs.join(ok, "boardkey", "left_anti").select("id").distinct()


@query("jobs", "board_statuses", sql=f"""
SELECT DISTINCT j.id, s.sweep_no FROM jobs j JOIN board_statuses s ON {_KEY.replace('type', 's.type').replace('token', 's.token')} = j.boardkey AND NOT s.ok AND j.checked >= s.checkedat - INTERVAL 24 HOUR""")
def j04_failed_and_young(jobs: DataFrame, board_statuses: DataFrame) -> DataFrame:
    bad = board_statuses.where("not ok").select(board_key(F.col("type"), F.col("token")).alias("boardkey"), "sweep_no", "checkedat").distinct()
    return jobs.select("id", "boardkey", "checked").distinct().join(bad, "boardkey").where(F.col("checked") >= F.col("checkedat") - F.expr("INTERVAL 24 HOURS")).select("id", "sweep_no").distinct()


@query("boards", "jobs", sql="SELECT DISTINCT b.boardkey FROM boards b WHERE b.boardkey IN (SELECT boardkey FROM jobs GROUP BY boardkey HAVING max(firstseen) >= TIMESTAMP '2025-11-08 00:00:00')")
def j05_hot_boards(boards: DataFrame, jobs: DataFrame) -> DataFrame:
    hot = selection.hot_boards(jobs, F.lit("2025-11-09 00:00:00").cast("timestamp"), 1)
    return boards.join(hot, "boardkey", "left_semi").select("boardkey").distinct()


@query("board_statuses", "boards", sql=f"SELECT DISTINCT {_KEY} AS boardkey FROM board_statuses WHERE sweep_no = (SELECT min(sweep_no) FROM board_statuses) AND {_KEY} NOT IN (SELECT boardkey FROM boards WHERE boardkey IS NOT NULL AND from_extra)")
def j06_not_in_directory(board_statuses: DataFrame, boards: DataFrame) -> DataFrame:
    first = board_statuses.join(F.broadcast(board_statuses.agg(F.min("sweep_no").alias("sweep_no"))), "sweep_no")
    seen = first.select(board_key(F.col("type"), F.col("token")).alias("boardkey")).distinct()
    return seen.join(boards.where("from_extra").select("boardkey"), "boardkey", "left_anti")


@query("boards", "jobs", sql="SELECT type, token, company FROM boards WHERE boardkey IN (SELECT boardkey FROM jobs)")
def j07_boards_with_jobs(boards: DataFrame, jobs: DataFrame) -> DataFrame:
    return boards.join(jobs.select("boardkey"), "boardkey", "left_semi").select("type", "token", "company")


@query("jobs", "boards", sql=f"SELECT DISTINCT id FROM (SELECT id, {_LIST} AS c FROM jobs WHERE company IS NOT NULL) WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT {_LIST} AS n FROM boards WHERE from_extra) WHERE contains(n, c))")
def j08_contained_names(jobs: DataFrame, boards: DataFrame) -> DataFrame:
    name = normal_company(F.col("company"), spell_and=False)
    listed = boards.where("from_extra").select(name.alias("n"))
    return matching.contained_in(jobs.where("company is not null"), listed, name, "n").select("id").distinct()


@query("jobs", "boards", sql=f"SELECT DISTINCT id FROM jobs WHERE {_LIST} IN (SELECT {_LIST} FROM boards WHERE from_extra)")
def j09_equal_names(jobs: DataFrame, boards: DataFrame) -> DataFrame:
    name = normal_company(F.col("company"), spell_and=False)
    return jobs.withColumn("n", name).join(boards.where("from_extra").select(name.alias("n")), "n", "left_semi").select("id").distinct()


@query("boards", "jobs", sql=f"SELECT type, token FROM boards WHERE {_LIST} NOT IN (SELECT {_LIST} FROM jobs)")
def j10_excluded_names(boards: DataFrame, jobs: DataFrame) -> DataFrame:
    name = normal_company(F.col("company"), spell_and=False)
    return boards.withColumn("n", name).join(jobs.select(name.alias("n")), "n", "left_anti").select("type", "token")


_PREFIX = "(a = b OR starts_with(a, b || ' ') OR starts_with(b, a || ' '))"


@query("boards", "jobs", sql=f"""
WITH l AS (SELECT DISTINCT {_CORE} AS b FROM jobs), c AS (SELECT DISTINCT company, {_CORE} AS a FROM boards)
SELECT company, CASE WHEN EXISTS (SELECT 1 FROM l WHERE b <> '' AND {_PREFIX}) THEN 0 ELSE 1 END AS rank FROM c WHERE a <> ''""")
def j11_prefix_rank(boards: DataFrame, jobs: DataFrame) -> DataFrame:
    """Names that equal, or begin, a listed one in whole words rank first; an equality join on beginnings."""
    core = boards.select("company", core_name(F.col("company")).alias("a")).distinct().where("a <> ''")
    hit = matching.prefix_pairs(core, jobs.select(core_name(F.col("company")).alias("b")), "a", "b").select("a").distinct().withColumn("hit", F.lit(0))
    return core.join(hit, "a", "left").select("company", F.coalesce("hit", F.lit(1)).alias("rank"))


@query("boards", "jobs", sql=f"""
WITH l AS (SELECT DISTINCT {_CORE} AS b FROM jobs WHERE stale), c AS (SELECT DISTINCT company, {_CORE} AS a FROM boards)
SELECT company FROM c WHERE a <> '' AND NOT EXISTS (SELECT 1 FROM l WHERE b <> '' AND (starts_with(a, b) OR starts_with(b, a)))""")
def j12_raw_prefix_anti(boards: DataFrame, jobs: DataFrame) -> DataFrame:
    """Names of which no listed one is a beginning, character by character, either way round."""
    core = boards.select("company", core_name(F.col("company")).alias("a")).distinct().where("a <> ''")
    listed = jobs.where("stale").select(core_name(F.col("company")).alias("b")).distinct().where("b <> ''")
    begins = core.select("company", F.explode(matching.prefixes(F.col("a"), by_word=False)).alias("b")).join(listed, "b").select("company")
    begun = listed.select(F.explode(matching.prefixes(F.col("b"), by_word=False)).alias("a")).join(core, "a").select("company")
    return core.join(begins.union(begun).distinct(), "company", "left_anti").select("company")


@query("boards", "jobs", sql=f"""
WITH l AS (SELECT DISTINCT {_CORE} AS b FROM jobs), c AS (SELECT DISTINCT {_CORE} AS a FROM boards)
SELECT a, b FROM c JOIN l ON a <> '' AND b <> '' AND (a = b OR ((starts_with(a, b || ' ') OR starts_with(b, a || ' ')) AND contains(a, ' ') AND contains(b, ' ')))""")
def j13_name_match(boards: DataFrame, jobs: DataFrame) -> DataFrame:
    pairs = matching.prefix_pairs(boards.select(core_name(F.col("company")).alias("a")), jobs.select(core_name(F.col("company")).alias("b")), "a", "b")
    return pairs.where((F.col("a") == F.col("b")) | (F.contains("a", F.lit(" ")) & F.contains("b", F.lit(" "))))


@query("jobs")
def j14_near_titles(jobs: DataFrame) -> DataFrame:
    """Pairs by the cosine of term counts within company and place; tested by brute force."""
    return near_pairs(jobs)


@query("boards", "board_statuses", sql=f"""
WITH y AS (SELECT {_KEY} AS boardkey, sum(coalesce(matched, 0)) / count(*) AS yield FROM board_statuses GROUP BY 1)
SELECT b.boardkey, b.token, coalesce(y.yield, 0) AS yield FROM boards b LEFT JOIN y USING (boardkey)""")
def j15_yield_lookup(boards: DataFrame, board_statuses: DataFrame) -> DataFrame:
    return selection.by_yield(boards, selection.board_yield(board_statuses)).select("boardkey", "token", "yield")


@query("boards", sql="SELECT DISTINCT type, CASE type WHEN 'workday' THEN 'large' WHEN 'oracle' THEN 'large' WHEN 'lever' THEN 'small' END AS size FROM boards")
def j16_map_lookup(boards: DataFrame) -> DataFrame:
    sizes = F.create_map(*[F.lit(x) for x in ("workday", "large", "oracle", "large", "lever", "small")])
    return boards.select("type", F.try_element_at(sizes, F.col("type")).alias("size")).distinct()


@query("jobs", "boards", sql=f"""
WITH c AS (SELECT DISTINCT company, list_filter(string_split({_NORMAL}, ' '), lambda w: w <> '' AND NOT list_contains({_LEGAL}, w)) AS w FROM jobs WHERE company IS NOT NULL),
g AS (SELECT company, unnest([1, 2, 3]) AS n, unnest([array_to_string(w, ''), array_to_string(w[1:2], ''), array_to_string(w[1:1], '')]) AS guess FROM c),
hit AS (SELECT company, guess, n FROM g WHERE length(guess) >= 3 AND guess IN (SELECT lower(token) FROM boards))
SELECT company, arg_min(guess, n) AS guess FROM hit GROUP BY company""")
def j17_first_verified_guess(jobs: DataFrame, boards: DataFrame) -> DataFrame:
    guesses = jobs.select("company").where("company is not null").distinct().select("company", F.posexplode(token_guesses(F.col("company"))).alias("n", "guess"))
    real = guesses.join(boards.select(F.lower("token").alias("guess")), "guess", "left_semi")
    return real.groupBy("company").agg(F.min_by("guess", "n").alias("guess"))


# Aggregations


@query("boards", sql="SELECT type, count(*) AS n FROM boards GROUP BY type")
def a01_count_by_type(boards: DataFrame) -> DataFrame:
    return boards.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("jobs", sql="SELECT boardkey, max(firstseen) AS last_seen FROM jobs GROUP BY boardkey")
def a02_last_seen(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("boardkey").agg(F.max("firstseen").alias("last_seen"))


@query("board_statuses", sql=f"SELECT {_KEY} AS boardkey, count(*) AS checks, CAST(sum(coalesce(matched, 0)) AS BIGINT) AS found, sum(coalesce(matched, 0)) / count(*) AS yield FROM board_statuses GROUP BY 1")
def a03_board_yield(board_statuses: DataFrame) -> DataFrame:
    return selection.board_yield(board_statuses)


@query("jobs", sql="SELECT boardkey, count(*) AS n FROM jobs GROUP BY boardkey")
def a04_jobs_per_board(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("boardkey").agg(F.count(F.lit(1)).alias("n"))


@query("board_statuses", sql="SELECT sweep_no, count(*) AS attempted, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS failed, CAST(sum(coalesce(matched, 0)) AS BIGINT) AS matched FROM board_statuses GROUP BY sweep_no")
def a05_coverage(board_statuses: DataFrame) -> DataFrame:
    return board_statuses.groupBy("sweep_no").agg(F.count(F.lit(1)).alias("attempted"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"), F.sum(F.coalesce(F.col("matched").cast("bigint"), F.lit(0))).alias("matched"))


@query("jobs", sql="SELECT count(*) FILTER (WHERE firstseen >= TIMESTAMP '2025-11-09 00:00:00') AS by_first_seen, count(*) FILTER (WHERE within7d AND stale IS DISTINCT FROM true) AS by_window FROM jobs")
def a06_recent_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("firstseen") >= F.lit("2025-11-09 00:00:00").cast("timestamp")).alias("by_first_seen"), F.count_if(F.col("within7d") & ~F.col("stale").eqNullSafe(F.lit(True))).alias("by_window"))


@query("jobs", sql="SELECT count(*) FILTER (WHERE within24h) AS new_jobs, count(*) FILTER (WHERE regexp_matches(company, '(?i)education')) AS education, count(*) AS total, count(DISTINCT boardkey) AS boards FROM jobs")
def a07_sweep_entry(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if("within24h").alias("new_jobs"), F.count_if(F.col("company").rlike("(?i)education")).alias("education"), F.count(F.lit(1)).alias("total"), F.count_distinct("boardkey").alias("boards"))


@query("jobs", sql="SELECT count(*) FILTER (WHERE fitscore >= 70) AS high, count(*) FILTER (WHERE fitscore <= 30) AS low, count(*) FILTER (WHERE fitscore > 30 AND fitscore < 70) AS middle FROM jobs")
def a10_bands(jobs: DataFrame) -> DataFrame:
    s = F.col("fitscore")
    return jobs.agg(F.count_if(s >= 70).alias("high"), F.count_if(s <= 30).alias("low"), F.count_if((s > 30) & (s < 70)).alias("middle"))


_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split(boardkey, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"


@query("boards", "jobs", sql=f"""
SELECT tier, count(*) AS n FROM (SELECT CASE WHEN from_extra THEN 'extra' WHEN boardkey IN (SELECT boardkey FROM jobs GROUP BY 1 HAVING max(firstseen) >= TIMESTAMP '2025-11-08 00:00:00') THEN 'hot' WHEN {_HASH} % 16 = 3 THEN 'slice' END AS tier FROM boards) GROUP BY tier""")
def a12_tier_counts(boards: DataFrame, jobs: DataFrame) -> DataFrame:
    hot = selection.hot_boards(jobs, F.lit("2025-11-09 00:00:00").cast("timestamp"), 1)
    return selection.tiers(boards, hot, 16, 3).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("jobs", sql="""
WITH RECURSIVE e AS (SELECT DISTINCT id AS a, duplicateof AS b FROM jobs WHERE id <> duplicateof), t AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, a FROM t UNION SELECT r.a, t.b FROM reach r JOIN t ON t.a = r.b)
SELECT a AS node, min(b) AS component FROM reach GROUP BY a""")
def a13_components(jobs: DataFrame) -> DataFrame:
    return connected_components(jobs.select(F.col("id").alias("a"), F.col("duplicateof").alias("b")))


def _of_last(board_statuses: DataFrame) -> DataFrame:
    """The rows with ``is_last`` for those of the last sweep."""
    last = board_statuses.agg(F.max("sweep_no").alias("sweep_no")).withColumn("is_last", F.lit(True))
    return board_statuses.join(F.broadcast(last), "sweep_no", "left").withColumn("is_last", F.coalesce("is_last", F.lit(False)))


@query("board_statuses", sql=f"SELECT {_KEY} AS boardkey, count(*) AS checks, CAST(sum(coalesce(matched, 0)) AS BIGINT) AS found, sum(coalesce(matched, 0)) / count(*) AS yield FROM board_statuses GROUP BY 1")
def a03_yield_merged(board_statuses: DataFrame) -> DataFrame:
    """The yields of all sweeps but the last one, with those of the last one added."""
    marked = _of_last(board_statuses)
    return selection.merged_yield(selection.board_yield(marked.where("not is_last")), selection.board_yield(marked.where("is_last")))


@query("board_statuses", "jobs", sql="""
SELECT count(*) AS attempted, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS failed, (SELECT count(*) FROM jobs WHERE fit) AS fit, (SELECT count(*) FROM jobs WHERE within7d AND NOT coalesce(stale, false)) AS recent7d
FROM board_statuses WHERE sweep_no = (SELECT max(sweep_no) FROM board_statuses)""")
def a05_coverage_row(board_statuses: DataFrame, jobs: DataFrame) -> DataFrame:
    """The coverage of the last sweep in one row: boards by outcome, and the postings that fit and are recent."""
    none = F.lit(0).cast("bigint")
    last = board_statuses.agg(F.max("sweep_no").alias("sweep_no"))
    boards = board_statuses.join(F.broadcast(last), "sweep_no").agg(F.count(F.lit(1)).alias("attempted"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"))
    rows = jobs.agg(F.count_if("fit").alias("fit"), F.count_if(F.col("within7d") & ~F.coalesce("stale", F.lit(False))).alias("recent7d"))
    both = boards.select("*", none.alias("fit"), none.alias("recent7d")).unionByName(rows.select(none.alias("attempted"), none.alias("success"), none.alias("failed"), "fit", "recent7d"))
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


@query("sweep_jobs", sql="""
WITH s AS (SELECT sweep_no, lag(min(sweep_at)) OVER (ORDER BY sweep_no) AS began FROM sweep_jobs GROUP BY 1)
SELECT sweep_no, count(*) FILTER (WHERE n) AS new_jobs, count(*) FILTER (WHERE n AND regexp_matches(company, '(?i)education')) AS education, count(*) AS total
FROM (SELECT j.sweep_no, j.company, CAST(CAST(j.firstseen AS TIMESTAMPTZ) AS TIMESTAMP) >= s.began AS n FROM sweep_jobs j JOIN s USING (sweep_no)) GROUP BY 1""")
def a07_sweep_new(sweep_jobs: DataFrame) -> DataFrame:
    """Of each sweep the postings first seen since the one before, and those of a kind among them."""
    # One row a sweep: the window's single partition is as long as the list of sweeps.
    began = sweep_jobs.groupBy("sweep_no").agg(F.min("sweep_at").alias("at")).select("sweep_no", F.lag("at").over(Window.orderBy("sweep_no")).alias("began"))
    new = F.col("firstseen").try_cast("timestamp") >= F.col("began")
    rows = sweep_jobs.select("sweep_no", "company", "firstseen").join(F.broadcast(began), "sweep_no")  # one row a sweep
    return rows.groupBy("sweep_no").agg(F.count_if(new).alias("new_jobs"), F.count_if(new & F.col("company").rlike("(?i)education")).alias("education"), F.count(F.lit(1)).alias("total"))


# Order, choice and limits


@query("boards", sql="SELECT boardkey, min(company) AS company FROM boards GROUP BY boardkey")
def o01_first_wins(boards: DataFrame) -> DataFrame:
    return keyed.first_wins(boards, ["boardkey"], [F.col("company"), F.col("token")]).select("boardkey", "company")


@query("board_statuses", sql=f"SELECT {_KEY} AS boardkey, arg_max(matched, checkedat) AS matched, max(checkedat) AS checkedat FROM board_statuses WHERE ok GROUP BY 1")
def o02_last_wins(board_statuses: DataFrame) -> DataFrame:
    keyed_rows = board_statuses.where("ok").select(board_key(F.col("type"), F.col("token")).alias("boardkey"), "matched", "checkedat").distinct()
    return keyed.last_wins(keyed_rows, ["boardkey"], "checkedat")


@query("jobs", sql="SELECT id, fit, row_number() OVER (ORDER BY coalesce(fit, false) DESC, firstseen DESC NULLS LAST, id) - 1 AS position FROM (SELECT DISTINCT id, fit, firstseen FROM jobs)")
def o03_snapshot_order(jobs: DataFrame) -> DataFrame:
    rows = jobs.select("id", "fit", "firstseen").distinct()
    return keyed.number_rows(rows, [~F.coalesce("fit", F.lit(False)), F.col("firstseen").isNull(), -F.unix_micros("firstseen"), F.col("id")], "position").select("id", "fit", "position")


@query("jobs", sql="""
WITH p AS (SELECT DISTINCT id, fit, firstseen, CASE WHEN regexp_matches(trim(published), '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+Z$') THEN CAST(try_cast(trim(published) AS TIMESTAMPTZ) AS TIMESTAMP) END AS stated FROM jobs)
SELECT id, row_number() OVER (ORDER BY coalesce(fit, false) DESC, coalesce(stated, firstseen) DESC NULLS LAST, id) - 1 AS position FROM p""")
def o03_order_published(jobs: DataFrame) -> DataFrame:
    """Fitting postings first, then by the stated instant, or the first sight where none is stated."""
    stated = F.when(F.trim("published").rlike(r"^\d{4}-\d{2}-\d{2}T[\d:.]+Z$"), iso_instant(F.col("published")))
    rows = jobs.select("id", "fit", "firstseen", F.coalesce(stated, "firstseen").alias("at")).distinct()
    return keyed.number_rows(rows, [~F.coalesce("fit", F.lit(False)), F.col("at").isNull(), -F.unix_micros("at"), F.col("id")], "position").select("id", "position")


@query("boards", "jobs", sql=f"""
WITH l AS (SELECT DISTINCT {_CORE} AS b FROM jobs), c AS (SELECT DISTINCT company, {_CORE} AS a FROM boards WHERE company IS NOT NULL),
r AS (SELECT company, CASE WHEN a <> '' AND EXISTS (SELECT 1 FROM l WHERE b <> '' AND {_PREFIX}) THEN 0 ELSE 1 END AS rank FROM c)
SELECT company, rank, row_number() OVER (ORDER BY rank, company) - 1 AS position FROM r""")
def o08_priority_sort(boards: DataFrame, jobs: DataFrame) -> DataFrame:
    """Names that match a listed one first, each part in its own order."""
    ranked = j11_prefix_rank(boards, jobs)
    names = boards.select("company").where("company is not null").distinct().join(ranked, "company", "left").select("company", F.coalesce("rank", F.lit(1)).alias("rank"))
    return keyed.number_rows(names, [F.col("rank"), F.col("company")], "position").select("company", "rank", "position")


@query("board_statuses", sql="""
WITH e AS (SELECT CAST(date_trunc('day', checkedat) AS DATE) AS day, sweep_no, count(*) AS boards FROM board_statuses WHERE checkedat IS NOT NULL GROUP BY 1, 2)
SELECT day, sweep_no, boards, row_number() OVER (ORDER BY day, sweep_no) - 1 AS position FROM e""")
def o10_history(board_statuses: DataFrame) -> DataFrame:
    """A history by day and sweep: the entries of the last sweep replace older ones of the same key, then it is sorted."""
    per = lambda rows: rows.groupBy(F.to_date("checkedat").alias("day"), "sweep_no").agg(F.count(F.lit(1)).alias("boards"))
    timed = board_statuses.where("checkedat is not null")
    marked = _of_last(timed)
    fresh, old = per(marked.where("is_last")), per(timed)
    return keyed.number_rows(keyed.upsert(old, fresh, ["day", "sweep_no"]), [F.col("day"), F.col("sweep_no")], "position").select("day", "sweep_no", "boards", "position")


@query("jobs")
def o04_canonical(jobs: DataFrame) -> DataFrame:
    """Each near-duplicate with the canonical posting of its cluster; tested by brute force."""
    return canonical(jobs)


@query("boards", "board_statuses", sql=f"""
WITH y AS (SELECT {_KEY} AS boardkey, sum(coalesce(matched, 0)) / count(*) AS yield FROM board_statuses GROUP BY 1)
SELECT boardkey, row_number() OVER (ORDER BY yield DESC, boardkey) - 1 AS position FROM (SELECT DISTINCT b.boardkey, coalesce(y.yield, 0) AS yield FROM boards b LEFT JOIN y USING (boardkey))""")
def o05_yield_order(boards: DataFrame, board_statuses: DataFrame) -> DataFrame:
    rows = selection.by_yield(boards, selection.board_yield(board_statuses)).select("boardkey", "yield").distinct()
    return keyed.number_rows(rows, [-F.col("yield"), F.col("boardkey")], "position").select("boardkey", "position")


@query("boards", sql="""
WITH n AS (SELECT boardkey, row_number() OVER (ORDER BY boardkey) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT boardkey FROM boards))
SELECT boardkey, (n - 5 + 20) % n AS next_offset FROM n WHERE (pos - (n - 5) + n) % n < 20""")
def o06_circular_batch(boards: DataFrame) -> DataFrame:
    """A batch that wraps around the end of the list."""
    rows = boards.select("boardkey").distinct()
    return keyed.circular_batch(rows, [F.col("boardkey")], -5, 20)


@query("jobs", sql="SELECT id, fitscore FROM (SELECT DISTINCT id, fitscore FROM jobs WHERE fitscore >= 70) ORDER BY fitscore DESC, id LIMIT 10")
def o07_top_ten(jobs: DataFrame) -> DataFrame:
    """A top-k report: TakeOrderedAndProject."""
    return jobs.where("fitscore >= 70").select("id", "fitscore").distinct().orderBy(F.desc("fitscore"), "id").limit(10)


@query("jobs", sql="SELECT boardkey, id, rank_no FROM (SELECT boardkey, id, CAST(row_number() OVER (PARTITION BY boardkey ORDER BY firstseen DESC, id) AS INT) AS rank_no FROM (SELECT DISTINCT boardkey, id, firstseen FROM jobs)) WHERE rank_no <= 3")
def o08_newest_per_board(jobs: DataFrame) -> DataFrame:
    rows = jobs.select("boardkey", "id", "firstseen").distinct()
    return keyed.top_per_key(rows, "boardkey", [F.desc("firstseen"), F.asc("id")], 3).select("boardkey", "id", "rank_no")


@query("jobs", sql="SELECT DISTINCT id, left(title, 20) AS title FROM jobs")
def o09_caps(jobs: DataFrame) -> DataFrame:
    """Texts cut to a length."""
    return jobs.select("id", F.substring("title", 1, 20).alias("title")).distinct()


@query("board_statuses", sql="SELECT DISTINCT checkedat, company, type, token FROM board_statuses WHERE checkedat >= TIMESTAMP '2025-11-05 00:00:00' ORDER BY checkedat DESC, company, type, token LIMIT 400")
def o11_retention(board_statuses: DataFrame) -> DataFrame:
    """The history's limits: so many days, so many rows."""
    rows = board_statuses.select("checkedat", "company", "type", "token").distinct()
    return keyed.keep_recent(rows, "checkedat", F.lit("2025-11-19 00:00:00").cast("timestamp"), 14, 400, [F.col("company"), F.col("type"), F.col("token")])


# Sets


@query("boards", "board_statuses", sql=f"SELECT boardkey, min(company) AS company FROM (SELECT boardkey, company FROM boards UNION ALL SELECT {_KEY}, company FROM board_statuses) GROUP BY 1")
def u01_union_then_first(boards: DataFrame, board_statuses: DataFrame) -> DataFrame:
    other = board_statuses.select(board_key(F.col("type"), F.col("token")).alias("boardkey"), "company")
    return keyed.first_wins(boards.select("boardkey", "company").unionByName(other), ["boardkey"], [F.col("company")])


@query("boards", "jobs", sql="SELECT boardkey FROM boards EXCEPT SELECT boardkey FROM jobs")
def u02_difference(boards: DataFrame, jobs: DataFrame) -> DataFrame:
    return boards.select("boardkey").subtract(jobs.select("boardkey"))


@query("jobs", sql="SELECT DISTINCT company, source FROM jobs")
def u03_distinct(jobs: DataFrame) -> DataFrame:
    return jobs.select("company", "source").distinct()


@query("sweep_jobs", sql="SELECT id FROM sweep_jobs WHERE sweep_no = (SELECT min(sweep_no) FROM sweep_jobs) INTERSECT SELECT id FROM sweep_jobs WHERE sweep_no = (SELECT max(sweep_no) FROM sweep_jobs)")
def u04_in_both_scans(sweep_jobs: DataFrame) -> DataFrame:
    ends = sweep_jobs.agg(F.min("sweep_no").alias("a"), F.max("sweep_no").alias("b"))
    marked = sweep_jobs.select("id", "sweep_no").join(F.broadcast(ends), (F.col("sweep_no") == F.col("a")) | (F.col("sweep_no") == F.col("b")))
    return marked.groupBy("id").agg(F.count_distinct("sweep_no").alias("n")).where("n = 2").select("id")


@query("jobs", sql="""
SELECT id, title FROM (SELECT DISTINCT id, title FROM jobs ORDER BY title, id LIMIT 1500) UNION SELECT id, title FROM (SELECT DISTINCT id, title FROM jobs ORDER BY id DESC, title LIMIT 1500)""")
def u04_two_orders(jobs: DataFrame) -> DataFrame:
    """What two scans in different orders, each of thirty pages of fifty, bring together, repeats once."""
    rows = jobs.select("id", "title").distinct()
    one, two = rows.orderBy(F.asc_nulls_last("title"), F.asc_nulls_last("id")).limit(1500), rows.orderBy(F.desc_nulls_first("id"), F.asc_nulls_last("title")).limit(1500)
    return one.union(two).distinct()


@query("boards", "board_statuses", sql=f"""
WITH s AS (SELECT {_KEY} AS boardkey, max(company) AS company FROM board_statuses GROUP BY 1)
SELECT boardkey, company FROM s UNION ALL SELECT boardkey, min(company) FROM boards WHERE boardkey NOT IN (SELECT boardkey FROM s) GROUP BY boardkey""")
def u05_upsert(boards: DataFrame, board_statuses: DataFrame) -> DataFrame:
    fresh = board_statuses.groupBy(board_key(F.col("type"), F.col("token")).alias("boardkey")).agg(F.max("company").alias("company"))
    old = boards.groupBy("boardkey").agg(F.min("company").alias("company"))
    return keyed.upsert(old, fresh, ["boardkey"])


# Beyond the reference: what Spark states natively over the same tables


@query("events", sql="""
SELECT e.event_id, (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS bought_at FROM events e WHERE e.event_type <> 'purchase'""")
def x01_as_of_join(events: DataFrame) -> DataFrame:
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("ts").alias("bought_at"))
    return matching.as_of(events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "at", "bought_at").select("event_id", F.col("as_of_bought_at").alias("bought_at"))


def _points_in_spans(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Events, moved to begin with the first order, within the days of the orders; seconds to the nearest."""
    s = lambda c: F.bround(F.unix_micros(c) / F.lit(1e6), 0).cast("bigint")
    spans = orders.select("o_orderkey", s("o_orderdate").alias("a"), (s("o_orderdate") + 86400).alias("b"))
    # Two numbers, the least of each table.
    first = [df.agg(F.min(s(c))).first()[0] for df, c in ((events, "ts"), (orders, "o_orderdate"))]
    moved = F.lit(None).cast("bigint") if None in first else s("ts") + F.lit(first[1] - first[0])
    points = events.select("event_id", moved.alias("at"))
    return matching.range_join(points, spans, "at", "a", "b", 86400).select("event_id", "o_orderkey")


@query("events", "orders", sql="""
WITH spans AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS a, CAST(epoch(o_orderdate) AS BIGINT) + 86400 AS b FROM orders),
shifted AS (SELECT event_id, CAST(epoch(ts) AS BIGINT) - (SELECT min(CAST(epoch(ts) AS BIGINT)) FROM events) + (SELECT min(CAST(epoch(o_orderdate) AS BIGINT)) FROM orders) AS tick FROM events)
SELECT event_id, o_orderkey FROM shifted JOIN spans ON tick >= a AND tick < b""")
def x02_range_join(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Points within the spans of all orders, by bins."""
    return _points_in_spans(events, orders)


@query("jobs", sql="SELECT source, workplace, count(*) AS n FROM jobs GROUP BY CUBE (source, workplace)")
def x03_cube(jobs: DataFrame) -> DataFrame:
    return jobs.cube("source", "workplace").agg(F.count(F.lit(1)).alias("n"))


@query("events", sql="""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens, event_id FROM events),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM g)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n, min(ts) AS started FROM s GROUP BY ALL""")
def x04_sessions(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    opens = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 30 MINUTES"), 0).otherwise(1)
    return events.withColumn("opens", opens).withColumn("session_no", F.sum("opens").over(w)).groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("started"))
