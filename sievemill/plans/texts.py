"""Queries of the scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import dates, html, text, urls
from sievemill.plans.registry import query

_WS = r"[\s\x{00A0}]+"
_STATE_LIST = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.STATES.items()) + "}"


@query("documents", sql=rf"""
SELECT doc_id, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?is)<(script)\b.*?</script>|<(style)\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '{_WS}', ' ', 'g')) AS plain FROM documents""")
def f01_strip_html(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", text.strip_html(F.col("text")).alias("plain"))


_RAW = "concat('<p>A &amp;amp; B</p> &lt;', company, '&gt; &quot;x&quot; &#39;&apos;&nbsp;.')"
_DECODE = "replace(replace(replace(replace(replace(replace(replace({}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' ')"


def _raw() -> Column:
    return F.concat(F.lit("<p>A &amp;amp; B</p> &lt;"), F.coalesce("company", F.lit("")), F.lit("&gt; &quot;x&quot; &#39;&apos;&nbsp;."))


@query("boards", sql=f"SELECT boardkey, token, company, {_DECODE.format(_RAW)} AS decoded FROM boards")
def f02_decode_entities(boards: DataFrame) -> DataFrame:
    return boards.select("boardkey", "token", "company", text.decode_entities(_raw()).alias("decoded"))


@query("boards", sql=r"""
SELECT boardkey, token, company, replace(replace(replace(replace(replace(replace(replace(concat('x ', company, ' &amp;lt;b&gt;'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS decoded FROM boards""")
def f03_decode_xml(boards: DataFrame) -> DataFrame:
    return boards.select("boardkey", "token", "company", text.decode_xml(F.concat(F.lit("x <![CDATA["), F.coalesce("company", F.lit("")), F.lit("]]> &amp;lt;b&gt;"))).alias("decoded"))


@query("boards", sql=f"SELECT boardkey, token, company, trim(regexp_replace({_DECODE.format(f'regexp_replace({_RAW}, ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '{_WS}', ' ', 'g')) AS bare FROM boards")
def f04_strip_tags(boards: DataFrame) -> DataFrame:
    return boards.select("boardkey", "token", "company", text.strip_tags(_raw()).alias("bare"))


_NORMAL = "trim(regexp_replace(replace(lower(coalesce(company, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_LEGAL = "[" + ", ".join(f"'{w}'" for w in text.LEGAL_WORDS) + "]"
_CORE = f"list_filter(string_split({_NORMAL}, ' '), lambda w: w <> '' AND NOT list_contains({_LEGAL}, w))"


@query("boards", sql=f"SELECT DISTINCT company, {_NORMAL} AS normal FROM boards")
def f05_normal_company(boards: DataFrame) -> DataFrame:
    return boards.select("company", text.normal_company(F.col("company")).alias("normal")).distinct()


@query("boards", sql="SELECT DISTINCT company, trim(regexp_replace(lower(coalesce(company, '')), '[^a-z0-9]+', ' ', 'g')) AS normal FROM boards")
def f06_list_name(boards: DataFrame) -> DataFrame:
    return boards.select("company", text.normal_company(F.col("company"), spell_and=False).alias("normal")).distinct()


@query("boards", sql=f"SELECT DISTINCT company, array_to_string({_CORE}, ' ') AS core FROM boards")
def f07_core_name(boards: DataFrame) -> DataFrame:
    return boards.select("company", text.core_name(F.col("company")).alias("core")).distinct()


@query("boards", sql=f"""
WITH c AS (SELECT DISTINCT company, {_CORE} AS w FROM boards),
g AS (SELECT company, unnest([array_to_string(w, ''), array_to_string(w[1:2], ''), array_to_string(w[1:1], '')]) AS guess FROM c)
SELECT DISTINCT company, guess FROM g WHERE length(guess) >= 3""")
def f08_token_guesses(boards: DataFrame) -> DataFrame:
    return boards.select("company").distinct().select("company", F.explode(text.token_guesses(F.col("company"))).alias("guess"))


@query("jobs", sql=rf"""
WITH l AS (SELECT DISTINCT location, {_STATE_LIST} AS m FROM jobs WHERE location IS NOT NULL),
p AS (SELECT location, m, array_to_string(list_transform(string_split(trim(location), ','), lambda part, i:
        CASE WHEN i > 1 AND regexp_matches(part, '^\s*[A-Z]{{2}}\b') THEN concat(' ', coalesce(m[regexp_extract(part, '^\s*([A-Z]{{2}})\b', 1)], regexp_extract(part, '^\s*([A-Z]{{2}})\b', 1)), regexp_replace(part, '^\s*[A-Z]{{2}}\b', ''))
             ELSE part END), ',') AS j FROM l),
e AS (SELECT location, CASE WHEN regexp_extract(j, '\b([A-Z]{{2}})$', 1) <> '' THEN concat(regexp_replace(j, '\b[A-Z]{{2}}$', ''), coalesce(m[regexp_extract(j, '\b([A-Z]{{2}})$', 1)], regexp_extract(j, '\b([A-Z]{{2}})$', 1))) ELSE j END AS f FROM p)
SELECT location, trim(regexp_replace(lower(f), '[^a-z0-9]+', ' ', 'g')) AS normal FROM e""")
def f09_normal_location(jobs: DataFrame) -> DataFrame:
    return jobs.select("location").where("location is not null").distinct().select("location", text.normal_location(F.col("location")).alias("normal"))


@query("jobs")
def f10_iso_instant(jobs: DataFrame) -> DataFrame:
    """Every published value: ISO text and counts; what is neither gives null. Tested against Python."""
    return jobs.select("published").distinct().select("published", F.unix_micros(dates.iso_instant(F.col("published"))).alias("epoch_us"))


@query("jobs", sql=r"""
SELECT day, count(*) AS n FROM (SELECT DISTINCT id, CASE WHEN regexp_matches(trim(published), '^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2}))?$') THEN CAST(try_cast(trim(published) AS TIMESTAMPTZ) AS DATE)
  WHEN regexp_matches(published, '^[0-9]{1,11}$') THEN CAST(to_timestamp(try_cast(published AS BIGINT)) AS DATE) WHEN regexp_matches(published, '^[0-9]{12,14}$') THEN CAST(epoch_ms(try_cast(published AS BIGINT)) AS DATE) END AS day FROM jobs) GROUP BY day""")
def f10_days(jobs: DataFrame) -> DataFrame:
    """Postings by the day of a full ISO instant, an ISO date or a count; all others under null."""
    s = F.trim("published")
    full = s.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2}))?$") | F.col("published").rlike(r"^\d{1,14}$")
    rows = jobs.select("id", F.to_date(F.when(full, dates.iso_instant(F.col("published")))).alias("day")).distinct()
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("jobs", sql=r"""
SELECT DISTINCT id, CASE WHEN contains(lower(published), 'today') THEN checked WHEN contains(lower(published), 'yesterday') THEN checked - INTERVAL 1 DAY
  ELSE checked - to_days(CAST(regexp_extract(lower(published), '(\d+)\+?\s*days?', 1) AS INT)) END AS at
FROM jobs WHERE regexp_matches(lower(published), 'today|yesterday|\d+\+?\s*days?')""")
def f11_relative_instant(jobs: DataFrame) -> DataFrame:
    labels = jobs.where(F.lower("published").rlike(r"today|yesterday|\d+\+?\s*days?"))
    return labels.select("id", dates.relative_instant(F.col("published"), F.col("checked")).alias("at")).distinct()


@query("jobs", sql=r"""
SELECT DISTINCT published, coalesce(
  CASE WHEN regexp_matches(published, '^\d{1,2}/\d{1,2}/\d{4}$') THEN try_strptime(published, '%d/%m/%Y') END,
  CASE WHEN regexp_matches(published, '^\d{1,2}/\d{1,2}/\d{2}$') THEN try_strptime(published, '%d/%m/%y') END,
  CASE WHEN regexp_matches(published, '^\d{1,2}-[A-Za-z]{3}-\d{4}$') THEN try_strptime(published, '%d-%b-%Y') END) AS at
FROM jobs WHERE regexp_matches(published, '^\d{1,2}[/-]')""")
def f12_day_first(jobs: DataFrame) -> DataFrame:
    return jobs.select("published").where(F.col("published").rlike(r"^\d{1,2}[/-]")).distinct().select("published", dates.day_first(F.col("published")).alias("at"))


@query("jobs", sql="""
WITH a AS (SELECT DISTINCT id, (epoch_us(checked) - epoch_us(firstseen)) / 1e6 AS age FROM jobs)
SELECT id, round_even(age / 86400 * 10, 0) AS tenths, coalesce(age BETWEEN 0 AND 86400, false) AS within_24h, coalesce(age BETWEEN 0 AND 604800, false) AS within_7d FROM a""")
def f13_freshness(jobs: DataFrame) -> DataFrame:
    return jobs.select("id", "firstseen", "checked").distinct().select("id", dates.freshness(F.col("firstseen"), F.col("checked")).alias("f")).select("id", "f.*")


@query("jobs", sql="""
WITH a AS (SELECT DISTINCT id, (epoch_us(checked) - epoch_us(firstseen)) / 1e6 AS age FROM jobs)
SELECT id, floor(age / 86400 * 10 + 0.5) AS tenths FROM a""")
def f13_half_up(jobs: DataFrame) -> DataFrame:
    return jobs.select("id", "firstseen", "checked").distinct().select("id", dates.freshness(F.col("firstseen"), F.col("checked"), half_up=True)["tenths"].alias("tenths"))


_LANES = [(r"\bdata (engineer|scientist|analyst)\b", "data"), (r"machine learning|\bml\b", "learning"), (r"\b(developer|engineer)\b", "engineering"), (r"\bmanager\b", "management")]
_LANE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(title, ''), '(?i){p}') THEN '{label}'" for p, label in _LANES) + " ELSE 'other' END"


@query("jobs", sql=f"SELECT lane, count(*) AS n FROM (SELECT {_LANE_SQL} AS lane FROM jobs) GROUP BY lane")
def f14_rule_cascade(jobs: DataFrame) -> DataFrame:
    """The mechanism of ordered rules; the rules are this query's own."""
    return jobs.select(text.cascade(_LANES, F.coalesce("title", F.lit("")), "other").alias("lane")).groupBy("lane").agg(F.count(F.lit(1)).alias("n"))


# DuckDB's own notation of a dollar amount: a sign, digits with marks of thousands, 'k' for thousands.
_MONEY = r"(?:[$]|USD)\s?([0-9][0-9,]*(?:[.][0-9]+)?)\s?(k?)"
_SPAN = r"(?i)" + _MONEY + r"\s*(?:-|to|–|—)\s*" + _MONEY.replace("(?:[$]|USD)", "(?:[$]|USD|)")
_ONE = r"(?i)" + _MONEY + r"\b"


def _amount(pattern: str, at: int) -> str:
    n = f"try_cast(replace(regexp_extract(s, '{pattern}', {at}), ',', '') AS DOUBLE)"
    return f"nullif(CAST(round_even({n} * CASE WHEN regexp_extract(s, '{pattern}', {at + 1}) <> '' OR {n} < 1000 THEN 1000 ELSE 1 END, 0) AS BIGINT), 0)"


@query("jobs", sql=f"""
WITH t AS (SELECT DISTINCT salary, trim(regexp_replace(salary, '{_WS}', ' ', 'g')) AS s FROM jobs WHERE salary IS NOT NULL),
v AS (SELECT salary, {_amount(_SPAN, 1)} AS a, {_amount(_SPAN, 3)} AS b, {_amount(_ONE, 1)} AS one FROM t)
SELECT salary, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a ELSE one END AS low, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b ELSE one END AS high FROM v""")
def f16_dollar_range(jobs: DataFrame) -> DataFrame:
    return jobs.select("salary").where("salary is not null").distinct().select("salary", text.dollar_range(F.col("salary")).alias("r")).select("salary", "r.*")


@query("jobs", sql=r"""
WITH t AS (SELECT id, title, concat(coalesce(title, ''), ' ', coalesce(company, '')) AS s FROM jobs)
SELECT id, bool_or(regexp_matches(s, '(?i)\b(senior|lead|principal|staff)\b')) AS ranked, max(len(regexp_extract_all(lower(s), 'data')) ) AS data_words FROM t GROUP BY id""")
def f17_title_tests(jobs: DataFrame) -> DataFrame:
    """Boolean tests and counts of patterns in texts (the mechanism of the flags)."""
    s = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("company", F.lit("")))
    return jobs.groupBy("id").agg(F.bool_or(s.rlike(r"(?i)\b(senior|lead|principal|staff)\b")).alias("ranked"), F.max(F.regexp_count(F.lower(s), F.lit("data"))).alias("data_words"))


@query("documents", sql=r"""
WITH m AS (SELECT doc_id, regexp_replace(text, '\b(\d+) (people|weeks|months|hours)', '\1 years', 'g') AS t FROM documents),
e AS (SELECT doc_id, unnest(list_transform(list_zip(regexp_extract_all(t, '(?i)(\d{1,2})\s*(?:\+|(?:-|–|to)\s*(\d{1,2}))?\s*\+?\s*years?', 1), regexp_extract_all(t, '(?i)(\d{1,2})\s*(?:\+|(?:-|–|to)\s*(\d{1,2}))?\s*\+?\s*years?', 2)),
   lambda z: try_cast(CASE WHEN coalesce(z[2], '') <> '' THEN z[2] ELSE z[1] END AS INT))) AS y FROM m)
SELECT d.doc_id, max(y) FILTER (WHERE y BETWEEN 1 AND 30) AS years FROM documents d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id""")
def f21_most_years(documents: DataFrame) -> DataFrame:
    asked = F.regexp_replace("text", r"\b(\d+) (people|weeks|months|hours)", "$1 years")
    return documents.select("doc_id", text.most_years(asked).alias("years"))


@query("documents", sql=r"""
WITH m AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '([0-9]+) (people|weeks|months|hours)', '\1 years', 'g') AS t FROM documents),
p AS (SELECT doc_id, regexp_extract(t, '([0-9]+)\s*[-–to]+\s*([0-9]+)\s*year', 1) AS a, regexp_extract(t, '([0-9]+)\s*[-–to]+\s*([0-9]+)\s*year', 2) AS b,
  coalesce(nullif(regexp_extract(t, '([0-9]+)[+]\s*year', 1), ''), nullif(regexp_extract(t, 'minimum\s*([0-9]+)\s*year', 1), ''), nullif(regexp_extract(t, '([0-9]+)\s*years?\s*of\s*experience', 1), '')) AS one FROM m)
SELECT doc_id, CASE WHEN a <> '' THEN try_cast(a AS INT) ELSE try_cast(one AS INT) END AS min_years, CASE WHEN a <> '' THEN try_cast(b AS INT) ELSE try_cast(one AS INT) + 2 END AS max_years FROM p""")
def f28_experience_range(documents: DataFrame) -> DataFrame:
    asked = F.regexp_replace(F.lower("text"), r"(\d+) (people|weeks|months|hours)", "$1 years")
    return documents.select("doc_id", text.experience_range(asked).alias("r")).select("doc_id", "r.*")


_WORDS = ["engineer", "data", "senior", "platform", "billing"]
_HITS = " + ".join(f"CAST(contains(lower(coalesce(title, '')), '{w}') AS INT)" for w in _WORDS)


@query("jobs", sql=f"""
WITH h AS (SELECT DISTINCT id, {_HITS} AS hits, agedays FROM jobs)
SELECT id, hits, CASE WHEN hits >= 3 THEN 40 WHEN hits >= 2 THEN 25 WHEN hits >= 1 THEN 10 ELSE 0 END + CASE WHEN agedays <= 7 THEN 10 ELSE 0 END AS score,
  list_filter([CASE WHEN hits = 0 THEN 'no keyword' END, CASE WHEN agedays IS NULL THEN 'no age' END, CASE WHEN agedays > 7 THEN 'old' END], lambda x: x IS NOT NULL) AS notes FROM h""")
def f26_weighted_score(jobs: DataFrame) -> DataFrame:
    """Keyword hits in bands and ordered reasons (the mechanism of the scores; the weights are this query's own)."""
    h = jobs.select("id", text.keyword_hits(F.col("title"), _WORDS).alias("hits"), "agedays").distinct()
    score = text.banded(F.col("hits"), [(3, 40), (2, 25), (1, 10)]) + F.when(F.col("agedays") <= 7, 10).otherwise(0)
    return h.select("id", "hits", score.alias("score"), text.reasons((F.col("hits") == 0, "no keyword"), (F.col("agedays").isNull(), "no age"), (F.col("agedays") > 7, "old")).alias("notes"))


_ENC = "replace(url_encode(token), '%2F', '/')"
_URL_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN concat('{p.split('{}')[0]}', {_ENC}, '{p.split('{}')[1]}')" for k, p in urls.HOSTED.items()) + " WHEN 'workday' THEN concat('https://', token) WHEN 'icims' THEN concat('https://', token, '/') WHEN 'oracle' THEN CASE WHEN split_part(token, '/', 2) <> '' THEN concat('https://', split_part(token, '/', 1), '/hcmUI/CandidateExperience/en/sites/', split_part(token, '/', 2)) END END"


@query("boards", sql=f"SELECT DISTINCT type, token, {_URL_SQL} AS url FROM boards")
def f30_board_url(boards: DataFrame) -> DataFrame:
    return boards.select("type", "token").distinct().select("type", "token", urls.board_url(F.col("type"), F.col("token")).alias("url"))


_RESERVED = ", ".join(f"'{w}'" for w in urls.RESERVED)
_VALID = f"regexp_matches(lower(token), '^[a-z0-9][a-z0-9._-]{{1,90}}$') AND lower(token) NOT IN ({_RESERVED})"
_HOSTED = ", ".join(f"'{k}'" for k in urls.HOSTED)


@query("boards", sql=f"""
SELECT DISTINCT {_URL_SQL} AS url, CASE WHEN {_VALID} THEN type END AS kind, CASE WHEN {_VALID} THEN lower(token) END AS found FROM boards WHERE type IN ({_HOSTED})""")
def f31_board_of_url(boards: DataFrame) -> DataFrame:
    """The address of a board read back gives its platform and lower-case token."""
    made = boards.where(F.col("type").isin(*urls.HOSTED)).select(urls.board_url(F.col("type"), F.col("token")).alias("url")).distinct()
    return made.select("url", urls.board_of_url(F.col("url")).alias("b")).select("url", F.col("b.kind").alias("kind"), F.col("b.token").alias("found"))


@query("jobs", sql=r"""
SELECT DISTINCT id, unnest([regexp_replace(applyurl, '[.,;]+$', ''), 'http://a.example/x']) AS url FROM jobs WHERE applyurl IS NOT NULL""")
def f32_urls_in_text(jobs: DataFrame) -> DataFrame:
    said = F.concat(F.lit("See "), F.col("applyurl"), F.lit("., or (http://a.example/x) too"))
    return jobs.where("applyurl is not null").select("id", F.explode(urls.urls_in(said)).alias("url")).distinct()


@query("jobs", sql=r"""
WITH u AS (SELECT DISTINCT applyurl, regexp_extract(applyurl, '^https?://([^/:]+)', 1) AS host, list_filter(string_split(regexp_extract(applyurl, '^https?://[^/]+([^?#]*)', 1), '/'), lambda p: p <> '' AND NOT regexp_matches(p, '^[a-z]{2}(-[A-Za-z]{2})?$')) AS parts FROM jobs WHERE applyurl IS NOT NULL)
SELECT applyurl, lower(parts[1]) AS path_token, CASE WHEN regexp_matches(lower(host), '^[a-z0-9-]+\.greenhouse\.example$') THEN regexp_extract(lower(host), '^([a-z0-9-]+)\.', 1) END AS host_token FROM u""")
def f33_path_and_host_token(jobs: DataFrame) -> DataFrame:
    u = jobs.select("applyurl").where("applyurl is not null").distinct()
    return u.select("applyurl", urls.path_token(F.col("applyurl")).alias("path_token"), urls.host_token(F.col("applyurl"), ".greenhouse.example").alias("host_token"))


def _page(body: Column) -> Column:
    return F.concat(F.lit("<html><a href='/jobs/"), F.col("id"), F.lit("'>"), body, F.lit("</a> <span>Austin, TX</span><a href='/x'>Apply now</a></html>"))


@query("jobs", sql=r"""
SELECT DISTINCT id, trim(regexp_replace(title, '[\s\x{00A0}]+', ' ', 'g')) AS title, 'Austin, TX' AS location FROM jobs
WHERE length(trim(regexp_replace(title, '[\s\x{00A0}]+', ' ', 'g'))) BETWEEN 3 AND 140 AND NOT regexp_matches(trim(title), '(?i)^(apply|view|learn more|back|home|skip)')""")
def f35_page_links(jobs: DataFrame) -> DataFrame:
    """Links of pages with the location near them (F34, F35)."""
    plain = jobs.select("id", "title").distinct().where("title is not null")
    escaped = F.replace(F.replace(F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    links = plain.select("id", F.explode(html.page_links(_page(escaped))).alias("l"))
    return links.select("id", F.col("l.title").alias("title"), F.col("l.location").alias("location"))


@query("events", sql="SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f36_embedded_json(events: DataFrame) -> DataFrame:
    """A balanced object out of a script, then read by path."""
    page = F.concat(F.lit('<script>window.data = {"q":"}\\"{","props":'), F.col("props"), F.lit("}; more()</script>"))
    got = html.embedded_json(page, "window.data")
    return events.select("event_id", F.variant_get(F.try_parse_json(got), "$.props.k", "bigint").alias("k"))


@query("jobs", sql="SELECT DISTINCT id, title FROM jobs WHERE title IS NOT NULL")
def f37_json_ld(jobs: DataFrame) -> DataFrame:
    item = F.to_json(F.struct(F.array(F.lit("Thing"), F.lit("JobPosting")).alias("@type"), "title", "id"))
    page = F.concat(F.lit('<script type="application/ld+json">['), F.replace(item, F.lit("</"), F.lit("<\\/")), F.lit(',{"@type":"Person"}]</script>'))
    rows = jobs.select("id", "title").distinct().where("title is not null").select(F.explode(html.json_ld_postings(page)).alias("j"))
    return rows.select(F.get_json_object("j", "$.id").alias("id"), F.get_json_object("j", "$.title").alias("title"))


@query("jobs", sql="SELECT DISTINCT id, CASE WHEN trim(coalesce(role, '')) <> '' THEN role WHEN trim(coalesce(title, '')) <> '' THEN title END AS answer FROM jobs")
def f38_question_answer(jobs: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(v, F.lit("")).alias("value")) for n, v in (("x", "source"), ("ROLE", "role"), ("title", "title"))])
    return jobs.select("id", "role", "title", "source").distinct().select("id", html.answer(pairs, "role", "title").alias("answer")).distinct()


@query("places", sql="""
SELECT place_id, CASE WHEN f THEN city ELSE concat(city, ' in Oslo, ', region_code) END AS title, CASE WHEN f THEN concat('Oslo, ', region_code) END AS place FROM (SELECT *, regexp_full_match(region_code, '[A-Z]{2}') AS f FROM places)""")
def f39_label_title(places: DataFrame) -> DataFrame:
    label = F.concat("city", F.lit(" in Oslo, "), "region_code")
    return places.select("place_id", html.label_title(label).alias("l")).select("place_id", "l.*")


@query("boards", sql="""
SELECT boardkey, list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split(boardkey, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS hash
FROM (SELECT DISTINCT boardkey FROM boards WHERE boardkey IS NOT NULL)""")
def f40_numeric_hash(boards: DataFrame) -> DataFrame:
    return boards.select("boardkey").where("boardkey is not null").distinct().select("boardkey", text.numeric_hash(F.col("boardkey")).alias("hash"))


@query("jobs", sql="SELECT DISTINCT company, replace(url_encode(company), '%2F', '/') AS quoted FROM jobs WHERE company IS NOT NULL")
def f42_quoted(jobs: DataFrame) -> DataFrame:
    return jobs.select("company").where("company is not null").distinct().select("company", urls.quoted(F.col("company")).alias("quoted"))


@query("boards", sql=f"""
WITH u AS (SELECT DISTINCT type, token, {_URL_SQL} AS url FROM boards)
SELECT type, token, CASE WHEN contains(lower(coalesce(url, '')), 'ashbyhq.com') THEN 'ashby' WHEN contains(lower(coalesce(url, '')), 'lever.co') THEN 'lever' WHEN contains(lower(coalesce(url, '')), 'greenhouse.io') THEN 'greenhouse' ELSE 'vendor ' || type END AS kind FROM u""")
def f43_kind_of_csv(boards: DataFrame) -> DataFrame:
    u = boards.select("type", "token").distinct()
    return u.select("type", "token", urls.kind_of_csv(urls.board_url(F.col("type"), F.col("token")), F.concat(F.lit(" Vendor "), "type")).alias("kind"))


@query("sweep_jobs", sql="SELECT DISTINCT sweep_no, strftime(sweep_at, '%Y-%m-%d') AS day, strftime(sweep_at, '%H:%M') AS minute FROM sweep_jobs")
def f44_sweep_label(sweep_jobs: DataFrame) -> DataFrame:
    return sweep_jobs.select("sweep_no", "sweep_at").distinct().select("sweep_no", dates.sweep_label(F.col("sweep_at")).alias("l")).select("sweep_no", "l.*")


@query("sweep_jobs", sql="SELECT DISTINCT sweep_no, CAST(hour(sweep_at) * 2 + CASE WHEN minute(sweep_at) >= 30 THEN 2 ELSE 1 END AS INT) AS of_day FROM sweep_jobs")
def f44_sweep_number(sweep_jobs: DataFrame) -> DataFrame:
    return sweep_jobs.select("sweep_no", dates.sweep_number(F.col("sweep_at")).alias("of_day")).distinct()


_PARTS = "string_split(token, '/')"


@query("boards", sql=f"""
WITH k AS (SELECT DISTINCT unnest(['hireology','adp','dover','ukg','successfactors','brassring','phenom','paylocity','zoho','careerplug']) AS type), t AS (SELECT DISTINCT token FROM boards WHERE token IS NOT NULL)
SELECT type, token, CASE type
  WHEN 'hireology' THEN 'https://careers.hireology.com/' || {_ENC} WHEN 'dover' THEN 'https://app.dover.com/careers/' || {_ENC}
  WHEN 'adp' THEN 'https://workforcenow.adp.com/mascsr/default/mdf/recruitment/recruitment.html?cid=' || {_ENC.replace('token', "split_part(token, '/', 1)")} || '&ccId=' || {_ENC.replace('token', "split_part(token, '/', 2)")} || '&lang=en_US'
  WHEN 'ukg' THEN CASE WHEN len({_PARTS}) > 1 THEN 'https://' || split_part(token, '/', 1) || '/' || split_part(token, '/', 2) || '/JobBoard/' || {_ENC.replace('token', "split_part(token, '/', 3)")} || '/' END
  WHEN 'successfactors' THEN rtrim(token, '/') || '/search/'
  WHEN 'brassring' THEN 'https://sjobs.brassring.com/TGnewUI/Search/Home/Home?partnerid=' || {_ENC.replace('token', "split_part(token, '/', 1)")} || '&siteid=' || {_ENC.replace('token', "split_part(token, '/', 2)")}
  WHEN 'phenom' THEN 'https://' || rtrim(token, '/') || CASE WHEN contains(rtrim(token, '/'), '/') THEN '' ELSE '/search-results' END
  WHEN 'paylocity' THEN 'https://recruiting.paylocity.com/recruiting/jobs/All/' || {_ENC}
  WHEN 'zoho' THEN 'https://' || split_part(token, '/', 1) || '.zohorecruit.' || CASE WHEN len({_PARTS}) > 1 THEN split_part(token, '/', 2) ELSE 'com' END || '/jobs/Careers'
  WHEN 'careerplug' THEN 'https://' || {_ENC} || '.careerplug.com/jobs' END AS url FROM k, t""")
def f30_extra_board_url(boards: DataFrame) -> DataFrame:
    """Every token as the board of each of the platforms with addresses of their own form."""
    kinds = F.array(*[F.lit(k) for k in ("hireology", "adp", "dover", "ukg", "successfactors", "brassring", "phenom", "paylocity", "zoho", "careerplug")])
    each = boards.select("token").where("token is not null").distinct().select("token", F.explode(kinds).alias("type"))
    return each.select("type", "token", urls.extra_board_url(F.col("type"), F.col("token")).alias("url"))


@query("boards", sql=f"""
SELECT DISTINCT type, lower(token) AS token, CASE WHEN type IN ('careerpage', 'successfactors') THEN regexp_matches(lower(token), '^https://[a-z0-9][a-z0-9.-]*[.][a-z]{{2,}}(/[^ ]*)?$')
  ELSE regexp_matches(lower(token), CASE WHEN type IN ('workday', 'oracle', 'icims') THEN '^[a-z0-9][a-z0-9._/-]{{1,180}}$' ELSE '^[a-z0-9][a-z0-9._-]{{1,90}}$' END) AND lower(token) NOT IN ({_RESERVED}) END
  AND NOT regexp_matches(lower(token), '/(robots[.]txt|sitemap[.]xml|sitemap_index[.]xml|favicon[.]ico|manifest[.]json)$') AS usable FROM boards WHERE token IS NOT NULL""")
def p07_usable_token(boards: DataFrame) -> DataFrame:
    t = F.lower("token")
    return boards.where("token is not null").select("type", t.alias("token"), urls.usable_token(F.col("type"), t).alias("usable")).distinct()


# Names of staffing firms.
_STAFFING = ["jobgether", "alten", "guidehouse", "booz allen", "bah", "randstad", "teksystems", "robert half", "kforce", "apex systems", "insight global", "modis", "experis", "aston carter", "synergisticit"]
_STAFFING_SQL = "(?i)\\b(jobgether|alten|guidehouse|booz allen|bah|randstad|teksystems|robert half|kforce|apex systems|insight global|modis|experis|aston carter|synergisticit)\\b"


@query("jobs", sql=f"SELECT DISTINCT id FROM (SELECT id, company FROM jobs UNION ALL SELECT 'x' || id, company || ' (via Robert Half)' FROM jobs) WHERE NOT regexp_matches(coalesce(company, ''), '{_STAFFING_SQL}')")
def p06_staffing(jobs: DataFrame) -> DataFrame:
    """Postings of employers that are no staffing firm; a second copy of each is named as one of them."""
    both = jobs.select("id", "company").unionByName(jobs.select(F.concat(F.lit("x"), "id").alias("id"), F.concat("company", F.lit(" (via Robert Half)")).alias("company")))
    return both.where(~text.names_one_of(F.col("company"), _STAFFING)).select("id").distinct()


@query("jobs", sql="SELECT DISTINCT id FROM jobs WHERE coalesce(remotetype <> 'non-us', true) AND NOT coalesce(flags.nonustext, false)")
def p01_kept(jobs: DataFrame) -> DataFrame:
    """A filter whose null flags keep the row."""
    return jobs.where(F.coalesce(F.col("remotetype") != "non-us", F.lit(True)) & ~F.coalesce("flags.nonustext", F.lit(False))).select("id").distinct()


@query("jobs", sql="SELECT DISTINCT id FROM jobs WHERE coalesce(remotetype <> 'non-us', true) AND NOT coalesce(flags.nonustext, false) AND NOT coalesce(flags.restricted, false)")
def p02_snapshot_filter(jobs: DataFrame) -> DataFrame:
    return p01_kept(jobs.where(~F.coalesce("flags.restricted", F.lit(False))))


@query("jobs", sql="SELECT id, title FROM jobs WHERE regexp_matches(title, '(?i)\\b(data|software) (engineer|scientist)\\b')")
def p03_title_pattern(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("title").rlike(r"(?i)\b(data|software) (engineer|scientist)\b")).select("id", "title")


@query("jobs", sql="SELECT DISTINCT applyurl, CASE WHEN starts_with(applyurl, 'https://') THEN applyurl END AS safe FROM jobs")
def p04_https_only(jobs: DataFrame) -> DataFrame:
    return jobs.select("applyurl").distinct().select("applyurl", urls.safe_url(F.col("applyurl")).alias("safe"))


_EXCLUDED = ["melhota tizesu foods", "vanzodre totika analytics"]


@query("boards", sql=f"""
SELECT DISTINCT company FROM boards WHERE trim(regexp_replace(lower(coalesce(company, '')), '[^a-z0-9]+', ' ', 'g')) NOT IN ('{"', '".join(_EXCLUDED)}') AND NOT regexp_matches(coalesce(company, ''), '(?i)\\bsecurity$')""")
def p05_excluded_names(boards: DataFrame) -> DataFrame:
    """An exact list and a pattern exclude names (J10 and the staffing test of P06 take this form)."""
    name = text.normal_company(F.col("company"), spell_and=False)
    return boards.where(~name.isin(*_EXCLUDED) & ~F.coalesce("company", F.lit("")).rlike(r"(?i)\bsecurity$")).select("company").distinct()


@query("boards", sql=f"SELECT DISTINCT type, lower(token) AS token, regexp_matches(lower(token), CASE WHEN type IN ('workday', 'oracle', 'icims') THEN '^[a-z0-9][a-z0-9._/-]{{1,180}}$' ELSE '^[a-z0-9][a-z0-9._-]{{1,90}}$' END) AND lower(token) NOT IN ({_RESERVED}) AS valid FROM boards")
def p07_valid_token(boards: DataFrame) -> DataFrame:
    t = F.lower("token")
    return boards.select("type", t.alias("token"), urls.valid_token(F.col("type"), t).alias("valid")).distinct()


@query("boards", sql="SELECT * FROM boards WHERE trim(coalesce(company, '')) <> '' AND trim(coalesce(type, '')) <> '' AND trim(coalesce(token, '')) <> ''")
def p08_required(boards: DataFrame) -> DataFrame:
    full = F.lit(True)
    for c in ("company", "type", "token"):
        full = full & (F.trim(F.coalesce(c, F.lit(""))) != "")
    return boards.where(full)


@query("jobs", sql="SELECT DISTINCT title FROM jobs WHERE length(title) BETWEEN 3 AND 140 AND NOT regexp_matches(title, '(?i)^(apply|view|learn more|back|home|skip)')")
def p09_title_hygiene(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.length("title").between(3, 140) & ~F.col("title").rlike(r"(?i)^(apply|view|learn more|back|home|skip)")).select("title").distinct()


@query("jobs", sql="SELECT count(*) FILTER (WHERE epoch_us(checked) - epoch_us(firstseen) BETWEEN 0 AND 86400000000) AS day, count(*) FILTER (WHERE epoch_us(checked) - epoch_us(firstseen) BETWEEN 0 AND 604800000000) AS week FROM jobs")
def p10w_freshness_windows(jobs: DataFrame) -> DataFrame:
    f = dates.freshness(F.col("firstseen"), F.col("checked"))
    return jobs.agg(F.count_if(f["within_24h"]).alias("day"), F.count_if(f["within_7d"]).alias("week"))


@query("boards", sql="SELECT type, token, company FROM boards WHERE from_extra IS DISTINCT FROM true")
def p13_null_safe(boards: DataFrame) -> DataFrame:
    return boards.where(~F.col("from_extra").eqNullSafe(F.lit(True))).select("type", "token", "company")
