"""The queries of the llm operators, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievemill.llm.leak import leaked_passages
from sievemill.llm.mix import mixed, mixed_texts, mixture_report
from sievemill.llm.names import spelling_classes, spelling_pairs
from sievemill.llm.places import posting_places
from sievemill.llm.quality import label_shares, not_prose, text_statistics
from sievemill.llm.reposts import linked_openings, repost_pairs
from sievemill.llm.survivor import best_of_groups, duplicate_groups, field_claims, golden_records, source_reliability
from sievemill.operators.units import pay_per_year
from sievemill.session import table

#: No line of business is known beforehand: the names show them.
LEARNT: frozenset[str] = frozenset()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return repost_pairs(table(spark, d, "jobs"), table(spark, d, "boards"), table(spark, d, "places"), lines=LEARNT)


def p7_openings(spark: SparkSession, d: str) -> DataFrame:
    return linked_openings(table(spark, d, "jobs"), table(spark, d, "boards"), table(spark, d, "places"), lines=LEARNT)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_texts(spark: SparkSession, d: str) -> DataFrame:
    return mixed_texts(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return not_prose(table(spark, d, "documents"), table(spark, d, "common_words"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return label_shares(table(spark, d, "documents"), table(spark, d, "common_words"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return text_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs")
    return best_of_groups(jobs, pay_per_year(jobs, table(spark, d, "pay_units")))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_groups(table(spark, d, "jobs"))


_FIELDS = ["title", "company", "location", "workplace", "salary"]


def p5_golden(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs")
    return golden_records(jobs, duplicate_groups(jobs), _FIELDS)


def p5_reliability(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs")
    return source_reliability(field_claims(jobs, duplicate_groups(jobs), _FIELDS))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return spelling_pairs(table(spark, d, "boards"), table(spark, d, "jobs"), lines=LEARNT)


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return spelling_classes(table(spark, d, "boards"), table(spark, d, "jobs"), lines=LEARNT)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return posting_places(table(spark, d, "jobs"), table(spark, d, "places"))


QUERIES = {f.__name__: f for f in (p1_found, p5_found, p5_groups, p5_golden, p5_reliability, p6_found, p6_classes, p7_found, p7_openings, p8_found, p9_mixed, p9_texts, p9_shares, p10_found, p10_shares, p10_statistics)}
SQL: dict[str, str] = {
    "p5_groups": r"""
WITH RECURSIVE e AS (
  SELECT DISTINCT id AS a, duplicateof AS b FROM jobs WHERE id IS NOT NULL AND duplicateof <> '' AND id <> duplicateof),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON t.a = r.b),
member AS (SELECT r.a AS id, min(r.b) FILTER (WHERE r.b IN (SELECT id FROM jobs)) AS group_id FROM reach r WHERE r.a IN (SELECT id FROM jobs) GROUP BY 1)
SELECT id, group_id FROM member WHERE group_id IN (SELECT group_id FROM member GROUP BY 1 HAVING count(*) > 1)
""",
    "p10_statistics": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '') AS l,
         length(regexp_replace(coalesce(text, ''), '[\p{L}\p{N}\s]', '', 'g')) AS n_symbols FROM documents),
c AS (SELECT list(DISTINCT lower(word)) AS words FROM common_words)
SELECT doc_id, n_chars, len(w) AS n_words,
       round(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / nullif(len(w), 0), 6) AS mean_word_length,
       round(n_symbols / nullif(n_chars, 0), 6) AS symbol_ratio, len(l) AS n_lines,
       round(len(list_filter(l, lambda x: regexp_matches(rtrim(x, ' '), '[.!?]$'))) / nullif(len(l), 0), 6) AS ended_lines,
       round(len(list_filter(w, lambda x: list_contains(words, x))) / nullif(len(w), 0), 6) AS common_share
FROM d, c
""",
}
