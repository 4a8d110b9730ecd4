"""The queries of the general training-data problems: timestamps, snapshots, units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievemill.operators.snapshots import posting_changes
from sievemill.operators.timestamps import posting_instants
from sievemill.operators.units import further_amounts, pay_per_year
from sievemill.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return posting_instants(table(spark, d, "jobs")).select("id", "published_us")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return posting_changes(table(spark, d, "sweep_jobs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pay_per_year(table(spark, d, "jobs"), table(spark, d, "pay_units"))


def p4_further(spark: SparkSession, d: str) -> DataFrame:
    return further_amounts(table(spark, d, "jobs"), table(spark, d, "pay_units"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p4_found, p4_further)}

#: DuckDB's own statement of the same results; time zones and pay texts are tested by brute force instead.
SQL = {
    "p3_found": r"""
WITH norm AS (
  SELECT sweep_no, id, checked,
         [trim(regexp_replace(coalesce(company, ''), '[\s\x{00A0}\x{2007}\x{202F}]+', ' ', 'g')),
          trim(regexp_replace(coalesce(title, ''), '[\s\x{00A0}\x{2007}\x{202F}]+', ' ', 'g')),
          trim(regexp_replace(coalesce(location, ''), '[\s\x{00A0}\x{2007}\x{202F}]+', ' ', 'g')),
          trim(regexp_replace(coalesce(workplace, ''), '[\s\x{00A0}\x{2007}\x{202F}]+', ' ', 'g')),
          trim(regexp_replace(coalesce(salary, ''), '[\s\x{00A0}\x{2007}\x{202F}]+', ' ', 'g')),
          coalesce(CAST(epoch_us(try_cast(firstseen AS TIMESTAMPTZ)) AS VARCHAR), trim(coalesce(firstseen, '')))] AS content
  FROM sweep_jobs WHERE id IS NOT NULL AND sweep_no IS NOT NULL),
last AS (SELECT sweep_no, id, arg_max(content, coalesce(checked, TIMESTAMP '0001-01-01')) AS content FROM norm GROUP BY ALL),
pairs AS (SELECT sweep_no, lag(sweep_no) OVER (ORDER BY sweep_no) AS prior FROM (SELECT DISTINCT sweep_no FROM last))
SELECT p.sweep_no, b.id, CASE WHEN a.id IS NULL THEN 'added' ELSE 'changed' END AS change_kind
FROM pairs p JOIN last b ON b.sweep_no = p.sweep_no LEFT JOIN last a ON a.sweep_no = p.prior AND a.id = b.id
WHERE p.prior IS NOT NULL AND (a.id IS NULL OR a.content <> b.content)
UNION ALL
SELECT p.sweep_no, a.id, 'removed' FROM pairs p JOIN last a ON a.sweep_no = p.prior
WHERE NOT EXISTS (SELECT 1 FROM last b WHERE b.sweep_no = p.sweep_no AND b.id = a.id)
""",
}
