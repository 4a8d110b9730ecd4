"""The best representative of each group of duplicates."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.operators.components import connected_components
from sievemill.session import cut


def duplicate_groups(rows: DataFrame, *, key: str = "id", parent: str = "duplicateof") -> DataFrame:
    """(id, group_id): ids tied directly, through others or by naming the same id, in groups of two or more.

    ``group_id`` is the smallest id present. An id that only occurs as a value ties its namers together but
    is no member. Naming oneself, and null or empty values, join nothing.
    """
    edges = rows.where(F.col(parent) != "").select(F.col(key).alias("a"), F.col(parent).alias("b"))
    parts = connected_components(edges)
    present = rows.select(F.col(key).alias("node")).where("node is not null").distinct()
    members = cut(parts.join(present, "node", "left_semi"))
    heads = members.groupBy("component").agg(F.min("node").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(heads, "component").select(F.col("node").alias("id"), "group_id")


def best_by(order: Sequence[Column], value: Column) -> Column:
    """The value of the row that comes first; an aggregate, so nothing of a group is collected."""
    return F.min_by(value, F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))


def _discovered(claims: DataFrame, rounds: int, tolerance: float) -> tuple[DataFrame, DataFrame, int, bool]:
    """The winners, the weights, the rounds taken and whether the weights came to rest."""
    c = cut(claims.where("value is not null and object is not null").groupBy("object", "field", "value", "source").agg(F.count(F.lit(1)).alias("__n")).drop("__n"))
    weights = cut(c.select("source").distinct().withColumn("weight", F.lit(1.0)))
    for n in range(1, rounds + 1):
        support = c.join(weights, "source").groupBy("object", "field", "value").agg(F.sum("weight").alias("support"))
        # With a rounded sum the order of additions cannot decide a tie.
        order = F.struct((-F.round("support", 9)).alias("s"), F.col("value").alias("v"))
        winners = cut(support.groupBy("object", "field").agg(F.min(order).alias("w")).select("object", "field", F.col("w.v").alias("winner"), (-F.col("w.s")).alias("support")))
        rate = c.join(winners.drop("support"), ["object", "field"]).groupBy("source").agg(((F.sum((F.col("value") != F.col("winner")).cast("double")) + 0.5) / (F.count(F.lit(1)) + 1.0)).alias("lost"))
        fresh = cut(rate.select("source", F.greatest(F.lit(0.01), -F.log("lost")).alias("weight")).join(weights.withColumnRenamed("weight", "old"), "source"))
        moved = fresh.agg(F.max(F.abs(F.col("weight") - F.col("old")))).first()[0]
        weights = fresh.select("source", "weight")
        if moved is None or moved <= tolerance:
            return winners, weights, n, True
    warnings.warn(f"truth discovery: weights still move by {moved:.2g} after {rounds} rounds", stacklevel=3)
    return winners, weights, rounds, False


def truth_discovery(claims: DataFrame, *, rounds: int = 50, tolerance: float = 1e-4) -> DataFrame:
    """Per object and field the value with the highest support.

    ``claims``: (object, field, value, source). Alternately the support of a value is the sum of the
    weights of the sources that claim it, and a source's weight is -log of its share of claims lost
    (smoothed), until no weight moves by more than ``tolerance``; after ``rounds`` it ends with a warning.
    Ties go to the smaller value. Null values are no claims; a claim counts once for each source. The
    weights table has one row a source; all steps are aggregations with partial sums.
    """
    return _discovered(claims, rounds, tolerance)[0].select("object", "field", F.col("winner").alias("value"), "support")


def source_reliability(claims: DataFrame, *, rounds: int = 50, tolerance: float = 1e-4) -> DataFrame:
    """(source, weight, rounds, at_rest): what truth discovery holds of each source, and whether it converged."""
    _, weights, taken, at_rest = _discovered(claims, rounds, tolerance)
    return weights.select("source", "weight", F.lit(taken).alias("rounds"), F.lit(at_rest).alias("at_rest"))


def field_claims(jobs: DataFrame, groups: DataFrame, fields: Sequence[str], *, key: str = "id", source: str = "source") -> DataFrame:
    """(object, field, value, source): what each member of a group claims, its non-blank values; the
    platforms are the sources whose reliability is estimated."""
    member = jobs.select(F.col(key).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"), *[F.col(f).cast("string").alias(f"__f_{f}") for f in fields]).join(groups, "id")
    claim = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__f_{f}").alias("value")) for f in fields]))
    return member.select(F.col("group_id").alias("object"), "source", claim.alias("c")).select("object", "source", "c.field", F.nullif(F.trim("c.value"), F.lit("")).alias("value"))


def golden_records(jobs: DataFrame, groups: DataFrame, fields: Sequence[str], *, key: str = "id", source: str = "source") -> DataFrame:
    """(group_id, one column per field): the surviving record of each group, field by field, by truth
    discovery over the claims of its members; a field that no member fills is null."""
    won = truth_discovery(field_claims(jobs, groups, fields, key=key, source=source))
    return won.groupBy(F.col("object").alias("group_id")).pivot("field", list(fields)).agg(F.first("value"))


def best_of_groups(jobs: DataFrame, pay: DataFrame) -> DataFrame:
    """(group_id, best_id, pay_id): the posting to keep and the one whose salary is carried over.

    ``best_id``: earliest ``firstseen`` (nulls last), highest ``fitscore`` (nulls last), smallest id.
    ``pay_id``: of the members in ``pay`` the one checked last (nulls last), then the smallest id; '' for
    none. Groups are aggregated, never collected; repeated rows change nothing.
    """
    groups = duplicate_groups(jobs)
    paid = pay.select("id").distinct().withColumn("paid", F.lit(True))
    members = groups.join(jobs.select("id", "firstseen", "fitscore", "checked"), "id").join(paid, "id", "left")
    i = F.col("id")
    best = best_by([F.col("firstseen").isNull(), F.col("firstseen"), F.col("fitscore").isNull(), -F.col("fitscore"), i], i)
    carried = best_by([F.col("paid").isNull(), F.col("checked").isNull(), -F.unix_micros("checked"), i], F.when(F.col("paid"), i))
    return members.groupBy("group_id").agg(best.alias("best_id"), F.coalesce(carried, F.lit("")).alias("pay_id"))
