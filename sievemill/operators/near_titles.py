"""Near-duplicate postings within a company and place by the cosine of term counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.text import normal_company, normal_location
from sievemill.operators.components import connected_components
from sievemill.session import cut

#: Least cosine of two titles.
NEAR = 0.85
# Frequent English words that say nothing of a job.
STOP_WORDS = "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split()


def terms(c: Column) -> Column:
    """The words (two characters or more, no stop words) of a text and each pair of neighbours."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), 0), lambda w: ~w.isin(*STOP_WORDS))
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def near_pairs(rows: DataFrame, near: float = NEAR) -> DataFrame:
    """(a, b, cosine) of ids with equal normal company and location and titles of that cosine.

    Equal titles of one company and place are one class; only classes are compared. Terms are ordered from
    rare to common over all titles, and a title is indexed by its first ones, up to where the rest alone
    is too short for the least cosine: two titles that are near share one of those, so common words alone
    bring no pair together. Products of counts are then summed over the shared terms of the pairs found. A
    member meets the class through its smallest id.
    """
    base = rows.select("id", normal_company(F.col("company")).alias("c"), normal_location(F.col("location")).alias("l"), F.lower(F.coalesce("title", F.lit(""))).alias("t")).where("id is not null and c <> ''").distinct()
    classes = base.groupBy("c", "l", "t").agg(F.min("id").alias("head"))
    several = classes.groupBy("c", "l").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c", "l")
    counts = classes.join(several, ["c", "l"], "left_semi").withColumn("term", F.explode(terms(F.col("t")))).groupBy("c", "l", "head", "term").agg(F.count(F.lit(1)).alias("tf"))
    norms = counts.groupBy("head").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    weighed = counts.join(norms, "head").select("c", "l", "term", "head", (F.col("tf") / F.col("norm")).alias("w"))
    weighed = cut(weighed)
    rarity = weighed.groupBy("term").agg(F.count(F.lit(1)).alias("titles"))
    order = Window.partitionBy("head").orderBy("titles", "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.sum(F.col("w") * F.col("w")).over(order)
    index = weighed.join(rarity, "term").withColumn("rest", rest).where(F.col("rest") >= near * near - 1e-9).select("c", "l", "term", "head")
    met = index.withColumnRenamed("head", "a").join(index.withColumnRenamed("head", "b"), ["c", "l", "term"]).where("a < b").select("a", "b").distinct()
    one, two = (weighed.select(F.col("head").alias(x), "term", F.col("w").alias(f"w{x}")) for x in "ab")
    across = met.join(one, "a").join(two, ["b", "term"]).groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 9).alias("cosine")).where(F.col("cosine") >= near)
    inside = base.join(classes, ["c", "l", "t"]).where((F.col("id") != F.col("head")) & (F.size(terms(F.col("t"))) > 0)).select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine"))
    return across.unionByName(inside)


def canonical(rows: DataFrame, near: float = NEAR) -> DataFrame:
    """(id, duplicateof): each member of a cluster but its canonical one (earliest ``firstseen``, nulls
    last, then the highest ``fitscore``, then the smallest id) with the canonical id."""
    groups = connected_components(near_pairs(rows, near)).withColumnRenamed("node", "id")
    facts = rows.select("id", "firstseen", "fitscore").dropDuplicates(["id"])
    members = groups.join(facts, "id")
    rank = F.struct(F.col("firstseen").isNull().alias("n"), F.col("firstseen").alias("f"), (-F.coalesce("fitscore", F.lit(0))).alias("s"), F.col("id").alias("i"))
    heads = members.groupBy("component").agg(F.min_by("id", rank).alias("duplicateof"))
    return members.join(heads, "component").where("id <> duplicateof").select("id", "duplicateof")
