"""Joins on conditions other than equality of keys, and matching against lists of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the beginning on which a text meets the names that hold it.
KEY = 6


def contained_in(rows: DataFrame, names: DataFrame, subject: Column, name: str, *, anti: bool = False, bound: int | None = None) -> DataFrame:
    """Rows whose subject equals, or is part of, a name of a list of any length.

    Containment is an equality on pieces: the beginning of a distinct subject meets the pieces of that
    length of the distinct names, and only those pairs are compared, so nothing is compared with every name
    nor broadcast. The empty subject is part of any name; null subjects and names match nothing. With
    ``bound`` longer lists are refused.
    """
    listed = names.select(F.col(name).alias("__name")).where("__name is not null").distinct()
    if bound is not None and (n := listed.limit(bound + 1).count()) > bound:
        raise ValueError(f"the list has {n} names or more; it may have at most {bound}")
    length = F.length("__name")
    of_size = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(length - k + 1, F.lit(1))), lambda i: F.substring("__name", i, k))
    pieces = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.least(length, F.lit(KEY))), of_size)))
    index = listed.select("__name", F.explode_outer(pieces).alias("__piece"))
    asked = rows.select(subject.alias("__s")).where("__s is not null").distinct().withColumn("__piece", F.substring("__s", 1, KEY))
    held = asked.join(index, "__piece").where(F.contains("__name", "__s")).select("__s").distinct()
    return rows.withColumn("__s", subject).join(held, "__s", "left_anti" if anti else "left_semi").drop("__s")


def prefixes(name: Column, by_word: bool = True) -> Column:
    """All beginnings of a name, in whole words or characters."""
    if by_word:
        words = F.split(name, " ")
        return F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda n: F.substring(name, F.lit(1), n))


def prefix_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): names equal to, or a beginning in whole words of, each other.

    A prefix condition is an equality on beginnings: each side is exploded into its own beginnings once and
    joined on equality, so nothing is compared pair by pair and nothing must be broadcast.
    """
    one, two = left.select(F.col(a).alias("a")).where("a <> ''").distinct(), right.select(F.col(b).alias("b")).where("b <> ''").distinct()
    a_in_b = one.join(two.select("b", F.explode(prefixes(F.col("b"))).alias("a")), "a")
    b_in_a = two.join(one.select("a", F.explode(prefixes(F.col("a"))).alias("b")), "b")
    return a_in_b.select("a", "b").union(b_in_a.select("a", "b")).distinct()


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, value: str) -> DataFrame:
    """Each left row with the right value of its key that is the latest not after it.

    Both sides are united and scanned once in order by key, one shuffle, no pairs.
    """
    from pyspark.sql import Window

    both = left.withColumns({"__at": F.col(at), "__v": F.lit(None).cast(right.schema[value].dataType), "__side": F.lit(1)}).unionByName(
        right.select(F.col(key), F.col(right_at).alias("__at"), F.col(value).alias("__v"), F.lit(0).alias("__side")), allowMissingColumns=True
    )
    order = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(f"as_of_{value}", F.last("__v", ignorenulls=True).over(order)).where("__side = 1").drop("__at", "__v", "__side")


def range_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Points within spans [low, high) of a bigint axis, joined on the bins of ``width`` a span touches."""
    binned = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return points.withColumn("__bin", F.floor(F.col(at) / width)).join(binned, "__bin").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__bin")
