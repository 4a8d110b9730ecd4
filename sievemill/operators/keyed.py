"""Keyed choices, order, batches and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.session import cut


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], *, keep_blank: bool = False) -> DataFrame:
    """One row a key, the first in ``order``; null keys are one key. With ``keep_blank`` rows whose keys are
    all null or '' are kept as they are. Ties go to the row of the smaller hash, so the choice repeats.
    min_by aggregates map-side, so a hot key costs one row a partition."""
    blank = None
    for k in keys:
        test = F.coalesce(F.col(k).cast("string"), F.lit("")) == ""
        blank = test if blank is None else blank & test
    keyed = rows.where(~blank) if keep_blank else rows
    whole = F.struct(*[F.col(c) for c in rows.columns])
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.xxhash64(*rows.columns).alias("tie"))
    one = keyed.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(whole, rank).alias("__row")).select("__row.*")
    return one.unionByName(rows.where(blank)) if keep_blank else one


def last_wins(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """One row a key, the one with the highest ``seq``; ties go to the row of the greater hash."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max_by(whole, F.when(F.col(seq).isNotNull(), F.struct(F.col(seq).alias("seq"), F.xxhash64(*rows.columns).alias("tie")))).alias("__row")).select("__row.*")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of both; of one key the new row. Keys of ``new`` are unique; null keys match nothing."""
    return new.unionByName(old.join(new.select(*keys), list(keys), "left_anti"))


def circular_batch(rows: DataFrame, order: Sequence[Column], offset: int, size: int) -> DataFrame:
    """The batch [offset, offset + size) of the ordered rows modulo their number, with ``next_offset``.

    Rows are numbered by range partitions: the sort is distributed, and only the partitions' counts, one
    row each, meet to become offsets.
    """
    numbered = number_rows(rows, order, "__pos")
    n = rows.count()
    placed = numbered.where(F.pmod(F.col("__pos") - offset, F.lit(n)) < size)
    return placed.withColumn("next_offset", F.lit((offset + size) % max(n, 1)).cast("bigint")).drop("__pos")


def number_rows(rows: DataFrame, order: Sequence[Column], into: str) -> DataFrame:
    """The position (from 0) of each row in a total order, without sorting in one task.

    The ranged rows are written once, as ranges sampled twice could differ.
    """
    keys = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    ranged = cut(rows.withColumn("__o", keys).repartitionByRange("__o").withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.select("__part", (F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"))
    local = ranged.withColumn("__nth", F.row_number().over(Window.partitionBy("__part").orderBy("__o")))
    return local.join(F.broadcast(before), "__part").withColumn(into, F.coalesce("__before", F.lit(0)) + F.col("__nth") - 1).drop("__o", "__part", "__nth", "__before")


def top_per_key(rows: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows a key; Spark limits each partition's groups before the shuffle."""
    return rows.withColumn("rank_no", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank_no") <= n)


def keep_recent(history: DataFrame, at: str, now: Column, days: int, most: int, then: Sequence[Column] = ()) -> DataFrame:
    """Retention: the rows of the last ``days`` days, at most the ``most`` newest, ties in the order ``then``."""
    return history.where(F.col(at) >= now - F.make_dt_interval(F.lit(days))).orderBy(F.desc(at), *then).limit(most)
