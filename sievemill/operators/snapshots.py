"""Change events between consecutive full snapshots (gaps and islands)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blanks: what Java calls white space, and the no-break blanks.
_BLANKS = r"[\s\u00A0\u2007\u202F]+"


def squash(c: Column) -> Column:
    """Text without leading, trailing and repeated blanks; null counts as blank."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _BLANKS, " "))


def instant(c: Column) -> Column:
    """ISO text as an instant in microseconds; text that is no instant stays as it is, blank is ''."""
    text = squash(c)
    return F.coalesce(F.unix_micros(text.try_cast("timestamp")).cast("string"), text)


def snapshot_intervals(
    rows: DataFrame,
    *,
    sweep: str,
    key: str,
    checked: str,
    compare: Sequence[Column],
) -> DataFrame:
    """Validity intervals (key, first, last, first_no, next_no, opens, ends) of unchanged content.

    ``first`` and ``last`` are ranks of delivered sweeps (so gaps in the numbers do not matter),
    ``first_no`` the sweep that starts the interval, ``next_no`` the sweep delivered after its end
    (null after the last one).

    Of several rows of a key in one sweep the one checked last counts (a null check is earliest, equal
    checks go to the smaller hash). Rows with a null key or sweep are no records and are left out.
    Copies collapse map-side before the first shuffle, so a key that holds a large share of all rows
    reaches the window as one row for each sweep and content.
    """
    k, s = F.col(key), F.col(sweep)
    valid = rows.where(k.isNotNull() & s.isNotNull())
    # One row per delivered snapshot: a table of hourly deliveries needs a century to reach a million.
    numbers = valid.agg(F.array_sort(F.collect_set(s)).alias("nos"))
    sweeps = numbers.select(F.posexplode("nos").alias("rank", "no"), "nos").select(
        F.col("no").alias("__no"), "rank", F.try_element_at("nos", F.col("rank") + 2).alias("next_no")
    )
    lean = valid.select(
        k.alias("key"),
        s.alias("no"),
        F.col(checked).alias("at"),
        F.xxhash64(*compare).alias("h1"),
        F.xxhash64(F.lit(7), *compare).alias("h2"),
    )
    # One exchange by key then serves all windows and the grouping into islands.
    versions = lean.groupBy("key", "no", "h1", "h2").agg(F.max("at").alias("at")).repartition("key")
    by_key = Window.partitionBy("key")
    kept = (
        versions.withColumn("nth", F.row_number().over(Window.partitionBy("key", "no").orderBy(F.desc_nulls_last("at"), "h1", "h2")))
        .where("nth = 1")
        .join(F.broadcast(sweeps), F.col("no") == F.col("__no"))
    )
    order = by_key.orderBy("rank")
    same = (F.lag("rank").over(order) == F.col("rank") - 1) & (F.lag("h1").over(order) == F.col("h1")) & (F.lag("h2").over(order) == F.col("h2"))
    islands = kept.withColumn("opens", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("island", F.sum("opens").over(order))
    return islands.groupBy("key", "island").agg(
        F.min("rank").alias("first"),
        F.max("rank").alias("last"),
        F.min_by("no", "rank").alias("first_no"),
        F.max_by("next_no", "rank").alias("next_no"),
    )


def snapshot_changes(rows: DataFrame, *, sweep: str, key: str, checked: str, compare: Sequence[Column]) -> DataFrame:
    """(sweep_no, id, change_kind): what differs between each sweep and the one delivered before.

    Starts, ends and adjacencies of the intervals are the events: an interval that starts right after
    another of the same key is ``changed``, one that starts otherwise (except in the first sweep) is
    ``added``, an end without an adjacent successor (except in the last sweep) is ``removed`` in the
    sweep that follows. No rows, or one sweep only, give no events.
    """
    spans = snapshot_intervals(rows, sweep=sweep, key=key, checked=checked, compare=compare)
    order = Window.partitionBy("key").orderBy("first")
    before, after = F.lag("last").over(order), F.lead("first").over(order)
    events = spans.select(
        "key",
        F.when((F.col("first") > 0) & (before == F.col("first") - 1), F.struct(F.col("first_no").alias("no"), F.lit("changed").alias("kind")))
        .when(F.col("first") > 0, F.struct(F.col("first_no").alias("no"), F.lit("added").alias("kind")))
        .alias("start"),
        F.when(F.col("next_no").isNotNull() & ~F.coalesce(after == F.col("last") + 1, F.lit(False)), F.struct(F.col("next_no").alias("no"), F.lit("removed").alias("kind"))).alias("end"),
    )
    return (
        events.select("key", F.explode(F.array_compact(F.array("start", "end"))).alias("e"))
        .select(F.col("e.no").alias("sweep_no"), F.col("key").alias("id"), F.col("e.kind").alias("change_kind"))
    )


def posting_changes(sweep_jobs: DataFrame) -> DataFrame:
    """The changes of the postings: company, title, location, workplace and salary compare without
    blanks at the ends or repeated, ``firstseen`` compares as an instant."""
    compare = [squash(F.col(c)) for c in ("company", "title", "location", "workplace", "salary")] + [instant(F.col("firstseen"))]
    return snapshot_changes(sweep_jobs, sweep="sweep_no", key="id", checked="checked", compare=compare)
