"""Timestamps of mixed formats, precisions and zones as exact UTC instants."""

from __future__ import annotations

import os
import struct
import zoneinfo
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from importlib import resources

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions.wallclock import read_wallclock
from sievemill.session import map_batches

#: The years for which zone offsets are tabulated by default; wall times outside use Spark's own conversion.
YEARS = (1970, 2060)
#: The years tabulated for postings, whose dates of any plausible year take the same way.
POSTING_YEARS = (1900, 2100)


def _tz_file(name: str) -> bytes:
    """A zone of the tz database as its compiled file, from the system or the tzdata package."""
    for folder in zoneinfo.TZPATH:
        path = os.path.join(folder, *name.split("/"))
        if os.path.isfile(path):
            with open(path, "rb") as f:
                return f.read()
    package, _, last = ("tzdata/zoneinfo/" + name).rpartition("/")
    return resources.files(package.replace("/", ".")).joinpath(last).read_bytes()


def _recorded_changes(data: bytes) -> list[int]:
    """The instants (seconds UTC) at which a compiled zone records a change; RFC 8536, 64-bit block."""
    sizes = lambda at: struct.unpack(">6l", data[at + 20 : at + 44])
    utc, std, leap, times, kinds, chars = sizes(0)
    if data[4:5] in (b"", b"\0"):  # the first version has 32-bit times only
        return list(struct.unpack(f">{times}l", data[44 : 44 + 4 * times]))
    second = 44 + 5 * times + 6 * kinds + chars + 8 * leap + std + utc
    times = sizes(second)[3]
    return list(struct.unpack(f">{times}q", data[second + 44 : second + 44 + 8 * times]))


def _offset_spans(names: Iterator[pd.DataFrame], first: int, last: int) -> Iterator[pd.DataFrame]:
    """Per zone the spans of one offset: UTC start and end in seconds, offset in seconds.

    The recorded changes of the tz database are taken as they are. After the last of them a zone keeps its
    offset or follows the yearly rule of its file, whose changes lie months apart: it is then sampled every
    four weeks and a change located by bisection."""
    stride, day = 28 * 86400, 86400
    start, end = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) + d * day for y, d in ((first, -2), (last + 1, 2)))
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    for pdf in names:
        out = []
        for name in pdf["zone"]:
            zone = zoneinfo.ZoneInfo(name)
            off = lambda s: int((epoch + timedelta(seconds=s)).astimezone(zone).utcoffset().total_seconds())  # noqa: B023, E731
            data = _tz_file(name)
            recorded = _recorded_changes(data)
            changes = [s for s in recorded if start < s < end]
            rule = data[4:5] in (b"", b"\0") or b"," in data.rstrip(b"\n").rpartition(b"\n")[2]
            at = max([start, *recorded[-1:]]) if rule else end
            while at < end:
                if off(at + stride) != off(at):
                    lo, hi = at, at + stride
                    while hi - lo > 1:
                        mid = (lo + hi) // 2
                        lo, hi = (mid, hi) if off(mid) == off(at) else (lo, mid)
                    changes.append(hi)
                    at = hi
                else:
                    at += stride
            since, now = start, off(start)
            for s in changes:
                if off(s) != now:
                    out.append((name, since, s, now))
                    since, now = s, off(s)
            out.append((name, since, end, now))
        yield pd.DataFrame(out, columns=["zone", "utc_from", "utc_to", "offset_s"])


def zone_intervals(spark: SparkSession, years: tuple[int, int] = YEARS) -> DataFrame:
    """(zone, year, spans): per zone and local year the offset intervals that touch it.

    ``spans`` holds local start and end in microseconds and the offset. The size is bounded by the tz
    database: some 600 names x the tabulated years x the two or three intervals of a year.
    """
    names = spark.createDataFrame([(z,) for z in sorted(zoneinfo.available_timezones())], "zone string").repartition(16)
    spans = map_batches(names, lambda it: _offset_spans(it, *years), "zone string, utc_from long, utc_to long, offset_s int")
    million = F.lit(1_000_000).cast("bigint")
    local = spans.select(
        "zone",
        ((F.col("utc_from") + F.col("offset_s")) * million).alias("from_us"),
        ((F.col("utc_to") + F.col("offset_s")) * million).alias("to_us"),
        (F.col("offset_s") * million).alias("offset_us"),
    )
    # A skipped hour needs the interval before it: it counts for the year in which it ends, plus a day.
    year = lambda us: F.year(F.timestamp_micros(us))
    exploded = local.withColumn("year", F.explode(F.sequence(F.greatest(year("from_us"), F.lit(years[0])), F.least(year(F.col("to_us") + F.lit(86_400_000_000)), F.lit(years[1])))))
    return exploded.groupBy("zone", "year").agg(F.array_sort(F.collect_list(F.struct("from_us", "to_us", "offset_us"))).alias("spans"))


def local_to_utc(rows: DataFrame, *, local_us: str, zone: str, into: str = "utc_us", kind: str = "zone_case", years: tuple[int, int] = YEARS) -> DataFrame:
    """As-of join of local times to zone-offset intervals.

    Adds ``into`` (microseconds UTC) and ``kind``: 'exact' if one interval holds the wall time,
    'ambiguous' if two do (the earlier instant is taken), 'skipped' if none does (the offset valid before
    the jump is taken), 'outside' for years beyond the table, 'unknown zone' (UTC is taken) for a name the
    tz database lacks, null where the time or the zone is null. Extra columns stay as they are.
    """
    spark = rows.sparkSession
    spans = zone_intervals(spark, years).select(F.col("zone").alias("__zone"), F.col("year").alias("__year"), F.col("spans").alias("__spans"))
    t = F.col(local_us)
    year = F.year(F.timestamp_micros(t))
    joined = rows.withColumn("__y", F.least(F.greatest(year, F.lit(years[0])), F.lit(years[1]))).join(
        F.broadcast(spans), (F.col(zone) == F.col("__zone")) & (F.col("__y") == F.col("__year")), "left"
    )
    within = F.filter("__spans", lambda s: (s["from_us"] <= t) & (t < s["to_us"]))
    before = F.filter("__spans", lambda s: s["to_us"] <= t)
    offset: Column = F.when(F.size(within) > 0, F.array_max(F.transform(within, lambda s: s["offset_us"]))).otherwise(F.element_at(F.transform(before, lambda s: s["offset_us"]), -1))
    inside = year.between(*years)
    known = F.col("__zone").isNotNull()
    native = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(t), F.when(known, F.col(zone)).otherwise("UTC")))
    case = F.when(t.isNull() | F.col(zone).isNull(), F.lit(None).cast("string")).when(~known, "unknown zone").when(~inside, "outside")
    return (
        joined.withColumn(into, F.when(~known, t).when(inside, t - offset).otherwise(native))
        .withColumn(kind, case.when(F.size(within) > 1, "ambiguous").when(F.size(within) == 1, "exact").otherwise("skipped"))
        .drop("__zone", "__year", "__spans", "__y")
    )


def posting_instants(jobs: DataFrame) -> DataFrame:
    """(id, published_us, zone_case): every id whose ``published`` states a real instant.

    Repeated rows give one row. Null or blank values, remarks and impossible dates give none, nor does a
    relative label without a time of the visit or a row without id.
    """
    valued = jobs.where(F.col("id").isNotNull() & F.col("published").isNotNull()).select("id", "published", "publishedmeaning", F.unix_micros("checked").alias("checked_us"))
    stated = read_wallclock(valued, "published", "publishedmeaning")
    resolved = local_to_utc(stated, local_us="local_us", zone="zone", years=POSTING_YEARS)
    us = F.coalesce(
        F.col("epoch_us"),
        F.when(F.col("offset_min").isNotNull(), F.col("local_us") - F.col("offset_min").cast("bigint") * 60_000_000),
        F.when(F.col("zone").isNull(), F.col("local_us")),
        F.col("utc_us"),
        F.col("checked_us") - F.col("days_back").cast("bigint") * 86_400_000_000,
    )
    return resolved.select("id", us.alias("published_us"), "zone_case").where(F.col("published_us").isNotNull()).distinct()
