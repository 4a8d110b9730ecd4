"""Repeated sweeps as streams: micro-batches, state with a time to live, windows and a budget."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievemill.session import ship

#: Seconds: the first estimate of an iteration, the least one, and how much longer the next may take.
FIRST_ESTIMATE, LEAST_ESTIMATE, SLACK = 300.0, 180.0, 1.5

#: Groups of ids whose state lies together.
GROUPS = 256

#: Micro-batches that what is there is dealt out to, where each of them writes a growing state anew.
BATCHES = 16


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet (or one local file) as a stream; wall-clock timestamps become UTC instants, as
    watermarks need them."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    single = os.path.isfile(path)
    df = reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path)) if single else reader.parquet(path)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)})


def files_a_batch(spark: SparkSession, path: str, batches: int = BATCHES) -> int:
    """How many files a micro-batch takes for all that is there to come in at most so many."""
    return max(1, -(-len(spark.read.parquet(path).inputFiles()) // batches))


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """All that is there as micro-batches, then stop. The checkpoint is the cursor: a batch that did not
    finish is delivered again under its number, so ``each`` must overwrite by number."""
    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def write_batches(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Each micro-batch under its number: delivered twice it is written once."""
    run_available(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), checkpoint, mode)


def _packed(held: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(held)
    return sink.getvalue().to_pybytes()


def first_seen(stream: DataFrame, *, hours: int, late: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """(id, firstseen, checked, stale): put-if-absent of ``firstseen`` by id, and rows whose board was not
    seen for ``hours`` (event time) leave as stale.

    State: the first instant seen and the last check of each id, dropped when the watermark passes it. Rows
    later than ``late`` are dropped; a row within it may bring the first instant forward. The ids whose hashes
    fall in one of ``groups`` lie together as an Arrow table, so Python is called by group and not by id; a
    batch writes the groups anew that it touches.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = []
        if state.exists:
            old = pa.ipc.open_stream(state.get[0]).read_all()
            parts.append(old.append_column("fresh", pa.repeat(False, len(old))))
        if not state.hasTimedOut:
            for pdf in batches:
                at = pa.array(pdf["at"], pa.int64())
                parts.append(pa.table({"id": pa.array(pdf["id"], pa.string()), "first": at, "last": at, "fresh": pa.repeat(True, len(at))}))
        held = pa.concat_tables(parts).group_by("id", use_threads=False).aggregate([("first", "min"), ("last", "max"), ("fresh", "any")])
        held = held.select(["id", "first_min", "last_max", "fresh_any"]).rename_columns(["id", "first", "last", "fresh"])
        until = held["last"].to_numpy() // 1000 + hours * 3_600_000
        stale = until < state.getCurrentWatermarkMs()
        kept = held.filter(pa.array(~stale)).drop_columns(["fresh"])
        if len(kept):
            state.update((_packed(kept.combine_chunks()),))
            state.setTimeoutTimestamp(int(until[~stale].min()))
        elif state.exists:
            state.remove()
        for rows, leave in ((held.filter(held["fresh"]), False), (held.filter(pa.array(stale)), True)):
            if len(rows):
                yield rows.drop_columns(["fresh"]).to_pandas().assign(stale=leave)

    ship(stream.sparkSession)
    timed = stream.where("id is not null and checked is not null").select("id", "checked").withWatermark("checked", late)
    grouped = timed.withColumns({"at": F.unix_micros("checked"), "part": F.pmod(F.xxhash64("id"), F.lit(groups))}).groupBy("part")
    rows = grouped.applyInPandasWithState(update, "id string, first long, last long, stale boolean", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return rows.select("id", F.timestamp_micros("first").alias("firstseen"), F.timestamp_micros("last").alias("checked"), "stale")


def windowed_counts(stream: DataFrame, at: str, by: str, late: str | None, window: str, slide: str | None = None) -> DataFrame:
    """Counts by tumbling or sliding windows of event time; rows later than ``late`` are dropped, none where it is None."""
    timed = stream.withWatermark(at, late) if late else stream
    return timed.groupBy(F.window(at, window, slide or window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def sessions(stream: DataFrame, at: str, by: str, late: str, gap: str) -> DataFrame:
    """Session windows: a session ends after ``gap`` without a row of its key."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("started"), by, "n")


def once(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def rotation_slot(now: Column, slots: int) -> Column:
    """The slot of a rotation by the hour of the day (UTC)."""
    return F.hour(now) % slots


def within_budget(step: Callable[[], None], hours: float, *, clock: Callable[[], float] = time.monotonic, least: float = LEAST_ESTIMATE, first: float = FIRST_ESTIMATE) -> int:
    """Repeats ``step`` while the next one is expected to end within the budget; the number of steps done.

    The expectation is ``SLACK`` times the last duration, at least ``least``; the first is ``first``."""
    began, expected, done = clock(), first, 0
    while clock() - began + expected <= hours * 3600:
        start = clock()
        step()
        done += 1
        expected = max(least, SLACK * (clock() - start))
    return done
