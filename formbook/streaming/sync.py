"""Incremental copy of an append-only change log.

``sync_change_log`` is an ``availableNow`` Structured Streaming job over
the landed log files; each micro-batch is de-duplicated on ``event_id``
and anti-joined with the ids already in the target (restricted to the
batch's id range, so Parquet min/max statistics prune the target scan),
appended, and the one-row watermark is rewritten from an ``Observation``
taken during that same write — the batch is evaluated once. Re-running,
re-delivered rows and a crash between append and watermark all end with
each event exactly once in the target.

``sync_by_event_time`` is the same copy with state bounded by event time:
ids are remembered only as long as an event may be late, so a batch never
reads the target. What arrives later than that is settled afterwards against
the part of the target that is as old.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from formbook.session import session_with
from formbook.sources.tables import path_exists as _path_exists
from formbook.sources.tables import remove_folder


def read_watermark(spark: SparkSession, watermark_path: str) -> int:
    if not _path_exists(spark, watermark_path):
        return 0
    row = spark.read.parquet(watermark_path).agg(F.max("last_event_id")).first()
    return int(row[0] or 0)


def sync_change_log(spark: SparkSession, source: str, schema: StructType, target: str, watermark: str,
                    checkpoint: str, key: str = "event_id", max_files_per_trigger: int = 1000) -> None:
    """Copy new log rows from ``source`` (a directory of Parquet files that
    only grows) into ``target``; idempotent and restartable. A micro-batch
    holds at most ``max_files_per_trigger`` files."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)

    def apply_batch(batch: DataFrame, epoch_id: int) -> None:
        # the micro-batch (bounded by the trigger) is read once: persisted for
        # the id-range probe and the write
        dedup = batch.dropDuplicates([key]).persist()
        try:
            new = dedup
            if _path_exists(spark, target):
                lo = dedup.agg(F.min(key)).first()[0]
                if lo is None:
                    return
                have = spark.read.parquet(target).where(F.col(key) >= lo).select(key)
                new = dedup.join(have, key, "left_anti")
            obs = Observation(f"sync_{epoch_id}")
            observed = new.observe(obs, F.count(F.lit(1)).alias("rows"), F.max(key).alias("max_id"))
            observed.write.mode("append").parquet(target)
            stats = obs.get
            if stats.get("rows"):
                last = max(int(stats["max_id"]), read_watermark(spark, watermark))
                spark.createDataFrame([(last,)], "last_event_id long").coalesce(1) \
                    .write.mode("overwrite").parquet(watermark)
        finally:
            dedup.unpersist()

    q = (stream.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


@dataclass(frozen=True)
class SyncProgress:
    """What one call of :func:`sync_by_event_time` did. ``watermark`` is the
    event time up to which nothing more is expected (None before any event),
    ``behind`` the delivered rows at or before it when they came, first-time
    and repeated ones alike, and ``settled`` those of them that were new."""

    watermark: dt.datetime | None
    taken: int
    behind: int
    settled: int


#: How many batches of one call keep their progress in the driver.
PROGRESS_KEPT = 1_000_000


def sync_by_event_time(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str,
                       event_time: str, lateness: str = "1 hour", key: str = "event_id",
                       max_files_per_trigger: int = 1000, settle: bool = True) -> SyncProgress:
    """Copy new log rows from ``source`` (a folder of Parquet files that only
    grows) into ``target``, each ``key`` once.

    The stream drops repeats with ``dropDuplicatesWithinWatermark``: its state
    holds the keys of the last ``lateness`` only. It also drops rows at or
    before the watermark, repeats or not, and counts them in its progress.
    Where there are any, :func:`settle_behind` appends those that the target
    lacks. A marker beside the checkpoint stands from before the stream
    starts until that is done, so a call that died in between is made good by
    the next one. With ``settle`` false the marker stays and the next call
    settles.

    Defined results: rows of a null key are one event; rows of a null event
    time are not given to the stream but settled, as if they were behind. An
    event keeps its time: a repeat of another time counts as that of the key
    only while the key is in the state.
    """
    own = session_with(spark, {"spark.sql.streaming.numRecentProgressUpdates": str(PROGRESS_KEPT)})
    marker = f"{checkpoint.rstrip('/')}-unsettled"
    owed = _path_exists(spark, marker)
    if not owed:
        spark.range(1).write.parquet(marker)
    rows = own.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)
    timed = rows.observe("landed", F.count_if(F.col(event_time).isNull()).alias("timeless")).where(F.col(event_time).isNotNull())
    query = (timed.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([key])
             .writeStream.format("parquet").option("path", f"{target}/stream")
             .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    watermark, taken, behind = None, 0, 0
    for progress in query.recentProgress:
        taken += progress.numInputRows
        behind += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        landed = progress.observedMetrics.get("landed")
        behind += landed["timeless"] if landed else 0
        at = progress.eventTime.get("watermark")
        if at and not at.startswith("1970-01-01T00:00:00.000"):
            read = dt.datetime.strptime(at, "%Y-%m-%dT%H:%M:%S.%f%z")
            watermark = read if watermark is None else max(watermark, read)
    settled = 0
    if settle:
        if owed or behind:
            settled = settle_behind(spark, source, schema, target, event_time, key, watermark)
        remove_folder(spark, marker)
    return SyncProgress(watermark, taken, behind, settled)


def settle_behind(spark: SparkSession, source: str, schema: StructType, target: str, event_time: str,
                  key: str = "event_id", watermark: dt.datetime | None = None) -> int:
    """Append the delivered rows at or before ``watermark`` (all, where none
    is known) that the target lacks, each key once; returns their number.
    Both sides are cut at the watermark, which Parquet statistics prune."""
    def old(df: DataFrame) -> DataFrame:
        at = F.col(event_time)
        return df if watermark is None else df.where((at <= F.lit(watermark)) | at.isNull())

    landed = old(spark.read.schema(schema).parquet(source))
    held = old(read_synced(spark, target, schema)).select(F.col(key).alias("_held"))
    lacking = landed.join(held, F.col(key).eqNullSafe(F.col("_held")), "left_anti").dropDuplicates([key])
    seen = Observation("settled")
    lacking.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(f"{target}/settled")
    return int(seen.get["rows"])


def read_synced(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The table that :func:`sync_by_event_time` writes."""
    parts = [spark.read.schema(schema).parquet(f"{target}/{part}") for part in ("stream", "settled")
             if _path_exists(spark, f"{target}/{part}")]
    if not parts:
        return spark.createDataFrame([], schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_change_log_jdbc(spark: SparkSession, url: str, table: str, last_id: int, *, key: str = "event_id",
                         upper_id: int | None = None, partitions: int = 8,
                         properties: dict[str, str] | None = None) -> DataFrame:
    """Incremental JDBC scan of ``key > last_id``. With ``upper_id`` the
    read is split into ``partitions`` parallel range queries; Spark pushes
    the filter into each query."""
    props = dict(properties or {})
    if upper_id is not None and upper_id > last_id:
        df = spark.read.jdbc(url, table, column=key, lowerBound=last_id + 1, upperBound=upper_id + 1,
                             numPartitions=partitions, properties=props)
    else:
        df = spark.read.jdbc(url, table, properties=props)
    return df.where(F.col(key) > F.lit(last_id))


def sync_lag(live: DataFrame, synced: DataFrame, key: str = "event_id") -> DataFrame:
    """Live vs synced counts, lag = max(live - synced, 0), and the
    number of live ids still missing in the target (anti join)."""
    n_live = live.agg(F.count("*").alias("n")).scalar()
    n_synced = synced.agg(F.count("*").alias("n")).scalar()
    n_missing = (live.select(key).join(synced.select(key), key, "left_anti")
                 .agg(F.count("*").alias("n")).scalar())
    return live.sparkSession.range(1).select(
        n_live.alias("live_events"), n_synced.alias("synced_events"), n_missing.alias("missing_ids"),
        F.greatest(n_live - n_synced, F.lit(0)).alias("lag"))
