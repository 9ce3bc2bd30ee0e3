"""SparkSession construction and cluster-safe helpers."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "formbook") -> SparkSession:
    """Return the active session or build one tuned for this library.

    On a cluster the session already exists (spark-submit) and only the
    SQL confs below are applied; locally a ``local[N]`` session is built.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        _apply_sql_confs(active, shuffle_partitions)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    _apply_sql_confs(spark, shuffle_partitions)
    return spark


def apply_plan_confs(spark: SparkSession) -> None:
    """SQL settings the plans are designed for (runtime-settable):
    joins may reuse a partitioning on a subset of their keys — the ball
    grain is hash-partitioned by ``match_id`` once and the innings-level
    joins and aggregates (keys that contain ``match_id``) add no shuffle.
    A match is bounded in size, so the coarser key cannot skew."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def _apply_sql_confs(spark: SparkSession, shuffle_partitions: int | None) -> None:
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    apply_plan_confs(spark)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))


def input_bytes(spark: SparkSession, path: str) -> int:
    """On-disk size of a file or folder (Hadoop content summary, metadata only)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


def shuffle_partitions_for(spark: SparkSession, path: str, target_bytes: int = 128 << 20,
                           expansion: float = 40.0) -> int:
    """Partitions for a shuffle of the rows made of the data at ``path``:
    their size (on-disk bytes x ``expansion``; a ball has some 40 columns
    where its packed event has six) over ``target_bytes``, never fewer than
    there are cores. A named count is not coalesced by AQE, and each
    partition of the balls is written as a file a competition, so the count
    follows the input alone and not ``spark.sql.shuffle.partitions``."""
    return max(spark.sparkContext.defaultParallelism, -(-int(input_bytes(spark, path) * expansion) // target_bytes))


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A runtime setting for one write; the caller's value comes back."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def session_with(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session on the same context with the caller's runtime settings and
    ``settings`` on top, so that a scan or stream can have its own without
    changing the caller's other queries."""
    own = spark.newSession()
    for name, value in (spark.conf.getAll | settings).items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    return own


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared lineage-cut / staging folder.

    Read from the session (``spark.checkpoint.dir`` given at cluster or
    session start, or an earlier ``setCheckpointDir``). Where none is named,
    a folder of the session's warehouse is used, on any master: the
    warehouse is shared by the driver and the executors.
    ``spark.checkpoint.dir`` is a core setting and cannot be changed at
    runtime, so this never calls ``spark.conf.set`` on it.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir()
    if not path:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named:
            named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoint"
        sc.setCheckpointDir(named)
        path = sc.getCheckpointDir()
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives
    executor loss, unlike a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
