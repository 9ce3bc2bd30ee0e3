"""Change-log views (B14, B15, A38, A39, W5): audit trail, tool usage,
bid outcomes, running activity count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.session import cut_lineage


def audit_trail(change_log: DataFrame, franchises: DataFrame, limit: int | None = 25) -> DataFrame:
    """B14 (J12 + O4): events with the team name, newest first."""
    out = change_log.join(franchises.select("franchise_id", F.col("name").alias("franchise_name")),
                          "franchise_id", "left").select(
        "event_id", "event_type", "tool_name", "result_status", "payload", "created_at", "franchise_name")
    return out.orderBy(F.desc("event_id")).limit(limit) if limit else out


def tool_usage(change_log: DataFrame) -> DataFrame:
    """Calls per tool, most used first."""
    return change_log.groupBy("tool_name").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "tool_name")


def bid_outcomes(change_log: DataFrame) -> DataFrame:
    """Successful vs blocked bids (status prefix) — one row."""
    b = change_log.where(F.col("tool_name") == "execute_player_bid")
    return b.agg(F.count_if(F.col("result_status") == "success").alias("successful_bids"),
                 F.count_if(F.col("result_status").startswith("blocked")).alias("blocked_bids"),
                 F.count("*").alias("bid_events"))


def log_tool_calls(calls: DataFrame) -> DataFrame:
    """Tool-call rows -> change_log shape with a JSON payload."""
    return calls.select(
        F.when(F.col("result_status") == "success", "data_change").otherwise("tool_call").alias("event_type"),
        "table_name", "tool_name", "franchise_id",
        F.to_json(F.col("payload")).alias("payload"), "result_status")


def running_count(df: DataFrame, order_col: str, tiebreak: str, partitions: int | None = None) -> DataFrame:
    """1..n over ``(order_col, tiebreak)`` without a single-partition
    window. Rows are range-partitioned on the (unique) ordering key — a
    hot timestamp is split too — sorted inside each partition, numbered
    locally, and shifted by the cumulative count of the earlier
    partitions (a tiny table). The numbered rows are checkpointed first so
    both branches see one partitioning."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = (df.repartitionByRange(n, order_col, tiebreak).sortWithinPartitions(order_col, tiebreak)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_mid", F.monotonically_increasing_id()))
    local = cut_lineage(local.withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)))
    sizes = local.groupBy("_pid").agg(F.count("*").alias("_n"))
    from pyspark.sql import Window
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_pid", "_off")
    # one row a partition: at most n rows, so the broadcast is bounded by the partition count
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn("running_count", (F.col("_off") + F.col("_pos") + 1).cast("bigint"))
            .drop("_pid", "_mid", "_pos", "_off"))
