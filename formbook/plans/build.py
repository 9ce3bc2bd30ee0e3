"""The full batch build — enriched balls and innings facts (written
once, partitioned by competition) -> every KPI table -> both profiles,
each written as Parquet under ``out_dir`` with its row count observed
during the write (no recount).

The KPI tables and profiles depend only on the written facts, so their
writes are submitted as concurrent Spark jobs (a driver thread per job);
small jobs then share the executors instead of queueing one by one.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from formbook.plans.gold import Gold
from formbook.sources.tables import write_counted

KPI_TABLES = (
    "bat_career", "bowl_career", "bat_t20", "bowl_t20", "bat_recent", "bowl_recent", "bat_venue",
    "bowl_venue", "bat_phase", "bowl_phase", "bat_sit", "bowl_sit", "allrounders",
)


def build_gold(spark: SparkSession, sf_dir: str, out_dir: str, parallel_jobs: int = 8) -> dict[str, int]:
    g = Gold(spark, sf_dir)
    out = out_dir.rstrip("/")
    g.materialize(out)  # enriched balls + innings facts, re-read from Parquet
    names = list(KPI_TABLES) + ["batter_profile", "bowler_profile"]
    plans = {name: getattr(g, name) for name in names}  # built on the driver thread
    with ThreadPoolExecutor(max_workers=max(1, parallel_jobs)) as pool:
        futures = {name: pool.submit(write_counted, df, f"{out}/{name}") for name, df in plans.items()}
        return {name: f.result() for name, f in futures.items()}
