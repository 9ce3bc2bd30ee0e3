"""Triggered refresh of the article vector index.

An ``availableNow`` stream over the landed article files embeds each new
micro-batch with a stateless, deterministic text embedding: term frequencies
scaled to length one, in whole millionths, stored sparse (the terms a text
has, in order). The same text has the same vector in any batch.

The index is partitioned by a bucket of the key. A batch reads the keys of
the buckets it touches only, and of those the key column only, so its cost
follows the batch and not the index; known keys add nothing, so re-runs and
re-delivered files leave the index as it is. The number of buckets is fixed
when an index is first written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from formbook.operators.search import SCALE, term_counts
from formbook.streaming.sync import _path_exists

BUCKETS = 64


def sparse_vectors(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, vector): the terms of each text with their weights; texts without
    words have no row."""
    counts = term_counts(df, key, text_col)
    length = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("length"))
    weight = F.floor(F.lit(SCALE) * F.col("tf") / F.col("length")).cast("long").alias("weight")
    return (counts.join(length, "id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", weight))).alias("vector"))
            .withColumnRenamed("id", key))


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(buckets)).cast("int")


def unknown(batch: DataFrame, index_path: str, key: str) -> DataFrame:
    """The batch's rows whose key the index does not hold, from the buckets
    that the batch touches (at most as many as there are)."""
    spark = batch.sparkSession
    touched = [r[0] for r in batch.select("bucket").distinct().collect()]
    held = spark.read.parquet(index_path).where(F.col("bucket").isin(touched)).select("bucket", key)
    return batch.join(held, ["bucket", key], "left_anti")


def refresh_index(spark: SparkSession, source: str, schema: StructType, index_path: str, checkpoint: str,
                  key: str = "article_id", text_col: str = "content", keep: tuple[str, ...] = ("article_id", "player_key", "url"),
                  buckets: int = BUCKETS, max_files_per_trigger: int = 1000) -> None:
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)

    def apply_batch(batch: DataFrame, epoch_id: int) -> None:
        new = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("bucket", bucket_of(key, buckets)).persist()
        try:
            fresh = unknown(new, index_path, key) if _path_exists(spark, index_path) else new
            vectors = sparse_vectors(fresh, key, text_col)
            (fresh.select("bucket", *keep).join(vectors, key, "left").repartition("bucket")
             .write.mode("append").partitionBy("bucket").parquet(index_path))
        finally:
            new.unpersist()

    (stream.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
