"""The triggered index refresh: pruned reads, sparse vectors, idempotence."""

import math
from collections import Counter

from formbook.streaming import index


def vector(text):
    tf = Counter((text or "").lower().split())
    norm = math.sqrt(sum(n * n for n in tf.values()))
    return [(t, math.floor(1_000_000 * n / norm)) for t, n in sorted(tf.items())]


def test_refresh_adds_each_article_once(spark, tmp_dir):
    texts = {f"a{i}": " ".join(f"w{j % (i + 2)}" for j in range(i * 3)) for i in range(30)} | {"none": None, "blank": " "}
    schema = "article_id string, player_key string, url string, content string"

    def land(ids, k):
        rows = [(i, "p", f"u{i}", texts[i]) for i in ids] + [(None, "p", "u", "no key")]
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_dir}/in/arrival={k}")

    kind = spark.createDataFrame([], schema).schema
    args = dict(source=f"{tmp_dir}/in", schema=kind, index_path=f"{tmp_dir}/index", checkpoint=f"{tmp_dir}/c", buckets=8)
    ids = list(texts)
    for k, part in enumerate((ids[:12], ids[:20], ids, ids)):
        land(part, k)
        index.refresh_index(spark, **args)
        index.refresh_index(spark, **args)
        got = {r.article_id: r.vector for r in spark.read.parquet(f"{tmp_dir}/index").collect()}
        assert spark.read.parquet(f"{tmp_dir}/index").count() == len(got) == len(set(part))
    assert {i: [tuple(x) for x in v or []] for i, v in got.items()} == {i: vector(t) for i, t in texts.items()}


def test_a_batch_reads_touched_buckets_only(spark, tmp_dir):
    rows = spark.range(200).selectExpr("concat('k', id) AS article_id").withColumn("bucket", index.bucket_of("article_id", 16))
    rows.write.partitionBy("bucket").parquet(f"{tmp_dir}/index")
    batch = rows.where("bucket = 3").unionByName(spark.createDataFrame([("new", 5)], "article_id string, bucket int"))
    out = index.unknown(batch, f"{tmp_dir}/index", "article_id")
    assert [r.article_id for r in out.collect()] == ["new"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "ReadSchema: struct<article_id:string>" in plan
