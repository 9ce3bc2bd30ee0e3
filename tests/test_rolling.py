"""Figures over the last rows of a key against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from formbook.operators import rolling


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
def test_last_rows_across_chunk_edges(spark, chunk):
    """A key with a third of all rows, a null key, chunks smaller than a frame."""
    rnd = random.Random(chunk)
    rows = [(rnd.choice(["hot", "a", "b", "c", None]) if i % 3 else "hot", i, rnd.choice([None, 1, 2, 5])) for i in range(400)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(5)
    out = rolling.last_rows(df, "k", "at", [2, 9], {"v": F.col("v"), "n": F.lit(1)}, chunk)
    got = {(r.k, r.at): (r.place, r.v_last_2, r.v_last_9, r.n_last_9) for r in out.collect()}
    assert out.count() == len(got) == 400
    for key in {k for k, _, _ in rows}:
        own = sorted((at, v) for k, at, v in rows if k == key)
        for i, (at, _) in enumerate(own):
            def total(n):
                values = [v for _, v in own[max(0, i - n + 1):i + 1] if v is not None]
                return sum(values) if values else None
            assert got[key, at] == (i + 1, total(2), total(9), min(i + 1, 9))


def test_empty(spark):
    none = spark.createDataFrame([], "k string, at long, v long")
    assert rolling.last_rows(none, "k", "at", [3], {"v": F.col("v")}).count() == 0
