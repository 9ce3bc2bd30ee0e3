"""Helpers shared by the operators: staging, sizes and Arrow text buffers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formbook.session import checkpoint_dir

#: ASCII white space, as the contracts define it: words are [^\x20\x09-\x0D]+
SPACES = b" \t\n\x0b\x0c\r"
CHUNK_BYTES = 4 << 20

ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts
    the lineage in a way that outlives any executor."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def set_aside(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with every column but ``own`` under a reserved name, so that
    none can clash with what an operator adds or needs quoting; and a
    function that gives a result the columns of ``docs`` back."""
    names = [c if c in own else f"_column_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda out: out.select(*names).toDF(*docs.columns)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, col: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(col))).first()[0] or 0)


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its offsets (null: empty), without
    making Python objects."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system, so that a reused worker holds
    no more between tasks than it needs (where the C library can)."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
    pa.default_memory_pool().release_unused()


def chunks(batches: Iterator[pa.RecordBatch], col: str = "text",
           limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` text bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and document index of every word of the texts."""
    word = (data != 32) & ((data < 9) | (data > 13))
    n = len(data)
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = word[:-1]
        after[-1] = False
        after[:-1] = word[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before[cuts] = False
        after[cuts - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hash (mod 2^64, random table per symbol) of any slice of a
    symbol array in O(1) by prefix sums."""

    _base = np.uint64(0xD1342543DE82EF95)
    _inverse = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
    _table = np.random.default_rng(42).integers(0, 1 << 64, 256, dtype=np.uint64)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        values = self._table[symbols] if symbols.dtype == np.uint8 else mix64(symbols.astype(np.uint64) + ODD)
        powers = np.full(n, self._base, np.uint64)
        self.back = np.full(n + 1, self._inverse, np.uint64)
        if n:
            powers[0] = 1
        self.back[0] = 1
        np.cumprod(powers, out=powers)
        np.cumprod(self.back, out=self.back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers, out=self.sums[1:])

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all slices of length ``k``."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self.sums[k:] - self.sums[:n]) * self.back[:n])


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, in log2(w) passes."""
    if len(values) < w:
        return values[:0]
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type)
                                       for c, t in zip(columns, schema)], schema=schema)


def ranged(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` written in globally sorted ranges, ``_part`` being the range."""
    return stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)


#: A key with more than one part in so many of all rows is hot: there are fewer hot keys than this, whatever the data.
HOT_SHARES = 1000


def join_hot(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``facts`` (one row a key) where one key may hold
    any share of the rows. A hot key is dealt over as many parts as it holds
    shares, its row of facts repeated for each; the hot keys, fewer than
    ``HOT_SHARES``, are listed and sent to all tasks, and their parts are at
    most twice as many. ``rows`` is read twice; null keys meet nothing."""
    total = rows.count()
    parts = F.least(F.col("count"), F.ceil(F.col("count") * HOT_SHARES / max(1, total))).cast("int")
    counts = rows.groupBy(key).count().where(F.col(key).isNotNull() & (F.col("count") * HOT_SHARES > total))
    hot = counts.select(key, parts.alias("_parts"))
    hot = F.broadcast(rows.sparkSession.createDataFrame(hot.collect(), hot.schema))
    count = F.coalesce("_parts", F.lit(1))
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).join(hot, key, "left")
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("_row"), count).cast("int")).drop("_row", "_parts")
    spread = facts.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), count - 1))).drop("_parts")
    return dealt.join(spread, [key, "_part"]).drop("_part")


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str, name: str) -> DataFrame:
    """``df`` plus the running sum of ``value`` in ``order`` within ``group``,
    the row included. Ranges are summed first and their offsets added, so no
    task holds more than a range, however large the group. Null groups are a
    group; rows equal in ``order`` count one after the other."""
    part = ranged(df, [*group, *order], name)
    sums = part.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*[F.col(g) for g in group]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", *group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    sums = sums.select([F.col(c).alias(f"_r_{c}") for c in ("_part", *group)] + ["_before"])
    on = F.lit(True)
    for c in ("_part", *group):
        on = on & part[c].eqNullSafe(sums[f"_r_{c}"])
    here = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (part.join(sums, on).withColumn(out, F.sum(value).over(here) + F.col("_before"))
            .drop("_part", "_before", *[f"_r_{c}" for c in ("_part", *group)]))
