"""Set-based text matching without cross joins.

* ``top_k`` — k rows per group in two stages (salted, then merged), so a
  hot group is split over many tasks before its last k are picked.
* ``substring_join`` — exact "pattern is a substring of text" join by a
  multi-pattern automaton (Aho-Corasick). Patterns and texts are dealt into
  blocks of bounded bytes by a hash; each pair of blocks meets in one task,
  which builds the automaton of the patterns and runs it along each text
  once. No key is a gram or a word, so a part that all patterns share makes
  no hot task; what a task holds is bounded, and the work is texts x pattern
  blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def top_k(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str], k: int,
          salt_buckets: int = 16, rank_col: str | None = None) -> DataFrame:
    """Keep the first ``k`` rows of every group by ``order_cols``.

    Stage 1 ranks inside (group, salt) so a hot group is spread over
    ``salt_buckets`` tasks; stage 2 ranks at most ``k * salt_buckets``
    survivors per group.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order_cols]
    salted = df.withColumn("_salt", F.abs(F.xxhash64(*df.columns)) % salt_buckets)
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    out = stage1.withColumn("_rk", F.row_number().over(w2)).where(F.col("_rk") <= k).drop("_salt", "_r1")
    return out.withColumnRenamed("_rk", rank_col) if rank_col else out.drop("_rk")


def substring_join(patterns: DataFrame, pattern_col: str, pattern_ids: Sequence[str],
                   texts: DataFrame, text_col: str, text_ids: Sequence[str], *, first: int | None = None,
                   pattern_bytes: int = 1 << 20, text_bytes: int = 8 << 20) -> DataFrame:
    """Pairs (pattern ids, text ids) where lower(pattern) is a substring of
    lower(text); empty and null patterns match nothing. With ``first`` at
    least the first so many texts of each pattern come, in the order of text
    and ids, and at most so many from each block of texts."""
    p = (patterns.select(*pattern_ids, F.lower(F.col(pattern_col)).alias("_pat")).where(F.length("_pat") > 0))
    t = (texts.select(*text_ids, F.col(text_col).alias("_raw"), F.lower(F.col(text_col)).alias("_txt"))
         .where(F.length("_txt") > 0))

    def blocks(df: DataFrame, col: str, size: int) -> Column:
        return df.agg(F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length(col)) / size)).cast("int").alias("n")).scalar()

    np_, nt = blocks(p, "_pat", pattern_bytes), blocks(t, "_txt", text_bytes)
    left = (p.withColumn("_pb", F.pmod(F.xxhash64(*pattern_ids, "_pat"), np_).cast("int"))
            .withColumn("_tb", F.explode(F.sequence(F.lit(0), nt - 1))))
    right = (t.withColumn("_tb", F.pmod(F.xxhash64(*text_ids, "_raw"), nt).cast("int"))
             .withColumn("_pb", F.explode(F.sequence(F.lit(0), np_ - 1))))
    schema = StructType([patterns.schema[c] for c in pattern_ids] + [texts.schema[c] for c in text_ids])
    order = [("_raw", "ascending"), *[(c, "ascending") for c in text_ids]]

    def meet(asked: pa.Table, searched: pa.Table) -> pa.Table:
        rows_of: dict[str, list[int]] = {}
        for i, pattern in enumerate(asked.column("_pat").to_pylist()):
            rows_of.setdefault(pattern, []).append(i)
        if first:
            searched = searched.sort_by(order)
        hits: list[tuple[str, int]] = []
        if rows_of:
            automaton = ahocorasick.Automaton()
            for pattern in rows_of:
                automaton.add_word(pattern, pattern)
            automaton.make_automaton()
            count: Counter[str] = Counter()
            for j, text in enumerate(searched.column("_txt").to_pylist()):
                found = {pattern for _, pattern in automaton.iter(text)}
                if first:
                    found = {pattern for pattern in found if count[pattern] < first}
                    count.update(found)
                hits += [(pattern, j) for pattern in found]
        mine = np.array([i for pattern, _ in hits for i in rows_of[pattern]], np.int64)
        theirs = np.array([j for pattern, j in hits for _ in rows_of[pattern]], np.int64)
        return pa.Table.from_arrays(asked.select(list(pattern_ids)).take(mine).columns
                                    + searched.select(list(text_ids)).take(theirs).columns, names=schema.names)

    return left.groupBy("_pb", "_tb").cogroup(right.groupBy("_pb", "_tb")).applyInArrow(meet, schema)
