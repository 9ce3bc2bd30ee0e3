"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors x become integers floor(64 x). Equal vectors are one candidate with
their k + 1 smallest ids, all that a top k can use. Candidates and queries
are grouped by their nearest pivot (Voronoi cells), and a cell's summary is
its row count and radius. For a query q and a cell with pivot p and radius r

    q.p - |q| r  <=  q.x  <=  q.p + |q| r        for every x of the cell,

so the cells with the best lower bounds that together hold k + 1 rows give a
score t(q) that the answers reach at least. Query groups keep, for each
cell, the largest q.p - t(q) and |q|; a candidate at distance d from its
pivot goes only to the groups where q.p + |q| d can reach t. Each group then
meets the candidates it was sent in blocks, keeps k + 1 a query and block,
and the blocks' rows are ranked by (score, id).

Queries and candidates meet in blocks of bounded size; pivots are a bounded
sample and only steer the pruning. Defined results: null ids, null vectors
and vectors with null or non-finite components take no part; shorter
vectors count as filled with zeros; equal rows are a row each, and a query
skips one row, its own; scores are ranked as whole numbers of any size, and
one beyond 64 bits is shown as the nearest long; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formbook.llm.common import record_batch, stage

PIVOTS = 64
GROUP_QUERIES = 1024
BLOCK = 16_384
EXACT = float(1 << 53)


def encode(v: np.ndarray) -> bytes:
    """Integers as bytes, one form for equal vectors: trailing zeros go."""
    v = np.trim_zeros(v, "b")
    if not len(v) or np.abs(v).max() < 1 << 31:
        return b"i" + v.astype("<i4").tobytes()
    return b"f" + (v + 0.0).astype("<f8").tobytes()


def matrix(vectors: list[bytes], dims: int | None = None) -> np.ndarray:
    parts = [np.frombuffer(v, "<i4" if v[:1] == b"i" else "<f8", offset=1) for v in vectors]
    out = np.zeros((len(parts), dims or max([1, *map(len, parts)])))
    for row, part in zip(out, parts):
        row[:len(part)] = part[:out.shape[1]]
    return out


def products(a: np.ndarray, b: np.ndarray, whole_numbers: bool = False) -> np.ndarray:
    """Exact integer inner products, kept within 64 bits or, as
    ``whole_numbers``, of any size."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a) @ whole(b).T
    return exact if whole_numbers else np.vectorize(as_long, otypes=[np.int64])(exact)


def order_key(score: int) -> bytes:
    """Bytes that sort as the integers do, of any size."""
    size = abs(score).to_bytes((score.bit_length() + 7) // 8, "big")
    body = len(size).to_bytes(2, "big") + size
    return b"\1" + body if score >= 0 else b"\0" + bytes(255 - x for x in body)


def as_long(score: int) -> int:
    return max(-(1 << 63), min(score, (1 << 63) - 1))


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("v", pa.binary())])

    def make(batches):
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column("id").to_pylist(), batch.column("x").to_pylist()):
                if i is None or x is None or None in x:
                    continue
                y = np.floor(scale * np.array(x, np.float64))
                if np.isfinite(y).all():
                    ids.append(i)
                    out.append(encode(y))
            yield record_batch(schema, [ids, out])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x")).mapInArrow(
        make, "id long, v binary")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each row
    whose id is divisible by ``every``."""
    rows = stage(quantised(vectors, id_col, vec_col, scale), "vectors")
    asked = rows.where(F.col("id") % every == 0)
    need = k + 1
    least = Window.partitionBy("v").orderBy("id")
    known = stage(rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= need)
                  .groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "candidates")
    pivots = [bytes(r[0]) for r in known.orderBy(F.xxhash64("v"), "v").select("v").limit(PIVOTS).collect()]
    if not pivots:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"),
                           F.lit(0).cast("long").alias("score")).where("false")
    centres = matrix(pivots)

    def cells(vs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = matrix(vs)
        wide = max(x.shape[1], centres.shape[1])
        p = np.pad(centres, ((0, 0), (0, wide - centres.shape[1])))
        x = np.pad(x, ((0, 0), (0, wide - x.shape[1])))
        far = np.array([np.sqrt(((p - row) ** 2).sum(axis=1)) for row in x])
        cell = far.argmin(axis=1)
        return cell, far[np.arange(len(x)), cell], x @ p.T

    def in_cells(batches):
        for batch in batches:
            if batch.num_rows:
                cell, far, _ = cells(batch.column("v").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int32()), pa.array(far, pa.float64())],
                    [*batch.schema.names, "cell", "far"])

    known = stage(known.mapInArrow(in_cells, "v binary, ids array<long>, cell int, far double"), "cells")
    summary = known.groupBy("cell").agg(F.sum(F.size("ids")), F.max("far"), F.count("*")).collect()  # a row a pivot
    held, radius = np.zeros(len(pivots)), np.zeros(len(pivots))
    for c, n, far, _ in summary:
        held[c], radius[c] = n, far
    blocks = -(-sum(r[3] for r in summary) // BLOCK)

    queries = stage(asked.select("v").distinct().mapInArrow(in_cells, "v binary, cell int, far double"), "queries")
    # small cells share a query group, large ones are dealt over several
    groups, base, load = {}, 0, 0
    for c, n in sorted(queries.groupBy("cell").count().collect()):
        if load and load + n > GROUP_QUERIES:
            base, load = base + 1, 0
        parts = -(-n // GROUP_QUERIES)
        groups[c] = (base, parts)
        base, load = (base + parts, 0) if parts > 1 else (base, load + n)
    deal = F.lit(0)
    for c, (b, parts) in groups.items():
        deal = F.when(F.col("cell") == c, F.lit(b) + F.pmod(F.xxhash64("v"), F.lit(parts))).otherwise(deal)
    queries = stage(queries.withColumn("grp", deal.cast("int")).select("v", "grp"), "groups")

    def bounds(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vs = batch.column("v").to_pylist()
            _, _, dots = cells(vs)
            norm = np.sqrt((matrix(vs) ** 2).sum(axis=1))
            low = dots - norm[:, None] * radius
            low[:, held == 0] = -np.inf
            order = np.argsort(-low, axis=1)
            enough = np.cumsum(held[order], axis=1) >= need
            at = np.where(enough.any(axis=1), enough.argmax(axis=1), -1)
            reach = np.where(at >= 0, low[np.arange(len(vs)), order[np.arange(len(vs)), at]], -np.inf)
            room = dots - reach[:, None] + 1e-9 * (1 + np.abs(dots) + norm[:, None] * radius.max())
            grp = np.asarray(batch.column("grp"))
            for g in np.unique(grp):
                mine = grp == g
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * len(pivots), pa.int32()), pa.array(np.arange(len(pivots)), pa.int32()),
                     pa.array(room[mine].max(axis=0), pa.float64()), pa.array([norm[mine].max()] * len(pivots), pa.float64())],
                    ["grp", "cell", "room", "norm"])

    bound = (queries.mapInArrow(bounds, "grp int, cell int, room double, norm double")
             .groupBy("grp", "cell").agg(F.max("room").alias("room"), F.max("norm").alias("norm")))
    sent = (known.join(bound, "cell").where(F.col("room") + F.col("norm") * F.col("far") * (1 + 1e-9) >= 0)
            .select("grp", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("block"), "v", "ids"))
    posed = queries.select("grp", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "v")
    answer = pa.schema([("v", pa.binary()), ("id", pa.int64()), ("score", pa.int64()), ("key", pa.binary()),
                        ("same", pa.bool_())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        qs, xs = left.column("v").to_pylist(), right.column("v").to_pylist()
        ids = right.column("ids").to_pylist()
        out_v, out_id, out_score, out_key, out_same = [], [], [], [], []
        if qs and xs:
            x = matrix(xs)
            for at in range(0, len(qs), 256):
                part = qs[at:at + 256]
                wide = max([x.shape[1], *[(len(v) - 1) // 4 for v in part]])
                q = matrix(part, wide)
                scores = products(q, np.pad(x, ((0, 0), (0, wide - x.shape[1]))), whole_numbers=True)
                for v, row in zip(part, scores):
                    if len(row) > need:
                        row_ids = np.flatnonzero(row >= np.partition(row, len(row) - need)[len(row) - need])
                    else:
                        row_ids = np.arange(len(row))
                    best = sorted((-int(row[j]), i, xs[j] == v) for j in row_ids.tolist() for i in ids[j])[:need]
                    out_v += [v] * len(best)
                    out_id += [b[1] for b in best]
                    out_score += [as_long(-b[0]) for b in best]
                    out_key += [order_key(-b[0]) for b in best]
                    out_same += [b[2] for b in best]
        return pa.table([out_v, out_id, out_score, out_key, out_same], schema=answer)

    met = (posed.groupBy("grp", "block").cogroup(sent.groupBy("grp", "block"))
           .applyInArrow(meet, "v binary, id long, score long, key binary, same boolean"))
    rank = Window.partitionBy("v").orderBy(F.desc("key"), "id", F.desc("same"))
    best = (met.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= need).groupBy("v")
            .agg(F.array_sort(F.collect_list(F.struct("n", "id", "score", "same"))).alias("best")))
    # a query's own row: the first with its id and vector
    own = F.array_min(F.transform(F.filter("best", lambda b: (b["id"] == F.col("query_id")) & b["same"]), lambda b: b["n"]))
    found = asked.select(F.col("id").alias("query_id"), "v").join(best, "v").withColumn("own", F.coalesce(own, F.lit(0)))
    others = F.slice(F.filter("best", lambda b: b["n"] != F.col("own")), 1, k)
    return (found.select("query_id", F.posexplode(others).alias("pos", "b"))
            .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score")))
