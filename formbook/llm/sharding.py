"""Shards of near equal bytes by histogram sort.

Documents are ordered by (hash of text, doc_id), so equal texts stand
together. Splitters are found by counting: each round asks, for some hundred
candidate boundaries, how many bytes and rows lie below and which keys lie
next to them, exactly and over all partitions; only one row a boundary comes
back. The next round probes between the neighbours, at first between hashes
only, so a splitter keeps equal texts together wherever one lies within the
tolerance; where a group of copies is too large for that, it is split by
doc_id. When every splitter is within the tolerance (or no key is left
between its neighbours), each row moves once, to its place in the order;
boundaries already counted cut a shard into parts, so that no task sorts
more than a part, and their counts number the rows without a gap.

Defined results: a null text has no bytes and the CRC of the empty string;
null doc_ids come first; equal rows take places next to each other; an empty
table gives no rows; columns of the same names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.llm.common import stage

PROBES = 512
PARTS = 8
BIAS = np.uint64(1 << 63)
HASH = 72  # a key: 64 bits of hash, 1 byte for a doc_id that is not null, 64 bits of doc_id
TOP = 1 << (HASH + 64)


def _keys(hashes: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys as 17-byte strings in order, and that order."""
    h = np.asarray(hashes).view(np.uint64) ^ BIAS
    known = ~np.asarray(ids.is_null())
    d = np.where(known, np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64) ^ BIAS, np.uint64(0))
    order = np.lexsort((d, known, h))
    raw = np.empty((len(h), 17), np.uint8)
    raw[:, :8] = h[order].astype(">u8").view(np.uint8).reshape(-1, 8)
    raw[:, 8] = known[order]
    raw[:, 9:] = d[order].astype(">u8").view(np.uint8).reshape(-1, 8)
    return raw.reshape(-1).view("S17"), order


def _strings(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(17, "big") for k in keys], "S17")


def _count(keys: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(bucket, bytes, rows, least key, greatest key) of the rows between
    consecutive probes; bucket 0 is below the first."""
    marks = _strings(probes)

    def histogram(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ranked, order = _keys(batch.column("_hash"), batch.column("doc_id"))
            below = np.concatenate([[0], np.cumsum(np.asarray(batch.column("size"))[order])])
            cuts = np.concatenate([[0], np.searchsorted(ranked, marks), [len(ranked)]])
            use = np.flatnonzero(cuts[1:] > cuts[:-1])
            a, b = cuts[use], cuts[use + 1]
            ends = [ranked[x].ljust(17, b"\0") for x in a], [ranked[x - 1].ljust(17, b"\0") for x in b]
            yield pa.RecordBatch.from_arrays(
                [pa.array(use, pa.int32()), pa.array(below[b] - below[a], pa.int64()), pa.array(b - a, pa.int64()),
                 pa.array(ends[0], pa.binary()), pa.array(ends[1], pa.binary())],
                ["bucket", "bytes", "rows", "least", "most"])

    got = (keys.select("_hash", "doc_id", "size")
           .mapInArrow(histogram, "bucket int, bytes long, rows long, least binary, most binary")
           .groupBy("bucket").agg(F.sum("bytes"), F.sum("rows"), F.min("least"), F.max("most")).collect())
    return sorted((r[0], r[1], r[2], int.from_bytes(r[3], "big"), int.from_bytes(r[4], "big")) for r in got)


def splitters(keys: DataFrame, shards: int, tolerance: float) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Key of each shard's first place (but the first shard's), and all
    counted boundaries as (key, bytes below, rows below)."""
    counted: dict[int, tuple[int, int]] = {0: (0, 0)}
    total = None
    found: dict[int, int] = {}
    # the open range of each splitter: keys at or above the first and at or below the second are in it
    ranges = {s: (0, TOP - 1) for s in range(1, shards)}
    while ranges or total is None:
        each = max(1, PROBES // max(1, len(set(ranges.values()))))
        probes: set[int] = set()
        for lo, hi in set(ranges.values()):
            grain = 1 << HASH if lo >> HASH != hi >> HASH else 1
            first, last = lo // grain + 1, hi // grain
            n = min(each, last - first + 1)
            probes |= {(first + (last - first) * i // max(1, n - 1 if n > 1 else 1)) * grain for i in range(n)}
            probes |= {hi + 1} if hi + 1 < TOP else set()
        marks = sorted(probes)
        buckets = {b[0]: b[1:] for b in _count(keys, marks)}
        size = rows = 0
        spans = []  # (bytes below, bytes up to the end, least, most) of filled buckets
        for i in range(len(marks) + 1):
            if i:
                counted[marks[i - 1]] = (size, rows)
            if i in buckets:
                b, r, least, most = buckets[i]
                counted.setdefault(least, (size, rows))
                spans.append((size, size + b, least, most))
                size, rows = size + b, rows + r
        total = size
        if not total:
            break
        counted[TOP - 1 + 1] = (size, rows)
        slack = tolerance * total / shards
        for s in list(ranges):
            goal = total * s / shards
            at = next((x for x in spans if x[0] <= goal < x[1]), spans[-1])
            below, upto, least, most = at
            after = next((x[2] for x in spans if x[0] >= upto and x[2] > most), TOP)
            near = min(((least, below), (after, upto)), key=lambda x: abs(x[1] - goal))
            if abs(near[1] - goal) <= slack or least == most:
                found[s] = near[0]
                del ranges[s]
            else:
                ranges[s] = (least, most)
    cuts = sorted((k, *v) for k, v in counted.items())
    return [found.get(s, TOP) for s in range(1, shards)], cuts


def _places(first: list[int], cuts: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(key, shard, rows of the shard below) of each part of a shard."""
    total = max(c[1] for c in cuts)
    known = {k: (b, r) for k, b, r in cuts}
    starts = [0, *first]
    out = []
    for s, a in enumerate(starts):
        b = starts[s + 1] if s + 1 < shards else TOP
        if a >= b:
            continue
        base, done = known[a][1], known[a][0]
        out.append((a, s, 0))
        for k, size, rows in cuts:
            if a < k < b and size - done >= total / shards / PARTS:
                out.append((k, s, rows - base))
                done = size
    return out


def shard(rows: DataFrame, shards: int, tolerance: float = 0.005) -> DataFrame:
    """``rows`` (with ``doc_id``, ``size`` and the text's ``_hash``) plus
    shard and slot, the gapless place in the shard."""
    rows = rows.drop("shard", "slot")
    keys = stage(rows.select("doc_id", "size", "_hash"), "shard-keys")
    first, cuts = splitters(keys, shards, tolerance)
    places = _places(first, cuts, shards)
    marks = _strings([k for k, _, _ in places])
    number = np.array([s for _, s, _ in places], np.int32)
    base = np.array([b for _, _, b in places], np.int64)

    def assign(batches):
        for batch in batches:
            ranked, order = _keys(batch.column("_hash"), batch.column("doc_id"))
            part = np.empty(len(order), np.int64)
            part[order] = np.searchsorted(marks, ranked, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(part, pa.int32()), pa.array(number[part]), pa.array(base[part])],
                [*batch.schema.names, "_place", "shard", "_base"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.mapInArrow(assign, f"{schema}, _place int, shard int, _base long")
    order = Window.partitionBy("_place").orderBy("_hash", "doc_id")
    return (placed.withColumn("slot", F.col("_base") + F.row_number().over(order) - 1)
            .drop("_place", "_base", "_hash"))


def measures(text: Column, overhead: int = 16) -> dict[str, Column]:
    whole = F.coalesce(text, F.lit(""))
    return {"size": (F.octet_length(whole) + overhead).cast("long"), "text_crc32": F.crc32(whole.cast("binary")),
            "_hash": F.xxhash64(whole)}


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Whole documents with size, text_crc32, shard and slot."""
    rows = docs.withColumns({**measures(F.col("text")), "doc_id": F.col("doc_id").cast("long")})
    return shard(rows, shards)


def digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       *[c.alias(n) for n, c in measures(F.col("text")).items()])
    out = shard(stage(rows, "shard-rows"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
