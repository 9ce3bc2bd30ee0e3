"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints: a bit is set if it is set in over half of the XXH64 hashes
(seed 42) of a text's word shingles. Linking: fingerprints that differ in at
most ``distance`` bits.

The index has two parts. Its upper nodes are *masked bit patterns* shared by
all fingerprints below: the 64 bits are cut into ``distance + 1`` parts, and
two linked fingerprints agree on one part at least, so each fingerprint
hangs under that many nodes (mask, pattern). A node over ``NODE_ROWS``
fingerprints is cut again, over the bits its mask leaves, until it fits: no
key is too hot and no pair is lost. Below a node the fingerprints stand in
Gray order, in runs of eight, runs of runs, and so on; each inner node keeps
the bits on which all below agree. Two inner nodes are compared on the bits
both have fixed: as one descends, more bits are fixed and the differences
accumulate, and beyond ``distance`` the two groups are dropped whole.

A task gives out a spanning forest of its links, and the components come
from those. Defined results: null and empty texts have fingerprint zero,
linked like any other; a component of null doc_ids only has a null
component_id; of each component ``one_of_each`` keeps one row, whatever
doc_ids are null or repeated; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.llm.common import chunks, join_hot, record_batch, set_aside, stage, utf8, width
from formbook.llm.components import components

NODE_ROWS = 4096
FAN = 8
SLICE = 16_384


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[:len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:].tolist())], np.uint64)
    votes = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long) of every document, and its string columns ``carry``."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), *[(c, pa.string()) for c in carry]])

    def make(batches):
        for chunk in chunks(batches):
            data, offsets = utf8(chunk.column("text"))
            raw = data.tobytes()
            fps = [fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield record_batch(schema, [chunk.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64)),
                                        *[chunk.column(c) for c in carry]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry).mapInArrow(
        make, ", ".join(["doc_id long", "fp long", *[f"{c} string" for c in carry]]))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cuts(mask: int, parts: int) -> list[int]:
    """``mask`` with each of ``parts`` even shares of the bits it leaves."""
    free = [b for b in range(64) if not mask >> b & 1]
    shares = [s for s in np.array_split(np.array(free, np.int64), parts) if len(s)]
    return [mask | sum(1 << int(b) for b in s) for s in shares]


def under_patterns(fps: DataFrame, distance: int) -> DataFrame:
    """(mask, pattern, fp): every fingerprint below its upper nodes, none of
    which has more than ``NODE_ROWS``."""
    spark, parts = fps.sparkSession, distance + 1

    def hang(table, masks):
        """Rows of ``table`` under every part of the mask they came from."""
        pairs = [(signed(m), signed(c)) for m in masks for c in cuts(m, parts)]
        below = spark.createDataFrame(pairs, "old long, mask long")  # a row for each way to cut: bounded by 64 bits
        return (table.join(F.broadcast(below), "old").select("fp", "mask")
                .withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask"))))

    done, keys = None, ["mask", "pattern"]
    first = F.explode(F.array(*[F.lit(signed(m)) for m in cuts(0, parts)])).alias("mask")
    nodes = fps.select("fp", first).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
    while True:
        hot = stage(nodes.groupBy(keys).count().where(F.col("count") > NODE_ROWS).select(keys), "hot")
        masks = [r[0] & (1 << 64) - 1 for r in hot.select("mask").distinct().collect()]
        if not masks:
            return nodes if done is None else done.unionByName(nodes)
        nodes = stage(nodes, "nodes")
        fit = nodes.join(hot, keys, "left_anti").select("fp", *keys)
        done = fit if done is None else done.unionByName(fit)
        # two cuts in different order can give one mask: each fingerprint once
        nodes = hang(nodes.join(hot, keys, "left_semi").select("fp", F.col("mask").alias("old")), masks).distinct()


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def linked(fps: np.ndarray, node: np.ndarray, distance: int) -> np.ndarray:
    """For fingerprints below upper nodes (``node`` numbers them): the index
    of each one's representative among those linked inside a node."""
    order = np.lexsort((gray_rank(fps), node))
    codes, node = fps[order], node[order]
    levels = [(codes, codes, node, None)]  # and of all below, or of all below, upper node, first child
    while len(levels[-1][2]) > 1 and (levels[-1][2][1:] == levels[-1][2][:-1]).any():
        every, some, up, _ = levels[-1]
        start = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
        within = np.arange(len(up)) - np.repeat(start, np.diff(np.append(start, len(up))))
        first = np.flatnonzero(within % FAN == 0)
        levels.append((np.bitwise_and.reduceat(every, first), np.bitwise_or.reduceat(some, first), up[first],
                       np.append(first, len(up))))
    label = np.arange(len(codes))
    roots = np.arange(len(levels[-1][2]))
    todo = [(len(levels) - 1, roots[i:i + SLICE], roots[i:i + SLICE]) for i in range(0, len(roots), SLICE)]
    step = np.arange(FAN)
    while todo:
        depth, a, b = todo.pop()
        if depth == 0:
            join(label, a, b)
            continue
        child = levels[depth][3]
        x = child[a][:, None] + step
        y = child[b][:, None] + step
        x, y = np.broadcast_arrays(x[:, :, None], y[:, None, :])
        real = ((x < child[a + 1][:, None, None]) & (y < child[b + 1][:, None, None])
                & ((a != b)[:, None, None] | (x < y if depth == 1 else x <= y)))
        x, y = x[real], y[real]
        every, some = levels[depth - 1][0], levels[depth - 1][1]
        # bits fixed on both sides that differ: all set here and none set there, or the reverse
        apart = (every[x] & ~some[y]) | (every[y] & ~some[x])
        near = np.bitwise_count(apart) <= distance
        x, y = x[near], y[near]
        todo += [(depth - 1, x[i:i + SLICE], y[i:i + SLICE]) for i in range(0, len(x), SLICE)]
    out = np.empty(len(label), np.int64)
    out[order] = order[label]
    return out


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the groups of ``a`` and ``b`` pairwise; labels are group minima."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def linked_codes(fps: DataFrame, distance: int) -> DataFrame:
    """(fp long, root long, component_id long) of every fingerprint, root
    being the component's least."""
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    n = max(width(fps.sparkSession), (distance + 1) * distinct.count() // 1_000_000)

    def link(group: pa.Table) -> pa.Table:
        codes = group.column("fp").to_numpy()
        _, node = np.unique(np.stack([group.column("mask").to_numpy(), group.column("pattern").to_numpy()], axis=1),
                            axis=0, return_inverse=True)
        to = linked(codes.view(np.uint64), node.reshape(-1), distance)
        tied = to != np.arange(len(to))
        return pa.table({"u": codes[tied], "v": codes[to[tied]]})

    nodes = under_patterns(distinct.select("fp"), distance)
    edges = (nodes.withColumn("bucket", F.pmod(F.xxhash64("mask", "pattern"), F.lit(n)))
             .groupBy("bucket").applyInArrow(link, "u long, v long"))
    root = components(edges)
    tied = root.join(distinct, root.node == distinct.fp).select("fp", "root", "least")
    named = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    far = tied.join(named, "root").select("fp", "root", "component_id")
    return (distinct.join(far, "fp", "left")
            .select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id")))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id long) of every document."""
    fps = stage(fingerprints(docs, shingle), "fingerprints")
    return join_hot(fps, linked_codes(fps, distance), "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                        "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row of each component: that of the smallest doc_id, nulls last, of
    those the one with the smallest hash of its text, then of the rest."""
    plain, back = set_aside(docs, "doc_id", "text")
    rest = [c for c in plain.columns if c != "text"]
    keyed = plain.withColumn("_key", F.concat_ws(  # the same in equal rows only
        "-", F.col("doc_id").cast("long").cast("string"), F.coalesce(F.sha2("text", 256), F.lit("")),
        F.hex(F.xxhash64(*rest, *map(F.isnull, rest)))))
    fps = stage(fingerprints(keyed, shingle, ("_key",)), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    first = fps.groupBy("fp").agg(F.min(row).alias("row"))  # copies meet in aggregates only
    keep = (first.join(linked_codes(fps, distance), "fp").groupBy("root").agg(F.min("row").alias("row"))
            .select("row._key"))
    return back(keyed.join(keep, "_key", "left_semi").dropDuplicates(["_key"]))
