"""Documents in compressed bundles that send keys to buckets and get answers.

A *bundle* is one row: a number and a few MB of documents, compressed. In a
round every bundle sends each bucket one payload (unique keys of the whole
bundle, so a key held by a third of all documents still arrives once a
bundle), the bucket compares the payloads, and the answers come back to the
bundle by its number. Texts cross the network once; keys that all documents
share make no hot task.

Bundles are made inside the scan's tasks and written once by their users: all
rounds read the same numbers and contents, also after a lost executor and
for an input whose rows come in another order when it is read again.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.llm.common import chunks, record_batch, release, utf8

NULL_ID = np.iinfo(np.int64).max  # a null doc_id ranks above every other
BUCKET_BYTES = 48 << 20
BUNDLE_BYTES = 1 << 20

BUNDLE = pa.schema([("bid", pa.int64()), ("docs", pa.binary())])
SENT = pa.schema([("bucket", pa.int32()), ("bid", pa.int64()), ("payload", pa.binary())])
REPLY = pa.schema([("bid", pa.int64()), ("bucket", pa.int32()), ("reply", pa.binary())])


def pack(batch: pa.RecordBatch) -> bytes:
    data, offsets = utf8(batch.column("text"))
    rest = batch.select([c for c in batch.schema.names if c not in ("doc_id", "text")])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rest.schema) as out:
        out.write_batch(rest)
    ids = batch.column("doc_id")
    null = np.asarray(ids.is_null())
    ids = np.where(null, NULL_ID, np.asarray(ids.fill_null(0)).astype(np.int64))
    body = pickle.dumps((ids, null, offsets, data.tobytes(), sink.getvalue().to_pybytes()), protocol=5)
    return zstandard.ZstdCompressor(level=1).compress(body)


class Bundle:
    """``ids`` (null as NULL_ID), ``null`` flags, text ``offsets`` and
    ``data`` bytes, and the other columns carried along."""

    def __init__(self, blob: bytes):
        self.ids, self.null, self.offsets, data, self._rest = pickle.loads(
            zstandard.ZstdDecompressor().decompress(blob))
        self.data = np.frombuffer(data, np.uint8)

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.null)

    def carried(self) -> list[pa.Array]:
        return pa.ipc.open_stream(self._rest).read_all().combine_chunks().to_batches()[0].columns \
            if self._rest and len(self.ids) else []

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist())]


def bundles(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(bid, docs) rows of the ``doc_id``, ``text`` and ``carry`` columns of
    all documents."""
    def make(batches):
        part = TaskContext.get().partitionId()
        for k, chunk in enumerate(chunks(batches, limit=BUNDLE_BYTES)):
            yield record_batch(BUNDLE, [[(part << 32) | k], [pack(chunk)]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry).mapInArrow(make, "bid long, docs binary")


def by_bucket(keys: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """Slices of sorted 64-bit keys by bucket (equal ranges of the key space)."""
    step = (1 << 64) // n + 1
    edges = np.searchsorted(keys, np.array([step * i for i in range(1, n)], np.uint64))
    edges = [0, *edges.tolist(), len(keys)]
    return [(b, slice(edges[b], edges[b + 1])) for b in range(n) if edges[b] < edges[b + 1]]


def answers(table: DataFrame, emit: Callable, reduce: Callable, n: int, name: str) -> DataFrame:
    """One round. ``emit(row, n)`` yields (bucket, payload) of a bundle row;
    ``reduce(payloads)`` returns one answer a payload. Returns (bid, ``name``),
    ``name`` being the list of (bucket, reply) of the bundle."""
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                got = list(emit(row, n))
                if got:
                    yield record_batch(SENT, [[b for b, _ in got], [row["bid"]] * len(got), [p for _, p in got]])
        release()

    def merge(group: pa.Table) -> pa.Table:
        replies = pa.array(reduce(group.column("payload").to_pylist()), pa.binary())
        release()
        return pa.table([group.column("bid"), group.column("bucket"), replies], schema=REPLY)

    sent = table.mapInArrow(send, "bucket int, bid long, payload binary")
    back = sent.groupBy("bucket").applyInArrow(merge, "bid long, bucket int, reply binary")
    return back.groupBy("bid").agg(F.collect_list(F.struct("bucket", "reply")).alias(name))


def flags(row: dict, name: str, slices: list[tuple[int, slice]], n: int) -> np.ndarray:
    """The answers of one round as a boolean a sent key, in sent order."""
    out = np.zeros(n, bool)
    replies = {x["bucket"]: x["reply"] for x in row.get(name) or ()}
    for b, part in slices:
        size = part.stop - part.start
        out[part] = np.unpackbits(np.frombuffer(replies[b], np.uint8), count=size).astype(bool)
    return out


def bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def seen_elsewhere(payloads: list[bytes]) -> list[bytes]:
    """For sorted unique keys of each bundle, followed by one flag bit a key
    (already repeated inside the bundle): a bit a key, set if the key is
    repeated anywhere."""
    keys, local, sizes = [], [], []
    for p in payloads:
        size = int.from_bytes(p[:4], "little")
        keys.append(np.frombuffer(p, np.uint64, size, 4))
        local.append(np.unpackbits(np.frombuffer(p, np.uint8, offset=4 + 8 * size), count=size).astype(bool))
        sizes.append(size)
    all_keys, all_local = np.concatenate(keys), np.concatenate(local)
    order = np.argsort(all_keys, kind="stable")
    ranked = all_keys[order]
    same = np.zeros(len(ranked), bool)
    if len(ranked):
        equal = ranked[1:] == ranked[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    out = np.empty(len(ranked), bool)
    out[order] = same
    out |= all_local
    ends = np.cumsum([0, *sizes])
    return [bits(out[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def send_keys(keys: np.ndarray, local: np.ndarray, n: int):
    """Payloads of :func:`seen_elsewhere` for sorted unique ``keys``."""
    for b, part in by_bucket(keys, n):
        mine = keys[part]
        yield b, len(mine).to_bytes(4, "little") + mine.tobytes() + bits(local[part])
