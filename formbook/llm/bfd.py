"""Best-fit-decreasing packing into matrices of token ids.

Scan tasks tokenize and pack on the spot, without a shuffle: they gather
windows of ``window`` ids, take a window's pieces longest first, and put
each into the fullest sequence that still takes it, found in a segment tree
over free space. Only the last sequences of a window stay part empty.

A row is one sequence: ``ids`` (``capacity`` little-endian ids, uint16 for
vocabularies below 65,536, padded with ``pad_id``), ``length``,
``cu_seqlens`` (0, end of each segment), ``position_resets`` (offset of each
segment, where positions start over), and the doc_id, piece number and start
in its document of each segment. Documents longer than ``capacity`` are cut
into full pieces and a rest, so joining a document's pieces gives its ids
back.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.llm.bestfit import CAPACITY, END_ID
from formbook.llm.common import chunks, utf8
from formbook.llm.tokens import Encoder, default_tokenizer

SCHEMA = ("sequence_id long, length int, dtype string, ids binary, cu_seqlens array<int>, position_resets array<int>,"
          "doc_ids array<long>, pieces array<int>, starts array<long>")
ARROW = pa.schema([("sequence_id", pa.int64()), ("length", pa.int32()), ("dtype", pa.string()), ("ids", pa.binary()),
                   ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
                   ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64()))])


class FreeSpace:
    """Segment tree over free space: how many sequences have each amount."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, space: int, times: int) -> None:
        k = self.leaves + space
        while k:
            self.count[k] += times
            k //= 2

    def tightest(self, length: int) -> int | None:
        """The least free space >= ``length`` of any sequence."""
        k = self.leaves + length
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k //= 2
            if k == 1:
                return None
            k += 1
            while k < self.leaves:
                k *= 2
                if not self.count[k]:
                    k += 1
        return k - self.leaves


def best_fit_decreasing(lengths: Iterable[int], capacity: int) -> list[list[int]]:
    """Item numbers of each bin, in placing order."""
    lengths = list(lengths)
    tree, by_space = FreeSpace(capacity), [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        space = tree.tightest(lengths[i])
        if space is None:
            space, at = capacity, len(bins)
            bins.append([])
        else:
            at = by_space[space].pop()
            tree.add(space, -1)
        bins[at].append(i)
        rest = space - lengths[i]
        if rest:
            by_space[rest].append(at)
            tree.add(rest, 1)
    return bins


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID,
           pad_id: int = 0, window: int = 16 << 20) -> DataFrame:
    path = tokenizer or default_tokenizer()

    def rows(parts, encoder, base):
        out = []
        for k, members in enumerate(best_fit_decreasing([len(p[3]) for p in parts], capacity)):
            ends = np.cumsum([len(parts[i][3]) for i in members])
            ids = np.full(capacity, pad_id, encoder.dtype)
            ids[:ends[-1]] = np.concatenate([parts[i][3] for i in members])
            out.append((base + k, int(ends[-1]), np.dtype(encoder.dtype).name, ids.tobytes(), [0, *ends.tolist()],
                        [0, *ends[:-1].tolist()], [parts[i][0] for i in members], [parts[i][1] for i in members],
                        [parts[i][2] for i in members]))
        return out

    def make(batches):
        encoder, parts, held = Encoder.of(path), [], 0
        at = TaskContext.get().partitionId() << 40

        def flush():
            nonlocal parts, held, at
            out = rows(parts, encoder, at)
            at, parts, held = at + len(out), [], 0
            for k in range(0, len(out), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k:k + 512]), ARROW)], schema=ARROW)

        for chunk in chunks(batches, limit=1 << 20):
            data, offsets = utf8(chunk.column("text"))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            for doc_id, ids in zip(chunk.column("doc_id").to_pylist(), encoder.encode(texts)):
                ids = np.append(np.frombuffer(ids, encoder.dtype), encoder.dtype(end_id))
                parts += [(doc_id, k, s, ids[s:s + capacity]) for k, s in enumerate(range(0, len(ids), capacity))]
                held += len(ids)
            if held >= window:
                yield from flush()
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, SCHEMA)
