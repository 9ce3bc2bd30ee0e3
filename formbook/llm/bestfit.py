"""Bounded-space online best-fit packing.

A task packs its share of the pieces as they come, some thousand ahead at a
time and those longest first. It holds at most
``open_bins`` open bins; a bitset keyed by free space finds the fullest bin
that still takes the piece in one shift, and when a new bin is needed beyond
the limit the fullest open one closes. Lengths travel, ids do not: a row is
a few dozen bytes, shares are made by hash and merged by adaptive execution
up to its advisory size, so a share is some million pieces and its last open
bins cost nothing that counts.

Defined results: a null or empty text is one piece, the end id alone; a
document longer than ``capacity`` is cut into full pieces and a rest; an
empty table gives no rows; repeated rows are packed each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.llm.common import chunks, record_batch, release, utf8
from formbook.llm.tokens import CACHE_WORDS, Encoder, default_tokenizer

CAPACITY = 4096
END_ID = 1


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID,
           cache_words: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids."""
    path = tokenizer or default_tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def make(batches):
        release()
        encoder = Encoder.of(path, cache_words)
        for chunk in chunks(batches, limit=1 << 20):
            data, offsets = utf8(chunk.column("text"))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            out = []
            for doc_id, ids in zip(chunk.column("doc_id").to_pylist(), encoder.encode(texts)):
                wide = np.append(np.frombuffer(ids, encoder.dtype), encoder.dtype(end_id)).astype("<u4").tobytes()
                for k, at in enumerate(range(0, len(wide), 4 * capacity)):
                    part = wide[at:at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield record_batch(schema, list(zip(*out)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        make, "doc_id long, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """At most ``limit`` open bins by free space."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free = 0  # bit f: a bin with f free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        found = self.bins[space].pop()
        if not self.bins[space]:
            self.free ^= 1 << space
        self.open -= 1
        return found

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fit = self.free >> length
        if fit:
            space = length + (fit & -fit).bit_length() - 1
            found = self._take(space)
        else:
            space, found = self.capacity, self.made
            self.made += 1
            if self.open == self.limit and length < self.capacity:
                self._take((self.free & -self.free).bit_length() - 1)
        rest = space - length
        if rest:
            if not self.bins[rest]:
                self.free |= 1 << rest
            self.bins[rest].append(found)
            self.open += 1
        return found, self.capacity - space


def pack(table: DataFrame, capacity: int = CAPACITY, open_bins: int = 4096, ahead: int = 8192) -> DataFrame:
    """``table`` (with a ``length`` of 1 to ``capacity``) plus sequence_id
    and offset. Each ``ahead`` pieces enter longest first."""
    def place(batches):
        bins = OpenBins(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        held, count = [], 0

        def flush():
            block = pa.Table.from_batches(held).combine_chunks()
            lengths = block.column("length").to_pylist()
            got = [(0, 0)] * len(lengths)
            for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
                got[i] = bins.put(lengths[i])
            block = (block.append_column("sequence_id", pa.array([base + b for b, _ in got], pa.int64()))
                     .append_column("offset", pa.array([o for _, o in got], pa.int64())))
            return block.to_batches()

        for batch in batches:
            for at in range(0, batch.num_rows, ahead):
                part = batch.slice(at, ahead)
                held.append(part)
                count += part.num_rows
                if count >= ahead:
                    yield from flush()
                    held, count = [], 0
        if held:
            yield from flush()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return table.repartition(*table.columns).mapInArrow(place, f"{schema}, sequence_id long, offset long")


def digest(docs: DataFrame, tokenizer: str | None = None, cache_words: int = CACHE_WORDS) -> DataFrame:
    return pack(pieces(docs, tokenizer=tokenizer, cache_words=cache_words))
