"""Substring dedup by seed and extend.

*Seed*: every 13-word window holds one winnowed anchor, the least of its
6-word hashes, so two equal windows hold the same anchor at the same place.
Documents are joined on anchors; an anchor that only one document has
settles all its windows at once. *Extend*: around a shared anchor the match
is extended left and right to every window that holds it, each compared by
96 bits of two independent hashes; overlapping matched windows make up the
maximal repeats, all of them at least ``min_words`` long.

Both joins go through :mod:`formbook.llm.bundles`: a bundle sends each key
once with its smallest doc_id, so a passage that a third of all documents
share is compared bundle by bundle, never pair by pair.

Defined results: a null text has no words; a null doc_id ranks above all
others; of rows with one doc_id none is smaller than another; documents
under ``min_words`` words keep all; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.llm import bundles as B
from formbook.llm.common import Rolling, mix64, release, set_aside, sliding_min, stage, text_bytes, width, word_bounds

H2 = np.uint64(0xA5A5B4C3D2E1F00F)


class Windows:
    """The windows of a bundle and their anchors."""

    def __init__(self, row: dict, size: int):
        self.bundle = B.Bundle(row["docs"])
        self.size, k = size, max(1, size // 2)
        starts, ends, self.doc = word_bounds(self.bundle.data, self.bundle.offsets)
        self.words = Rolling(self.bundle.data).slices(starts, ends)
        least = sliding_min(Rolling(self.words).grams(k), size - k + 1)
        n = len(least)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[size - 1:size - 1 + n]) if n else np.zeros(0, np.int64)
        self.anchor = mix64(least[self.at])  # least hashes are small: spread them over the buckets
        # anchors by document, each once
        new = np.ones(len(self.at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[self.at[1:]] != self.doc[self.at[:-1]])
        keys, docs = self.anchor[new], self.doc[self.at[new]]
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        self.keys = keys[first]
        group = np.cumsum(first) - 1
        self.local = np.zeros(len(self.keys), bool)
        self.local[group[1:][~first[1:] & (docs[1:] != docs[:-1])]] = True

    def seeds(self, n: int):
        return B.send_keys(self.keys, self.local, n)

    def extend(self, row: dict, n: int) -> None:
        """Keep windows round shared anchors, equal ones once, with the
        smallest doc_id of the bundle that has them."""
        shared = B.flags(row, "seeds", B.by_bucket(self.keys, n), len(self.keys))
        self.at = self.at[shared[np.searchsorted(self.keys, self.anchor)]]
        h1 = Rolling(self.words).grams(self.size)[self.at]
        h2 = (Rolling(mix64(self.words ^ H2)).grams(self.size)[self.at] >> np.uint64(32)).astype(np.uint32)
        owner = self.bundle.ids[self.doc[self.at]]
        order = np.lexsort((owner, h2, h1))
        h1, h2, owner = h1[order], h2[order], owner[order]
        first = np.ones(len(order), bool)
        first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        self.h1, self.h2, self.least = h1[first], h2[first], owner[first]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(first) - 1

    def matches(self, n: int):
        pack = zstandard.ZstdCompressor(level=1).compress
        for b, part in B.by_bucket(self.h1, n):
            size = part.stop - part.start
            yield b, (size.to_bytes(4, "little") + self.h1[part].tobytes() + self.h2[part].tobytes()
                      + pack(self.least[part].tobytes()))

    def covered(self, row: dict, n: int) -> np.ndarray:
        """Which words lie in a window that a smaller doc_id also has."""
        smaller = B.flags(row, "matches", B.by_bucket(self.h1, n), len(self.h1))
        gone = smaller[self.entry] | (self.bundle.ids[self.doc[self.at]] > self.least[self.entry])
        at = self.at[gone]
        edge = np.zeros(len(self.words) + 1, np.int32)
        edge[at] += 1
        edge[at + self.size] -= 1
        return np.cumsum(edge[:-1]) > 0


def smaller_owner(payloads: list[bytes]) -> list[bytes]:
    """A bit for each sent window: some bundle has it with a smaller doc_id."""
    h1, h2, owner, sizes = [], [], [], []
    for p in payloads:
        size = int.from_bytes(p[:4], "little")
        h1.append(np.frombuffer(p, np.uint64, size, 4))
        h2.append(np.frombuffer(p, np.uint32, size, 4 + 8 * size))
        owner.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(p[4 + 12 * size:]), np.int64))
        sizes.append(size)
    h1, h2, owner = np.concatenate(h1), np.concatenate(h2), np.concatenate(owner)
    order = np.lexsort((owner, h2, h1))
    first = np.ones(len(order), bool)
    a, b = h1[order], h2[order]
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    ranked = owner[order]
    out = np.empty(len(order), bool)
    out[order] = ranked > ranked[first][np.cumsum(first) - 1]
    ends = np.cumsum([0, *sizes])
    return [B.bits(out[x:y]) for x, y in zip(ends[:-1], ends[1:])]


def runs(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def substring_dedup(docs: DataFrame, min_words: int = 13, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, text, removed, *carry): ``kept`` is
    the kept words joined by single blanks, ``text`` the same but for texts
    that keep all words, which stand as they are; ``removed`` lists spans of
    words. ``carry`` are columns of ``docs`` whose names are not among the
    first six."""
    spark = docs.sparkSession
    n = max(width(spark), text_bytes(docs) * 2 // B.BUCKET_BYTES)
    table = stage(B.bundles(docs, carry), "bundles")  # three rounds read them

    def seeds(row, n):
        return Windows(row, min_words).seeds(n)

    def matches(row, n):
        windows = Windows(row, min_words)
        windows.extend(row, n)
        return windows.matches(n)

    carried = [docs.schema[c] for c in carry]
    schema = ("doc_id long, n_words long, n_removed long, kept string, text string,"
              "removed array<struct<start:long,end:long>>" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in carried))

    def result(batches):
        for batch in batches:
            for row in batch.to_pylist():
                windows = Windows(row, min_words)
                windows.extend(row, n)
                gone, bundle = windows.covered(row, n), windows.bundle
                count = np.bincount(windows.doc, minlength=len(bundle.ids))
                removed = np.bincount(windows.doc[gone], minlength=len(bundle.ids))
                ends = np.cumsum(count)
                kept, text, spans = [], bundle.texts(), []
                for i, whole in enumerate(text):
                    words = whole.split()
                    if removed[i]:
                        mask = gone[ends[i] - count[i]:ends[i]]
                        text[i] = b" ".join(compress(words, (~mask).tolist()))
                        kept.append(text[i])
                        spans.append(runs(mask))
                    else:
                        kept.append(b" ".join(words))
                        spans.append([])
                cols = [bundle.id_column(), pa.array(count, pa.int64()), pa.array(removed, pa.int64()),
                        pa.array(kept, pa.binary()).cast(pa.string()), pa.array(text, pa.binary()).cast(pa.string()),
                        pa.array(spans, SPANS), *bundle.carried()]
                names = ["doc_id", "n_words", "n_removed", "kept", "text", "removed", *carry]
                yield pa.RecordBatch.from_arrays(cols, names)
        release()

    first = B.answers(table, seeds, B.seen_elsewhere, n, "seeds")
    joined = table.join(first, "bid", "left")
    second = B.answers(joined, matches, smaller_owner, n, "matches")
    return joined.join(second, "bid", "left").mapInArrow(result, schema)


def digest(docs: DataFrame) -> DataFrame:
    out = substring_dedup(docs)
    return out.select("doc_id", "n_words", "n_removed",
                      F.sha2("kept", 256).alias("kept_sha256"))


def clean(docs: DataFrame, min_words: int = 13) -> DataFrame:
    """The documents without passages that a smaller doc_id has too, with all
    their columns whatever these are called; where words go, ``n_chars``, if
    there is one, is that of the text left."""
    plain, back = set_aside(docs, "doc_id", "text", "n_chars")
    others = tuple(c for c in plain.columns if c not in ("doc_id", "text"))
    out = substring_dedup(plain, min_words, others)
    if "n_chars" in others:
        chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", chars.cast(plain.schema["n_chars"].dataType))
    return back(out)
