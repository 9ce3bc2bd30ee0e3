"""Suffix dedup: a distributed merge sort of front-coded suffix runs.

A byte goes if a string of ``min_bytes`` bytes that covers it also starts
anywhere else. Sorting every suffix would move the corpus hundreds of times
over, so the array is sparse and exact: each window of ``min_bytes`` bytes
holds one sampled position, the (rightmost) least hash of its 32-byte
strings, and equal windows hold it at the same place. A sampled string seen
once settles its windows. For the others a bundle of documents sends

* the suffix from the sampled position to the end of its last window, and
* the bytes before it back to its first window,

as a sorted run, front-coded: the length shared with the string before, and
the rest. A bucket merges its runs with a loser tree that carries for each
loser the prefix it shares with the winner, so bytes known to be equal are
never compared again, and the merge yields the common-prefix lengths of
neighbours. Strings that share r bytes from the sampled position form
intervals of that array; inside an interval the longest common part before
the position, l, comes from sorting the reversed left parts. Wherever
l + r >= min_bytes the bytes [position - l, position + r) go. All decisions
compare bytes; hashes only choose positions.

Defined results: a null text is empty; empty and short texts keep all;
repeated rows count as further occurrences; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.llm import bundles as B
from formbook.llm.common import Rolling, mix64, release, sliding_min, stage, text_bytes, width

GRAM = 32


class Samples:
    """Sampled positions of a bundle: ``key`` (hash of the bytes there), ``at``
    and the first and last window start that each one answers for."""

    def __init__(self, row: dict, size: int):
        self.bundle, self.size = B.Bundle(row["docs"]), size
        k = min(GRAM, size)
        w = size - k + 1
        grams = Rolling(self.bundle.data).grams(k) | np.uint64(1)
        least = sliding_min(grams, w)
        offsets = self.bundle.offsets
        inside = np.zeros(len(least) + 1, np.int32)
        long = np.diff(offsets) >= size
        np.add.at(inside, offsets[:-1][long], 1)
        np.add.at(inside, offsets[1:][long] - size + 1, -1)
        valid = np.cumsum(inside[:-1]) > 0
        least = np.where(valid, least, np.uint64(0))
        # positions that are the least of some window
        rim = np.zeros(w - 1, np.uint64)
        highest = ~sliding_min(~np.concatenate([rim, least, rim]), w) if len(least) else least
        at = np.flatnonzero((grams == highest[:len(grams)]) & (highest[:len(grams)] > 0)) if len(least) else np.zeros(0, np.int64)
        # runs of windows with one least value, within a document
        edge = np.ones(len(least) + 1, bool)
        edge[1:-1] = least[1:] != least[:-1]
        edge[offsets[offsets < len(edge)]] = True
        lo = np.flatnonzero(edge[:-1])
        hi = np.concatenate([lo[1:], [len(least)]])[:len(lo)] - 1
        real = least[lo] > 0 if len(lo) else np.zeros(0, bool)
        lo, hi = lo[real], hi[real]
        values, rank = np.unique(least[lo], return_inverse=True)
        order = np.lexsort((lo, rank))
        lo, hi, place = lo[order], hi[order], (rank[order].astype(np.int64) << 32) | lo[order]
        key = np.searchsorted(values, grams[at])
        order = np.lexsort((at, key))
        at, key = at[order], key[order]
        run = np.searchsorted(place, (key.astype(np.int64) << 32) | at, side="right") - 1
        later = np.full(len(at), np.iinfo(np.int64).max)
        if len(at) > 1:
            later[:-1] = np.where(key[1:] == key[:-1], at[1:] - w, later[:-1])
        self.first = np.maximum(lo[run], at - w + 1)
        self.last = np.minimum(np.minimum(hi[run], at), later)
        use = self.first <= self.last
        self.at, self.first, self.last, key = at[use], self.first[use], self.last[use], key[use]
        # least hashes are small: spread them over the buckets
        self.keys, self.key, count = np.unique(mix64(values)[key], return_inverse=True, return_counts=True)
        self.local = count > 1

    def seeds(self, n: int):
        return B.send_keys(self.keys, self.local, n)

    def shared(self, row: dict, n: int) -> None:
        """Keep positions whose string occurs twice; equal surroundings once."""
        repeated = B.flags(row, "seeds", B.by_bucket(self.keys, n), len(self.keys))[self.key]
        raw, entries = self.bundle.data.tobytes(), {}
        self.at, keys = self.at[repeated], self.keys[self.key[repeated]]
        self.entry = np.empty(len(self.at), np.int64)
        heads = keys.byteswap().tobytes()
        for i, (p, a, b) in enumerate(zip(self.at.tolist(), self.first[repeated].tolist(),
                                          (self.last[repeated] + self.size).tolist())):
            both = (heads[8 * i:8 * i + 8] + raw[p:b], raw[a:p][::-1])
            self.entry[i] = entries.setdefault(both, len(entries))
        times = np.bincount(self.entry, minlength=len(entries))
        strings = list(entries)
        order = sorted(range(len(strings)), key=strings.__getitem__)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.entry = place[self.entry]
        self.strings = [strings[i] for i in order]
        self.twice = times[order] > 1
        self.heads = np.frombuffer(b"".join(s[:8] for s, _ in self.strings), ">u8").astype(np.uint64)

    def suffixes(self, n: int):
        pack = zstandard.ZstdCompressor(level=1).compress
        for b, part in B.by_bucket(self.heads, n):
            run, coded, before = self.strings[part], [], b""
            for s, _ in run:
                h = shared_prefix(before, s, 0)
                coded.append((h, s[h:]))
                before = s
            yield b, pack(pickle.dumps((coded, [x for _, x in run], self.twice[part].tolist()), protocol=5))

    def gone(self, row: dict, n: int) -> np.ndarray:
        """Which bytes go."""
        left, right = np.zeros(len(self.strings), np.int64), np.zeros(len(self.strings), np.int64)
        replies = {x["bucket"]: x["reply"] for x in row.get("suffixes") or ()}
        for b, part in B.by_bucket(self.heads, n):
            left[part], right[part] = np.frombuffer(replies[b], np.uint32).reshape(2, -1)
        at, left, right = self.at, left[self.entry], right[self.entry]
        hit = right > 0
        edge = np.zeros(len(self.bundle.data) + 1, np.int32)
        np.add.at(edge, (at - left)[hit], 1)
        np.add.at(edge, (at + right)[hit], -1)
        return np.cumsum(edge[:-1]) > 0


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix; the first ``known`` bytes are not read."""
    most, step = min(len(a), len(b)), 16
    while known < most:
        x, y = a[known:known + step], b[known:known + step]
        if x != y:
            return known + len(commonprefix((x, y)))
        known += len(x) if len(x) < len(y) else len(y)
        step *= 4
    return most


class LoserTree:
    """K-way merge of front-coded runs; yields (string, prefix shared with
    the string before, run number, place in the run)."""

    def __init__(self, runs: list[list[tuple[int, bytes]]]):
        self.runs, self.size = runs, 1
        while self.size < len(runs):
            self.size *= 2
        self.next = [0] * self.size
        self.string: list[bytes | None] = [None] * self.size
        self.lcp = [0] * self.size  # with the last string given out (or the node's winner)
        for r in range(len(runs)):
            self._advance(r)
        self.node = [0] * self.size
        self.winner = self._play(1)

    def _advance(self, r: int) -> None:
        if self.next[r] < len(self.runs[r]):
            h, rest = self.runs[r][self.next[r]]
            before = self.string[r]
            self.string[r] = before[:h] + rest if h else rest
            self.lcp[r] = h
            self.next[r] += 1
        else:
            self.string[r] = None

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs whose ``lcp`` refer to one string;
        the loser's becomes the prefix it shares with the winner."""
        x, y = self.string[a], self.string[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if self.lcp[a] != self.lcp[b]:
            return (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        h = shared_prefix(x, y, self.lcp[a])
        if x[h:h + 1] <= y[h:h + 1]:
            self.lcp[b] = h
            return a, b
        self.lcp[a] = h
        return b, a

    def _play(self, k: int) -> int:
        if k >= self.size:
            return k - self.size
        won, self.node[k] = self._match(self._play(2 * k), self._play(2 * k + 1))
        return won

    def __iter__(self):
        while self.string[self.winner] is not None:
            r = self.winner
            yield self.string[r], self.lcp[r], r, self.next[r] - 1
            self._advance(r)
            k = (r + self.size) // 2
            while k:
                r, self.node[k] = self._match(r, self.node[k])
                k //= 2
            self.winner = r


def intervals(lcps: list[int], least: int):
    """(depth, start, end) of maximal ranges whose strings share ``depth``
    >= ``least`` bytes, inner ones first; lcps[i] is between i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, h in enumerate([*lcps, 0]):
        start = i
        while stack and stack[-1][0] > h:
            depth, start = stack.pop()
            yield depth, start, i + 1
        if h >= least and (not stack or stack[-1][0] < h):
            stack.append((h, start))


def extents(rights: list[bytes], lcps: list[int], lefts: list[bytes], size: int) -> tuple[list[int], list[int]]:
    """For strings of one sampled hash in sorted order: the longest match to
    the left and to the right of the position among the pairs that share
    ``size`` bytes or more round it (0, 0 if there are none)."""
    m = len(rights)
    out_l, out_r = [0] * m, [0] * m
    longest = max(map(len, lefts))
    for depth, a, b in intervals(lcps, max(1, size - longest)):
        if all(out_r[i] and out_l[i] == len(lefts[i]) for i in range(a, b)):
            continue
        order = sorted(range(a, b), key=lefts.__getitem__)
        before = 0
        for j, i in enumerate(order):
            after = shared_prefix(lefts[i], lefts[order[j + 1]], 0) if j + 1 < len(order) else 0
            l = max(before, after)
            if l + depth >= size:
                out_l[i] = max(out_l[i], l)
                out_r[i] = max(out_r[i], depth)
            before = after
    return out_l, out_r


def merge(payloads: list[bytes], size: int) -> list[bytes]:
    """Merge the runs of a bucket and answer each with its extents."""
    open_ = zstandard.ZstdDecompressor().decompress
    runs = [pickle.loads(open_(p)) for p in payloads]
    out = [np.zeros((2, len(run[0])), np.uint32) for run in runs]

    def settle(group, lcps):
        if len(group) > 1:
            rights = [s for s, _, _ in group]
            found_l, found_r = extents(rights, lcps, [runs[r][1][i] for _, r, i in group], size)
            for (s, r, i), l, h in zip(group, found_l, found_r):
                out[r][:, i] = l, h
        for s, r, i in group:
            if runs[r][2][i]:  # its whole surroundings occur twice in its bundle
                out[r][:, i] = len(runs[r][1][i]), len(s)

    group, lcps = [], []
    for s, h, r, i in LoserTree([run[0] for run in runs]):
        if group and h < 8:
            settle(group, lcps)
            group, lcps = [], []
        if group:
            lcps.append(h - 8)
        group.append((s[8:], r, i))
    settle(group, lcps)
    return [x.tobytes() for x in out]


def suffix_dedup(docs: DataFrame, min_bytes: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, removed spans of
    bytes)."""
    spark = docs.sparkSession
    n = max(width(spark), text_bytes(docs) * 2 // B.BUCKET_BYTES)
    table = stage(B.bundles(docs), "bundles")  # three rounds read them

    def seeds(row, n):
        return Samples(row, min_bytes).seeds(n)

    def suffixes(row, n):
        samples = Samples(row, min_bytes)
        samples.shared(row, n)
        return samples.suffixes(n)

    def result(batches):
        for batch in batches:
            for row in batch.to_pylist():
                samples = Samples(row, min_bytes)
                samples.shared(row, n)
                gone, bundle = samples.gone(row, n), samples.bundle
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[bundle.offsets[1:]] - total[bundle.offsets[:-1]]
                kept, spans = [], []
                for i, (text, a, b) in enumerate(zip(bundle.texts(), bundle.offsets[:-1], bundle.offsets[1:])):
                    mask = gone[a:b]
                    kept.append(bundle.data[a:b][~mask].tobytes() if removed[i] else text)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))) if removed[i] else mask[:0]
                    spans.append([{"start": x, "end": y} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist())])
                yield pa.RecordBatch.from_arrays(
                    [bundle.id_column(), pa.array(np.diff(bundle.offsets)), pa.array(removed, pa.int64()),
                     pa.array(list(map(len, spans)), pa.int64()), pa.array(kept, pa.binary()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"])
        release()

    first = B.answers(table, seeds, B.seen_elsewhere, n, "seeds")
    joined = table.join(first, "bid", "left")
    second = B.answers(joined, suffixes, lambda payloads: merge(payloads, min_bytes), n, "suffixes")
    return joined.join(second, "bid", "left").mapInArrow(
        result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary,"
                "removed array<struct<start:long,end:long>>")


def digest(docs: DataFrame) -> DataFrame:
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                     F.sha2("kept", 256).alias("kept_sha256"))
