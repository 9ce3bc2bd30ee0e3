"""Periodic runs of words by an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q and a length
of at least ``min_length`` and ``min_exponent`` * q that no neighbouring word
extends. Each run ends in exactly one branching tandem repeat of its period:
a square that the next word does not continue.

The suffixes of every text are sorted by words (rank doubling; texts are
ranked apart, so a whole batch is sorted at once and no match crosses
texts), neighbours' common prefixes read off the rank levels. An LCP
interval of depth d is halved at each place where its least common prefix
stands; for each suffix i of the smaller half the inverse suffix array tells
whether i + d or i - d lies in the other half, which is the
branching-tandem test. The smaller halves of a text of n words hold at most
n log n suffixes. There are no tree nodes: the halves are the nearest
smaller entries of the common-prefix array. Each square found is rotated to
the left as far as its period holds (the rank levels answer it), which gives
the run; of runs with one place the least period stays.

A run of the sizes asked for holds two equal stretches of
min_length - min_length / min_exponent words, so the texts without any two
such stretches are settled after the first rank levels.

At scale: scan tasks do all of it, in slices of 4 MB of text (a longer text
is a slice of its own); nothing is exchanged. A text needs about 250 bytes
of memory a word.

Defined results: null texts have no words, like empty ones; a run may start
or end anywhere, a text may be one whole run; equal rows are each a
document; null doc_ids keep their rows; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.llm.common import chunks, utf8
from formbook.llm.wordarrays import Words, ranges

MIN_LENGTH = 24
MIN_EXPONENT = 3
BLOCK = 1 << 20
SPACE = r"[\x20\x09-\x0D]+"


def rank_levels(symbols: np.ndarray, ends: np.ndarray, upto: int | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... symbols, equal ones
    alike, until all differ or ``upto`` symbols count; and the suffixes that
    still have an equal. ``ends``: where the text of each symbol ends;
    ``symbols`` differ between texts."""
    n = len(symbols)
    rank = np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)
    todo, levels, k = np.arange(n), [], 0
    keys = symbols
    while True:
        order = np.argsort(keys, kind="stable")
        todo, keys = todo[order], keys[order]
        fresh = np.ones(len(todo), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        old = group[todo]
        opens = np.ones(len(todo), bool)
        opens[1:] = old[1:] != old[:-1]
        place = np.arange(len(todo))
        inner = np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(opens, place, 0))
        rank = rank.copy()
        rank[todo] = old + inner
        group = rank
        levels.append(rank.astype(np.int32))
        sizes = np.diff(np.append(np.flatnonzero(fresh), len(todo)))
        todo = todo[np.repeat(sizes > 1, sizes)]
        k = 2 * k or 1
        if not len(todo) or (upto and k >= upto):
            return levels, todo
        second = todo + k
        inside = second < ends[todo]
        keys = rank[todo] * (n + 1) + np.where(inside, rank[np.minimum(second, n - 1)] + 1, 0)


def common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes a and b (a <> b)."""
    n = len(levels[0])
    out = np.zeros(len(a), np.int64)
    for t in reversed(range(len(levels))):
        x, y = a + out, b + out
        inside = np.maximum(x, y) < n
        same = inside.copy()
        same[inside] = levels[t][x[inside]] == levels[t][y[inside]]
        out += same * (1 << t)
    return out


def common_before(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols before a equal those before b (a < b)."""
    out = np.zeros(len(a), np.int64)
    for t in reversed(range(len(levels))):
        x, y = a - out - (1 << t), b - out - (1 << t)
        inside = x >= 0
        same = inside.copy()
        same[inside] = levels[t][x[inside]] == levels[t][y[inside]]
        out += same * (1 << t)
    return out


def halves(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the boundaries ``at`` between neighbouring suffixes: the first and
    the last suffix of the interval that the boundary halves, entries equal
    to its own counting as smaller on the left and as larger on the right."""
    low, size = [lcp], 1
    while 2 * size <= len(lcp):
        last = low[-1]
        low.append(np.minimum(last[:-size], last[size:]))
        size *= 2
    depth = lcp[at]
    first, last = at.copy(), at + 1
    for t in reversed(range(len(low))):
        step = 1 << t
        to = first - step
        more = to >= 0
        more[more] = low[t][to[more]] > depth[more]
        first = np.where(more, to, first)
        more = last + step <= len(lcp)
        more[more] = low[t][last[more]] >= depth[more]
        last = np.where(more, last + step, last)
    return first, last


def branching_squares(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all squares that the next symbol does not go on with."""
    isa = levels[-1].astype(np.int64)
    n = len(isa)
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    lcp = common(levels, sa[:-1], sa[1:])
    at = np.flatnonzero(lcp > 0)
    first, last = halves(lcp, at)
    depth = lcp[at]
    left = at - first + 1 <= last - at
    from_, size = np.where(left, first, at + 1), np.minimum(at - first + 1, last - at)
    low, high = np.where(left, at + 1, first), np.where(left, last, at)  # the other half
    out: list[tuple[np.ndarray, np.ndarray]] = []
    upto = np.cumsum(size)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + BLOCK, side="right")))
        own = sa[ranges(from_[a:b], size[a:b])]
        d, lo, hi = (np.repeat(v[a:b], size[a:b]) for v in (depth, low, high))
        for step in (d, -d):
            to = own + step
            inside = (to >= 0) & (to < n)
            place = isa[np.where(inside, to, 0)]
            hit = inside & (place >= lo) & (place <= hi)
            out.append((np.minimum(own, to)[hit], d[hit]))
        a = b
    return (np.concatenate([o[0] for o in out]) if out else np.zeros(0, np.int64),
            np.concatenate([o[1] for o in out]) if out else np.zeros(0, np.int64))


def runs_of(symbols: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH,
            min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """(text, start, length, period) of the runs in each text, in this order;
    the texts' symbols stand one behind the other, ``first`` being where each
    begins, and the end."""
    none = np.zeros((0, 4), np.int64)
    n, sizes = len(symbols), np.diff(first)
    if not n:
        return none
    text = np.repeat(np.arange(len(sizes)), sizes)
    base = int(symbols.max()) + 1
    ends = np.repeat(first[1:], sizes)
    repeated = 1 << max(0, (min_length - min_length // min_exponent).bit_length() - 1)
    _, todo = rank_levels(text * base + symbols, ends, repeated)
    some = np.unique(text[todo])
    if not len(some):
        return none
    sizes = sizes[some]
    keep = ranges(first[some], sizes)
    begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
    levels, _ = rank_levels(text[keep] * base + symbols[keep], begins + np.repeat(sizes, sizes))
    start, period = branching_squares(levels)
    end = start + 2 * period
    start = start - common_before(levels, start, start + period)
    long = end - start >= np.maximum(min_length, min_exponent * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))  # of one stretch the least period first
    start, end, period = start[order], end[order], period[order]
    least = np.ones(len(start), bool)
    least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[least], end[least], period[least]
    out = np.stack([text[keep][start], start - begins[start], end - start, period], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def scan(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of each text by start and
    period, and its words, joined by blanks, without those that a run has
    beyond its first period."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, offsets = utf8(batch.column("text"))
            words = Words(data, offsets, (data != 32) & ((data < 9) | (data > 13)))
            codes, _ = words.coded()
            found = runs_of(codes, words.first, min_length, min_exponent)
            joined, at = words.joined()
            cuts = np.searchsorted(found[:, 0], np.arange(batch.num_rows + 1))
            shown, texts = [], []
            for i in range(batch.num_rows):
                a, b = int(words.first[i]), int(words.first[i + 1])
                own = found[cuts[i]:cuts[i + 1], 1:].tolist()
                shown.append([dict(zip(("start", "length", "period"), r)) for r in own])
                kept, upto = [], a
                for start, length, period in own:  # by start: what is kept so far ends at ``upto``
                    cut = a + start + period
                    if cut > upto:
                        kept.append(joined[at[upto]:at[cut]])
                    upto = max(upto, a + start + length)
                kept.append(joined[at[upto]:at[b]])
                texts.append(b"".join(kept)[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(words.first), pa.int64()), pa.array(shown, pa.list_(run)),
                 pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        make, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text); a tenth of the documents, by the crc32 of the doc_id,
    go on periodically from a word on."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", g.alias("g"),
                       F.when(h % 10 == 0, F.array_remove(F.split("text", SPACE), "")).alias("words"))
    rows = rows.withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    head = F.slice("words", F.lit(1), F.col("a").cast("int"))
    turn = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(turn, times)), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(head, tail), " "))
                       .otherwise(F.col("text")).alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """The runs of the planted texts, one row a document."""
    rows = scan(with_planted_tails(docs))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    rows = rows.withColumn("best", F.expr("""
        aggregate(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), (b, r) ->
          CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)"""))
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                       F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
