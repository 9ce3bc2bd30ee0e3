"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of a text; of every w consecutive ones the
least is chosen, the rightmost of equals, and kept with its position. One w
serves all texts, whatever their length, so two texts that share k + w - 1
characters (19) share a chosen hash, and any two fingerprints compare. A
fingerprint is written as 11 base-85 digits a choice: ten of its hash, and
its distance from the choice before (or the start), which no window exceeds.
Nothing is lost by that (``choices_of``), and a fingerprint is several times
its text, so its digits are what a result weighs. Likeness is the Jaccard
index of the sets of hashes.

``edited_fingerprints`` compares each document with the one after it in
descending doc_id order. Ranges of doc_id are sorted apart; the first
document of a range is also sent to the range before it, so a text moves
once, compressed, and no task sees more than its ranges. There are as many
tasks as the bytes of the texts ask for, so that a sort needs no disk.

Defined results: null texts are empty; an empty text has the empty
fingerprint, alike (1.0) to another empty one only; texts shorter than k
have one hash, of the whole; texts of fewer than w k-grams have the least of
them; null doc_ids come last in descending order;
equal doc_ids stand in the order of a hash of their texts; a table of one
document is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.llm.common import Rolling, record_batch, text_bytes, width

K = 12
WINDOW = 8
WINDOWS, CHOICES = (WINDOW,), 1  # as the tests' plain loop reads it: that window from the first character on
RANGES = 4  # ranges a shuffle partition
TASK_BYTES = 32 << 20  # of text in a shuffle partition
LEAST = -(1 << 63)
DIGITS = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz!#$%&()*+-;<=>?@^_`{|}~", np.uint8)
PAIRS = np.stack([np.repeat(DIGITS, 85), np.tile(DIGITS, 85)], 1).copy().view(np.uint16).ravel()


def winnow(texts: list[str], k: int = K, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) chosen in each text."""
    symbols = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    rolling = Rolling(symbols)
    grams = rolling.grams(k)
    least, at, have = grams, np.arange(len(grams), dtype=np.int32), 1
    while have < window and len(least) > window - have:  # the place of the least gram of every window
        step = min(have, window - have)
        right = least[step:] <= least[:-step]
        least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    out = []
    for a, n in zip(starts.tolist(), sizes.tolist()):
        if n >= k + window - 1:
            chosen = at[a:a + n - k - window + 2]
            chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]
        elif n >= k:
            own = grams[a:a + n - k + 1]
            chosen = np.array([a + len(own) - 1 - int(own[::-1].argmin())])
        else:
            whole = np.array([a]) if n else np.zeros(0, np.int64)
            out.append((rolling.slices(whole, whole + n), whole - a))
            continue
        out.append((grams[chosen], chosen - a))
    return out


def gap_digits(window: int) -> int:
    digits = 1
    while 85 ** digits <= window:
        digits += 1
    return digits


def texts_of(choices: list[tuple[np.ndarray, np.ndarray]], window: int = WINDOW) -> list[str]:
    """The fingerprint of each text's choices."""
    more = gap_digits(window)
    hashes = np.concatenate([np.zeros(0, np.uint64), *[c[0].astype(np.uint64) for c in choices]])
    gaps = np.concatenate([np.zeros(0, np.int64), *[np.diff(c[1], prepend=0) for c in choices]]).astype(np.uint32)
    out = np.empty((len(hashes), 10 + more), np.uint8)
    for half, at in (((hashes >> np.uint64(32)).astype(np.uint32), 0), (hashes.astype(np.uint32), 5)):
        for end in (at + 5, at + 3):
            rest = half // np.uint32(7225)
            out[:, end - 2:end] = PAIRS[half - rest * np.uint32(7225)].view(np.uint8).reshape(-1, 2)
            half = rest
        out[:, at] = DIGITS[half]
    for at in range(9 + more, 9, -1):
        rest = gaps // np.uint32(85)
        out[:, at] = DIGITS[gaps - rest * np.uint32(85)]
        gaps = rest
    whole = out.tobytes().decode("ascii")
    ends = np.cumsum([0, *[len(c[0]) for c in choices]]) * (10 + more)
    return [whole[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


def text_of(choice: tuple[np.ndarray, np.ndarray], window: int = WINDOW) -> str:
    return texts_of([choice], window)[0]


def choices_of(fingerprint: str, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that ``text_of`` has written."""
    value = np.zeros(256, np.uint64)
    value[DIGITS] = np.arange(85)
    more = gap_digits(window)
    digits = value[np.frombuffer(fingerprint.encode("ascii"), np.uint8)].reshape(-1, 10 + more)

    def number(first: int, count: int) -> np.ndarray:
        return digits[:, first:first + count] @ np.uint64(85) ** np.arange(count - 1, -1, -1, dtype=np.uint64)

    return number(0, 5) << np.uint64(32) | number(5, 5), np.cumsum(number(10, more).astype(np.int64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted sets."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, fingerprint) of every document."""
    def make(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts_of(winnow(texts, k, window), window), pa.string())],
                ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        make, "doc_id long, fingerprint string")


def edited_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, chunk: int = 1 << 20) -> DataFrame:
    parts = max(width(docs.sparkSession), -(-text_bytes(docs) // TASK_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("key")).withColumn("tie", F.xxhash64("text"))
    marks = parts * RANGES
    cuts = rows.select("key").stat.approxQuantile("key", [i / marks for i in range(1, marks)], 0.25 / marks)
    edges = np.unique(np.array(cuts, np.float64))

    def range_of(keys: np.ndarray) -> np.ndarray:
        return len(edges) - np.searchsorted(edges, keys.astype(np.float64), side="right")

    def heads(batches):
        for batch in batches:
            keys = np.asarray(batch.column("key"))
            part = range_of(keys)
            for p in np.unique(part):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([keys[part == p].max()], pa.int64())],
                                                 ["part", "head"])

    first = dict(rows.select("key").mapInArrow(heads, "part int, head long").groupBy("part").agg(F.max("head"))
                 .collect())  # a row a range
    filled = sorted(first)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}

    def deal(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            batch = record_batch(packed, [batch.column("doc_id"), [codec.compress(t, asbytes=True) for t in texts],
                                          [len(t) for t in texts], batch.column("key"), batch.column("tie")])
            keys = np.asarray(batch.column("key"))
            part = range_of(keys)
            yield record_batch(dealt, [part, np.zeros(len(part), bool), *batch.columns])
            head = np.array([k == first[p] for p, k in zip(part.tolist(), keys.tolist())], bool)
            if head.any():
                also = batch.filter(pa.array(head))
                yield record_batch(dealt, [[before[p] for p in part[head].tolist()], np.ones(int(head.sum()), bool),
                                           *also.columns])

    packed = pa.schema([("doc_id", pa.int64()), ("packed", pa.binary()), ("size", pa.int64()), ("key", pa.int64()),
                        ("tie", pa.int64())])
    dealt = pa.schema([("part", pa.int32()), ("halo", pa.bool_()), *packed])
    result = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def compare(chain: list[tuple], last: bool):
        """Rows of the documents of a chain but the last, whose next is unknown."""
        texts = [c[1] for c in chain]
        edited = []
        for own, after in zip(texts, texts[1:]):
            third = len(own) // 3
            edited.append(own[:len(own) - third] + after[:third])
        m, n = len(texts), len(edited)
        made = winnow(texts + edited, k, window)
        written = texts_of(made[:n] + made[m:], window)  # the last text's is in the next chain
        sets = [np.unique(c[0]) for c in made]
        out = []
        for i, e in enumerate(edited):
            out.append((chain[i][0], len(texts[i]), hashlib.sha256(e.encode()).hexdigest(), written[i],
                        written[n + i], likeness(sets[i], sets[m + i]), likeness(sets[i], sets[i + 1])))
        return record_batch(result, list(zip(*out))) if out else None

    def walk(batches):
        chain, held, part, closed, codec = [], 0, None, False, pa.Codec("zstd")
        for batch in batches:
            for p, halo, doc_id, packed, size in zip(*[c.to_pylist() for c in batch.columns]):
                if p != part:
                    chain, held, part, closed = [], 0, p, False
                if closed:
                    continue
                text = codec.decompress(packed, size, asbytes=True).decode() if size else ""
                chain.append((doc_id, text))
                held += len(text)
                closed = halo
                if (halo or held >= chunk) and len(chain) > 1:
                    got = compare(chain, halo)
                    chain, held = chain[-1:], len(text)
                    if got is not None:
                        yield got

    return (rows.mapInArrow(deal, "part int, halo boolean, doc_id long, packed binary, size long, key long, tie long")
            .repartition(parts, "part").sortWithinPartitions("part", "halo", F.desc("key"), "tie")
            .select("part", "halo", "doc_id", "packed", "size")
            .mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
                              "edited_fingerprint string, near_edited double, near_next double"))
