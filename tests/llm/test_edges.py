"""Each operator against brute force on a small messy table: nulls, empty
and long texts, ties, repeated rows, clashing extra columns; and empty."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from formbook.llm import bundles, knn, mixing, sharding, simhash, substring, suffix, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, fp string"
RNG = np.random.default_rng(11)
VOCAB = ["".join(map(chr, RNG.integers(97, 123, RNG.integers(2, 9)))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


PASSAGE, LONG = prose(90), prose(9000)
ROWS = ([(i, prose(int(n))) for i, n in enumerate(RNG.integers(1, 120, 40))]
        + [(100 + i, f"{prose(20)}\n{PASSAGE} {prose(i)}") for i in range(12)]
        + [(200 + i, "copy of\ta  text " * 30) for i in range(9)]
        + [(300, None), (301, ""), (302, " \n\t"), (303, "One"), (304, "one"), (305, LONG), (306, LONG + " tail"),
           (307, "é😀 " * 200), (None, PASSAGE), (None, prose(30)), (308, "ab " * 700),
           (400, prose(50)), (401, PASSAGE), (401, PASSAGE), (401, PASSAGE)])
SOURCES = [None, "b", "a", "Z", "é"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", SOURCES[min(4, i % 13)], len(t or ""), "x", "y", "z")
                                  for i, (d, t) in enumerate(ROWS)], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(autouse=True)
def small_bundles(monkeypatch):
    monkeypatch.setattr(bundles, "BUNDLE_BYTES", 20_000)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_shards(docs, empty):
    rows = sharding.digest(docs, 8).collect()
    assert len(rows) == len(ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in ROWS)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert sharding.digest(empty).count() == 0
    whole = sharding.shard_documents(docs, 8)
    assert {"text", "lang", "shard", "slot"} <= set(whole.columns) and whole.count() == len(ROWS)


def test_shards_are_near_equal_and_split_hot_groups(spark):
    df = spark.createDataFrame([(i, "hot " * 20 if i % 3 == 0 else f"text {i} " * (i % 30 + 1)) for i in range(3000)],
                               "doc_id long, text string")
    size = Counter()
    for r in sharding.digest(df, 10).collect():
        size[r["shard"]] += r.size
    mean = sum(size.values()) / 10
    assert max(abs(v - mean) for v in size.values()) < 0.03 * mean


def test_simhash(docs, empty):
    def fingerprint(text):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [(d, fingerprint(t)) for d, t in ROWS]
    group = list(range(len(fps)))
    for _ in fps:
        for i, (_, a) in enumerate(fps):
            for j, (_, b) in enumerate(fps[:i]):
                if (a ^ b).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
        if all(group[g] == g for g in group):
            break
    least = defaultdict(list)
    for g, (d, _) in zip(group, fps):
        least[g] += [d] if d is not None else []
    want = Counter((d, f"{f:016x}", min(least[g], default=None)) for g, (d, f) in zip(group, fps))
    assert Counter(map(tuple, simhash.digest(docs).collect())) == want
    assert simhash.digest(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))


def test_one_row_of_each_component_whatever_the_ids(spark):
    a, b, c, d, e = (prose(80) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (None, c), (9, d), (9, e), (5, e), (5, e)]
    want = Counter([(None, a), (None, b), (7, c), (7, d), (5, e)])
    for parts in (1, 6):
        df = spark.createDataFrame([(i, t, str(k % 2)) for k, (i, t) in enumerate(rows)],
                                   "doc_id long, text string, source string").repartition(parts)
        kept = simhash.one_of_each(df).collect()
        assert Counter((r.doc_id, r.text) for r in kept) == want
        assert parts == 1 or Counter(map(tuple, kept)) == before
        before = Counter(map(tuple, kept))


def test_hot_patterns_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", 20)
    codes = {0}
    while len(codes) < 300:
        codes.add(int(RNG.choice(list(codes))) ^ 1 << int(RNG.integers(0, 64)))
    table = spark.createDataFrame([(simhash.signed(c),) for c in codes], "fp long")
    nodes = simhash.under_patterns(table, 3)
    assert nodes.groupBy("mask", "pattern").count().agg({"count": "max"}).first()[0] <= 20
    below = defaultdict(list)
    for r in nodes.collect():
        below[r["mask"], r.pattern].append(r.fp & (1 << 64) - 1)
    met = {(a, b) for group in below.values() for a in group for b in group}
    assert all((a, b) in met for a in codes for b in codes if (a ^ b).bit_count() <= 3)


def test_substring(docs, empty):
    first = {}
    for d, t in ROWS:
        w, rank = words(t), bundles.NULL_ID if d is None else d
        for i in range(len(w) - 12):
            key = tuple(w[i:i + 13])
            first[key] = min(first.get(key, rank), rank)
    want = Counter()
    for d, t in ROWS:
        w, rank = words(t), bundles.NULL_ID if d is None else d
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i:i + 13])] < rank for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter(map(tuple, substring.digest(docs).collect())) == want
    assert substring.digest(empty).count() == 0


def test_suffixes(docs, empty):
    texts = [(t or "").encode() for _, t in ROWS]
    for size in (400, 60):
        seen = Counter(x[i:i + size] for x in texts for i in range(len(x) - size + 1))
        want = Counter()
        for (d, _), x in zip(ROWS, texts):
            gone = np.zeros(len(x), bool)
            for i in range(len(x) - size + 1):
                if seen[x[i:i + size]] > 1:
                    gone[i:i + size] = True
            spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            want[d, len(x), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest()] += 1
        got = Counter()
        for r in suffix.suffix_dedup(docs, size).collect():
            got[r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()] += 1
        assert got == want
    assert suffix.digest(empty).count() == 0


def test_loser_tree_merges_front_coded_runs():
    runs = [sorted(bytes(RNG.integers(97, 99, RNG.integers(1, 12)).astype(np.uint8)) for _ in range(n)) for n in (9, 0, 14, 3, 1)]
    coded = [[(suffix.shared_prefix(a, b, 0), b[suffix.shared_prefix(a, b, 0):]) for a, b in zip([b"", *r], r)] for r in runs]
    out = list(suffix.LoserTree(coded))
    assert [s for s, *_ in out] == sorted(sum(runs, []))
    assert all(h == suffix.shared_prefix(a[0], b[0], 0) for a, b in zip(out, out[1:]) for h in [b[1]])


def test_mixing(docs, empty):
    rows = mixing.digest(docs).collect()
    again = mixing.digest(docs.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again)) and len(rows) == len(ROWS)
    total = sum(r["size"] for r in rows)
    goals = {(r.source_size, r.target) for r in rows}
    assert all(t <= 3 * s + 1e-6 for s, t in goals) and sum(t for _, t in goals) == pytest.approx(total)
    assert all(r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in rows)
    assert sum(r.taken for r in rows) <= total
    assert mixing.digest(empty).count() == 0 and mixing.mix(empty).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.select("text").collect()) == sum(r.taken for r in rows)


def test_search(spark):
    vectors = [(i, [float(x) for x in RNG.integers(-3, 4, 5) / 8]) for i in range(150)]
    vectors += [(i, [0.25, -0.5, 0.1]) for i in range(200, 260)] + [(60, [1.0] * 5), (60, [1.0] * 5), (80, [])]
    bad = [(300, None), (None, [1.0]), (320, [None, 1.0]), (340, [float("nan")]), (360, [float("inf")])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in vectors + bad], "vec_id long, embedding array<double>, score string")
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in vectors]
    want = Counter()
    for n, (i, a) in enumerate(whole):
        if i % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), j) for m, (j, b) in enumerate(whole) if m != n)[:20]
            want.update((i, k, j, -s) for k, (s, j) in enumerate(best, 1))
    assert Counter(map(tuple, knn.top_k(df).collect())) == want
    assert knn.top_k(df.where("false")).count() == 0
    few = knn.top_k(spark.createDataFrame([(0, [1.0]), (7, [2.0])], "vec_id long, embedding array<double>")).collect()
    assert [tuple(r) for r in few] == [(0, 1, 7, 64 * 128)]


def test_scores_beyond_64_bits_rank_as_whole_numbers(spark):
    big = 2.0 ** 40
    df = spark.createDataFrame([(0, [big, 1.0]), (1, [big, 1.0]), (2, [2 * big, 1.0]), (3, [2 * big, 2.0]), (4, [4 * big, 0.0]),
                                (5, [-2 * big, 0.0]), (6, [-4 * big, 0.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in knn.top_k(df).orderBy("rank").collect()]
    top, low = 2 ** 63 - 1, -2 ** 63
    assert got == [(4, top), (3, top), (2, top), (1, top), (7, 64 * 64), (5, low), (6, low)]
    numbers = [0, 1, -1, 255, 256, -255, -256, 2 ** 63, -2 ** 63, 2 ** 64 + 1, 10 ** 40, -10 ** 40, 10 ** 400, 7, 8]
    assert sorted(numbers) == sorted(numbers, key=knn.order_key)


def test_join_with_hot_keys_is_the_plain_join(spark):
    from formbook.llm.common import join_hot
    rows = spark.createDataFrame([(i, 7 if i % 3 else i % 1500) for i in range(6000)] + [(i, None) for i in range(5)] + [(1, 7)] * 3,
                                 "doc_id long, fp long").repartition(5)
    facts = spark.createDataFrame([(k, k * 10) for k in range(1400)], "fp long, root long")
    joined = join_hot(rows, facts, "fp")
    assert Counter(map(tuple, joined.select("doc_id", "fp", "root").collect())) == Counter(
        map(tuple, rows.join(facts, "fp").select("doc_id", "fp", "root").collect()))
    assert join_hot(rows.where("false"), facts, "fp").count() == 0
    assert join_hot(rows.limit(2), facts, "fp").count() <= 2


def test_products_beyond_doubles():
    a = np.array([[2.0 ** 40, 3.0]])
    assert knn.products(a, np.array([[2.0 ** 20, 1.0]])).tolist() == [[2 ** 60 + 3]]
    assert knn.products(a, np.array([[2.0 ** 40, 1.0]])).tolist() == [[2 ** 63 - 1]]


def test_segments_are_the_maximal_ones():
    def plain(s):
        """Ruzzo and Tompa by definition: take the best segment, then look left and right of it."""
        best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        _, _, i, j = best
        return plain(s[:i]) + [(i, j - 1, best[0])] + [(i2 + j, j2 + j, x) for i2, j2, x in plain(s[j:])]

    for _ in range(60):
        s = [float(x) if x > 0 else -1.37 for x in RNG.random(25) * 5 * (RNG.random(25) < 0.4)]
        got = toxicity.segments([(i, x) for i, x in enumerate(s) if x > 0], 1.37)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain(s)]


def test_toxicity(spark, empty):
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        text = prose(60) + (" vilest scumword " + prose(3) + " vilest" if toxic else "")
        rows.append((i, text, "en", "s", 1, "x", "y", "z"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(None, None, "", "", 0, "", "", ""), (999, "", "", "", 0, "", "", "")], SCHEMA)
    marks = spark.createDataFrame(labels + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.digest(docs, marks).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (i in held) for i in range(400)) and len(out) == 402
    assert np.mean([out[i].predicted == int(i % 5 == 0) for i in held]) > 0.95
    assert out[999].predicted == 0 and 0 <= out[999].score <= 1 and out[None].predicted == 0
    kept = toxicity.clean(docs, marks)
    assert kept.columns == docs.columns and 300 < kept.count() < 340
    assert toxicity.digest(empty, marks).count() == 0
    none = toxicity.digest(docs, marks.where("false")).collect()
    assert len(none) == 402 and all(r.score == 0 for r in none)
