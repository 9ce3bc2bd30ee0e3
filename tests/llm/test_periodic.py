"""Periodic runs against the definition, word by word."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from formbook.llm import periodic


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(ws, min_length=24, exponent=3):
    """Every maximal stretch of each period; of one stretch the least period."""
    out, n = {}, len(ws)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and ws[i] == ws[i + q]:
                i += 1
            length = i + q - s
            if length >= max(min_length, exponent * q):
                out.setdefault((s, length), q)
            # the stretches of a period overlap by less than q, so none is skipped
    return sorted((s, length, q) for (s, length), q in out.items())


def collapse(ws, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def plain_digest(doc_id, text):
    ws = words(text)
    n = len(ws)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    runs = plain_runs(ws)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, runs and 1000 * best[1] // best[2] or None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapse(ws, runs).encode()).hexdigest())


def random_texts(rng, count):
    out = []
    for _ in range(count):
        n, letters = int(rng.integers(0, 90)), int(rng.integers(1, 5))
        ws = list(rng.integers(0, letters, n))
        for _ in range(int(rng.integers(0, 4))):  # periodic stretches, one into the other
            q = int(rng.integers(1, 9))
            ws += list(ws[-q:] or [0]) * int(rng.integers(2, 9))
            ws += list(rng.integers(0, letters, int(rng.integers(0, 5))))
        out.append([int(w) for w in ws])
    return out


@pytest.mark.parametrize("min_length,exponent", [(24, 3), (2, 2), (6, 2), (9, 4)])
def test_runs_of_random_words(min_length, exponent):
    texts = random_texts(np.random.default_rng(min_length), 150)
    symbols = np.array([w for t in texts for w in t], np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = periodic.runs_of(symbols, first, min_length, exponent).tolist()
    want = [[i, *r] for i, t in enumerate(texts) for r in plain_runs(t, min_length, exponent)]
    assert got == want and len(want) > 20


def test_small_blocks_find_the_same(monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 7)
    test_runs_of_random_words(2, 2)


def test_digest(spark):
    rng = np.random.default_rng(3)
    vocab = ["a", "b", "é", "😀x", "word", "A"]
    texts = ["\t ".join(vocab[w] for w in t) for t in random_texts(rng, 120)]
    texts += [None, "", " \n", "one", "x " * 5000, "x y " * 700 + "z " + "x y " * 700,
              " ".join(f"w{i}" for i in range(3000)), "ab ab"]
    rows = [(i, t, "en", i, "n") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "q r " * 30, "en", 0, "n"), (None, None, None, None, None), (5, "s " * 40, "en", 0, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, start long, period string").repartition(3)
    got = sorted(map(tuple, periodic.digest(df).collect()), key=str)
    assert got == sorted((plain_digest(r[0], r[1]) for r in rows), key=str)
    assert sum(r[1] for r in got) > 50
    out = periodic.digest(spark.createDataFrame([], df.schema))
    assert out.count() == 0 and [f.dataType.simpleString() for f in out.schema] == ["bigint"] * 6 + ["string"] * 2


def test_the_registered_query(spark):
    from formbook.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    for r in docs:
        if len(words(r.text)) < 900:
            assert got[r.doc_id] == plain_digest(r.doc_id, r.text)
