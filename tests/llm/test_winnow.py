"""Winnowing against a plain loop, and neighbours across ranges."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from formbook.llm import winnow as W

SCHEMA = "doc_id long, text string, lang string, n_chars string"


def plain(text, k, windows=W.WINDOWS):
    grams = [int(W.winnow([text[i:i + k]])[0][0][0]) for i in range(len(text) - k + 1)]
    if not grams:
        return [0] if text else []
    w = min(len(grams), max((w for w in windows if w * W.CHOICES <= len(text)), default=windows[0]))
    out = []
    for s in range(len(grams) - w + 1):
        least = min(grams[s:s + w])
        at = s + max(i for i in range(w) if grams[s + i] == least)
        if out[-1:] != [at]:
            out.append(at)
    return out


@pytest.mark.parametrize("text", ["", "short", "abcdefghijkl", "abab" * 60, "x" * 900, "é😀 word " * 100,
                                  "".join(chr(97 + i * i % 23) for i in range(2500))])
def test_choices_match_a_plain_loop(text):
    around = W.winnow(["before " * 9, text, "", "after"])
    assert around[1][1].tolist() == plain(text, W.K)


def test_shared_passage_is_found_across_lengths():
    rng = np.random.default_rng(3)
    def noise(n):
        return "".join(map(chr, rng.integers(97, 123, n)))
    passage = noise(W.K + W.WINDOWS[-1] - 1)
    for n in (0, 40, 400, 4000):
        a, b = W.winnow([noise(n) + passage + noise(n), noise(3000) + passage])
        assert set(a[0].tolist()) & set(b[0].tolist())


def expected(rows):
    def key(r):
        return (r[0] is None, -(r[0] or 0))
    rows = sorted(rows, key=key)
    out = []
    for i, (d, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        out.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(),
                    W.text_of(W.winnow([text])[0]), W.text_of(W.winnow([edited])[0])))
    return sorted(out, key=str)


def test_neighbours(spark):
    rows = [(i * 7 % 101 - 20, None if i == 5 else "" if i == 6 else f"text {i} " * (i % 40)) for i in range(100)] + [(None, "last")]
    got = W.edited_fingerprints(spark.createDataFrame([(*r, "en", "9") for r in rows], SCHEMA).repartition(5)).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == expected(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_one_document_and_none(spark):
    one = W.edited_fingerprints(spark.createDataFrame([(1, "a b c " * 50, "en", "9")], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert W.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_rows_and_equal_ids(spark):
    rows = [(1, "same text " * 30)] * 4 + [(1, "other " * 30), (2, "same text " * 30)]
    got = W.edited_fingerprints(spark.createDataFrame([(*r, "en", "9") for r in rows], SCHEMA)).collect()
    assert len(got) == 6
    assert len({r.fingerprint for r in got}) == 2


def test_fingerprints_of_documents(spark):
    df = spark.createDataFrame([(1, None, "en", "9"), (2, "abc " * 99, "en", "9"), (3, "abc " * 99, "en", "9")], SCHEMA)
    got = {r.doc_id: r.fingerprint for r in W.fingerprints(df).collect()}
    assert got[1] == "" and got[2] == got[3] != ""
    assert df.where(F.col("doc_id") < 0).count() == 0


def letters(rng, n):
    return "".join(map(chr, rng.integers(97, 123, n)))


@pytest.mark.parametrize("n", [384, 768, 1536, 2040])
def test_near_equal_texts_of_any_two_lengths_are_alike(n):
    text = letters(np.random.default_rng(n), n + 1)
    a, b = [np.unique(c[0]) for c in W.winnow([text[:n - 1], text])]
    assert W.likeness(a, b) > 0.95


def test_a_short_passage_is_found_in_long_texts():
    rng = np.random.default_rng(5)
    for _ in range(20):
        passage = letters(rng, W.K + 7)
        a, b = W.winnow([letters(rng, 5000) + passage + letters(rng, 90), letters(rng, 30) + passage])
        assert set(a[0].tolist()) & set(b[0].tolist())


def test_texts_cut_by_a_third_keep_two_thirds_of_their_choices(spark):
    rng = np.random.default_rng(7)
    sizes = (400, 800, 1600, 3000)
    rows = [(i * 2 + j, t) for i, n in enumerate(sizes) for j, t in ((1, letters(rng, n)), (0, "end"))]
    got = W.edited_fingerprints(spark.createDataFrame([(*r, "en", "9") for r in rows], SCHEMA)).collect()
    near = {r.n_chars: r.near_edited for r in got}
    assert all(0.58 < near[n] < 0.72 for n in sizes)


@pytest.mark.parametrize("window", [W.WINDOW, 100])
def test_a_fingerprint_weighs_eleven_characters_a_choice_and_loses_nothing(window):
    texts = ["", "short", "abcdefghijklm", letters(np.random.default_rng(2), 3000), "x" * 500, "é😀 word " * 100]
    made = W.winnow(texts, window=window)
    written = W.texts_of(made, window)
    for (hashes, places), fingerprint in zip(made, written):
        assert len(fingerprint) == (11 if window == W.WINDOW else 12) * len(hashes)
        got = W.choices_of(fingerprint, window)
        assert got[0].tolist() == hashes.tolist() and got[1].tolist() == places.tolist()
        assert fingerprint == W.text_of((hashes, places), window)
    ends = np.array([0, 1, 85 ** 5 - 1, 1 << 32, (1 << 64) - 1], np.uint64)
    got = W.choices_of(W.text_of((ends, np.arange(5) * 8)))
    assert got[0].tolist() == ends.tolist() and got[1].tolist() == [0, 8, 16, 24, 32]


def test_more_text_makes_more_tasks_and_moves_compressed(spark, monkeypatch):
    rows = [(i, f"text {i} of many words " * 300) for i in range(60)] + [(60, None), (None, "last")]
    docs = spark.createDataFrame([(*r, "en", "9") for r in rows], SCHEMA).repartition(3)
    def tasks(got):
        plan = got._jdf.queryExecution().executedPlan().toString()
        return max(int(x) for x in re.findall(r"hashpartitioning\(part#\d+, (\d+)\)", plan)), plan
    few, plan = tasks(W.edited_fingerprints(docs))
    monkeypatch.setattr(W, "TASK_BYTES", 20_000)
    got = W.edited_fingerprints(docs)
    many, _ = tasks(got)
    assert few == 8 and many > 15
    assert re.search(r"MapInArrow deal.*packed", plan)
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == expected(rows)
