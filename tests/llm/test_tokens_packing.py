"""Token ids, both packings, and their edge cases."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from formbook.llm import bestfit, bfd
from formbook.llm.tokens import Encoder, default_tokenizer

SCHEMA = "doc_id long, text string, length string, piece int"
TEXTS = ["", None, " \t\n", "The cat's 12 hats... AND more", " ", "é İstanbul ÉÀ ﬁ क़ 1st", "word " * 5000,
         "x" * 300, "a\x0bb\x0cc\rd", "same text", "same text", "don't <|endoftext|> we'll"]


def expected(texts):
    tokenizer = Tokenizer.from_file(default_tokenizer())
    return [[*e.ids, 1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("cache", [0, 3, 10_000])
def test_encoder_equals_the_tokenizer(cache):
    encoder = Encoder(default_tokenizer(), cache)
    for _ in range(2):
        got = encoder.encode([(t or "").encode() for t in TEXTS])
        assert [np.frombuffer(g, encoder.dtype).tolist() for g in got] == [e[:-1] for e in expected(TEXTS)]


def frame(spark, texts):
    return spark.createDataFrame([(i if i else None, t, "clash", 7) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def test_best_fit(spark):
    rows = bestfit.digest(frame(spark, TEXTS)).collect()
    want = expected(TEXTS)
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id or 0].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, ids in enumerate(want):
        assert sorted(got[i]) == [(k, s, len(ids[s:s + 4096]), zlib.crc32(np.array(ids[s:s + 4096], "<u4").tobytes()))
                                  for k, s in enumerate(range(0, len(ids), 4096))]
    for parts in map(sorted, sequences.values()):
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
        assert sum(n for _, n in parts) <= 4096


def test_open_bins_are_bounded_and_best_fit():
    bins = bestfit.OpenBins(10, 2)
    assert [bins.put(n) for n in (7, 6, 3, 4)] == [(0, 0), (1, 0), (0, 7), (1, 6)]
    assert bins.open == 0
    bins = bestfit.OpenBins(10, 2)
    for n in (9, 8, 7, 6):
        bins.put(n)
        assert bins.open <= 2
    assert bins.put(3) == (2, 7)  # the fuller ones were closed


def test_bins_against_a_plain_search():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 101, 500).tolist()
    bins, free = bestfit.OpenBins(100, 1000), []
    for n in lengths:
        fits = [f for f in free if f >= n]
        at, offset = bins.put(n)
        assert (offset == 0) == (not fits)
        if fits:
            assert 100 - offset == min(fits)
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(100 - n)
    plain = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(plain) if f >= n]
        if fits:
            plain[min(fits, key=lambda i: plain[i])] -= n
        else:
            plain.append(100 - n)
    made = bfd.best_fit_decreasing(lengths, 100)
    assert len(made) == len(plain) and sorted(sum(made, [])) == list(range(500))
    assert all(sum(lengths[i] for i in b) <= 100 for b in made)


def test_matrices_give_the_ids_back(spark):
    back = defaultdict(dict)
    for r in bfd.packed(frame(spark, TEXTS)).collect():
        ids = np.frombuffer(r.ids, r.dtype)
        assert len(ids) == 4096 and not ids[r.length:].any() and r.cu_seqlens[-1] == r.length
        assert r.position_resets == r.cu_seqlens[:-1]
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            back[d or 0][s] = ids[a:b].tolist()
    assert [sum((back[i][s] for s in sorted(back[i])), []) for i in range(len(TEXTS))] == expected(TEXTS)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bestfit.digest(empty).count() == 0 and bfd.packed(empty).count() == 0
