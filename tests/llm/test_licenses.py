"""License places against a comparison at every word of every text."""

import math

import numpy as np
import pytest

from formbook.llm import licenses
from formbook.llm.licenses import TEMPLATES, Template, words_of


def plain_places(texts, templates):
    """[(text, template, start, share)] by trying every start."""
    split = [words_of(t or "") for t in texts]
    n = len(texts)
    df = {w: sum(w in s for s in map(set, split)) for t in templates for w in t.words()}
    idf = {w: math.log1p((n + 1) / (c + 1)) for w, c in df.items()}
    out = []
    for d, ws in enumerate(split):
        for t, template in enumerate(templates):
            own = template.words()
            keys = [range(i, i + len(k)) for k in map(words_of, template.keys) for i in range(len(own)) if own[i:i + len(k)] == k]
            for start in range(-len(own) + 1, len(ws)):
                same = [0 <= start + i < len(ws) and ws[start + i] == w for i, w in enumerate(own)]
                share = sum(idf[w] for w, s in zip(own, same) if s) / sum(map(idf.get, own))
                if share >= template.share - 1e-9 and all(same[i] for k in keys for i in k):
                    out.append((d, t, start, round(share, 6)))
    return out


def messy(rng, count=150):
    vocab = sorted({w for t in TEMPLATES for w in t.words()}) + ["foo", "é", "λx", "q9", "of", "the"]
    out = []
    for _ in range(count):
        ws = list(rng.choice(vocab, int(rng.integers(0, 30))))
        for _ in range(int(rng.integers(0, 4))):
            own = TEMPLATES[int(rng.integers(0, len(TEMPLATES)))].words()
            own = [w if rng.random() > 0.06 else "zz" for w in own][int(rng.integers(0, 2)):]
            ws += own + list(rng.choice(vocab, int(rng.integers(0, 6))))
        seps = [" ", ".", "\n", "-", " (", "_"]
        out.append("".join((w.upper() if rng.random() < 0.1 else w) + seps[int(rng.integers(0, 6))] for w in ws))
    return out


FIXED = [None, "", "...", "The MIT License. THE MIT LICENSE!", "mit\x00license", "general public general public license license",
         "apache license " * 4000, "mit", "License MIT", "mitlicense mit licensé", "Licensed under CC BY-NC 4.0.",
         "Licensed under CC BY 4.0.", "apache_license",
         "program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
         "as published by the Free Software Foundation"]


@pytest.fixture(scope="module")
def frame(spark):
    texts = FIXED + messy(np.random.default_rng(8))
    rows = [(i, t, 1, "x", 0.5) for i, t in enumerate(texts)] + [(None, "mit license", 1, "x", 0.5), (3, FIXED[3], 1, "x", 0.5)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, places int, labels string, score double").repartition(3)


def test_all_places(frame):
    rows, df = frame
    want = plain_places([r[1] for r in rows], TEMPLATES)
    got = [(str(r.doc_id), r.n_words, p.template, p.start, round(p.share, 6)) for r in licenses.scan(df).collect() for p in r.places]
    assert sorted(got) == sorted((str(rows[d][0]), len(words_of(rows[d][1] or "")), t, s, x) for d, t, s, x in want)
    assert {t for _, t, _, _ in want} == set(range(len(TEMPLATES)))
    assert any(s < 0 for _, _, s, _ in want) and any(x < 1 for *_, x in want)


def test_digest(frame, spark):
    rows, df = frame
    got = licenses.digest(df).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        ws = words_of(text[r.doc_id] or "")
        base = {p.label: [i for i in range(len(ws)) if ws[i:i + len(p.words())] == p.words()] for p in licenses.BASE}
        starts = sorted(i for at in base.values() for i in at)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (
            len(ws), len(starts), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted(k for k, at in base.items() if at))
        labels = r.labels.split(",") if r.labels else []
        assert labels == sorted(set(labels)) and {k for k, at in base.items() if at} <= set(labels)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)
    by = {r.doc_id: r for r in got}
    assert by[10].labels == "cc-by-nc" and by[11].labels == "cc-by" and by[6].n_base == 4000
    empty = licenses.digest(spark.createDataFrame([], df.schema))
    assert empty.count() == 0


def test_own_templates(spark):
    """Repeated words, one-word templates and a template no text has."""
    own = (Template("r", "a b a b a", ("b a",), 0.6), Template("one", "zap", (), 1.0), Template("none", "never here", (), 0.5))
    texts = ["a b a b a", "a b x b a", "x b a", "zap ZAP", "b a b a b a b a", "here", None]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), own).collect()
    assert sorted((r.doc_id, p.template, p.start, round(p.share, 6)) for r in got for p in r.places) == sorted(
        plain_places(texts, own))


def test_small_slices_find_the_same():
    """Look-ups of a very common rare word, some words at a time."""
    vocabulary = licenses.Vocabulary(TEMPLATES)
    ids = np.array([vocabulary.number["mit"], vocabulary.number["license"], -1] * 500, np.int64)
    first = np.array([0, 0, 700, 1500])
    index = licenses.Index(TEMPLATES, vocabulary, 3, np.ones(len(vocabulary.words), np.int64))
    whole = index.look_up(ids, first)
    assert len(whole) == 499 and whole == index.look_up(ids, first, 5)
