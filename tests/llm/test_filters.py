"""The filter audit against applying every order to every document."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from formbook.llm import filters

SCHEMA = "doc_id long, text string, source string, mask int, n long, part string, digest string, good int"
LABELS = "doc_id long, quality int, toxic int, mask int, part string"


def failures(rows):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({
            "A": len(ws) < 50,
            "B": 100 * len(set(ws)) < 65 * len(ws),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": doc_id is not None and doc_id > least[t]})
    return out


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    failed = failures(rows)
    out, shapley = {}, Counter()
    parts = {s or "" for _, _, s in rows}
    for order in map("".join, permutations("ABCDE")):
        for part in parts:
            own = [(r, f) for r, f in zip(rows, failed) if (r[2] or "") == part]
            gone = [False] * len(own)
            for step, letter in enumerate(order, 1):
                now = [f[letter] and not g for (_, f), g in zip(own, gone)]
                out[part, order, step] = (
                    sum(not g and not h for g, h in zip(gone, now)), sum(now),
                    sum(f[letter] and g for (_, f), g in zip(own, gone)),
                    sum(f[letter] and sum(f.values()) == 1 for _, f in own),
                    sum(h and r[0] in good for (r, _), h in zip(own, now)),
                    sum(h and r[0] in toxic for (r, _), h in zip(own, now)))
                shapley[part, letter] += sum(now)
                gone = [g or h for g, h in zip(gone, now)]
    return sorted((p, o, s, *m, shapley[p, o[s - 1]]) for (p, o, s), m in out.items())


def messy():
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(200)] + ["Aa", "é", "BIG", "x#", "\U0001F600"]
    rows = []
    for i in range(60):
        ws = rng.choice(vocab[:int(rng.integers(5, 206))], int(rng.integers(0, 120)))
        rows.append((i, rng.choice([" ", "\t", "\n "]).join(ws) + ("|" if i % 9 == 0 else ""), ["a", "b", None, "", "é"][i % 5]))
    # what stands just on and just over each line
    rows += [(100 + n, " ".join(f"u{i}" for i in range(n)), "a") for n in (49, 50, 51)]
    rows += [(110 + n, " ".join([f"u{i}" for i in range(n)] + ["u0"] * (100 - n)), "b") for n in (64, 65, 66)]
    rows += [(120 + n, "é" * (100 - n) + "A" * n, "b") for n in (4, 5, 6)]
    rows += [(200 + i, "same text " * (i // 10 + 1), ["a", "b"][i % 2]) for i in range(30)]  # copies in two parts
    rows += [(200, "same text ", "a"), (200, "same text ", "b"), (300, None, None), (301, "", "a"), (299, None, "b"),
             (None, "", "a"), (None, None, "b"), (None, "same text ", "a"), (None, "only null ids", "a"), (None, "only null ids", "a"),
             (400, "long text " * 20000, "a"), (401, "long text " * 20000, "b")]
    return [(d, None if t is None else str(t), s) for d, t, s in rows]


def test_audit(spark):
    rows = messy()
    labels = [(d, d % 3 % 2, int(d % 4 == 0)) for d in range(0, 402, 2)] + [(0, None, None), (2, 0, 1), (2, 1, 0), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2, "p", "q", 3) for r in rows], SCHEMA).repartition(4)
    marks = spark.createDataFrame([(*r, 7, "x") for r in labels], LABELS)
    out = filters.audit(docs, marks)
    assert out.columns == ["part", "filter_order", "step", *filters.METRICS, "shapley"]
    assert sorted(map(tuple, out.collect())) == plain_audit(rows, labels)


def test_empty_tables(spark):
    docs, marks = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert filters.audit(docs, marks).count() == 0
    one = spark.createDataFrame([(1, "x", "s", 0, 0, "", "", 0)], SCHEMA)
    assert filters.audit(one, marks).count() == 600


def test_more_prefixes_than_the_default_row_limit(spark):
    cells = spark.range(3200).select(F.col("id").cast("string").alias("part"), F.lit(1).alias("mask"), F.lit(1).cast("long").alias("n"),
                                     F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    assert filters.prefixes(cells).count() == 3200 * 325


def test_copies_are_counted_before_they_meet(spark):
    """A text that every row has crosses the last exchanges as one row a task."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("hot text").alias("text"), F.lit("s").alias("source"))
    got = filters.cells(docs.repartition(8), spark.createDataFrame([], LABELS)).collect()
    assert sorted((r["mask"], r["n"]) for r in got) == [(1, 1), (17, 3999)]
