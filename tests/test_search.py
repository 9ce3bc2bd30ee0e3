"""Inverted-index search against scoring every pair."""

import math
import random
import re
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from formbook.operators import search

WORDS = [f"w{i}" for i in range(60)]


def vector(tf, df, n):
    w = {t: c * math.log((n + 1) / (df.get(t, 0) + 1)) for t, c in tf.items()}
    norm = math.sqrt(sum(x * x for x in w.values()))
    return {t: math.floor(search.SCALE * x / norm) for t, x in w.items() if x > 0}


def plain(docs, queries, k):
    def counted(rows):
        out = {}
        for i, text in rows:
            if i is not None:
                out.setdefault(i, Counter()).update(re.findall(r"\w+", (text or "").lower(), re.A))
        return out

    d, q = counted(docs), counted(queries)
    df = Counter(t for tf in d.values() for t in tf)
    vectors = {i: vector(tf, df, len(d)) for i, tf in d.items()}
    rows = []
    for qid, tf in q.items():
        qv = vector(tf, df, len(d))
        points = {i: sum(x * v.get(t, 0) for t, x in qv.items()) for i, v in vectors.items()}
        best = sorted(((-p, i) for i, p in points.items() if p > 0))[:k]
        rows += [(qid, i, (search.SCALE // 2 - p) // search.SCALE / search.SCALE, rank) for rank, (p, i) in enumerate(best, 1)]
    return sorted(rows)


def table(seed):
    rnd = random.Random(seed)
    docs = []
    for i in range(300):
        common = ["the"] if i % 3 else ["The", "the"]
        docs.append((i, " ".join(common + rnd.choices(WORDS[:20 + i % 41], k=rnd.randint(0, 30)))))
    docs += [(1000 + i, docs[i % 4][1]) for i in range(40)]  # ties: the same texts under other ids
    docs += [(2000, None), (2001, ""), (None, "w1 w2"), (5, "w59 one more row of 5"), (2002, "the")]
    queries = [(q, " ".join(rnd.choices(WORDS + ["unseen", "the"], k=rnd.randint(1, 8)))) for q in range(50)]
    queries += [(100 + i, docs[i][1]) for i in range(4)] + [(200, None), (201, "!?"), (202, "unseen"), (203, "the")]
    return docs, queries


@pytest.mark.parametrize("block_docs,seeds", [(8, 1), (64, 2), (100_000, 1)])
def test_search_equals_every_pair(spark, tmp_dir, block_docs, seeds):
    docs, queries = table(block_docs)
    index = search.build_index(spark.createDataFrame(docs, "id long, text string").repartition(5), "id", "text",
                               f"{tmp_dir}/{uuid.uuid4().hex}", block_docs)
    got = search.search(index, spark.createDataFrame(queries, "q long, ask string").repartition(3), "q", "ask", k=5,
                        seed_blocks=seeds)
    assert sorted(map(tuple, got.collect())) == plain(docs, queries, 5)


def test_bounds_prune_lists_and_candidates(spark, tmp_dir):
    """A rare word decides: blocks without it go, and its common company
    makes no candidates."""
    docs = [(i, f"common filler{i % 7} w{i % 50}" + (" rare jewel" if i in (17, 400, 811) else "")) for i in range(1000)]
    index = search.build_index(spark.createDataFrame(docs, "id long, text string"), "id", "text",
                               f"{tmp_dir}/{uuid.uuid4().hex}", 50)
    asked = spark.createDataFrame([(1, "common rare jewel filler3")], "q long, ask string")
    lists = search.list_bounds(index, search.query_terms(index, asked, "q", "ask"))
    split = search.split_lists(lists, search.thresholds(index, lists, 1, 2))
    assert split.select("block").distinct().count() <= 3 < lists.select("block").distinct().count()
    assert {r.term for r in split.where("strong").collect()} <= {"rare", "jewel"}
    assert search.candidates(index, split).count() <= 3
    every = sorted((r[0], r[1]) for r in search.search(index, asked, "q", "ask", k=3).collect())
    assert every == [(1, 17), (1, 400), (1, 811)]


def test_empty_tables(spark, tmp_dir):
    none = spark.createDataFrame([], "id long, text string")
    one = spark.createDataFrame([(1, "a b")], "id long, text string")
    empty = search.build_index(none, "id", "text", f"{tmp_dir}/{uuid.uuid4().hex}")
    assert search.search(empty, one, "id", "text", doc_id="doc").count() == 0
    full = search.build_index(one.union(one.select(F.lit(2), F.lit("c"))), "id", "text", f"{tmp_dir}/{uuid.uuid4().hex}")
    assert search.search(full, none, "id", "text", doc_id="doc").count() == 0


def test_postings_are_shuffled_by_no_search(spark, tmp_dir):
    """Postings are lists of a block, bucketed by it: one row a term and block,
    and no exchange over them in a search."""
    docs = [(i, " ".join(WORDS[(i + j) % 60] for j in range(20))) for i in range(2000)]
    index = search.build_index(spark.createDataFrame(docs, "id long, text string"), "id", "text",
                               f"{tmp_dir}/{uuid.uuid4().hex}", 100)
    lists = index.table("postings")
    assert lists.count() == lists.select("term", "block").distinct().count() < 20 * 2000 / 10
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w59")], "q long, ask string")
    got = search.search(index, asked, "q", "ask", k=5)
    lines = got._jdf.queryExecution().executedPlan().toString().split("\n")
    deep = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    read = [i for i, line in enumerate(lines) if "formbook_postings" in line]
    assert read
    for i in read:
        at = deep[i]
        for j in range(i - 1, -1, -1):
            if deep[j] < at:
                at = deep[j]
                if "Join" in lines[j] or "CoGroups" in lines[j]:
                    break
                assert "Exchange hashpartitioning" not in lines[j]
    assert sorted(map(tuple, got.collect())) == plain(docs, [tuple(r) for r in asked.collect()], 5)
