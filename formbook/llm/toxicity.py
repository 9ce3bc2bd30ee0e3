"""Toxic passages by maximum-scoring segments.

Learning. Of the labelled documents (``max_docs`` at most, by hash of
doc_id; equal texts once) the words' document counts by class give log-odds
with an informative Dirichlet prior, alpha proportional to a word's count in
both classes together; a word whose log-odds lie ``z`` deviations above zero
scores its log-odds less one deviation, any other word a small loss, so that
clean text loses on average.

Scanning. One linear pass over a text's words finds all maximal scoring
segments (Ruzzo and Tompa). Under the clean word distribution the best score
S of L words has an extreme-value law: lambda S - ln L - mu is standard
Gumbel, lambda solving E[exp(lambda s)] = 1 and mu fitted to clean texts.
Segments significant by it are the toxic passages. A text's strongest
segment and the sum of its significant ones enter a logistic calibration,
fitted on labelled documents that gave no word counts.

Defined results: null and empty texts have no passage and the score of such;
labels that are null or without a document are ignored; of several labels of
one doc_id the greatest counts; without both classes among the labels no
word scores and every score is the share of toxic labels; equal rows are
scored each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.llm.common import chunks, record_batch, set_aside, stage

MAX_DOCS = 20_000
Z = 1.96
SIGNIFICANT = 0.05
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def segments(hits: list[tuple[int, float]], loss: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text
    whose words at ``hits`` (position, score) gain and all others lose
    ``loss``."""
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum up to the end
    gained = 0.0
    for n, (at, score) in enumerate(hits):
        before = gained - loss * (at - n)
        gained += score
        first, upto = at, before + score
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][2] >= before:
                k -= 1
            if k < 0 or found[k][3] >= upto:
                break
            first, before = found[k][0], found[k][2]
            del found[k:]
            k -= 1
        found.append((first, at, before, upto))
    return [(a, b, upto - before) for a, b, before, upto in found]


def solve_lambda(scores: np.ndarray, share: np.ndarray, loss: float) -> float:
    """Positive root of E[exp(lambda s)] = 1."""
    rest = max(0.0, 1.0 - share.sum())

    def over(x: float) -> bool:
        return float((share * np.exp(np.minimum(x * scores, 700))).sum() + rest * math.exp(-x * loss)) > 1

    lo, hi = 0.0, 1.0
    while not over(hi) and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if over(mid) else (mid, hi)
    return hi


class Model:
    """Word scores, the extreme-value law and the calibration."""

    def __init__(self, scores: dict[str, float], loss: float, scale: float, prior: float):
        self.scores, self.loss, self.scale, self.mu = scores, loss, scale, 0.0
        self.weights = np.array([math.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0, 0.0, 0.0])
        self.share = prior

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """(first word, last word, standard Gumbel deviate) of each segment."""
        words = words_of(text)
        get = self.scores.get
        hits = [(i, s) for i, s in enumerate(map(get, words)) if s is not None]
        shift = math.log(len(words) + 1) + self.mu
        return [(a, b, self.scale * s - shift) for a, b, s in segments(hits, self.loss)]

    def features(self, found: list[tuple[int, int, float]], words: int = 0) -> tuple[float, float]:
        best = max([e for _, _, e in found], default=-5.0)
        line = -math.log(-math.log1p(-SIGNIFICANT))
        return max(-5.0, min(best, 50.0)) / 5, math.log1p(sum(e for _, _, e in found if e > line))

    def score(self, found: list[tuple[int, int, float]]) -> float:
        if not self.scores:
            return self.share
        x = float(self.weights @ np.array([1.0, *self.features(found)]))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def calibrate(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Logistic regression with a Gaussian prior about ``start``, by Newton's
    method."""
    w = start.copy()
    pull = np.array([0.05, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) + pull * (w - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", max_docs: int = MAX_DOCS,
          z: float = Z) -> Model:
    """Fit on the labelled documents for which ``usable`` (an expression of
    ``doc_id``) holds."""
    ids = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
           .where(usable & F.col("y").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
    sample = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
                   .join(F.broadcast(ids), "doc_id").withColumn("h", F.xxhash64("text"))
                   .groupBy("h").agg(F.max(F.struct("y", "text")).alias("r")).select("h", "r.*"), "labelled")
    held = F.pmod(F.col("h"), F.lit(4)) == 0  # calibrates
    total = {bool(r[0]): r[1] for r in sample.groupBy(F.col("y") > 0).count().collect()}
    share = total.get(True, 0) / max(1, sum(total.values()))
    if not total.get(True) or not total.get(False):
        return Model({}, 1.0, 1.0, share)

    schema = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(batches):
        for batch in chunks(batches):
            of = (Counter(), Counter())
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                of[y > 0].update(set(words_of(text)))
            both = list(of[0].keys() | of[1].keys())
            if both:
                yield record_batch(schema, [both, [of[1][w] for w in both], [of[0][w] for w in both]])

    counts = stage(sample.where(~held).mapInArrow(count, "word string, toxic long, clean long")
                   .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "word-counts")
    n_toxic, n_clean = (float(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    if not n_toxic or not n_clean:
        return Model({}, 1.0, 1.0, share)
    a0 = 0.1 * (n_toxic + n_clean)
    alpha = (F.col("toxic") + F.col("clean")) * 0.1
    in_toxic, in_clean = F.col("toxic") + alpha, F.col("clean") + alpha
    odds = (F.log(in_toxic / (F.lit(n_toxic + a0) - in_toxic)) - F.log(in_clean / (F.lit(n_clean + a0) - in_clean)))
    spread = F.sqrt(1 / in_toxic + 1 / in_clean)
    top = (counts.select("word", odds.alias("odds"), spread.alias("spread"), (in_clean / F.lit(n_clean + a0)).alias("share"))
           .where(F.col("odds") > z * F.col("spread")).withColumn("score", F.col("odds") - F.col("spread"))
           .orderBy("word").collect())  # of the words of max_docs documents
    scores = np.array([r["score"] for r in top])
    shares = np.array([r["share"] for r in top])
    loss = 0.05 + 2 * float((scores * shares).sum())
    scale = solve_lambda(scores, shares, loss) if len(scores) else 1.0
    model = Model({r["word"]: r["score"] for r in top}, loss, scale, share)

    rows = pa.schema([("y", pa.int32()), ("best", pa.float64()), ("e", pa.list_(pa.float64()))])

    def measure(batches):
        for batch in chunks(batches):
            found = [[e for _, _, e in model.passages(t)] for t in batch.column("text").to_pylist()]
            yield record_batch(rows, [batch.column("y"), [max(f, default=float("nan")) for f in found], found])

    # a bounded sample again: at most max_docs rows of a few numbers
    seen = sample.where(held).mapInArrow(measure, "y int, best double, e array<double>").collect()
    null = np.array([r["best"] for r in seen if not r["y"] and not math.isnan(r["best"])])
    if len(null) > 1:
        model.mu = float(-np.log(np.mean(np.exp(-np.clip(null, -50, 50)))))
    x, y = [], []
    for r in seen:
        x.append((1.0, *model.features([(0, 0, e - model.mu) for e in r["e"]])))
        y.append(float(r["y"] > 0))
    start = np.array([model.weights[0], 1.0, 1.0])
    model.weights = calibrate(np.array(x).reshape(-1, 3), np.array(y), start) if x else start
    return model


def scored(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, predicted, n_passages, passages, *carry); a passage
    is a range of words and its significance. ``carry`` are columns of
    ``docs`` whose names are not among the first five."""
    line = -math.log(-math.log1p(-SIGNIFICANT))
    passage = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("p_value", pa.float64())])
    fields = [docs.schema[c] for c in carry]

    def make(batches):
        for batch in chunks(batches):
            score, shown = [], []
            for text in batch.column("text").to_pylist():
                found = model.passages(text)
                score.append(model.score(found))
                shown.append([{"first": a, "last": b, "p_value": -math.expm1(-math.exp(-e))} for a, b, e in found if e > line])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()),
                 pa.array([len(s) for s in shown], pa.int32()), pa.array(shown, pa.list_(passage)),
                 *[batch.column(c) for c in carry]],
                ["doc_id", "score", "predicted", "n_passages", "passages", *carry])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *dict.fromkeys(["text", *carry])).mapInArrow(
        make, "doc_id long, score double, predicted int, n_passages int,"
              "passages array<struct<first:int,last:int,p_value:double>>"
              + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in fields))


def in_training() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, learn(docs, labels, in_training()))
    return out.select("doc_id", (~F.coalesce(in_training(), F.lit(True))).alias("held_out"), "score", "predicted", "n_passages")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject, with all their columns
    whatever these are called."""
    plain, back = set_aside(docs, "doc_id", "text")
    others = tuple(c for c in plain.columns if c != "doc_id")
    return back(scored(plain, learn(plain, labels, in_training()), others).where("predicted = 0"))
