"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document joins its source's queue in shuffled order. Its
virtual finish time is the source's words up to and with it, divided by the
source's target; the mix is all copies sorted by finish time, cut where
their words reach the budget, so all sources advance in step with their
targets. A source may be read ``epochs`` times, a target stops there, and
what is above is shared out again by weight until no target is above.

The order within a source and the global order are both range-sorted with
running sums by range (a source with a third of all rows is many ranges);
only (id, source, size) rows move, no text.

Defined results: null texts have size 0; null sources are one source, last;
sources without words have target 0; equal rows are each a document; rows
of one doc_id that differ anywhere are different documents; an empty table
gives no rows. Reruns agree: the shuffle is by a hash of the doc_id, then
the doc_id, then the text (in ``mix``: the whole row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.llm.common import running_sum, set_aside, stage

WEIGHTS = (5, 2, 1)
EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) of every source."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    sums = sums.withColumn("last", F.col("source").isNull())
    ranks = running_sum(sums, [], ["last", "source"], "one", "rank", "sources")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                          ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranks = stage(ranks.select("source", "source_size", weight.alias("w")), "targets")
    total, left = ranks.agg(F.sum("source_size"), F.sum("w")).first()
    total, left, full = int(total or 0), int(left or 0), 0
    most = F.col("source_size") * epochs
    while True:  # the share a weight buys only rises, so this ends
        above = F.col("w") * F.lit(total - full) > most * F.lit(left)
        now = ranks.agg(F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("w")))).first()
        if (int(now[0] or 0), int(now[1] or 0)) == (full, left) or not left:
            break
        full, left = int(now[0] or 0), int(now[1] or 0)
    share = (F.col("w") * F.lit(total - full)).cast("double") / F.lit(float(left or 1))
    return ranks.select("source", "source_size", F.when(above, most.cast("double")).otherwise(share).alias("target"))


def schedule(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS,
             key: Column | None = None) -> DataFrame:
    """(doc_id, source, row_key, size, source_size, target, copies): one row
    a document, with how often the mix takes it. ``key``: settles the order
    of rows of one doc_id, a hash of the text by default."""
    key = F.xxhash64("text") if key is None else key
    rows = stage(docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), key.alias("row_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("shuffle")), "sizes")
    goal = stage(targets(rows, weights, epochs), "goals")
    order = ["shuffle", "doc_id", "row_key"]
    queued = running_sum(rows, ["source"], order, "size", "before", "queues")
    queued = queued.join(goal.withColumnRenamed("source", "_source"),
                         queued.source.eqNullSafe(F.col("_source"))).drop("_source")
    queued = stage(queued, "queued")

    def finish(epoch):
        words = F.col("before") + F.col("source_size") * epoch
        return F.when(F.col("target") > 0, words / F.col("target")).otherwise(F.lit(0.0))

    copies = queued.select("size", "shuffle", F.posexplode(
        F.array(*[finish(F.lit(e)) for e in range(epochs)])).alias("epoch", "finish")).where("size > 0")
    mixed = running_sum(copies, [], ["finish", "shuffle", "epoch"], "size", "taken", "mix")
    budget = queued.agg(F.sum("size")).first()[0] or 0
    end = mixed.where(F.col("taken") <= F.lit(budget)).agg(F.max(F.struct("finish", "shuffle", "epoch"))).first()[0]
    taken = F.lit(0)
    for e in range(epochs if end else 0):
        key = F.struct(finish(F.lit(e)).alias("finish"), F.col("shuffle"), F.lit(e).alias("epoch"))
        taken = taken + (key <= F.struct(F.lit(end["finish"]), F.lit(end["shuffle"]), F.lit(end["epoch"]))).cast("int")
    return queued.select("doc_id", "source", "row_key", "size", "source_size", "target", taken.alias("copies"))


def digest(docs: DataFrame) -> DataFrame:
    return schedule(docs).select("doc_id", "size", "source_size", "target",
                                 (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The documents of the mix, each as often as it takes them, with all
    their columns whatever these are called. Rows are told apart by all of
    their columns; only rows equal in every one stand for each other."""
    plain, back = set_aside(docs, "doc_id", "source", "text")
    rest = F.to_json(F.struct(*[c for c in plain.columns if c != "text"], F.isnull("text").alias("_no_text")))
    own = plain.withColumn("_row", F.sha2(F.concat(rest, F.coalesce("text", F.lit(""))), 256))
    times = (schedule(own, weights, epochs, F.col("_row")).groupBy("row_key").agg(F.sum("copies").alias("_copies"))
             .where("_copies > 0"))
    taken = own.dropDuplicates(["_row"]).join(times, F.col("_row") == F.col("row_key"))
    return back(taken.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies")))))
