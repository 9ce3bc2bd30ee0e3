"""Filter interaction audit by recursive enumeration of filter orders.

Every document gets a mask, one bit a filter it fails; documents are counted
once into cells (part, mask) with their labelled good and toxic ones. What
any order of the filters does at any step follows from the cells alone: a
recursive common table expression starts at the empty prefix, extends each
prefix by every unused letter, carries the bits applied so far and joins the
part's cells, and each level of the recursion emits its step's metrics. The
325 prefixes of five letters are evaluated once a part; the 120 orders read
their five steps from them.

Filters (a document fails when the condition holds; the lengths and shares
are parameters): A too few words, B too few distinct words, C too many
capitals, D a listed symbol, E a text that a smaller doc_id has too.

At scale: the texts are read once and leave no scan task; what moves is a
row of a digest, an id and a mask a document. Groups of equal texts are
counted by part and mask before they meet, and the smallest doc_id of a text
is found among those counts, so a text that a third of the documents share
is a few rows a task. Cells (parts x 32 at most) are written before the
recursion, which therefore reads no document again.

Defined results: null texts are empty (they fail A, not B, C or D, and are
equal to each other and to empty ones); a null source is the part ''; a null
doc_id is neither smaller nor larger than another, so it never fails E, and
has no label; rows of one doc_id and text do not fail E through each other;
of several labels of a doc_id the greatest counts, null as 0; equal rows are
each a document; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.llm.common import stage

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column, words: Column) -> Column:
    """Bits of the filters that look at one text: A 1, B 2, C 4, D 8."""
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    tests = [F.size(words) < MIN_WORDS,
             100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
             100 * capitals > MAX_CAPITALS * F.length(text),
             text.rlike(SYMBOLS)]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0)).cast("int")


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask of the filters A to D)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.array_remove(F.split(text, SPACE), "").alias("words"))
    return rows.select("doc_id", "part", F.sha2("text", 256).alias("digest"),
                       text_mask(F.col("text"), F.col("words")).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask of all filters, n, good, toxic), a row a cell that has documents."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    # null ids find no label; dealt by the text, they are no hot key of the join
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0))
    rows = (masked(docs).withColumn("_spread", spread)
            .join(marks.withColumn("_spread_to", F.lit(0).cast("long")),
                  (F.col("doc_id") == F.col("_id")) & (F.col("_spread") == F.col("_spread_to")), "left"))
    kind = ["digest", "part", "mask", "good", "toxic"]
    # keyed by a struct and not by doc_id, so the join above stays free to split a hot doc_id
    rows = rows.select("digest", "part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")],
                       F.struct("doc_id").alias("who"))
    each = rows.groupBy(*kind, "who").agg(F.count("*").alias("n"))
    known = F.when(F.col("who.doc_id").isNotNull(), F.struct("who.doc_id", "n"))
    groups = each.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(known).alias("least"),
                                     F.sum(F.when(F.col("who.doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))  # a text's groups: parts x labels at most
    free = F.col("n_null") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    groups = groups.withColumn("first", first).withColumn("free", free)
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("free").alias("n")),
                   F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("free")).alias("n")))
    split = groups.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
                                             F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _over(condition: str, value: str) -> str:
    return f"aggregate(filter(c.cells, x -> {condition}), 0L, (a, x) -> a + x.{value})"


def prefixes(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, prefix, applied, step, metrics of the prefix's last filter) of
    every sequence of distinct filters, by recursion over its length."""
    spark = counted.sparkSession
    by_part = stage(counted.groupBy("part").agg(
        F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells")), "filter-cells")
    free, hit = "(x.mask & e.applied) = 0", "(x.mask & e.bit) <> 0"
    return spark.sql(f"""
        WITH RECURSIVE steps(part, prefix, applied, step, {", ".join(METRICS)}) AS (
          SELECT part, '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{by_part}}
          UNION ALL
          SELECT e.part, concat(e.prefix, e.letter), e.applied | e.bit, e.step + 1,
                 {_over(f"{free} AND NOT {hit}", "n")},
                 {_over(f"{free} AND {hit}", "n")},
                 {_over(f"NOT {free} AND {hit}", "n")},
                 {_over("x.mask = e.bit", "n")},
                 {_over(f"{free} AND {hit}", "good")},
                 {_over(f"{free} AND {hit}", "toxic")}
          FROM (SELECT part, prefix, applied, step, substr('{letters}', at + 1, 1) AS letter, shiftleft(1, at) AS bit
                FROM (SELECT *, explode(filter(sequence(0, {len(letters) - 1}), i -> (applied & shiftleft(1, i)) = 0)) AS at
                      FROM steps WHERE step < {len(letters)})) e
          JOIN {{by_part}} c ON c.part = e.part)
        SELECT * FROM steps WHERE step > 0 LIMIT ALL""", by_part=by_part)


def audit(docs: DataFrame, labels: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of all filters and step of it."""
    steps = stage(prefixes(cells(docs, labels), letters), "filter-steps")
    k = len(letters)
    left = [*accumulate(range(1, k), lambda a, b: a * b, initial=1)]  # orders that go on from a prefix, by letters left
    orders_of = F.element_at(F.array(*[F.lit(x).cast("long") for x in left]), F.lit(k + 1) - F.col("step"))
    shapley = steps.groupBy(F.col("part").alias("_part"), F.right("prefix", F.lit(1)).alias("_letter")).agg(
        F.sum(F.col("removed") * orders_of).alias("shapley"))
    orders = steps.where(F.col("step") == k).select(
        "part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    orders = orders.withColumn("prefix", F.substring("filter_order", F.lit(1), F.col("step")))
    out = orders.join(steps.drop("step", "applied"), ["part", "prefix"])
    out = out.join(shapley, (F.col("part") == F.col("_part")) & (F.right("prefix", F.lit(1)) == F.col("_letter")))
    return out.select("part", "filter_order", F.col("step").cast("int").alias("step"), *METRICS, "shapley")
