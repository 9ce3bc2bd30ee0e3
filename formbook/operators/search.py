"""Text search: a stored inverted index and exact top-k by block bounds.

A text is embedded as its TF-IDF vector: term frequency times
ln((N + 1) / (df + 1)), scaled to length one. Weights are kept as whole
millionths (*impacts*), so scores are exact integer sums: equal in any
order of addition, and ties are real ties.

``build_index`` takes the documents in blocks as they lie and turns each block
into lists, a list being the documents of a block that hold a term. Lists and
not single postings go through the shuffles, and documents are numbers in
their block there. It writes

* ``lists`` (block, ids; block, term, docs, tfs): the ids of each block's
  documents, in a row of its own, and the counted terms,
* ``terms`` (term, df, idf),
* ``postings`` (term, block, docs, impacts, top): the weighted lists, so that a
  term in every document still is one bounded list a block; a table bucketed
  by block, so that a search shuffles none of it,
* ``blocks`` (term, block, top): the greatest impact of each list.

``search`` answers all queries at once, on tables only:

1. a block's bound for a query is the sum of weight x ``top``; the blocks of
   highest bound are scored whole, and the k-th best score there is the
   query's threshold;
2. blocks whose bound is below it are dropped;
3. in the others, the terms of least bound whose sum stays below the
   threshold cannot lift a document to it alone: candidates come from the
   lists of the remaining terms only, and those whose partial score cannot
   reach the threshold with all of the rest are dropped too;
4. what is left is completed from the lists of the weaker terms.

Documents at the threshold are kept, so ties are settled by id, and the
result is that of scoring every pair. Documents that share no weighted term
with a query are no answers to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from formbook.operators.textsearch import top_k
from formbook.session import apply_plan_confs

SCALE = 1_000_000
BLOCK_DOCS = 1024
BLOCK_BYTES = 16 << 20
BUCKET_BLOCKS = 8
MOST_DOCS = 1 << 15  # documents of a block are numbers of 16 bits
GROUP_ROWS = 1 << 20  # queries' terms that meet a block in one group


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf) of the lower-cased words of letters, digits and ``_``."""
    words = F.array_remove(F.split(F.lower(F.col(text_col)), r"\W+"), "")
    return (df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(words).alias("term"))
            .groupBy("id", "term").agg(F.count("*").alias("tf")))


def _impacts(weighted: DataFrame) -> DataFrame:
    """(id, term, tf, idf) -> (id, term, impact), unit length a document."""
    w = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(w * w).over(Window.partitionBy("id")))
    out = weighted.withColumn("impact", F.floor(F.try_divide(F.lit(SCALE) * w, norm)).cast("long"))
    return out.where("impact > 0").select("id", "term", "impact")


def idf_of(df: Column, documents: Column) -> Column:
    return F.log((documents + 1) / (df + 1))


@dataclass(frozen=True)
class Index:
    """A written index; ``path`` holds its tables."""

    spark: SparkSession
    path: str

    @property
    def bucketed(self) -> str:
        """Name of the postings in the session's catalog."""
        return f"formbook_postings_{hashlib.md5(self.path.encode()).hexdigest()}"

    def table(self, name: str) -> DataFrame:
        if name == "postings" and self.spark.catalog.tableExists(self.bucketed):
            return self.spark.table(self.bucketed)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def ids(self) -> DataFrame:
        """(block, doc, id) of every document."""
        return self.table("lists").where("term IS NULL").select("block", F.posexplode("ids").alias("doc", "id"))


def counted_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, terms, tfs) with one row an id: the text itself where no id
    repeats, else the counted terms."""
    known = docs.where(F.col(id_col).isNotNull())
    rows, ids = known.agg(F.count("*"), F.count_distinct(F.col(id_col))).first()
    if rows == ids:
        return known.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"),
                            F.lit(None).cast("array<string>").alias("terms"), F.lit(None).cast("array<long>").alias("tfs"))
    counts = term_counts(docs, id_col, text_col).groupBy("id").agg(F.collect_list("term").alias("terms"),
                                                                   F.collect_list("tf").alias("tfs"))
    return known.select(F.col(id_col).alias("id")).distinct().join(counts, "id", "left").select(
        "id", F.lit(None).cast("string").alias("text"), "terms", "tfs")


def slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows and ``size`` bytes of text
    (or one row)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + size, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def inverted(rows: DataFrame, block_docs: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """:func:`counted_rows` as the ``lists`` of blocks."""
    id_type = rows.schema["id"].dataType
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(to_arrow_type(id_type))), ("term", pa.string()),
                        ("docs", pa.list_(pa.int16())), ("tfs", pa.list_(pa.int32()))])

    def words_of(part: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Document, word and count of each word."""
        terms, tfs = part.column("terms"), part.column("tfs")
        if terms.null_count == len(terms):
            terms = pc.split_pattern_regex(pc.fill_null(part.column("text"), ""), r"\W+")
            tfs = None
        doc = np.repeat(np.arange(len(terms)), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
        flat = terms.flatten()
        keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        times = np.ones(len(flat), np.int64) if tfs is None else tfs.flatten().to_numpy(zero_copy_only=False)
        return doc[keep], flat.filter(pa.array(keep)), times[keep]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, min(block_docs, MOST_DOCS), block_bytes):
                n = part.num_rows
                doc, words, times = words_of(part)
                coded = words.dictionary_encode()
                key, of = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + doc, return_inverse=True)
                tf = np.bincount(of, times, len(key)).astype(np.int64)
                starts = np.flatnonzero(np.diff(key // n, prepend=-1))
                cuts = pa.array(np.append(starts, len(key)), pa.int32())
                held = len(starts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([block]), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column("id"), type=schema.field("ids").type),
                    *[pa.nulls(1, f.type) for f in list(schema)[2:]]], schema=schema)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(held, block)), pa.nulls(held, schema.field("ids").type),
                    coded.dictionary.take(pa.array(key[starts] // n)).cast(pa.string()),
                    pa.ListArray.from_arrays(cuts, pa.array(key % n, pa.int16())),
                    pa.ListArray.from_arrays(cuts, pa.array(tf, pa.int32()))], schema=schema)
                block += 1

    return rows.mapInArrow(make, f"block long, ids array<{id_type.simpleString()}>, term string, docs array<smallint>, tfs array<int>")


def weighted(block: pa.Table) -> pa.Table:
    """The postings of one block from its lists and the terms' idf: impacts
    at unit length a document, lists without any left out."""
    block = block.combine_chunks().sort_by("term")
    docs, tfs = block.column("docs").combine_chunks(), block.column("tfs").combine_chunks()
    sizes = pc.list_value_length(docs).to_numpy(zero_copy_only=False)
    doc = docs.flatten().to_numpy(zero_copy_only=False)
    w = tfs.flatten().to_numpy(zero_copy_only=False) * np.repeat(block.column("idf").to_numpy(), sizes)
    norm = np.sqrt(np.bincount(doc, w * w))
    impact = np.floor(np.divide(SCALE * w, norm[doc], out=np.zeros(len(w)), where=norm[doc] > 0)).astype(np.int64)
    keep = impact > 0
    of = np.repeat(np.arange(len(sizes)), sizes)[keep]
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    cuts, impact, rows = pa.array(np.append(starts, len(of)), pa.int32()), impact[keep], of[starts]
    top = np.maximum.reduceat(impact, starts) if len(starts) else impact
    return pa.table({
        "term": block.column("term").take(rows), "block": block.column("block").take(rows),
        "docs": pa.ListArray.from_arrays(cuts, pa.array(doc[keep], pa.int16())),
        "impacts": pa.ListArray.from_arrays(cuts, pa.array(impact, pa.int32())), "top": pa.array(top)})


def build_index(docs: DataFrame, id_col: str, text_col: str, path: str, block_docs: int = BLOCK_DOCS) -> Index:
    """Write the index of ``docs`` to ``path`` (rows of one id are one
    document, null ids are left out, null texts are empty)."""
    spark = docs.sparkSession
    index = Index(spark, path)
    inverted(counted_rows(docs, id_col, text_col), block_docs).write.parquet(f"{path}/lists")
    (index.table("lists").where("term IS NULL")
     .agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("documents"), F.count("*").alias("blocks")).write.parquet(f"{path}/size"))
    size = index.table("size")
    lists = index.table("lists").where("term IS NOT NULL").select("block", "term", "docs", "tfs")
    (lists.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
     .select("term", "df", idf_of(F.col("df"), size.select("documents").scalar()).alias("idf"))
     .write.parquet(f"{path}/terms"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size.first()["blocks"] // BUCKET_BLOCKS)
    postings = (lists.join(index.table("terms"), "term").repartition(buckets, "block").groupBy("block").applyInArrow(
        weighted, "term string, block long, docs array<smallint>, impacts array<int>, top long"))
    postings.write.bucketBy(buckets, "block").option("path", f"{path}/postings").saveAsTable(index.bucketed)
    index.table("postings").select("term", "block", "top").write.parquet(f"{path}/blocks")
    return index


def query_terms(index: Index, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(qid, term, weight) of the queries' terms; words no document has weigh
    in a query's length only."""
    documents = index.table("size").select("documents").scalar()
    counts = term_counts(queries, id_col, text_col).join(index.table("terms").select("term", "df"), "term", "left")
    weighted = counts.withColumn("idf", idf_of(F.coalesce("df", F.lit(0)), documents))
    return _impacts(weighted).select(F.col("id").alias("qid"), "term", F.col("impact").alias("weight"))


def list_bounds(index: Index, terms: DataFrame) -> DataFrame:
    """(qid, block, term, weight, bound) of every list that a query may read."""
    return terms.join(index.table("blocks"), "term").select(
        "qid", "block", "term", "weight", (F.col("weight") * F.col("top")).alias("bound"))


def thresholds(index: Index, lists: DataFrame, k: int, seed_blocks: int) -> DataFrame:
    """(qid, threshold): the k-th best score among each query's
    ``seed_blocks`` blocks of highest bound."""
    bounds = lists.groupBy("qid", "block").agg(F.sum("bound").alias("bound"))
    seeds = top_k(bounds, ["qid"], [F.desc("bound"), F.col("block")], seed_blocks).select("qid", "block")
    scored = (lists.join(seeds, ["qid", "block"]).join(index.table("postings").drop("top"), ["term", "block"])
              .select("qid", "block", "weight", F.inline(F.arrays_zip("docs", "impacts")).alias("doc", "impact"))
              .groupBy("qid", "block", "doc").agg(F.sum(F.col("weight") * F.col("impact")).alias("score")))
    best = top_k(scored, ["qid"], [F.desc("score"), F.col("block"), F.col("doc")], k)
    return (best.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            .select("qid", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(0)).alias("threshold")))


def split_lists(lists: DataFrame, limits: DataFrame) -> DataFrame:
    """The lists of the blocks that can reach their query's threshold, with
    ``strong`` (its documents are candidates) and ``weak`` (bound of all
    lists of the block that are not strong)."""
    of = Window.partitionBy("qid", "block")
    out = lists.join(limits, "qid").withColumn("whole", F.sum("bound").over(of)).where("whole >= threshold")
    upto = F.sum("bound").over(of.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("strong", upto >= F.col("threshold"))
    return out.withColumn("weak", F.sum(F.when(~F.col("strong"), F.col("bound")).otherwise(0)).over(of))


def reached(index: Index, split: DataFrame, whole: bool, parts: Column | None = None) -> DataFrame:
    """(qid, block, doc, score): documents that can still reach the threshold,
    with their score by strong lists or by all. The lists that the queries
    read in a block meet its postings there; ``parts`` deals the queries."""
    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        asked = asked.sort_by([("qid", "ascending"), ("strong", "descending")])
        at = pc.index_in(asked.column("term"), held.column("term").combine_chunks()).to_pylist()
        docs, impacts = held.column("docs").combine_chunks(), held.column("impacts").combine_chunks()
        cuts = np.append(0, np.cumsum(pc.list_value_length(docs).to_numpy(zero_copy_only=False))).astype(np.int64).tolist()
        docs, impacts = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (docs, impacts))
        weight, strong = asked.column("weight").to_pylist(), asked.column("strong").to_pylist()
        limit = (asked.column("threshold").to_numpy() - asked.column("weak").to_numpy()).tolist()
        starts = np.flatnonzero(np.diff(asked.column("qid").combine_chunks().dictionary_encode().indices.to_numpy(), prepend=-1)).tolist()
        out = [(np.zeros(0, np.int64),) * 3]
        for first, last in zip(starts, [*starts[1:], len(at)]):
            score, found = np.zeros(MOST_DOCS, np.int64), None
            for i in range(first, last):
                if found is None and not strong[i]:
                    found = np.flatnonzero((score > 0) & (score >= limit[first]))
                if found is not None and not (whole and len(found)):
                    break
                if at[i] is not None:
                    own = slice(cuts[at[i]], cuts[at[i] + 1])
                    score[docs[own]] += weight[i] * impacts[own]
            if found is None:
                found = np.flatnonzero((score > 0) & (score >= limit[first]))
            out.append((np.full(len(found), first), found, score[found]))
        rows, doc, points = (np.concatenate(x) for x in zip(*out))
        return pa.table({"qid": asked.column("qid").take(pa.array(rows, pa.int64())),
                         "block": asked.column("block").take(pa.array(rows, pa.int64())),
                         "doc": pa.array(doc, pa.int32()), "score": pa.array(points, pa.int64())})

    parts = F.lit(1) if parts is None else parts
    asked = split.select("qid", "block", "term", "weight", "strong", "weak", "threshold",
                         F.pmod(F.xxhash64("qid"), parts).cast("int").alias("part"))
    held = index.table("postings").select("term", "block", "docs", "impacts", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(
        meet, f"qid {split.schema['qid'].dataType.simpleString()}, block long, doc int, score long")


def candidates(index: Index, split: DataFrame) -> DataFrame:
    """The documents that :func:`reached` finds, by strong lists only."""
    return reached(index, split, whole=False)


def search(index: Index, queries: DataFrame, query_id: str, query_text: str, k: int = 5, doc_id: str = "id",
           seed_blocks: int = 2) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` documents nearest to each
    query by cosine, shown in millionths, ties by id. Rows of one query id
    are one query."""
    apply_plan_confs(index.spark)  # else the postings would be shuffled by all keys
    terms = query_terms(index, queries, query_id, query_text)
    lists = list_bounds(index, terms)
    parts = terms.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / GROUP_ROWS)).cast("int").alias("n")).scalar()
    split = split_lists(lists, thresholds(index, lists, k, seed_blocks))
    whole = (reached(index, split, whole=True, parts=parts).withColumnRenamed("score", "points")
             .join(index.ids(), ["block", "doc"]))
    best = top_k(whole, ["qid"], [F.desc("points"), F.col("id")], k, rank_col="rank")
    score = F.expr(f"(points + {SCALE // 2}L) div {SCALE}L") / F.lit(float(SCALE))
    return best.select(F.col("qid").alias(query_id), F.col("id").alias(doc_id), score.alias("score"),
                       F.col("rank").cast("bigint").alias("rank"))
