"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read back as the next one's ``docs``; all but the
last return the columns of documents, whatever these are called.

Defined results of all stages: an empty table gives no rows; null texts are
empty and stay null; null doc_ids rank above all others; equal rows are each
a document, but for the near-duplicate stage, where they are a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from formbook.llm import bestfit, mixing, simhash, substring, toxicity
from formbook.llm.common import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; labels only train it.
    Null and empty texts score as texts without passages."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that of the smallest doc_id,
    of equal ids the one with the least hash of its text. Null, empty and
    blank texts are one group."""
    return simhash.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a smaller doc_id has too go. A text without
    such passages stays as it is; one that loses words has the rest joined
    by single blanks, n_chars with it."""
    return substring.clean(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights, documents repeated where it
    takes that; texts without words have no size and are in no mix. A null
    source is a source, the last."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document and their places in sequences; a text
    longer than a sequence is cut, an empty one is its end mark."""
    return bestfit.digest(docs, cache_words=150_000)  # workers also hold what earlier stages left


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("bestfit_packing", pack_sequences),
]

#: Toxicity is learned and token ids come from a tokenizer: no SQL for these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
