"""A corpus pipeline of five stages over `documents`; each stage's rows are written and read again.

A stage takes (spark, docs, sf_dir) and works on all rows of docs, whatever earlier stages made of them.
All but the last keep docs' columns, further ones with any names too. Null texts count as empty, rows are
told apart by key and text where keys are null or repeated, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigmill.llm import exact_dedup, jaccard, mixing, packing, toxicity
from sigmill.llm.common import table, written
from sigmill.llm.queries import vocabulary


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, trained on the labels that are not held out, scores 0.3 or more.
    Without labels to learn from, nothing goes."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that are equal but for ASCII white space: the longest, then the smallest key."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group that pairs of texts with a Jaccard similarity of 0.8 (sets of 5-word shingles) connect: the
    smallest key. Texts without words are one group."""
    return jaccard.near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents 0 to 2 times, so that each source's words come near its share; a source without words has none."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [("toxicity", clean), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: Trained scores and hashed draws have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
