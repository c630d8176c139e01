"""Labelled rows: what a classifier may learn from, and a bounded sample of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most; more of them are sampled by the hash of their id.
SAMPLE = 20_000


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; a null id is none of them."""
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE) -> DataFrame:
    """``(doc_id, text, label 0/1)`` of at most ``limit`` labelled ids outside the held-out fold.

    The sampled ids, bounded by ``limit``, are broadcast: the texts are not shuffled. An id with several labels takes the highest.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
