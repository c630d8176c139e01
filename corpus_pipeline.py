"""From raw documents to token ids: the training-data operators as one pipeline.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; what it returns is written as Parquet and read again as
the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftloom.llm import bpe, mixing, near_copies, pii, quality_rules
from siftloom.llm.common import table, write_shared


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail by their own words nor by their host's verdicts.

    Null and empty texts have no words and go; a null source is a host; repeated rows are judged each, ids are not looked at.
    """
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the least id: five-word shingles, Jaccard similarity 0.8 or more.

    Found by the bit-sliced SimHash search and verified on whole sets. Documents without id stay where their class has no other; repeated rows
    are one document; null and empty texts are one class.
    """
    return near_copies.keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked and revealing terms generalised or removed; n_chars follows.

    Null texts stay null; rows without id, with shared ids and repeated rows all stay.
    """
    return pii.sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, never, once or twice.

    A null source is a source; empty texts take their turn; repeated rows have a turn each.
    """
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, with digests of the ids and of what they decode to; null and empty texts have no ids. Every row comes back."""
    return bpe.encode_documents(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", mixture),
    ("BPE", token_ids),
]

#: Shingle hashes and merges are beyond SQL: the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_shared(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
