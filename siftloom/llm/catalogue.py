"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, language_model, mixing, pii, quality_model, quality_rules, simhash, topk, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": topk.query,
    "op2_warc": warc.query,
    "op3_pii": pii.query,
    "op4_bpe": bpe.query,
    "op5_toxicity": toxicity.query,
    "op6_quality": quality_model.query,
    "op7_mixing": mixing.query,
    "op8_quality_rules": quality_rules.query,
    "op9_simhash": simhash.query,
    "op10_language_model": language_model.query,
}
ORACLE_SQL: dict[str, str] = {
    "op1_topk": topk.SQL,
    "op2_warc": warc.SQL,
    "op7_mixing": mixing.SQL,
    "op8_quality_rules": quality_rules.SQL,
}
