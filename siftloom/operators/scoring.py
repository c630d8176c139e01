"""Candidates for fields and how they are scored, chosen and explained.

A candidate is a row ``page_id, rank, record_ix, ord, name, value, source, selector, node_id, signals``; ``signals`` is an array of
``(name, weight, detail)`` and the confidence their sum, from 0 to 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..shared import apart

RECORD = ("page_id", "rank", "record_ix")
CONSISTENT, INCONSISTENT, SHARE, LOW_SHARE = 0.16, -0.12, 0.8, 0.35
SIGNAL = "struct<name:string,weight:double,detail:string>"


def signal(name: str | Column, weight: float | Column, detail: Column | str = "") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(name).alias("name"), lit(weight).cast("double").alias("weight"), F.coalesce(lit(detail), F.lit("")).alias("detail"))


def base_signal(source: Column | str) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in L.SOURCES.items() for x in kv])
    source = source if isinstance(source, Column) else F.lit(source)
    return signal(F.concat(F.lit("source: "), source), F.element_at(weights, source))


def source_rank(source: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, L.SOURCES)), source)


def confidence(signals: Column) -> Column:
    total = F.aggregate(signals, F.lit(0.0), lambda acc, s: acc + s["weight"])
    return F.round(F.greatest(F.lit(0.0), F.least(total, F.lit(1.0))), 4)


def score(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("confidence", confidence(F.col("signals")))


def apply_consistency(candidates: DataFrame) -> DataFrame:
    """A field that most records of a collection hold at one selector gains, one that few hold there loses."""
    # Counted per record first, so that a collection of any size is a few partial sums; the counts are joined back by what they count.
    each = candidates.groupBy("page_id", "rank", "name", "selector", "record_ix").agg(F.lit(1).alias("_one"))
    support = each.groupBy("page_id", "rank", "name", "selector").agg(F.count("*").alias("_support"))
    total = candidates.select(*RECORD).distinct().groupBy("page_id", "rank").agg(F.count("*").alias("_records"))
    counted = support.join(apart(total), ["page_id", "rank"]).select(*[F.col(c).alias(f"_{c}") for c in ("page_id", "rank", "name", "selector")], "_support", "_records")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("page_id", "rank", "name", "selector")]
    candidates = candidates.join(apart(counted), same).drop("_page_id", "_rank", "_name", "_selector")
    records = F.col("_records")
    share = F.col("_support") / records
    more = F.when(share >= SHARE, F.array(signal("consistent across records", CONSISTENT, F.format_number(share, 2)))).when(share < LOW_SHARE, F.array(signal("rare in the collection", INCONSISTENT, F.format_number(share, 2))))
    out = candidates.withColumn("_more", F.when(records >= 2, more))
    return score(out.withColumn("signals", F.when(F.col("_more").isNull(), F.col("signals")).otherwise(F.concat("signals", F.coalesce("_more", F.array().cast(f"array<{SIGNAL}>"))))).drop("_more", "_support", "_records"))


def best_per_field(candidates: DataFrame) -> DataFrame:
    """The candidate of each record and field with the highest confidence, then source, then longest value, then first."""
    w = W.partitionBy(*RECORD, "name").orderBy(F.desc("confidence"), source_rank(F.col("source")), F.desc(F.length("value")), "ord", "value")
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def demote_containers(candidates: DataFrame) -> DataFrame:
    """Candidates whose node (``node_id`` to ``end_id``) holds another node with a candidate of the same field lose a little.

    In document order a node's contents follow it at once, so the next candidate's node tells.
    """
    w = W.partitionBy(*RECORD, "name").orderBy("node_id").rangeBetween(1, W.unboundedFollowing)
    penalty = F.array(signal("contains a more specific candidate", -0.15))
    out = candidates.withColumn("_next", F.min("node_id").over(w))
    return score(out.withColumn("signals", F.when(F.col("_next") <= F.col("end_id"), F.concat("signals", penalty)).otherwise(F.col("signals"))).drop("_next"))


def explain(candidates: DataFrame) -> DataFrame:
    """A row for each signal of each candidate: its place ``n``, ``signal, weight, detail``."""
    rows = candidates.select(*RECORD, "name", "value", "source", "confidence", F.posexplode("signals").alias("n", "s"))
    return rows.select("*", F.col("s.name").alias("signal"), F.col("s.weight").alias("weight"), F.col("s.detail").alias("detail")).drop("s")


def schema_of(fields: DataFrame) -> DataFrame:
    """``name, type, confidence, records``: each field's most frequent type and mean confidence, the surest first."""
    counted = fields.groupBy("name", "type").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"))
    out = counted.groupBy("name").agg(F.max_by("type", F.struct("n", "type")).alias("type"), F.round(F.sum("c") / F.sum("n"), 3).alias("confidence"), F.sum("n").alias("records"))
    return out.orderBy(F.desc("confidence"), "name")
