"""Mixing sources to target weights by systematic sampling.

A source's documents are in order of (size, doc_id) and each expects target / source_size copies. The expected copies
are prefix-summed in that order, one random offset per source is added, and a document is emitted once per integer
boundary that its interval crosses. In order of size, any run of neighbours takes its share, so the words taken come
within a few documents' words of the target.

The prefix sum brings neither a source nor the sources to one task: rows are range-partitioned by the whole order, with a row number as its last key, so
that parts are even whatever repeats; each part counts its rows by source, and the counts of the parts before are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, table, write_shared

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, "siftloom"


def ranked(rows: DataFrame, order: list[str], within: list[str]) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the given order, whose last key is unique, within equal ``within``, the order's first keys (none: all)."""
    parts = write_shared(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    upto = W.partitionBy(*within).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # A row for each part and group in it: parts are as many as tasks.
    before = parts.groupBy(*within, "_part").agg(F.count("*").alias("_n")).select(*[F.col(c).alias(f"_{c}") for c in within], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    number = F.row_number().over(W.partitionBy("_part", *within).orderBy(*order))
    same = F.col("_part") == F.col("_p")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = parts.withColumn("_number", number).join(before, same)
    return out.withColumn("rank", F.col("_before") + F.col("_number")).select(*rows.columns, "rank")


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` of ``(source, source_size)``: weights shared with caps.

    Sources by code point, null last, weigh WEIGHTS in turn. Shares above their source's cap stop there and the excess is
    shared again by weight, until none is above. Each round is a sum over the sources.
    """
    keyed = sizes.withColumn("_null", F.col("source").isNull())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = write_shared(ranked(keyed, ["_null", "source"], []).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * MOST).alias("cap")), "weights")
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * SHARE
    level, over, rest = -1.0, 0, 0
    while True:
        capped = F.col("cap") / F.col("weight") < level
        over, rest = rows.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        higher = (total - over) / rest if rest else level
        if higher <= level:
            break
        level = higher
    target = F.when(F.col("cap") / F.col("weight") < level, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(total - over) / F.lit(max(1, rest)))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def offset(source: Column) -> Column:
    """A number in [0, 1) drawn for the source: 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(source, F.lit("")))), 1, 13), 16, 10)
    return bits.cast("double") / float(1 << 52)


def copies(sized: DataFrame) -> DataFrame:
    """``sized``, which has ``(doc_id, source, size, uid)`` with uid unique, with ``source_size, target, copies``."""
    sums = write_shared(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    aim = targets(sums).select(F.col("source").alias("_source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = lambda r: F.floor(r * rate + offset(F.col("source")))
    out = ranked(sized, ["source", "size", "doc_id", "uid"], ["source"]).join(aim, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return out.withColumn("copies", crossed(F.col("rank")) - crossed(F.col("rank") - 1)).drop("rank")


def sized(docs: DataFrame) -> list[Column]:
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.monotonically_increasing_id().alias("uid")]


def plan(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` of each row; the same on every run.

    Null and empty texts have size 0 and take their turn at no cost; a null source is a source, the last; a null
    doc_id comes first within its size; of repeated rows each has a place of its own. No rows give no rows.
    """
    return copies(write_shared(docs.select(*sized(docs)), "sized")).drop("uid")


def mix(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it, with their columns as they are.

    Nulls, empty texts and repeated rows are as in ``plan``; which of several rows that agree in source, size and id is taken is arbitrary.
    Rows are written with a number of their own, by which the plan finds them again: no key is shared.
    """
    # As one struct, the columns of docs clash with no other.
    rows = write_shared(docs.select(*sized(docs), F.struct("*").alias("doc")), "numbered", "zstd")
    taken = copies(rows.drop("doc")).where("copies > 0").select("uid", F.col("copies").cast("int").alias("n"))
    return rows.select("uid", "doc").join(taken, "uid").select("doc", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2 AS cap FROM sources),
levels AS (SELECT *, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS total, (sum(weight) OVER ())::BIGINT AS weights,
    coalesce(sum(cap) OVER rising, 0)::BIGINT AS spent, coalesce(sum(weight) OVER rising, 0)::BIGINT AS used
  FROM weighed WINDOW rising AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, cap / weight < (total - spent) / (weights - used) AS capped FROM levels),
rest AS (SELECT coalesce(sum(cap) FILTER (WHERE capped), 0)::BIGINT AS over, sum(weight) FILTER (WHERE NOT capped)::BIGINT AS weights FROM marked),
aims AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight * (total - over) / rest.weights END AS target,
    list_reduce(list_transform(string_split(md5('siftloom' || coalesce(source, ''))[:13], ''), lambda c: (instr('0123456789abcdef', c) - 1)::BIGINT), lambda x, y: x * 16 + y) / 4503599627370496.0::DOUBLE AS u
  FROM marked, rest),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) AS k FROM sized)
SELECT doc_id, size, source_size, target,
  (size * CASE WHEN source_size > 0 THEN floor(k * (target / source_size) + u) - floor((k - 1) * (target / source_size) + u) ELSE 0 END)::BIGINT AS taken
FROM ranked r JOIN aims a ON r.source IS NOT DISTINCT FROM a.source
"""
