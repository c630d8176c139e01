"""A short report of a collection's columns, and the gate that a proposal of fields must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalize import slug
from ..shared import apart
from . import alignment
from .fields import record_nodes
from .scoring import RECORD

MOST_COLUMNS, SAMPLES, CLIP = 20, 3, 60


def brief(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """``page_id, rank, id, name, selector, coverage, distinct, samples``: ids c1, c2, ... with the named columns first."""
    columns = alignment.columns(nodes, records)
    n = F.row_number().over(W.partitionBy("page_id", "rank").orderBy(F.col("name").isNull(), "n"))
    columns = columns.withColumn("i", n).where(F.col("i") <= MOST_COLUMNS)
    inside = record_nodes(nodes, records).where("sub_text <> ''").join(apart(columns.select("page_id", "rank", "selector")), ["page_id", "rank", "selector"])
    first = inside.groupBy(*RECORD, "selector").agg(F.min_by("sub_text", "node_id").alias("said")).where(F.col("record_ix") < 2 * SAMPLES)
    texts = first.groupBy("page_id", "rank", "selector").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("record_ix", "said"))), lambda x: F.substring(x["said"], 1, CLIP)), 1, SAMPLES).alias("samples"))
    out = columns.join(apart(texts), ["page_id", "rank", "selector"], "left")
    return out.select("page_id", "rank", F.concat(F.lit("c"), F.col("i")).alias("id"), "name", "selector", "coverage", "distinct", "samples")


def gate(proposals: DataFrame, columns: DataFrame, min_coverage: float = 0.8, max_fields: int = 24) -> DataFrame:
    """``ord, field, id`` proposals against ``id, coverage`` columns, with ``name``, ``status`` and ``reason``.

    In order: after ``max_fields`` accepted ones the rest is rejected; a name must be usable, and not that of an accepted field before;
    the column must exist and cover enough records.
    """
    name = slug("field")
    usable = F.when(name.rlike("^[a-z][a-z0-9_]{1,39}$"), name)
    judged = proposals.withColumn("name", usable).join(columns.select("id", "coverage"), "id", "left")
    own = F.when(F.col("name").isNull(), "not a usable field name").when(F.col("coverage").isNull(), "no such column").when(F.col("coverage") < min_coverage, "too few records")
    judged = judged.withColumn("own", own)
    # Among proposals of a name the first that stands by itself is accepted; names are bounded by the proposal's length.
    first = F.min(F.when(F.col("own").isNull(), F.col("ord"))).over(W.partitionBy("name"))
    judged = judged.withColumn("first", first)
    repeated = F.col("name").isNotNull() & (F.col("ord") > F.col("first"))
    judged = judged.withColumn("reason", F.when(F.col("name").isNull(), F.col("own")).when(repeated, "duplicate name").otherwise(F.col("own")))
    before = W.orderBy("ord").rowsBetween(W.unboundedPreceding, -1)  # proposals are a handful
    full = F.coalesce(F.sum(F.col("reason").isNull().cast("int")).over(before), F.lit(0)) >= max_fields
    judged = judged.withColumn("reason", F.when(full, "field limit reached").otherwise(F.col("reason")))
    return judged.select("ord", "field", "id", "name", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("status"), "reason")
