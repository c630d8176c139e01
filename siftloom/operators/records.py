"""Records from candidates: typed fields, validation, duplicates, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.normalize import coerce, lookup, normalize_enum
from ..shared import apart
from .scoring import RECORD

KEY_FIELDS = ("url", "sku", "email")
POSITION = ("page_id", "rank", "record_ix")


def finalize(best: DataFrame, wanted: list[str] | None = None, renames: dict[str, str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """Chosen candidates as typed fields, ``raw`` what the page said: restricted to the wanted ones, enumerations in words, empty values dropped, renamed."""
    renames = renames or {}
    keep = best.where(F.col("name").isin(*wanted, *[k for k, v in renames.items() if v in wanted])) if wanted else best
    given = [lookup(types, F.col("name"))] if types else []
    target = F.coalesce(*given, lookup(L.FIELD_TYPES, F.col("name")), F.lit("string"))
    typed = F.when(target == "string", F.struct(F.coalesce(normalize_enum("value"), F.col("value")).alias("value"), F.lit("string").alias("type"))).otherwise(coerce("value", target))
    out = keep.withColumn("raw", F.col("value")).withColumn("_t", typed).withColumns({"value": F.col("_t.value"), "type": F.col("_t.type")}).drop("_t").where("value <> ''")
    return out.withColumn("name", F.coalesce(lookup(renames, F.col("name")), "name")) if renames else out


def assemble(fields: DataFrame) -> DataFrame:
    """One row for each record: ``fields`` by name, and the mean confidence."""
    one = F.struct("value", "raw", "type", "source", "selector", "confidence", "signals")
    return fields.groupBy(*RECORD).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", one.alias("f"))), lambda a, b: F.when(a["name"] < b["name"], -1).otherwise(1))).alias("fields"), F.round(F.avg("confidence"), 4).alias("confidence"))


def value(name: str) -> Column:
    return F.element_at("fields", name)["value"]


def validate(records: DataFrame, required: list[str] | None = None, min_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Records that hold what is required, and the problems of the others."""
    missing = F.array_compact(F.array(*[F.when(value(n).isNull(), F.lit(n)) for n in required])) if required else F.array().cast("array<string>")
    problem = F.when(F.size("fields") == 0, "empty record").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))).when(F.col("confidence") < min_confidence, "low confidence")
    judged = records.withColumn("problem", problem)
    return judged.where("problem is null").drop("problem"), judged.where("problem is not null").select(*POSITION, "problem")


def dedupe_key(keys: list[str] | None = None) -> Column:
    """What makes two records one: configured fields if any is there, else url, sku, email, else all fields."""
    digest = lambda kind, v: F.sha2(F.concat(F.lit(kind), F.lit("\0"), v), 256)
    chosen = digest("keys", F.concat_ws("\0", *[F.coalesce(value(k), F.lit("")) for k in keys])) if keys else None
    given = [F.when(F.coalesce(*[value(k) for k in keys]).isNotNull(), chosen)] if keys else []
    pairs = F.transform(F.array_sort(F.map_keys("fields")), lambda k: F.concat_ws("=", k, F.element_at("fields", k)["value"]))
    return F.coalesce(*given, *[F.when(value(k).isNotNull(), digest(k, F.lower(value(k)) if k == "email" else value(k))) for k in KEY_FIELDS], digest("hash", F.concat_ws("\0", pairs)))


def dedupe(records: DataFrame, keys: list[str] | None = None, scope: tuple[str, ...] = (), order: tuple[str, ...] = POSITION) -> DataFrame:
    """The first record of each key within the scope's columns (none: all)."""
    keyed = records.withColumn("_key", dedupe_key(keys))
    w = W.partitionBy(*scope, "_key").orderBy(*order)
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key")


def unseen(records: DataFrame, seen: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Records whose key is not among ``seen(key)``."""
    return records.withColumn("key", dedupe_key(keys)).join(seen, "key", "left_anti").drop("key")


def follow_merge(listing: DataFrame, detail: DataFrame, prefer: str = "detail", by: str = "url") -> DataFrame:
    """Listing records with what their own page says: ``detail(url, fields)`` joined on the record's url, or another field.

    The preferred side wins; the listing's url stays, and so does a title that the other title merely extends. Records without a detail stay as they are.
    """
    other = detail.select(F.col("url").alias("_url"), F.col("fields").alias("_more")).dropDuplicates(["_url"])
    joined = listing.join(apart(other), value(by) == F.col("_url"), "left")
    a, b = F.col("fields"), F.col("_more")
    first, second = (b, a) if prefer == "detail" else (a, b)
    merged = F.map_concat(F.map_filter(second, lambda k, _: ~F.map_contains_key(first, k)), first)
    extended = F.element_at(b, "title")["value"].contains(F.element_at(a, "title")["value"])
    keep = F.map_filter(a, lambda k, _: (k == "url") | ((k == "title") & F.coalesce(extended, F.lit(False))))
    final = F.map_concat(F.map_filter(merged, lambda k, _: ~F.map_contains_key(keep, k)), keep)
    return joined.withColumn("fields", F.when(b.isNull(), a).otherwise(final)).drop("_url", "_more")


def follow_budget(records: DataFrame, budget: int, host: Column, order: tuple[str, ...] = POSITION, by: str = "url") -> DataFrame:
    """Distinct addresses to follow, of the same host, the first ``budget`` of them."""
    urls = records.withColumn("url", value(by)).where(F.col("url").rlike("^https?://") & host)
    first = urls.groupBy("url").agg(F.min(F.struct(*order)).alias("at"))
    return first.orderBy("at").limit(budget).select("url")


def cut_pages(records: DataFrame, most: int, page_order: str = "depth") -> DataFrame:
    """Records of the pages up to and with the one that brings the number of records to ``most``."""
    pages = records.groupBy("source_id", page_order).count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("source_id").orderBy(page_order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = pages.withColumn("before", before).where(F.col("before") < most).select("source_id", page_order)
    return records.join(apart(kept), ["source_id", page_order], "left_semi")
