"""Extraction over pages that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.normalize import content_hash
from ..plans.extract import Options, process

PAGES = "page_id long, url string, html string"


def page_stream(spark: SparkSession, path: str, schema: str = PAGES, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def new_content(pages: DataFrame, time: str | None = None, late: str = "1 day") -> DataFrame:
    """Pages whose content has not come before; with a time column, the state keeps what is not later than ``late``."""
    hashed = pages.withColumn("content_hash", content_hash("html"))
    if time:
        return hashed.withWatermark(time, late).dropDuplicatesWithinWatermark(["content_hash"])
    return hashed.dropDuplicates(["content_hash"])


def records_stream(pages: DataFrame, out: str, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Records of each arriving batch, appended to a Parquet table; a batch that runs again replaces its own rows."""

    def batch(df: DataFrame, epoch: int) -> None:
        found, _ = process(df, options)
        found.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
