"""Tables between the steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}
#: What has been written within the innermost ``settled``.
_within: ContextVar[list[str] | None] = ContextVar("_within", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset: on one machine a temporary folder, on a cluster the warehouse, which executors reach.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        one_machine = sc.master == "local" or sc.master.startswith("local[")
        found = tempfile.mkdtemp(prefix="siftloom-") if one_machine else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.siftloom"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def write_shared(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs tasks of the current stage only, and what several
    consumers read is computed once. The table stays until ``clear_shared`` or until the folder is emptied, or until a ``settled`` around it is done.
    ``codec``: the compression, for tables that hold whole texts; the session's, if not given.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    if (within := _within.get()) is not None:
        within.append(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """``df`` for a join that deals both sides out, whatever their size.

    Sizes are guessed from the files of written tables. Columns of numbers are compressed there to a few hundredths of what they take in memory,
    so a table that grows with the pages would pass for one that is small enough to be sent to the driver and to all executors.
    """
    return df.hint("merge")


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, as a table; the tables that it has written on the way are deleted, so nothing else that it makes may be used later."""
    own: list[str] = []
    token = _within.set(own)
    try:
        made = make()
    finally:
        _within.reset(token)
    out = write_shared(made, name)
    _delete(spark, own)
    known = _written[spark.sparkContext.applicationId]
    for p in own:
        known.remove(p)
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for p in paths:
        place = hadoop.Path(p)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def clear_shared(spark: SparkSession) -> int:
    """Delete the tables that this application has written; their number. Results that read them must have been saved."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)
