"""Helpers shared by the training-data operators: tables, the shared folder, component search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import settled, write_shared

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Rows of one key from which a join deals it over salts.
HOT_ROWS = 1_000
#: Bits of the filter of keys that joins get: 64 to a row, as broadcast 2^18 rows at most, whatever the number of keys.
FILTER_BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_join(rows: DataFrame, other: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """Inner join on a key that a large part of ``rows`` may share and ``other`` has once each: dealt by key and salt.

    Only keys with so many rows that one task would hold more than its share get salts, so ``other`` grows by a few rows.
    """
    total = rows.groupBy(key).agg(F.count("*").alias("_n"))
    hot = write_shared(total.where(F.col("_n") > HOT_ROWS).select(key), "hot-keys")
    if hot.isEmpty():
        return rows.join(other, key)
    mark = hot.select(F.col(key).alias("_hot"))
    spread = other.join(mark, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1))))).drop("_hot")
    dealt = rows.join(mark, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))).drop("_hot")
    return dealt.join(spread, [key, "_salt"]).drop("_salt")


def parted(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key``, a hash, may be among those of ``keys``, and the rows whose key is not; neither is shuffled.

    So a join of large rows with few keys need only deal out the first. With many keys the second become fewer; no row is in both or in none.
    """
    at = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    bits = keys.select(F.shiftright(at, 6).alias("_word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    bits = F.broadcast(write_shared(bits, "key-filter"))
    hit = (F.shiftright(at, 6) == F.col("_word")) & (F.getbit("_bits", F.col("key").bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
    return rows.join(bits, hit, "left_semi"), rows.join(bits, hit, "left_anti")


def connected_components(edges: DataFrame) -> DataFrame:
    """Root of each node: ``(a long, b long)`` edges to ``(node, root)``, root the least node of the component.

    Alternating large-star and small-star steps over the edge table. A step takes a minimum per node
    (combined before the shuffle) and joins it back, so no node's neighbours meet in one row. Nodes
    without an edge to another node are not returned; no edges give no rows.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, before = write_shared(pairs, "edges"), None
    while True:
        # Every node's larger neighbours, linked to the least of its neighbourhood.
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Every node's smaller neighbours and itself, linked to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(least, "a")
        small = kept.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        pairs = write_shared(small.where("a <> b").distinct(), "edges")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def text_key() -> Column:
    return F.xxhash64(F.col("text").cast("binary"))


def one_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class of its texts; ``classes`` has ``(key, root)`` of every text, key as in text_key.

    The row with the least doc_id stays, one without only if its class has no other; among rows that share it, that
    with the least hash. Rows of other classes stay whatever their doc_id.
    """
    row = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), row.alias("row"))
    of_text = docs.select(text_key().alias("key"), place.alias("place")).groupBy("key").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    of_text = write_shared(of_text.join(classes, "key"), "texts")
    of_class = write_shared(of_text.groupBy("root").agg(F.min("place").alias("place"), F.sum("n").alias("n")), "first-of-class")
    first = of_class.select("place.row")
    several = settled(docs.sparkSession, "several", lambda: salted_join(of_text.select("key", "root"), of_class.where("n > 1").select("root"), "root").select("key"))
    # As one struct, the columns of docs clash with no other. Texts that are alone in their class stay where they are.
    rows = docs.select(text_key().alias("key"), row.alias("row"), F.struct("*").alias("doc"))
    among, alone = parted(rows, several)
    return among.join(first, "row", "left_semi").dropDuplicates(["row"]).union(alone).select("doc.*")
