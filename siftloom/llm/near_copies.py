"""Near copies: SimHash's bit-sliced comparison proposes, the whole sets of shingles decide.

Documents whose sets of ``SHINGLE``-word shingles have a Jaccard similarity of ``LEAST`` or more are linked; a class is a
connected component of links. Equal sets are one node.

Texts that similar differ in 38 of 256 fingerprint bits on average, with a deviation of 5.7, whatever their length: ``RADIUS`` is
five deviations above that. So wide a radius leaves no useful choice of bit blocks as buckets; sets meet in ``BANDS`` buckets keyed by ``ROWS``
of their least hashes each, which a pair at the threshold misses with probability (1 - 0.8^5)^32, 3 in 10^6. In the buckets the
search is that of ``simhash.link_in_buckets``. It drops what shares a bucket or a passage only, and gives groups that hold whole classes.

Within a group each set is compared with a hub of the group, then with another hub if that is in another class, all on the whole sets. Groups that
still hold several classes are compared in cells: a chunk of the sets outside the largest class with a chunk of the group, each pair's shared
shingles counted by a product of incidence matrices. No pairs are put out, and no cell grows with its group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, one_of_each, parted, settled, text_key, write_shared
from .simhash import _merge, link_in_buckets, shingle_hashes

SHINGLE, LEAST, BANDS, ROWS, WORDS, RADIUS = 5, (4, 5), 32, 5, 4, 68
#: Pairs of one hub that are verified together; shingles and sets of a cell's side; texts whose sets a worker holds at a time.
PAIRS, CELL, SIDE, AT_A_TIME = 256, 250_000, 1_000, 128
HUBS = 2
_draw = np.random.default_rng(42)
FACTOR = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
SPREAD = _draw.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text or b"", SHINGLE), np.uint64))


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes())


def scrambled(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """WORDS words, bit by bit the majority of the shingles' hashes spread to so many bits."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(shingles), 4096):
        bits = scrambled(shingles[at : at + 4096, None] * SPREAD)
        counts += np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(shingles), bitorder="little").view(np.int64)


def buckets(shingles: np.ndarray) -> np.ndarray:
    """Key of each band; no shingles, no keys."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 2048):
        x = shingles[at : at + 2048, None] * FACTOR + SHIFT
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)], np.uint64).view(np.int64)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: sets of long texts are large."""
    for b in batches:
        for at in range(0, b.num_rows, AT_A_TIME):
            yield b.slice(at, AT_A_TIME)


def sketches(texts: DataFrame) -> DataFrame:
    """``(key, sid, fp, bands)`` of ``(key, text)``: the id of the set of shingles, its fingerprint and buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            sid = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
            fp, bands = (pa.array([f(s) for s in sets], pa.list_(pa.int64())) for f in (fingerprint, buckets))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sid), fp, bands], ["key", "sid", "fp", "bands"])

    return texts.mapInArrow(run, "key long, sid long, fp array<long>, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``(sid, shingles)`` of ``(key, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            sid = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["sid", "shingles"])

    return texts.mapInArrow(run, "sid long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``(a, b)`` that are as similar as LEAST. Pairs of one ``b`` are dealt over cells."""
    cells = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("n"))
    cells = write_shared(cells, "cells")
    dealt = pairs.join(cells, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("n")).cast("int").alias("x"))
    right = sets.join(cells, F.col("sid") == F.col("b")).select("b", F.explode(F.expr("sequence(0, n - 1)")).alias("x"), F.col("shingles").alias("t"))
    both = dealt.join(right, ["b", "x"]).join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("s")), "a")
    shared = F.size(F.array_intersect("s", "t"))
    up, down = LEAST
    fits = (down * F.size("s") >= up * F.size("t")) & (down * F.size("t") >= up * F.size("s"))
    return both.where(fits).where(down * shared >= up * (F.size("s") + F.size("t") - shared)).select("a", "b")


def similar(values: np.ndarray, sizes: np.ndarray, asked: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between the first ``asked`` of some sets and all of them; the sets lie in a row in ``values``."""
    n = len(sizes)
    of = np.repeat(np.arange(n), sizes)
    _, place, uses = np.unique(values, return_inverse=True, return_counts=True)
    several = uses > 1
    place, of = (np.cumsum(several) - 1)[place[several[place]]], of[several[place]]
    order = np.argsort(place, kind="stable")
    place, of = place[order], of[order]
    shared = np.zeros((asked, n), np.float32)
    for at in range(0, int(several.sum()), 4096):
        a, b = np.searchsorted(place, (at, at + 4096))
        m = np.zeros((n, 4096), np.float32)
        m[of[a:b], place[a:b] - at] = 1
        shared += m[:asked] @ m.T
    up, down = LEAST
    q, c = np.nonzero(down * shared >= up * (sizes[:asked, None] + sizes[None, :] - shared))
    label = _merge(np.arange(n), q, c)
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def compared_in_cells(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between classes of groups: ``members`` has ``(block, sid, root)``."""
    rows = members.join(sets.select("sid", F.size("shingles").alias("size")), "sid")
    of_class = rows.groupBy("block", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    largest = of_class.groupBy("block").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("classes")).where("classes > 1")
    largest = largest.join(of_class.select("block", F.col("root").alias("r"), F.col("size").alias("s")), "block").where("r = most.root")
    chunks = lambda n, size: F.greatest(F.ceil(n / SIDE), F.ceil(size / CELL)).cast("int")
    plan = write_shared(largest.select("block", F.col("r").alias("big"), chunks(F.col("most.n"), F.col("s")).alias("ls"), chunks(F.col("n") - F.col("most.n"), F.col("size") - F.col("s")).alias("os")), "cell-plan")
    mixed = rows.join(plan, "block").withColumn("inside", F.col("root") == F.col("big"))
    mine = F.pmod(F.xxhash64("sid"), F.when(F.col("inside"), F.col("ls")).otherwise(F.col("os"))).cast("int")
    mixed = mixed.select("block", "sid", "inside", "os", mine.alias("mine"))
    ask = mixed.where("not inside").select("block", "sid", F.col("mine").alias("x"), F.explode(F.expr("sequence(mine, os - 1)")).alias("y"), F.lit(True).alias("ask"), F.lit(False).alias("inside"))
    # Others meet the asked chunks up to their own; the largest class's sets meet all.
    told = mixed.where("not inside").select("block", "sid", F.explode(F.expr("sequence(0, mine)")).alias("x"), F.col("mine").alias("y"), F.lit(False).alias("ask"), F.lit(False).alias("inside"))
    big = mixed.where("inside").select("block", "sid", F.explode(F.expr("sequence(0, os - 1)")).alias("x"), F.col("mine").alias("y"), F.lit(False).alias("ask"), F.lit(True).alias("inside"))
    asked_of_big = mixed.where("not inside").join(plan.select("block", "ls"), "block").select("block", "sid", F.col("mine").alias("x"), F.explode(F.expr("sequence(0, ls - 1)")).alias("y"), F.lit(True).alias("ask"), F.lit(True).alias("inside"))
    cells = ask.union(told).union(big).union(asked_of_big).join(sets, "sid").select(F.xxhash64("block", "x", "y", "inside").alias("cell"), "sid", "ask", "shingles")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("ask", "descending"), ("sid", "ascending")]).combine_chunks()
        sid, ask = t.column("sid").to_numpy(), t.column("ask").to_numpy()
        lists = pa.concat_arrays(t.column("shingles").chunks)
        u, v = similar(lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), int(ask.sum()))
        u, v = sid[u], sid[v]
        return pa.table({"a": u[u != v], "b": v[u != v]})

    return cells.groupBy("cell").applyInArrow(run, "a long, b long")


def link_sets(docs: DataFrame, texts_of: DataFrame) -> DataFrame:
    """``(node, root)`` of the sets that are linked to another; ``texts_of`` has ``(key, sid, fp, bands)`` of every text."""
    nodes = write_shared(texts_of.groupBy("sid").agg(F.min("key").alias("key"), F.min(F.struct("fp", "bands")).alias("s")), "sets")
    # Most buckets hold one set: only the others' rows are dealt out, and get their fingerprints afterwards.
    held = nodes.select("sid", F.explode("s.bands").alias("key"))
    shared = write_shared(held.groupBy("key").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a <> b").select("key"), "shared-buckets")
    meeting = parted(held, shared)[0].join(shared, "key", "left_semi")
    rows = write_shared(meeting.join(nodes.select("sid", "s.fp"), "sid").select(F.col("sid").alias("id"), "fp", F.col("key").alias("bucket")), "buckets")
    groups = connected_components(link_in_buckets(rows, RADIUS))
    members = write_shared(groups.select(F.col("node").alias("sid"), F.col("root").alias("block")).join(nodes.select("sid", "key"), "sid"), "members")
    texts = docs.select(text_key().alias("key"), F.col("text").cast("binary").alias("text"))
    one = parted(texts, members.select("key"))[0].join(members.select("key"), "key", "left_semi").dropDuplicates(["key"])
    sets = write_shared(shingle_sets(one), "shingle-sets")
    links = None
    for k in range(HUBS):
        hubs = members.groupBy("block").agg(F.min_by("sid", F.xxhash64("sid", F.lit(k))).alias("hub"))
        pairs = members.join(hubs, "block").where("sid <> hub").select(F.col("sid").alias("a"), F.col("hub").alias("b"))
        if links is not None:
            roots = connected_components(links)
            pairs = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
            pairs = pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
        found = verified(write_shared(pairs, "pairs"), sets)
        links = write_shared(found if links is None else links.union(found), "links")
    roots = connected_components(links)
    placed = write_shared(members.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("block", "sid", F.coalesce("root", "sid").alias("root")), "placed")
    return connected_components(write_shared(links.union(compared_in_cells(placed, sets)), "links"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Class of every text: ``(key, root)``, key as text_key gives it. Null and empty texts, and others without a word, are one class. No rows give no rows."""
    texts = docs.select(text_key().alias("key"), F.col("text").cast("binary").alias("text"))
    rows = write_shared(sketches(texts), "sketches")
    roots = link_sets(docs, rows)
    return rows.select("key", "sid").distinct().join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("key", F.coalesce("root", "sid").alias("root"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the least id; documents of different classes may share an id or have none.

    A document without id stays only if its class has no other. Repeated rows are one document. All columns stay as they are.
    """
    return one_of_each(docs, settled(docs.sparkSession, "classes", lambda: near_duplicates(docs)))
