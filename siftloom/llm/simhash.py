"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint holds the majority of the bits of its shingles' hashes. Fingerprints that
differ in at most ``radius`` bits are linked; a class is a connected component of links.

The search is exact. The 64 bits are cut into blocks; two fingerprints within the radius agree on all
but ``radius`` blocks, so they meet in a bucket keyed by some choice of the other blocks. Each fingerprint is compared with its
bucket's first; those near it are linked by that. The others are compared with all of the bucket: the
fingerprints' bit planes are stored vertically, 64 candidates to a machine word, and one pass over the planes
adds each plane's differences into carry-save counters for all candidates at once; words all of whose
candidates have exceeded the radius are abandoned. Buckets over ``CHUNK`` fingerprints are cut into chunks
whose pairs are compared in cells of their own, so no bucket is gathered into one task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, salted_join, table, write_shared

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a bucket that are compared in one cell; a cell holds two chunks at most.
CHUNK = 2048
#: Rows compared at a time, and (query, word) pairs counted at a time.
ROWS, PAIRS = 65_536, 262_144
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, k: int = SHINGLE) -> list[int]:
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = [e - 1 for e in itertools.accumulate(len(w) + 1 for w in words)]
    starts = itertools.chain((0,), (e + 1 for e in ends))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :])]


def fingerprints(texts: list[bytes | None], k: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text as uint64; none or no word: zero."""
    counts, sizes = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[int] = []
    owner: list[int] = []
    lengths: list[int] = []

    def flush() -> None:
        h = np.array(held, np.uint64)
        who = np.repeat(np.array(owner, np.int64), lengths)
        for at in range(0, len(h), 131_072):
            bits = np.unpackbits(h[at : at + 131_072].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own = who[at : at + 131_072]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        held.clear(), owner.clear(), lengths.clear()

    for i, text in enumerate(texts):
        hs = shingle_hashes(text or b"", k)
        if hs:
            sizes[i] = len(hs)
            held += hs
            owner.append(i)
            lengths.append(len(hs))
        if len(held) > 500_000:
            flush()
    if held:
        flush()
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_documents(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp long)`` of every row; ``fp`` has the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(b.column(1).to_pylist(), k).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks, as signed longs, of each choice of blocks - radius blocks of the 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    out = [sum(c) for c in itertools.combinations(one, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def blocks_for(n: int, radius: int) -> int:
    """More blocks make longer keys in more tables: buckets stay small as ``n`` grows. Exact for any."""
    return radius + 1 + (n > 1 << 22) + 2 * (n > 1 << 30)


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    while True:
        a, b = label[u], label[v]
        if not (apart := a != b).any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (step := label[label]).tobytes() != label.tobytes():
            label = step


def bit_sliced_links(fp: np.ndarray, group: np.ndarray, radius: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, row) that join what is linked within each group; ``group`` is sorted. A row of ``fp`` is one 64-bit word or several.

    Returns a spanning forest of the links, so a group of n rows gives fewer than n edges. ``asked``: only links of these rows, which lead their group.
    """
    n = len(fp)
    fp = fp.reshape(n, -1) if n else fp.reshape(0, 1)
    bits_of = 64 * fp.shape[1]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    words = -(-size // 64)
    base = np.r_[0, np.cumsum(words)]
    of = np.repeat(np.arange(len(first)), size)
    inside = np.arange(n) - first[of]
    slot = base[of] * 64 + inside
    row_of = np.full(base[-1] * 64, -1, np.int64)
    row_of[slot] = np.arange(n)

    def plane(values: np.ndarray) -> np.ndarray:
        bits = np.zeros(base[-1] * 64, np.uint8)
        bits[slot] = values
        return np.packbits(bits, bitorder="little").view(np.uint64)

    one = np.uint64(1)
    bit_of = lambda rows, b: (fp[rows, b // 64] >> np.uint64(b % 64)) & one
    planes = [plane(bit_of(slice(None), b)) for b in range(bits_of)]
    there = plane(np.ones(n, np.uint8))
    # A row is compared with its own word's later rows and with the later words of its group.
    todo = words[of] - inside // 64
    todo[size[of] == 1] = 0
    if asked is not None:
        todo[~asked] = 0
    label, ends = np.arange(n), np.cumsum(todo)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        reps = todo[at:to]
        q = np.repeat(np.arange(at, to), reps)
        k = np.arange(len(q)) - np.repeat(np.cumsum(reps) - reps, reps)
        w = base[of[q]] + inside[q] // 64 + k
        at = to
        valid = there[w]
        own = k == 0
        valid[own] &= ~((np.uint64(2) << (inside[q[own]] % 64).astype(np.uint64)) - one)
        alive = valid != 0
        q, w, valid = q[alive], w[alive], valid[alive]
        counter = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length())]
        over = ~valid
        for b in range(bits_of):
            carry = planes[b][w] ^ (np.uint64(0) - bit_of(q, b))
            for i, c in enumerate(counter):
                counter[i], carry = c ^ carry, c & carry
            over |= carry  # beyond what the counters hold
            if b >= 2 * radius and b % max(4, radius // 4) == 0 or b == bits_of - 1:
                more, same = np.zeros(len(q), np.uint64), np.full(len(q), ONES)
                for i in reversed(range(len(counter))):
                    r = ONES if radius >> i & 1 else np.uint64(0)
                    more |= same & counter[i] & ~r
                    same &= ~(counter[i] ^ r)
                over |= more
                alive = over != ONES
                if alive.sum() < 0.7 * len(q):
                    q, w, over = q[alive], w[alive], over[alive]
                    counter = [c[alive] for c in counter]
        near = ~over
        for s in range(0, len(q), 16_384):
            bits = np.unpackbits(near[s : s + 16_384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            e, bit = np.nonzero(bits)
            if len(e):
                label = _merge(label, q[s + e], row_of[w[s + e] * 64 + bit])
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def link_in_buckets(rows: DataFrame, radius: int) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all links within buckets; ``rows`` has ``(id long, fp array<long>, bucket long)``, an id once a bucket.

    A bucket's hub, its least id, is joined to its members, whose distance to it is counted in the JVM. Members beyond the radius
    are compared with the whole bucket, in cells of a chunk of them and a chunk of the members.
    """
    one = F.struct("id", "fp")
    hubs = rows.groupBy("bucket").agg(F.min(one).alias("hub"), F.max("id").alias("most"), F.count("*").alias("n")).where("hub.id <> most").drop("most")
    distance = F.aggregate(F.zip_with("fp", "hub.fp", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    placed = write_shared(rows.join(hubs, "bucket").select("id", "fp", "bucket", "n", F.col("hub.id").alias("hub"), (distance <= radius).alias("near")), "bucket-members")
    links = placed.where("near and id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    apart = write_shared(placed.where("not near").groupBy("bucket").agg(F.count("*").alias("m")), "buckets-apart")
    if apart.isEmpty():
        return links
    chunks = lambda c: F.ceil(F.col(c) / CHUNK).cast("int")
    deal = lambda c, salt: F.pmod(F.xxhash64("id", F.lit(salt)), chunks(c)).cast("int")
    mixed = placed.join(apart, "bucket").withColumns({"asks": deal("m", 1), "asked": deal("n", 2), "ms": chunks("m"), "ns": chunks("n")})
    asking = mixed.where("not near").select("id", "fp", "bucket", F.col("asks").alias("x"), F.explode(F.expr("sequence(0, ns - 1)")).alias("y"), F.lit(1).alias("ask"))
    others = mixed.select("id", "fp", "bucket", F.explode(F.expr("sequence(0, ms - 1)")).alias("x"), F.col("asked").alias("y"), F.lit(0).alias("ask"))
    cells = asking.union(others).select("id", "ask", F.xxhash64("bucket", "x", "y").alias("cell"), "fp")
    cells = cells.repartition("cell").sortWithinPartitions("cell", F.desc("ask"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        for b in itertools.chain(batches, (None,)):
            if b is not None and b.num_rows:
                ids, ask, cell = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                kept.append((ids, ask, cell, b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)))
            if not kept or (b is not None and sum(len(k[0]) for k in kept) < ROWS):
                continue
            ids, ask, cell, fp = (np.concatenate(c) for c in zip(*kept))
            new = np.r_[True, cell[1:] != cell[:-1]]
            end = len(ids) if b is None else int(np.flatnonzero(new)[-1])
            kept = [(ids[end:], ask[end:], cell[end:], fp[end:])] if end < len(ids) else []
            if end:
                u, v = bit_sliced_links(np.ascontiguousarray(fp[:end]).view(np.uint64), np.cumsum(new[:end]), radius, ask[:end] == 1)
                u, v = ids[u], ids[v]
                yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["a", "b"])

    return links.union(cells.mapInArrow(compare, "a long, b long")).distinct()


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(a, b)`` over distinct fingerprints ``fp``: their components are those of all links."""
    masks = block_masks(blocks_for(distinct.count(), radius), radius)
    buckets = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks)]))
    return link_in_buckets(distinct.select(F.col("fp").alias("id"), F.array("fp").alias("fp"), buckets.alias("bucket")), radius)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Class of every document: ``(doc_id, fp, component_id)``.

    ``component_id`` is the least doc_id reachable by links, its own included. Null and empty texts have
    fingerprint zero and are linked like others; repeated rows are returned as often as they occur; a null
    doc_id is no class id unless the class has no other. No rows give no rows; further columns are ignored.
    """
    rows = write_shared(fingerprint_documents(docs, k), "fingerprints")
    distinct = write_shared(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected_components(link_fingerprints(distinct, radius))
    # Only fingerprints with links are in the table of roots. A class's name is found by a partial minimum, and goes back to them over salted keys.
    linked = write_shared(roots.join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "least"), "linked")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = salted_join(linked.select("fp", "root"), named, "root").select(F.col("fp").alias("_fp"), "component_id")
    placed = distinct.join(classes, F.col("fp") == F.col("_fp"), "left").select("fp", F.when(F.col("_fp").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return salted_join(rows, placed, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
