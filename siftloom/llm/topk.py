"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are rows of sparse integer weights: the dimensions are terms, floor(scale * x) the weight. Queries go to the workers in
groups of bounded size; candidates stay where they are and are read in blocks of bounded size. In a block the
candidates' weights become postings by term. A query row takes its terms in turn and scatters each
term's weighted postings into a dense array of scores, one per candidate; a partition selection finds the k best. What
the blocks found is merged per query. Every candidate is scored for every query.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, write_shared

SCALE, K, EVERY = 256, 5, 50
#: Rows of a block of candidates, and of a group of queries: what is sent to the workers at a time.
CANDIDATES, QUERIES = 16_384, 4_096


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(id, v array<long>)`` of the rows that take part: no null id or vector, no component null or non-finite.

    Rows that share an id are one vector, the least of theirs: results name vectors by id.
    """
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    fine = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null")
    rows = rows.where(F.forall("x", fine))
    return rows.select("id", F.transform("x", lambda c: F.floor(c * float(scale))).alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def postings(starts: np.ndarray, values: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By term: the rows that have it, and their weights."""
    sizes = np.diff(starts)
    some = np.flatnonzero(values)
    row = np.repeat(np.arange(n), sizes)[some]
    term = (np.arange(len(values)) - np.repeat(starts[:-1], sizes))[some]
    order = np.argsort(term, kind="stable")
    row, value, ends = row[order], values[some][order], np.cumsum(np.bincount(term, minlength=int(sizes.max(initial=0))))
    return [(row[a:b], value[a:b]) for a, b in zip(np.r_[0, ends], ends)]


def search_block(q_ids: np.ndarray, q_starts: np.ndarray, q_values: np.ndarray, ids: np.ndarray, starts: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query id, candidate id, score`` of each query's k best of the block; ``ids`` ascend."""
    n = len(ids)
    most = float(np.abs(values).max(initial=0)) * float(np.abs(q_values).max(initial=0)) * max(1, np.diff(q_starts).max(initial=0))
    kind = np.int32 if most < 2**31 else np.int64
    lists = postings(starts, values.astype(kind), n)
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for q, a, b in zip(q_ids, q_starts, q_starts[1:]):
        scores = np.zeros(n, kind)
        query = q_values[a:b].astype(kind)
        for t in np.flatnonzero(query):
            if t >= len(lists):
                break
            rows, weights = lists[t]
            scores[rows] += query[t] * weights
        at = np.searchsorted(ids, q)
        if at < n and ids[at] == q:
            rest = np.r_[0:at, at + 1 : n]
            scores = scores[rest]
        else:
            rest = None
        if len(scores) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            above = np.flatnonzero(scores > least)
            best = np.r_[above, np.flatnonzero(scores == least)[: k - len(above)]]
        else:
            best = np.arange(len(scores))
        found.append((q, ids[best if rest is None else rest[best]], scores[best].astype(np.int64)))
    who = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
    return who, np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates of highest inner product for each query.

    Both are ``(id long, v array<long>)`` with distinct ids, as ``integer_vectors`` gives. A query's own id is no
    candidate of its; equal scores go by smaller id; shorter vectors lack the further terms; with fewer than k candidates all
    are returned, and no rows for none. Scores are exact within 64 bits.
    """
    sc = vectors.sparkSession.sparkContext
    groups = -(-queries.count() // QUERIES)

    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = t.sort_by("id").combine_chunks()
        v = pa.concat_arrays(t.column("v").chunks) if t.num_rows else pa.array([], pa.list_(pa.int64()))
        sizes = np.array(v.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        return t.column("id").to_numpy(), np.r_[0, np.cumsum(sizes)].astype(np.int64), v.flatten().to_numpy()

    def found_by(group: DataFrame) -> DataFrame:
        sent = sc.broadcast(arrays(group.toArrow()))  # about QUERIES rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for b in itertools.chain(batches, (None,)):
                if b is not None:
                    held.append(b)
                if held and (b is None or sum(x.num_rows for x in held) >= CANDIDATES):
                    block = pa.Table.from_batches(held)
                    held = []
                    for at in range(0, block.num_rows, CANDIDATES):
                        found = search_block(*sent.value, *arrays(block.slice(at, CANDIDATES)), k)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

        return vectors.select("id", "v").mapInArrow(run, "query_id long, vec_id long, score long")

    parts = [queries.select("id", "v").where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g) for g in range(groups)]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Groups are searched one after the other, and each leaves its queries' best only.
    found = merged(found_by(parts[0]), k) if groups == 1 else None
    for part in parts if groups > 1 else ():
        one = write_shared(merged(found_by(part), k), "found")
        found = one if found is None else found.union(one)
    return found


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ranked."""
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = write_shared(integer_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(rows, rows.where(F.col("id") % EVERY == 0))


SQL = """
WITH vectors AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
