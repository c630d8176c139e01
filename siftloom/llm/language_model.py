"""Language-model scores: exact unigram base, and a hashed maximum-entropy model with class-factored softmax.

A token's probability is that of its class in its context, times that of its slot in the class, times its word's share of the slot:

- class: a softmax over ``CLASSES`` of summed weights of hashed features, which are the word before, the two words before (n-grams)
  and the word two back (a skip). Trained by distributed gradient updates: every task makes AdaGrad steps from the common
  weights over its share of a round's documents, and the tasks' updates are averaged by their tokens in a tree. The rounds
  cover each training document once.
- slot: a softmax over the class's ``SLOTS`` of a bias and a hashed feature of class and word before. One feature is active a token, so
  the gradient, observed less expected counts, is a function of hashed counts: those are summed over all training documents, and the steps taken on the sums.
- word: the most frequent words of a class have slots of their own; the others share the rest by hash, each with its smoothed share,
  and unknown words have one share of each of these. All three factors sum to 1.

Texts are read and split once. ``code_table`` keeps them as blocks: the distinct words of some documents by 64-bit hash, and each token as
its place among those. All later passes read numbers. Classes group word endings by clustering what stands around them.

Counts are exact and stay a table. The words above a count threshold, ``FREQUENT`` at most, go to the workers; other words of
documents are joined to the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, write_shared
from .labels import fold

CLASSES, UNITS, CONTEXTS, ROWS = 24, 4096, 256, 1 << 16
#: Slots of a class, those of them that words share, and rows of hashed words before for each class.
SLOTS, SHARED, BEFORE = 64, 16, 2048
FREQUENT, ROUNDS, STEP, RATE, RIDGE = 250_000, 2, 16_384, 0.15, 0.5
SMOOTH = 0.1
#: Tokens of a block, or one longer document.
BLOCK = 32_768
#: The end of a text is a token; no word is empty.
END = b""
#: Numbers of a shard of what tasks add up, and tasks that are added up at a time.
SHARD, FAN, NAMES = 65_536, 256, ["part", "shard", "n", "x"]


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from; a null id is none of them."""
    return F.coalesce(fold(doc_id, 10) == 0, F.lit(False))


def key_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def unit_of(word: bytes) -> int:
    """Number of a word's ending."""
    ending = word.rstrip(b".,;:!?\"')")[-3:] if word else b"\xff"
    return zlib.crc32(ending) & (UNITS - 1)


class Places(dict):
    """word to its place in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


class Keys(dict):
    """word to its key and unit, as one number. Emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = key_of(word) << 12 | unit_of(word)
        return found


CODES = "ids array<long>, learn binary, sizes binary, keys binary, units binary, codes binary"


def code_table(docs: DataFrame) -> DataFrame:
    """Documents in blocks: their ids, whether they are learned from, their tokens; the block's words by key and unit; each token's place among the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Keys()
        ids: list[int | None] = []
        learn: list[bool] = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []
        places, held = Places(), 0

        def flush() -> pa.RecordBatch:
            found = [known[w] for w in places]
            codes = np.concatenate(parts)
            row = {
                "ids": ids, "learn": np.array(learn, np.uint8).tobytes(), "sizes": np.array(sizes, np.int64).tobytes(), "keys": np.array([x >> 12 for x in found], np.uint64).tobytes(),
                "units": np.array([x & (UNITS - 1) for x in found], np.uint16).tobytes(), "codes": (codes.astype(np.uint16) if len(places) <= 1 << 16 else codes).tobytes(),
            }
            kinds = [pa.list_(pa.int64()), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], list(row))

        for b in batches:
            for doc_id, taught, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words = (text.as_py() or b"").lower().split()  # bytes: A-Z and ASCII white space only
                words.append(END)
                parts.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
                ids.append(doc_id)
                learn.append(taught)
                sizes.append(len(words))
                held += len(words)
                if held >= BLOCK:
                    yield flush()
                    ids, learn, sizes, parts, places, held = [], [], [], [], Places(), 0
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held_out(F.col("doc_id"))).alias("learn"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, CODES)


@dataclass
class Block:
    """Some documents' tokens in a row."""

    ids: list[int | None]
    learn: np.ndarray  # by document
    sizes: np.ndarray
    keys: np.ndarray  # by word
    units: np.ndarray
    codes: np.ndarray  # by token, its word

    def taught(self) -> Block:
        """The block without the documents that are not learned from."""
        if self.learn.all():
            return self
        return Block([], self.learn[self.learn], self.sizes[self.learn], self.keys, self.units, self.codes[np.repeat(self.learn, self.sizes)])

    def back(self, k: int) -> np.ndarray:
        """The word k tokens before each, in the document; before its beginning, the place after the words."""
        out = np.empty_like(self.codes)
        out[k:] = self.codes[: len(out) - k] if k < len(out) else out[k:]
        starts = np.cumsum(self.sizes) - self.sizes
        for i in range(k):
            out[(starts + i)[self.sizes > i]] = len(self.keys)
        return out

    def hashes(self) -> np.ndarray:
        """32 bits of each word's key, and of the beginning."""
        return np.r_[self.keys & np.uint64(0xFFFFFFFF), np.uint64(0)].astype(np.uint32)


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        columns = [b.column(i) for i in range(6)]
        for i in range(b.num_rows):
            raw = [c[i].as_buffer() for c in columns[1:]]
            kinds = [np.uint8, np.int64, np.uint64, np.uint16]
            learn, sizes, keys, units = (np.frombuffer(x, k) for x, k in zip(raw, kinds))
            codes = np.frombuffer(raw[4], np.uint16 if len(keys) <= 1 << 16 else np.uint32).astype(np.int64)
            yield Block(columns[0][i].as_py(), learn.astype(bool), sizes, keys, units.astype(np.int64), codes)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Hash of 16 bits."""
    return ((x * np.uint32(2654435761) + np.uint32(salt)) * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.uint16)


def feature_rows(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """The weight rows of each feature, from the hashes of the word before and of that two back."""
    return [mixed(one, 1), mixed(one * np.uint32(0x9E3779B1) ^ two, 2), mixed(two, 3)]


def probabilities(w: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    z = np.take(w, rows[0], axis=0, mode="clip")
    part = np.empty_like(z)
    for r in rows[1:]:
        z += np.take(w, r, axis=0, out=part, mode="clip")
    z += bias
    np.clip(z, -60, 60, out=z)
    np.exp(z, out=z)
    z /= np.einsum("ij->i", z)[:, None]
    return z


def count_words(coded: DataFrame) -> DataFrame:
    """``(key long, unit int, c long)`` of the words over all training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in read_blocks(batches):
            t = block.taught()
            n = np.bincount(t.codes, minlength=len(t.keys))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(t.keys[some].view(np.int64)), pa.array(t.units[some].astype(np.int32)), pa.array(n[some])], ["key", "unit", "c"])

    return coded.mapInArrow(run, "key long, unit int, c long").groupBy("key").agg(F.max("unit").alias("unit"), F.sum("c").alias("c"))


def reduced(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], tuple[np.ndarray, int]], kind: type, mean: bool, size: int) -> np.ndarray:
    """Sum over the tasks of an array that each makes, or mean by the weights that they give.

    Arrays travel in shards of ``SHARD`` numbers, added up on the executors ``FAN`` tasks at a time: neither a row nor a group is large, whatever the tasks' number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, n = make(batches)
        part = TaskContext.get().partitionId()
        for s in range(0, len(x), SHARD):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([s // SHARD], pa.int32()), pa.array([n], pa.int64()), pa.array([packed(x[s : s + SHARD].astype(kind))], pa.binary())], NAMES)

    def add(t: pa.Table) -> pa.Table:
        total, weight = 0, 0
        for n, x in zip(t.column("n").to_pylist(), t.column("x")):
            part = np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), kind).astype(np.float64 if mean else np.int64)
            total, weight = total + (part * n if mean else part), weight + n
        out = (total / max(1, weight) if mean else total).astype(kind)
        return pa.table([pa.array([t.column("part")[0].as_py() // FAN]), pa.array([t.column("shard")[0].as_py()], pa.int32()), pa.array([weight], pa.int64()), pa.array([packed(out)], pa.binary())], NAMES)

    shape = "part long, shard int, n long, x binary"
    parts, tasks = rows.mapInArrow(run, shape), rows.rdd.getNumPartitions()
    while tasks > FAN:
        parts, tasks = parts.groupBy("shard", F.floor(F.col("part") / FAN)).applyInArrow(add, shape), -(-tasks // FAN)
    found = {r["shard"]: bytes(r["x"]) for r in parts.groupBy("shard").applyInArrow(add, shape).collect()}  # one array
    out = np.zeros(size, np.float32 if mean else np.int64)
    for s, x in found.items():
        out[s * SHARD : (s + 1) * SHARD] = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)
    return out


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


class Tally:
    """Counts of a large array's cells: cells are noted, and counted many at a time."""

    def __init__(self, size: int) -> None:
        self.counts, self.held, self.n = np.zeros(size, np.int64), [], 0

    def note(self, cells: np.ndarray) -> None:
        self.held.append(cells)
        self.n += len(cells)
        if self.n > 1 << 20:
            self.flush()

    def flush(self) -> None:
        if self.held:
            cells, n = np.unique(np.concatenate(self.held), return_counts=True)
            self.counts[cells] += n
        self.held, self.n = [], 0

    def total(self) -> np.ndarray:
        self.flush()
        return self.counts


def cooccurrence(coded: DataFrame) -> np.ndarray:
    """How often each unit stands beside or two from each context, UNITS by CONTEXTS, over the training documents."""

    def make(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, int]:
        out = Tally(UNITS * CONTEXTS)
        for block in read_blocks(batches):
            t = block.taught()
            units = np.r_[t.units, 0]
            here = units[t.codes]
            for k in (1, 2):
                before = units[t.back(k)]
                out.note(here * CONTEXTS + before % CONTEXTS)
                out.note(before * CONTEXTS + here % CONTEXTS)
        return out.total(), 1

    return reduced(coded, make, np.int64, False, UNITS * CONTEXTS).reshape(UNITS, CONTEXTS)


def cluster(counts: np.ndarray, classes: int = CLASSES, rounds: int = 30) -> np.ndarray:
    """Class of each unit, the last class being the end's own: k-means of the logs of the contexts' lifts, weighted by use."""
    out = np.arange(UNITS) % (classes - 1)
    total = counts.sum(axis=1)
    seen = np.flatnonzero(total > 0)
    if len(seen):
        lift = counts[seen] / total[seen, None] / np.maximum(counts.sum(axis=0) / counts.sum(), 1e-12)
        x = np.log1p(lift)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        weight, rng = np.sqrt(total[seen]), np.random.default_rng(7)
        centres = x[[int(weight.argmax())]]
        while len(centres) < min(classes - 1, len(seen)):
            away = (1 - (x @ centres.T).max(axis=1)).clip(1e-12) * weight
            centres = np.r_[centres, x[[rng.choice(len(x), p=away / away.sum())]]]
        for _ in range(rounds):
            own = (x @ centres.T).argmax(axis=1)
            for c in range(len(centres)):
                if (own == c).any():
                    m = (x[own == c] * weight[own == c, None]).sum(axis=0)
                    centres[c] = m / max(np.linalg.norm(m), 1e-12)
        out[seen] = (x @ centres.T).argmax(axis=1)
    out[unit_of(END)] = classes - 1
    return out


@dataclass
class Vocabulary:
    """Class and slot of every word."""

    class_of: np.ndarray  # by unit
    keys: np.ndarray  # of the words with a slot of their own, ascending
    slots: np.ndarray  # theirs

    def place(self, keys: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and slot of words: its own, or one of the class's shared ones by hash."""
        shared = (keys >> np.uint64(40)).astype(np.int64) % SHARED + SLOTS - SHARED
        if not len(self.keys):
            return self.class_of[units], shared
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.class_of[units], np.where(self.keys[at] == keys, self.slots[at], shared)


def vocabulary(class_of: np.ndarray, keys: np.ndarray, units: np.ndarray, c: np.ndarray) -> Vocabulary:
    """Slots of their own for the most frequent of some words in each class."""
    order = np.lexsort((keys, -c))
    keys, classes = keys[order], class_of[units[order]]
    picked = np.concatenate([np.flatnonzero(classes == k)[: SLOTS - SHARED] for k in range(CLASSES)])
    rank = np.concatenate([np.arange(min(SLOTS - SHARED, (classes == k).sum())) for k in range(CLASSES)])
    up = np.argsort(keys[picked])
    return Vocabulary(class_of, keys[picked][up], rank[up])


def slot_rows(classes: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Weight row of the slot factor's feature: the class, and the word before by hash."""
    return classes * BEFORE + (mixed(one, 5) & (BEFORE - 1))


def slot_counts(coded: DataFrame, words: Vocabulary) -> np.ndarray:
    """How often each slot follows each word before, by row of the slot factor, over the training documents."""
    sent = coded.sparkSession.sparkContext.broadcast(words)

    def make(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, int]:
        out = Tally(CLASSES * BEFORE * SLOTS)
        for block in read_blocks(batches):
            t = block.taught()
            classes, slots = sent.value.place(t.keys, t.units)
            rows = slot_rows(classes[t.codes], t.hashes()[t.back(1)])
            out.note(rows * SLOTS + slots[t.codes])
        return out.total(), 1

    return reduced(coded, make, np.int64, False, CLASSES * BEFORE * SLOTS).reshape(-1, SLOTS)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=-1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=-1, keepdims=True))


def fit_slots(counts: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Log probabilities of the slots by row: gradient steps, scaled by the curvature, on the penalised likelihood of the counts.

    A row's weights are its class's bias, that of the smoothed counts of all its rows, and its own feature's, drawn to 0 by RIDGE.
    """
    of_class = counts.reshape(-1, BEFORE, SLOTS).sum(axis=1) + SMOOTH
    bias = np.repeat(np.log(of_class / of_class.sum(axis=1, keepdims=True)), BEFORE, axis=0).astype(np.float32)
    some = np.flatnonzero(counts.any(axis=1))
    for at in range(0, len(some), 4096):
        r = some[at : at + 4096]
        n, b = counts[r].astype(np.float32), bias[r]
        total, w = n.sum(axis=1, keepdims=True), np.zeros_like(b)
        for _ in range(rounds):
            p = np.exp(log_softmax(b + w))
            step = (n - total * p - RIDGE * w) / (total * p * (1 - p) + RIDGE)
            w += 0.5 * np.clip(step, -2, 2)
        bias[r] = b + w
    return log_softmax(bias).astype(np.float32)


def sum_rows(rows: np.ndarray, g: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct rows, and the sums of g over each: those that occur once need none, and are given apart."""
    order = np.argsort(rows, kind="stable")
    s = rows[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    n = np.diff(np.r_[first, len(s)])
    once = n == 1
    yield s[first[once]], np.take(g, order[first[once]], axis=0)
    if not once.all():
        several = order[np.repeat(~once, n)]
        ends = np.cumsum(n[~once])
        yield s[first[~once]], np.add.reduceat(np.take(g, several, axis=0), np.r_[0, ends[:-1]], axis=0)


def train_classes(coded: DataFrame, words: Vocabulary, tokens_of: np.ndarray) -> np.ndarray:
    """Weights of the class factor after ROUNDS rounds; the last row is the bias, at first the logs of the classes' tokens."""
    sc = coded.sparkSession.sparkContext
    state = np.zeros((ROWS + 1, CLASSES), np.float32)
    state[ROWS] = np.log((tokens_of + SMOOTH) / (tokens_of + SMOOTH).sum())

    for k in range(ROUNDS):
        sent = sc.broadcast((state, words))

        def make(batches: Iterator[pa.RecordBatch], k: int = k) -> tuple[np.ndarray, int]:
            common, vocab = sent.value
            w, tokens = common.copy(), 0
            squares = np.full_like(w, 1e-4)

            def update(rows: np.ndarray, step: np.ndarray) -> None:
                grown = np.take(squares, rows, axis=0)
                grown += step * step
                squares[rows] = grown
                np.sqrt(grown, out=grown)
                step = step * np.float32(-RATE)
                step /= grown
                step += np.take(w, rows, axis=0)
                w[rows] = step

            for n, block in enumerate(read_blocks(batches)):
                if n % ROUNDS != k:
                    continue
                t = block.taught()
                classes, _ = vocab.place(t.keys, t.units)
                h, own = t.hashes(), classes[t.codes]
                features = feature_rows(h[t.back(1)], h[t.back(2)])
                tokens += len(own)
                for s in range(0, len(own), STEP):
                    rows = [f[s : s + STEP] for f in features]
                    g = probabilities(w[:ROWS], w[ROWS], rows)
                    g[np.arange(len(g)), own[s : s + STEP]] -= 1
                    g /= np.float32(64)
                    for f in rows:
                        for part in sum_rows(f, g):
                            update(*part)
                    update(np.array([ROWS]), g.sum(axis=0, keepdims=True))
            return (w - common).ravel(), tokens

        state = state + reduced(coded, make, np.float16, True, state.size).reshape(state.shape)
        sent.unpersist()
    return state


def slot_totals(counts: DataFrame, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each slot, by class."""
    sent = counts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES * SLOTS, np.int64), np.zeros(CLASSES * SLOTS, np.int64)
        for b in batches:
            classes, slots = sent.value.place(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().astype(np.int64))
            np.add.at(n, classes * SLOTS + slots, b.column(2).to_numpy())
            v += np.bincount(classes * SLOTS + slots, minlength=len(v))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n), pa.array(v)], ["k", "n", "v"])

    n, v = np.zeros(CLASSES * SLOTS, np.int64), np.zeros(CLASSES * SLOTS, np.int64)
    for k, a, b in counts.select("key", "unit", "c").mapInArrow(run, "k long, n long, v long").groupBy("k").agg(F.sum("n"), F.sum("v")).collect():  # a row for each slot
        n[k], v[k] = a, b
    return n.reshape(CLASSES, SLOTS), v.reshape(CLASSES, SLOTS)


def frequent_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Keys, ascending, units and counts of the words with at least some count, FREQUENT at most, and that count."""
    grade = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(counts.groupBy(grade.alias("g")).count().collect(), reverse=True)  # 8 rows for each doubling
    held, least = 0, None
    for g, n in sizes:
        if held + n > FREQUENT:
            break
        held, least = held + n, g
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 1 << 62
    rows = counts.where(grade >= least).select("key", "unit", "c").toPandas()  # FREQUENT rows of three numbers
    keys = rows["key"].to_numpy().view(np.uint64)
    up = np.argsort(keys)
    return keys[up], rows["unit"].to_numpy(np.int64)[up], rows["c"].to_numpy(np.int64)[up], int(rows["c"].min())


@dataclass
class Model:
    words: Vocabulary
    weights: np.ndarray  # of the class factor, the last row its bias
    slots: np.ndarray  # log probabilities by row of the slot factor
    log_total: np.ndarray  # log10 of each slot's smoothed token total, by class; 0 for a word's own slot

    def token_scores(self, t: Block) -> np.ndarray:
        """log10 of each token's probability, without the word's own smoothed count where its slot is shared."""
        classes, slots = self.words.place(t.keys, t.units)
        h, own, slot = t.hashes(), classes[t.codes], slots[t.codes]
        one = h[t.back(1)]
        features = feature_rows(one, h[t.back(2)])
        out = self.slots[slot_rows(own, one), slot] / np.log(10) - self.log_total[own, slot]
        for s in range(0, len(own), STEP):
            p = probabilities(self.weights[:ROWS], self.weights[ROWS], [f[s : s + STEP] for f in features])
            out[s : s + STEP] += np.log10(np.maximum(p[np.arange(len(p)), own[s : s + STEP]], np.float32(1e-30)))
        return out


def fit(coded: DataFrame, counts: DataFrame, frequent: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> Model:
    """The model of the training documents of a code table."""
    words = vocabulary(cluster(cooccurrence(coded)), *frequent[:3])
    n, v = slot_totals(counts, words)
    log_total = np.log10(n + SMOOTH * (v + 1))
    log_total[:, : SLOTS - SHARED] = 0.0
    return Model(words, train_classes(coded, words, n.sum(axis=1)), fit_slots(slot_counts(coded, words)), log_total)


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row, held-out ones included.

    Null and empty texts are an end only. Repeated rows are learned from and scored each. Without training documents every token has
    base probability 1, the classes and slots are even. No rows give no rows; further columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    coded = write_shared(code_table(docs), "token-codes")
    counts = write_shared(count_words(coded), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = frequent_words(counts)
    least = frequent[3]
    sent = sc.broadcast((fit(coded, counts, frequent), frequent[0], frequent[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, c = sent.value
        logs = np.log10(np.r_[c, 1] + SMOOTH)
        for t in read_blocks(batches):
            starts = np.cumsum(t.sizes) - t.sizes
            found = np.minimum(np.searchsorted(keys, t.keys), max(0, len(keys) - 1))
            known = keys[found] == t.keys if len(keys) else np.zeros(len(t.keys), bool)
            # Only words that share a slot have a share of it; those of the others are theirs alone.
            _, slots = model.words.place(t.keys, t.units)
            shares = slots >= SLOTS - SHARED
            log_word = np.where(known, logs[found], 0.0)
            token_known = known[t.codes]
            sums = np.add.reduceat(model.token_scores(t) + np.where(shares, log_word, 0.0)[t.codes], starts)
            base = np.add.reduceat(log_word[t.codes], starts)
            seen = np.add.reduceat(token_known.astype(np.int64), starts)
            # The others, told by key: each document's distinct ones with their number.
            at = np.flatnonzero(~token_known)
            of = np.searchsorted(starts, at, "right") - 1
            pairs, n = np.unique(of * len(t.keys) + t.codes[at], return_counts=True)
            ends = np.searchsorted(pairs // len(t.keys), np.arange(len(starts) + 1)).astype(np.int32)
            rare = pa.StructArray.from_arrays([pa.array(t.keys[pairs % len(t.keys)].view(np.int64)), pa.array(n)], ["key", "n"])
            cols = [pa.array(t.ids, pa.int64()), pa.array(t.sizes), pa.array(seen), pa.array(base), pa.array(sums), pa.ListArray.from_arrays(pa.array(ends), rare)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "seen", "found", "model", "rare"])

    shape = "doc_id long, n_tokens long, seen long, found double, model double, rare array<struct<key: long, n: long>>"
    scored = write_shared(coded.mapInArrow(run, shape).withColumn("row", F.monotonically_increasing_id()), "scored")
    others = counts.where(F.col("c") < least).select("key", "c")
    rest = scored.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.n").join(others, "key", "left")
    rest = rest.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_seen"))
    out = scored.drop("rare").join(rest, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    each = float(np.log10(total + SMOOTH * (distinct + 1)))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("seen") + F.coalesce("more_seen", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("found") + more - F.col("n_tokens") * each).alias("base_score"), (F.col("model") + more).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
