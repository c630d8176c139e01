"""Toxicity by a weighted lexicon.

Texts are folded: lower case, look-alike letters to Latin ones, digits and signs that stand for letters to those
letters, i, l, 1, ! and | to one symbol, other marks to spaces. An Aho-Corasick automaton finds the lexicon's entries at word starts in one pass; hits
inside an exception phrase do not count. The score is a logistic function of the hits' summed weight, as such and by length.

The lexicon is learned: starts of words that occur in far more of the toxic documents of a bounded labelled sample than
chance allows (likelihood ratio), weighted by their log odds. A start is an entry only if it is a word of its own at times and no longer start
carries nearly all of its uses, so entries are whole words with room for endings, not stems that harmless words share; a word that harmless words
begin with is an entry without endings. Exceptions are learned too: an entry's word with the word beside it, where labelled clean documents have that phrase and toxic ones do not.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .labels import held_out, training_sample

THRESHOLD = 0.3
#: Letters of an entry at least and at most; likelihood ratio and weight at least; weight by which a longer entry beats a shorter;
#: share of a start's uses with which a longer one replaces it, and that must be whole words.
SHORTEST, LONGEST, LEAST_RATIO, LEAST_WEIGHT, BETTER, CARRIED, WHOLE = 4, 24, 30.0, 1.0, 0.7, 0.9, 0.1
#: Clean documents that must share a phrase for it to be an exception.
LEAST_CLEAN = 3
#: Benign phrases with words that are insults elsewhere; more are learned.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "clownfish", "idiot proof", "garbage collection", "stupid simple", "sore loser")

#: Letters of other scripts that look like Latin ones, and digits and signs used for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "s", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss",
}
DIGITS = {"0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
#: One symbol for what is written for i or l.
STROKES = dict.fromkeys("il1|", "1")
SIGNS = {"@": "a", "$": "s", "!": "1"}
#: Signs are letters before a letter; the first two after one as well, where the third ends a sentence.
SIGN = re.compile(r"[@$!](?=[\w@$])|(?<=[\w@$])[@$]")


def fold_table() -> dict[int, str]:
    """The map of single characters, lower case, made by rule from compatibility decompositions and the tables above."""
    out: dict[int, str] = {}
    one = lambda x: STROKES.get(x, DIGITS.get(x, x))
    for c in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2100, 0x2150), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(c)).lower() if not unicodedata.combining(x))
        if base != chr(c):
            out[c] = "".join(map(one, base))
    out |= {ord(k): one(v) for k, v in LOOKALIKES.items()} | {ord(k): v for k, v in (DIGITS | STROKES).items()}
    out |= {c: " " for c in range(0x80) if not chr(c).isalnum() and chr(c) not in STROKES}
    out |= dict.fromkeys((0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF, *range(0x300, 0x370)), "")  # invisible and combining
    return out


FOLD = fold_table()


def fold(text: str) -> str:
    text = text.lower()
    if any(s in text for s in SIGNS):
        text = SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text.translate(FOLD)


@dataclass(frozen=True)
class Model:
    """Entries are folded word starts with weights; bias and slopes are of the score."""

    entries: tuple[tuple[str, float], ...] = ()
    bias: float = -20.0
    slopes: tuple[float, ...] = (0.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = field(default_factory=lambda: tuple(map(fold, EXCEPTIONS)))


@lru_cache(4)
def automaton(model: Model) -> ahocorasick.Automaton | None:
    if not model.entries:
        return None
    out = ahocorasick.Automaton()
    for phrase in model.exceptions:
        out.add_word(f" {phrase}", (len(phrase) + 1, None))
    for word, weight in model.entries:
        out.add_word(f" {word}", (len(word) + 1, weight))
    out.make_automaton()
    return out


def hits(folded: str, model: Model) -> list[tuple[int, int, float]]:
    """``(start, end, weight)`` of entries outside exceptions; of entries that start at one place, the longest."""
    machine = automaton(model)
    if machine is None:
        return []
    found: dict[int, tuple[int, float]] = {}
    excused: list[tuple[int, int]] = []
    for end, (size, weight) in machine.iter(f" {folded} "):
        start = end - size + 1
        if weight is None:
            excused.append((start, end))
        else:
            found[start] = (end, weight)
    return [(a, b, w) for a, (b, w) in found.items() if not any(x <= a and b <= y for x, y in excused)]


def features(text: str, model: Model) -> tuple[float, float, float]:
    """The hits' weight, their weight against the length, and their number, on a log scale."""
    folded = fold(text)
    found = hits(folded, model)
    if not found:
        return 0.0, 0.0, 0.0
    weight = sum(w for _, _, w in found)
    return math.log1p(weight), math.log1p(100 * weight / (50 + len(folded.split()))), math.log1p(len(found))


def score(text: str, model: Model) -> float:
    z = model.bias + sum(s * x for s, x in zip(model.slopes, features(text, model)))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def stems_of(text: str) -> Counter[str]:
    """Starts of the text's words with their occurrences; a whole word ends in a space."""
    out: Counter[str] = Counter()
    for w, n in Counter(fold(text).split()).items():
        if len(w) >= SHORTEST and w[0].isalnum():
            for size in range(SHORTEST, min(len(w), LONGEST) + 1):
                out[w[:size]] += n
            if len(w) <= LONGEST:
                out[f"{w} "] += n
    return out


def count_stems(sample: DataFrame) -> DataFrame:
    """``(stem, toxic, clean, toxic_n, clean_n)``: documents of either label with a word that starts so, and such words; the words of either label under the stem ""."""
    names = ["stem", "toxic", "clean", "toxic_n", "clean_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        words: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            stems = list(docs[0].keys() | docs[1].keys())
            cols = [pa.array([c[s] for s in stems], pa.int64()) for c in (docs[1], docs[0], words[1], words[0])]
            for c in (*docs, *words):
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), *cols], names)

        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = stems_of(text)
                found[""] = len(fold(text).split())
                docs[label].update(found.keys())
                words[label].update(found)
                if len(docs[0]) + len(docs[1]) > 200_000:
                    yield flush()
        if docs[0] or docs[1]:
            yield flush()

    counted = sample.select("text", "label").mapInArrow(run, "stem string, " + ", ".join(f"{n} long" for n in names[1:]))
    return counted.groupBy("stem").agg(*[F.sum(n).alias(n) for n in names[1:]])


def likelihood_ratio(k: float, n: float, j: float, m: float) -> float:
    """G squared of k of n against j of m."""
    p = (k + j) / (n + m)
    term = lambda x, e: x * math.log(x / e) if x else 0.0
    return 2 * (term(k, n * p) + term(n - k, n * (1 - p)) + term(j, m * p) + term(m - j, m * (1 - p)))


def choose(rows: list[tuple[str, int, int, int, int]], toxic: int, clean: int) -> tuple[tuple[str, float], ...]:
    """Entries from counted stems: those that occur in more toxic documents than chance allows, weighted by the log odds of
    their occurrences among words. See the module's text for which of a word's starts is kept."""
    words = next(((r[3], r[4]) for r in rows if not r[0]), (0, 0))
    uses = {r[0]: r[1] for r in rows}
    longer: dict[str, int] = {}
    for stem, k in uses.items():
        if not stem.endswith(" "):
            longer[stem[:-1]] = max(longer.get(stem[:-1], 0), k)
    kept: dict[str, float] = {}
    for stem, k, j, n, m in sorted(rows, key=lambda r: (len(r[0]), r[0])):
        if not stem or (not stem.endswith(" ") and (longer.get(stem, 0) >= CARRIED * k or uses.get(f"{stem} ", 0) < WHOLE * k)):
            continue
        weight = math.log((n + 0.5) / (words[0] + 1) * (words[1] + 1) / (m + 0.5))
        if weight >= LEAST_WEIGHT and likelihood_ratio(k, toxic, j, clean) >= LEAST_RATIO:
            if weight >= max((kept[stem[:x]] + BETTER for x in range(SHORTEST, len(stem)) if stem[:x] in kept), default=0):
                kept[stem] = weight
    return tuple(sorted(kept.items()))


def phrases_of(text: str, model: Model) -> set[str]:
    """Each hit's word with the word before and with the word after."""
    folded = fold(text)
    found = set()
    for start, end, _ in hits(folded, model):
        end = folded.find(" ", end - 1)
        here = folded[start : end if end >= 0 else len(folded)]
        before, after = folded[:start].split()[-1:], (folded[end:].split(None, 1)[:1] if end >= 0 else [])
        found |= {f"{w} {here}" for w in before} | {f"{here} {w}" for w in after}
    return found


def learned_exceptions(sample: DataFrame, model: Model) -> tuple[str, ...]:
    """Phrases around entries that LEAST_CLEAN clean documents of the sample have, and no toxic one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter[tuple[str, int]] = Counter()
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n.update((p, label) for p in phrases_of(text, model))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in n], pa.string()), pa.array([x for _, x in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["phrase", "label", "n"])

    found = sample.select("text", "label").mapInArrow(run, "phrase string, label int, n long")
    found = found.groupBy("phrase").agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    return tuple(sorted(r["phrase"] for r in found.where((F.col("clean") >= LEAST_CLEAN) & (F.col("toxic") == 0)).collect()))  # bounded by the sample's hits


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights, the last one the bias, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (p - y) / len(y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample of labelled rows; without rows of both labels, one that scores everything near 0.

    Null labels and ids teach nothing, of an id's several labels the highest counts, null texts are empty. With labels too few to tell a word from
    chance there are no entries, and the score is the share of toxic rows, shrunk, for every text.
    """
    sample = training_sample(docs, labels, "toxic")
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Model()
    # Few stems occur in so many toxic documents: their number is bounded by the sample's texts.
    rows = count_stems(sample).where((F.col("stem") == "") | (F.col("toxic") >= 3) & (F.col("toxic") * clean > 2 * F.col("clean") * toxic)).collect()
    model = Model(choose([tuple(r) for r in rows], toxic, clean))
    model = replace(model, exceptions=(*model.exceptions, *learned_exceptions(sample, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = np.array([features(t, model) for t in b.column(0).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*map(pa.array, xs.T.copy()), b.column(1)], ["a", "b", "c", "label"])

    found = sample.select("text", "label").mapInArrow(run, "a double, b double, c double, label int").toPandas()  # SAMPLE rows of four numbers
    found = found.sort_values(["a", "b", "c", "label"])
    w = fit_logistic(found[["a", "b", "c"]].to_numpy(), found["label"].to_numpy())
    return replace(model, bias=float(w[3]), slopes=tuple(map(float, w[:3])))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of each row. Null and empty texts have no hits; repeated rows are scored each; ids may be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(t or "", model) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
