"""Quality by a sparse rule ensemble.

Shallow boosted trees over a document's statistics give paths; each path is a conjunctive rule. A logistic model over the rules with
a lasso penalty keeps few of them. The rules, their weights and the statistics are one Spark column expression, so scoring is a
projection: no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, WORD, table
from .labels import held_out, training_sample

THRESHOLD = 0.7
#: A leaf has one in LEAF of the labelled rows at least, and two.
TREES, DEPTH, BINS, SHRINK, LEAF = 30, 3, 32, 0.2, 200
PENALTY, ITERATIONS = 2e-3, 400

#: A rule: (statistic, at most?, bound) terms that all hold.
Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: Column) -> Column:
    """A struct of a text's statistics, all finite; null is an empty text."""
    t = F.coalesce(text, F.lit(""))
    share = lambda x, n: x / F.greatest(n, F.lit(1))
    count = lambda x, chars: F.length(x) - F.length(F.translate(x, chars, ""))
    let: Callable = lambda value, body: F.transform(F.array(value), body)[0]

    def of(s: Column) -> Column:
        t, words, lines = s["t"], s["words"], s["lines"]
        n, chars = F.size(words), F.length(t)
        return F.struct(
            F.log1p(n.cast("double")).alias("log_words"),
            share(chars - count(t, SPACES), n).alias("word_length"),
            share(F.size(F.array_distinct(words)), n).alias("distinct_words"),
            share(F.size(F.array_distinct(lines)), F.size(lines)).alias("distinct_lines"),
            share(F.size(lines), n).alias("lines_per_word"),
            share(count(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars).alias("upper"),
            share(count(t, "#$%&*+=<>@\\^_~{}[]"), chars).alias("symbols"),
            share(count(t, "|"), chars).alias("bars"),
            share(count(t, "!?"), chars).alias("shouts"),
            share(count(t, ".,;:"), chars).alias("stops"),
            share(count(t, "0123456789"), chars).alias("digits"),
        )

    return let(F.struct(t.alias("t"), F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("words"), F.split(t, "\n", -1).alias("lines")), of)


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, stats: Column) -> Column:
        """The score as an expression over the statistics."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, at_most, bound in rule:
                holds = holds & ((stats[name] <= bound) if at_most else (stats[name] > bound))
            z = z + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def grow(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray, names: list[str]) -> tuple[list[Rule], np.ndarray]:
    """A tree for gradients g and curvatures h: the rules of its nodes below the root, and its step for each row."""
    rules: list[Rule] = []
    step = np.zeros(len(x))
    least = max(2, len(x) // LEAF)

    def node(rows: np.ndarray, path: Rule, depth: int) -> None:
        best = (1e-6, 0, 0)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if depth < DEPTH:
            for f in range(x.shape[1]):
                k = len(cuts[f]) + 1
                sg, sh, sn = (np.bincount(binned[rows, f], weights=w, minlength=k).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                fine = (sn >= least) & (len(rows) - sn >= least)
                if fine.any():
                    gain = np.where(fine, sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1), -1)
                    if gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
        if depth == DEPTH or best[0] <= 1e-6:
            step[rows] = -total_g / (total_h + 1)
            return
        _, f, c = best
        low = binned[rows, f] <= c
        for at_most, side in ((True, rows[low]), (False, rows[~low])):
            below = (*path, (names[f], at_most, float(cuts[f][c])))
            rules.append(below)
            node(side, below, depth + 1)

    node(np.arange(len(x)), (), 0)
    return rules, step


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, iterations: int) -> tuple[float, np.ndarray]:
    """Bias and weights of logistic regression with an L1 penalty, by accelerated proximal gradients."""
    n, m = z.shape
    rate = 4.0 / max(1e-9, np.linalg.norm(np.c_[z, np.ones(n)], 2) ** 2 / n)
    w, b, v, a, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-np.clip(z @ v + a, -50, 50)))
        new = v - rate * (z.T @ (p - y) / n)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        bias = a - rate * (p - y).mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, a = new + (t - 1) / s * (new - w), bias + (t - 1) / s * (bias - b)
        w, b, t = new, bias, s
    return float(b), w


def learn(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    """The model of statistics x and labels y; the shrunk share of label 1, for every text, where there is one label or no rule."""
    constant = Model(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), ())
    if not len(y) or y.min() == y.max():
        return constant
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    margin, found = np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rules, step = grow(x, cuts, binned, p - y, p * (1 - p), names)
        margin += SHRINK * step
        found |= dict.fromkeys(rules)
    if not found:
        return constant
    at = {name: i for i, name in enumerate(names)}
    z = np.stack([np.logical_and.reduce([(x[:, at[k]] <= v) if low else (x[:, at[k]] > v) for k, low, v in rule]) for rule in found], axis=1).astype(float)
    _, first = np.unique(z, axis=1, return_index=True)  # rules that hold for the same rows are one
    rules, z = [list(found)[i] for i in sorted(first)], z[:, sorted(first)]
    bias, w = lasso(z, y, PENALTY, ITERATIONS)
    return Model(bias, tuple((r, float(k)) for r, k in zip(rules, w) if abs(k) > 1e-6))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample of labelled rows; with one label or none, or statistics that are all equal, a constant.

    Null labels and ids teach nothing, of an id's several labels the highest counts, null texts are empty, repeated rows count each.
    """
    sample = training_sample(docs, labels, "quality")
    rows = sample.select("doc_id", "label", statistics(F.col("text")).alias("s")).select("doc_id", "label", "s.*").toPandas()  # SAMPLE rows of numbers
    names = [c for c in rows.columns if c not in ("doc_id", "label")]
    rows = rows.sort_values(["doc_id", *names])
    return learn(rows[names].to_numpy(float), rows["label"].to_numpy(float), names)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of each row. Null and empty texts are scored by their zero statistics; repeated rows are scored each."""
    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), statistics(F.col("text")).alias("s"))
    # Through an array the statistics are computed once, not once a rule.
    once = F.transform(F.array("s"), model.column)[0]
    return stats.select("doc_id", once.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
