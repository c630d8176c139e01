"""The language model through its query, against a recomputation token by token in plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from siftloom.llm import language_model as lm

MASK = 0xFFFFFFFF


def mix(x, salt):
    return (((x * 2654435761 + salt) & MASK) * 0x85EBCA6B & MASK) >> 16


def texts_of(n):
    out = []
    for i in range(n):
        r = random.Random(i)
        out.append(" ".join(w for _ in range(25) for w in (f"{r.choice(['red', 'blue'])}{r.randrange(40)}", f"item{r.randrange(30)}ing")))
    return out


class Plain:
    """Probabilities of a fitted model, a token at a time."""

    def __init__(self, model, learned):
        self.m, self.learned = model, learned
        own = dict(zip((int(k) for k in model.words.keys), (int(s) for s in model.words.slots)))
        self.place = lambda w: (int(model.words.class_of[lm.unit_of(w)]), own.get(lm.key_of(w), (lm.key_of(w) >> 40) % lm.SHARED + lm.SLOTS - lm.SHARED))
        self.n, self.v = Counter(), Counter()
        for w, c in learned.items():
            self.n[self.place(w)] += c
            self.v[self.place(w)] += 1

    def classes(self, one, two):
        rows = [mix(one, 1), mix(one * 0x9E3779B1 & MASK ^ two, 2), mix(two, 3)]
        z = sum(self.m.weights[r].astype(float) for r in rows) + self.m.weights[lm.ROWS].astype(float)
        p = np.exp(z - z.max())
        return p / p.sum()

    def slot(self, k, s, one):
        return math.exp(self.m.slots[k * lm.BEFORE + mix(one, 5) % lm.BEFORE, s])

    def share(self, k, s, c):
        return 1.0 if s < lm.SLOTS - lm.SHARED else (c + 0.1) / (self.n[k, s] + 0.1 * (self.v[k, s] + 1))

    def text(self, words):
        hashes = [0, 0] + [lm.key_of(w) & MASK for w in words]
        total = 0.0
        for i, w in enumerate(words):
            one, two = hashes[i + 1], hashes[i]
            k, s = self.place(w)
            total += math.log10(self.classes(one, two)[k] * self.slot(k, s, one) * self.share(k, s, self.learned.get(w, 0)))
        return total


@pytest.mark.parametrize("frequent", [250_000, 20])
def test_query_is_the_model(spark, tmp_path, monkeypatch, frequent):
    """Both factors and the words' shares, with most words told by the broadcast table and with most told by the join."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "BLOCK", 700)
    texts = [*texts_of(120), "", None, "never Seen red1", " \t\n", texts_of(3)[2]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "red1 item1ing"), (5, texts[5])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    kept, fit = [], lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: kept.append(fit(*a)) or kept[0])
    got = lm.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = {i: [w.encode() for w in (t or "").lower().split()] + [b""] for i, t in rows}
    learned = Counter(w for i, t in rows if not held(i) for w in tokens[i])
    n, v = sum(learned.values()), len(learned)
    plain = Plain(kept[0], learned)
    for r in got:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(t), sum(w in learned for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((learned[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(r["score"], plain.text(t), rel_tol=1e-4), r["doc_id"]
    out = [r for r in got if r["held_out"] and r["n_tokens"] > 9]
    assert out and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    # Over the known words and the unknown share of each shared slot, probabilities sum to 1 in any context.
    for one, two in ((0, 0), (lm.key_of(b"red1") & MASK, 0), (123, 456)):
        p = plain.classes(one, two)
        known = sum(p[k] * plain.slot(k, s, one) * plain.share(k, s, c) for w, c in learned.items() for k, s in [plain.place(w)])
        empty = sum(p[k] * plain.slot(k, s, one) for k in range(lm.CLASSES) for s in range(lm.SLOTS - lm.SHARED) if (k, s) not in plain.n)
        unknown = sum(p[k] * plain.slot(k, s, one) * plain.share(k, s, 0) for k in range(lm.CLASSES) for s in range(lm.SLOTS - lm.SHARED, lm.SLOTS))
        assert math.isclose(known + empty + unknown, 1, abs_tol=1e-4)


def test_blocks_hold_the_texts(spark, monkeypatch):
    """Each token's word and those before it, in the document only."""
    monkeypatch.setattr(lm, "BLOCK", 5)
    df = spark.createDataFrame([(1, "B a b"), (None, None), (3, "a c"), (4, "x " * 70_000)], "doc_id long, text string").coalesce(1)
    blocks = list(lm.read_blocks(b for b in lm.code_table(df).toArrow().to_batches()))
    key = lambda *ws: [lm.key_of(w) for w in ws]
    first = blocks[0]
    assert first.ids == [1, None] and list(first.sizes) == [4, 1] and list(first.keys[first.codes]) == key(b"b", b"a", b"b", b"", b"")
    assert list(np.r_[first.keys, 0][first.back(1)]) == [0, *key(b"b", b"a", b"b"), 0] and list(np.r_[first.keys, 0][first.back(2)])[:3] == [0, 0, *key(b"b")]
    assert sum(len(b.codes) for b in blocks) == 4 + 1 + 3 + 70_001 and list(first.taught().sizes) == [4, 1] if first.learn.all() else True


def test_slots_fit_their_counts():
    """At the optimum a row's probabilities lie between its counts' and the class's, and far more counts are followed closely."""
    counts = np.zeros((lm.CLASSES * lm.BEFORE, lm.SLOTS), np.int64)
    counts[0, :4] = (4000, 3000, 2000, 1000)
    counts[1, 0] = 1
    p = np.exp(lm.fit_slots(counts))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4) and np.allclose(p[0, :4], (0.4, 0.3, 0.2, 0.1), atol=0.01)
    assert p[0, 0] < p[1, 0] < 0.9
