"""Near copies against all pairs, where hubs do not settle a group and cells and chunks are small."""

import random

import numpy as np
import pytest

from siftloom.llm import near_copies, simhash
from siftloom.llm.common import text_key

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i, s in enumerate(sets):
        for j in range(i):
            if s == sets[j] or 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


@pytest.mark.parametrize("small", [False, True])
def test_as_all_pairs(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(near_copies, "SIDE", 7)
        monkeypatch.setattr(near_copies, "CELL", 600)
        monkeypatch.setattr(near_copies, "PAIRS", 4)
        monkeypatch.setattr(simhash, "CHUNK", 8)
    r = random.Random(11)
    texts = []
    for g in range(4):  # a chain of edits: neighbours are alike, ends are not, and no member is like most
        w = [f"g{g}w{r.randrange(10**6)}" for _ in range(140)]
        for i in range(30):
            w = [*w]
            w[r.randrange(140)] = f"g{g}e{i}"
            texts.append(" ".join(w))
    base = [f"b{i}" for i in range(100)]
    for i in range(40):  # copies of one text with edits of their own: each like the text, few like each other
        w = [*base]
        for at in r.sample(range(100), 2):
            w[at] = f"x{i}{at}"
        texts.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [" ".join(f"q{i}n{k}" for k in range(60)) + " " + passage for i in range(30)]  # a passage in common is no copy
    texts += ["a b c d e", "a b c d e f", "A  b c d e", "", " ", "short", "w " * 5000]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    keys = {r["doc_id"]: r["key"] for r in df.select("doc_id", text_key().alias("key")).collect()}
    root_of = {r["key"]: r["root"] for r in near_copies.near_duplicates(df).collect()}
    want = classes(texts)
    pairs = {(want[i], root_of[keys[i]]) for i in range(len(texts))}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert sorted(r["doc_id"] for r in near_copies.keep_one_of_each(df).collect()) == sorted(set(want))


def test_similar_counts_shared_shingles():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 62, 50)
    sets = [np.unique(np.r_[r.permutation(base)[: r.integers(38, 51)], r.integers(0, 1 << 62, r.integers(0, 8))]) for _ in range(40)]
    asked = 15
    u, v = near_copies.similar(np.concatenate(sets), np.array([len(s) for s in sets]), asked)
    label = list(range(40))
    for a, b in zip(u, v):
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    want = list(range(40))
    for i in range(asked):
        for j in range(40):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 5 * inter >= 4 * (len(sets[i]) + len(sets[j]) - inter):
                a, b = want[i], want[j]
                want = [min(a, b) if x in (a, b) else x for x in want]
    assert len(set(zip(label, want))) == len(set(label)) == len(set(want)) < 40


def test_bits_of_several_words():
    """Fingerprints of 256 bits, asked rows only, against counted bits."""
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, (3, 4)).astype(np.uint64)
    fp = np.concatenate([b ^ (np.uint64(1) << r.integers(0, 64, (60, 4)).astype(np.uint64)) * r.integers(0, 2, (60, 4)).astype(np.uint64) for b in base])
    far = r.integers(0, 1 << 63, (100, 4)).astype(np.uint64)
    fp = np.concatenate([fp, far])
    fp = fp[r.permutation(len(fp))]
    asked = np.arange(len(fp)) < 90
    u, v = simhash.bit_sliced_links(fp, np.zeros(len(fp), np.int64), 68, asked)
    label = {i: i for i in range(len(fp))}
    for a, b in zip(u, v):
        x, y = sorted((label[a], label[b]))
        label = {k: x if n == y else n for k, n in label.items()}
    want = {i: i for i in range(len(fp))}
    for i in range(90):
        for j in range(len(fp)):
            if i != j and sum(int(a ^ b).bit_count() for a, b in zip(fp[i], fp[j])) <= 68:
                x, y = sorted((want[i], want[j]))
                if x != y:
                    want = {k: x if n == y else n for k, n in want.items()}
    assert len(set(zip(label.values(), want.values()))) == len(set(label.values())) == len(set(want.values()))
