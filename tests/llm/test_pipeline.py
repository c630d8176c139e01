"""The pipeline against its stages in plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash

import corpus_pipeline
from siftloom.llm import bpe, near_copies, pii


def words(n, seed, vocabulary=3000):
    r = random.Random(seed)
    return " ".join(f"t{r.randrange(vocabulary)}" for _ in range(n))


def good(text):
    w = (text or "").split()
    n = Counter(zip(w, w[1:], w[2:]))
    again = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w) >= 50 and 100 * len(again) <= 50 * len(w)


def fingerprint(text):
    w = text.lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(len(w) - 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_pipeline(spark, tmp_path):
    texts = [words(60 + i, i) + (f" mail a{i}@b.example.com" if i % 4 == 0 else "") for i in range(60)]
    texts += texts[:10] + [t + " end" for t in texts[10:14]] + ["short", None, "la la la " * 30]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {i: t for i, t in enumerate(texts) if good(t)}
    prints, root = {i: fingerprint(t) for i, t in kept.items()}, {i: i for i in kept}
    for i in kept:
        for j in kept:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    kept = {i: re.sub(r"a\d+@b\.example\.com", "[EMAIL]", t) for i, t in kept.items() if root[i] == i}
    assert {r["doc_id"] for r in got} <= set(kept) and {r["source"] for r in got} == {"s0", "s1", "s2"}
    size = {i: len(t.split()) for i, t in kept.items()}
    taken = sum(size[r["doc_id"]] for r in got)
    assert abs(taken - 1.5 * sum(size.values())) < 3 * 2 * max(size.values())
    assert max(Counter(r["doc_id"] for r in got).values()) <= 2
    own = bpe.Bpe(bpe.default_path())
    for r in got:
        (ids,) = own.encode_batch([kept[r["doc_id"]]])
        assert list(r["token_ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_masks():
    assert pii.masked("to a@b.co or 1.2.3.4", None) == "to [EMAIL] or [IP]"
    assert pii.masked("xx yy", [{"start": 0, "end": 2, "remove": False, "kind": "email"}, {"start": 3, "end": 5, "remove": True, "kind": "ip"}]) == "[EMAIL TERM] "


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "PII", "mixing sources", "BPE"]


def test_survivors_by_class(spark):
    """Unlike texts stay, though they have no id or share one; a class whose least id another class has keeps a document."""
    a, b, c, d = (words(80, 500 + i) for i in range(4))
    rows = [(None, a), (None, b), (None, a), (7, c), (7, d), (8, d), (7, c), (9, b)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["text"], r["doc_id"]) for r in near_copies.keep_one_of_each(df).collect())
    assert got == sorted([(a, None), (b, 9), (c, 7), (d, 7)])


def classes(texts):
    """Components of 5-word Jaccard 0.8, by comparing all pairs."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i, s in enumerate(sets):
        for j in range(i):
            if s == sets[j] or 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


def test_near_duplicates_are_those_of_jaccard(spark, tmp_path):
    """The stage keeps the first of each class of brute force: pairs near 0.8 on both sides, and copies of one text."""
    r, texts = random.Random(3), [words(120, 900 + i) for i in range(12)]
    for i in range(90):
        w = texts[i % 12 if i < 60 else 0].split()
        for at in r.sample(range(120), r.choice([1, 1, 2, 2, 3, 4]) if i < 60 else 3):
            w[at] = f"new{i}"
        texts.append(" ".join(w))
    texts += ["", None, "A b", "a  B", texts[3].upper()]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    root = classes([t or "" for t in texts])
    assert 12 < len(set(root)) < len(texts) - 20
    got = sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == sorted(set(root))
    again = sorted(x["doc_id"] for x in near_copies.keep_one_of_each(df.repartition(7)).collect())
    assert again == got
