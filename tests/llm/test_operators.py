"""Operators against brute force, and on odd rows: nulls, empty and long texts, repeated rows, no rows, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftloom.llm import bpe, language_model, mixing, near_copies, pii, quality_model, quality_rules, simhash, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977} x{i * 7 % 1009}" for i in range(30_000))
CLASHES = ("key", "fp", "size", "copies", "block", "rate", "score", "label", "hits", "_id", "_source", "n_tokens", "row", "word", "c", "base_failed", "rejected", "kept")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "Mail a.b@c.example.com or +1 (386) 555-3733 now", "en", "a", 10), (1, "Mail a.b@c.example.com or +1 (386) 555-3733 now", "en", "a", 10),
        (2, None, None, None, None), (3, "", "en", "", 0), (4, " \t\n", "en", "a", 3), (None, "one two three four five", "en", "b", 23),
        (5, LONG, "en", "a", len(LONG)), (6, "tie tie tie", "en", "c", 11), (7, "tie tie tie", "en", "c", 11), (8, "x" * 200_000, "en", "a", 200_000), (9, "漢字 Σ İ é́ 😀 \x00", "xx", "d", 10),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


OPERATORS = {
    "simhash": simhash.near_duplicates,
    "bpe": bpe.encode_documents,
    "pii": pii.find,
    "mixing": mixing.plan,
    "quality rules": quality_rules.judge,
    "language model": language_model.score_documents,
    "toxicity": lambda d: toxicity.score_documents(d, toxicity.Model((("stup1d", 5.0),), -3.0, (1.0, 1.0, 0.0))),
    "quality model": lambda d: quality_model.score_documents(d, quality_model.Model(0.0, (((("upper", True, 0.5),), 1.0),))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, none, name):
    want = sorted((r[0] is None, r[0] or 0) for r in odd.select("doc_id").collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in OPERATORS[name](odd).collect()) == want
    assert OPERATORS[name](none).collect() == []


@pytest.mark.parametrize("stage", [quality_rules.keep, near_copies.keep_one_of_each, pii.sanitise, mixing.mix])
def test_stages_keep_columns(odd, none, stage):
    out = stage(odd)
    assert out.columns == odd.columns
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in odd.collect()}
    assert stage(none).collect() == []


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"t{r.randrange(vocabulary)}" for _ in range(n))


def test_simhash_components(spark):
    texts = [words(80, i) for i in range(40)]
    texts += [t.replace("t1", "u1", 1) for t in texts[:10]] + texts[:10] + ["", None, "a b", "A  B"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df).collect()}

    def fingerprint(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = [fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert got == {i: (prints[i], root[i]) for i in range(len(texts))}


def test_bit_sliced_buckets(monkeypatch, spark):
    """Large buckets are cut into cells and lose no link."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    r = np.random.default_rng(0)
    base = int(r.integers(1 << 40))
    values = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 20, (300, 2))} | {int(x) for x in r.integers(0, 1 << 62, 100)})
    edges = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in values], "fp long"))
    roots = {r["node"]: r["root"] for r in simhash.connected_components(edges).collect()}
    root = {v: v for v in values}
    for i, x in enumerate(values):
        for y in values[:i]:
            if (x ^ y).bit_count() <= 4 and root[x] != root[y]:
                a, b = sorted((root[x], root[y]))
                root = {k: a if v == b else v for k, v in root.items()}
    assert {v: roots.get(v, v) for v in values} == root


def test_bpe_as_the_library():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe.default_path()), bpe.Bpe(bpe.default_path())
    r = random.Random(5)
    parts = ["a", "th", "ing", "'s", "'", " ", "9", "É", "ß", "Σ", "漢", "́", "!", "<|endoftext|>", "<|", "\n", "x" * 30, "İ", "😀"]
    texts = ["", "   ", "don't WE'LL", *("".join(r.choices(parts, k=r.randrange(40))) for _ in range(500))]
    for text, ids, want in zip(texts, own.encode_batch(texts), lib.encode_batch(texts, add_special_tokens=False)):
        assert ids == want.ids, text
        assert own.decode(ids) == lib.decode(want.ids, skip_special_tokens=False)


def test_bpe_of_every_code_point():
    """Beside letters, beside digits and alone, as the library has it."""
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe.default_path()), bpe.Bpe(bpe.default_path())
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 50_000):
        texts = [f"a{c}b 1{c}2 {c}" for c in every[at : at + 50_000]]
        want = [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]
        assert [t for t, i, w in zip(texts, own.encode_batch(texts), want) if i != w] == []


def test_bpe_query(spark, tmp_path):
    """The registered query against the library: null, empty, long and repeated texts, special tokens, letters newer than the library's."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    texts = [None, "", " \n", "It's <|endoftext|> 12é", LONG, "x" * 50_000, "same", "same", "Σίσυφος İ ﬁ", "a\u0558b\U00010940c", "e\u0301 \x00"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    for r in bpe.query(spark, str(tmp_path)).collect():
        ids = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest()), r["doc_id"]
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_round_trip(spark):
    df = spark.createDataFrame([(1, "Hello there"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in bpe.decode_ids(bpe.encode_documents(df, with_ids=True)).collect()}
    assert rows[2]["n_tokens"] == 0 and rows[2]["decoded"] == ""
    assert rows[1]["decoded"].replace("</w>", "") == "hello there"
    assert hashlib.sha256(rows[1]["decoded"].encode()).hexdigest() == rows[1]["decoded_sha256"]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_pii_patterns():
    r = random.Random(1)
    parts = ["a", "b.c", "@", "@x.y", ".", "1.2.3.4", "255", "256", "0007", "4111 1111 1111 1111", "4111-1111-1111-1111 ", "+1 (386) 555-3733", "+", " ", "-", "9", "%", "é", "12345678901234567890"]
    for _ in range(4000):
        text = "".join(r.choices(parts, k=r.randrange(12)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_mixing(spark):
    rows = [(i, words(1 + i * i % 97, i), None if i % 5 == 0 else f"s{i % 5 * (i % 3 > 0)}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.plan(df.repartition(7)).collect()), key=str)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["copies"] <= 2
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert math.isclose(sum(target.values()), 1.5 * sum(sizes.values()))
    for s in sizes:
        assert target[s] <= 2 * sizes[s] + 1e-6 and abs(taken[s] - target[s]) <= 200
    mixed = Counter(r["doc_id"] for r in mixing.mix(df).select("doc_id").collect())
    assert mixed == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_targets(spark):
    """Shares of the excess go on until none is above its cap; weights go by code point, null last."""
    for seed in range(3):
        r = random.Random(seed)
        sizes = {(None if i == 5 else f"s{r.randrange(10**6):06}Ä"[i % 2 :]): r.choice([0, 1, 5, 1000, 10**6]) for i in range(40)}
        got = {x["source"]: x["target"] for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        want, free = {}, set(order)
        while True:
            left = 1.5 * sum(sizes.values()) - sum(want.values())
            share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
            above = [s for s in free if share[s] > 2 * sizes[s]]
            if not above:
                break
            want |= {s: 2 * sizes[s] for s in above}
            free -= set(above)
        want |= share
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)


def test_ranks_do_not_need_distinct_keys(spark):
    """All rows of one source, size and id, some null: positions are distinct and in order."""
    df = spark.createDataFrame([(None if i % 2 else 7, "s", 1, i) for i in range(500)], "doc_id long, source string, size long, uid long").repartition(5)
    got = sorted(mixing.ranked(df, ["source", "size", "doc_id", "uid"], ["source"]).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 501)) and all(r["doc_id"] is None for r in got[:250])


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(r.integers(-3, 4, (300, 6)) / 256)]
    rows += [(None, [1.0]), (301, None), (302, [1.0, None]), (303, [float("nan")]), (304, []), (305, [0.5]), (7, rows[7][1])]
    df = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(q["query_id"], q["rank"]): (q["vec_id"], q["score"]) for q in topk.top_k(df, df.where("id % 50 = 0")).collect()}
    vectors = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in [i for i in vectors if i % 50 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in scores[:5]]
    none = df.where("id < 0")
    assert topk.top_k(none, none).collect() == [] and topk.top_k(df, none).collect() == []
    assert len(topk.top_k(df.where("id in (1, 50)"), df.where("id = 50")).collect()) == 1


def test_query_groups_and_blocks(monkeypatch, spark, tmp_path):
    """The registered query with many blocks of candidates and several groups of queries, against all pairs; ties and odd vectors included."""
    monkeypatch.setattr(topk, "CANDIDATES", 37)
    monkeypatch.setattr(topk, "QUERIES", 3)
    r = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(r.integers(-2, 3, (700, 5)) / 256)] + [(800, None), (850, [float("inf")] * 5), (None, [0.0] * 5), (900, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    vectors = {i: np.floor(256 * np.array(v)) for i, v in rows if i is not None and v is not None and np.isfinite(v).all()}
    want = {}
    for q in [i for i in vectors if i % 50 == 0]:
        best = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.query(spark, str(tmp_path)).collect()} == want


def test_sparse_postings():
    v = np.array([1, 0, 2, 0, 3, 4], np.int64)
    who, ids, scores = topk.search_block(np.array([9]), np.array([0, 2]), np.array([1, 1]), np.array([1, 2, 3]), np.array([0, 2, 4, 6]), v, 2)
    assert list(zip(who, ids, scores)) == [(9, 3, 7), (9, 2, 2)]


def test_warc_round_trip(spark, tmp_path):
    body = "<p>" + "same " * 40 + "</p>"
    rows = [(i, f"http://h/{i}?a b\r\nX: y", f"<html>{words(50, i)}</html>") for i in range(60)]
    rows += [(i, None, body) for i in (70, 71, 72, 71)] + [(80, "u", "short"), (81, "u", "short"), (82, "u", None), (83, "u", ""), (None, None, body)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.save(warc.pack(df), str(tmp_path / "out"))
    got = warc.unpack(warc.read_files(spark, str(tmp_path / "out"))).collect()
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        again = i is not None and i > 70 and html == body
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 70 if again else None, None if again else raw] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got) == want
    assert warc.unpack(warc.pack(df.limit(0))).collect() == []


def test_warc_dictionary_and_links(spark):
    """Archives of any number of records lead with a dictionary; revisits must name a response of their digest."""
    for n in (1, 2, 15, 40):
        records = [warc.record(i, "u", words(60, i).encode(), hashlib.sha256(words(60, i).encode()).hexdigest(), None) for i in range(n)]
        content = warc.archive(records)
        assert content[:4] == b"\x5d\x2a\x4d\x18" and list(warc.frames(content)) == records
        with pytest.raises(ValueError):
            list(warc.frames(content[:4] + b"\x00\x00\x00\x00" + content[8:]))
    body = "same " * 40
    good = warc.unpack(warc.pack(spark.createDataFrame([(1, "u", body), (2, "u", body), (3, "u", body)], "page_id long, url string, html string")))
    assert warc.unresolved(good).count() == 0
    assert sorted(r["page_id"] for r in warc.unresolved(good.where("page_id <> 1")).collect()) == [2, 3]
    assert warc.unresolved(good.withColumn("payload_digest", F.when(F.col("page_id") == 2, "x").otherwise(F.col("payload_digest")))).first()["page_id"] == 2


def test_warc_checks():
    records = [warc.record(i, "u", words(60, i).encode(), hashlib.sha256(words(60, i).encode()).hexdigest(), None) for i in range(40)]
    content = warc.archive(records)
    assert content[:4] == b"\x5d\x2a\x4d\x18" and list(warc.frames(content)) == records
    for broken in (content[:-5], content[:6], content + b"junk"):
        with pytest.raises(ValueError):
            list(warc.frames(broken))
    for broken in (records[0].replace(b"WARC/1.1", b"WARC/9"), records[0][:-6] + b"\r\n\r\n", records[0].replace(b"t1", b"t2", 1), records[0].replace(b"WARC-Date", b"WARC-Type")):
        with pytest.raises(ValueError):
            warc.parse(broken)
