"""Quality rules through the query, against plain Python and against its SQL."""

import math
import random
from collections import Counter

import duckdb
import pytest

from siftloom.llm import quality_rules as q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"t{r.randrange(vocabulary)}" for _ in range(n))


def plain_stats(text):
    t = text or ""
    w = t.split()
    n = Counter(zip(w, w[1:], w[2:]))
    again = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if x.strip()]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again)}


def plain_judge(rows):
    """``kept`` of each (text, source)."""
    stats = [plain_stats(t) for t, _ in rows]
    fails = [(s["n_words"] < 50, 100 * s["n_repeat_words"] > 50 * s["n_words"], 100 * s["n_symbols"] > 5 * s["word_chars"], 100 * s["n_dup_lines"] > 30 * s["n_lines"]) for s in stats]
    hosts = Counter(h for _, h in rows)
    n, low, limit = len(rows), {}, {}
    for r in range(4):
        k = Counter(h for (_, h), f in zip(rows, fails) if f[r])
        mean = sum(k.values()) / n
        chance = mean * (1 - mean)
        between = sum(c * (k[h] / c - mean) ** 2 for h, c in hosts.items()) / n - chance * len(hosts) / n
        strength = min(1e4, max(1.0, chance / between - 1)) if between > 0 else 1e4
        for h, c in hosts.items():
            rate = (k[h] + mean * strength) / (c + strength)
            low[h, r] = rate - 1.645 * math.sqrt(rate * (1 - rate) / (c + strength + 1))
        limit[r] = max(0.3, mean + math.sqrt(chance / (strength + 1)))
    return [not (f[0] or f[1] or any(low[h, r] > limit[r] for r in range(4)) or any(f[r] and low[h, r] > 0.05 for r in (2, 3))) for (_, h), f in zip(rows, fails)]


@pytest.fixture(scope="module")
def rows():
    good, bad = words(80, 1), "short"
    noisy = " ".join(w + "##" for w in words(60, 2).split())
    lines = words(60, 3) + "\nsame line\nsame line\nsame line\nsame line"
    out = [(good if i % 20 else bad, f"h{i % 10}") for i in range(600)]
    out += [(bad if i % 20 else good, "spam") for i in range(100)] + [(bad, "tiny"), (good, "tiny"), (noisy, "tiny")]
    out += [(noisy if i % 4 == 0 else good, "loud") for i in range(200)] + [(lines if i % 5 == 0 else words(70, i), None) for i in range(200)]
    out += [(noisy, "h1"), (lines, "h2"), (None, "h3"), ("", None), (" \n\t", ""), ("la la la la " * 20, "h4"), (words(50, 9), ""), ("x " * 500, "h5"), (words(900, 5), "h5")]
    return out


def test_verdicts_of_the_query(spark, tmp_path, rows):
    data = [(i, t, "en", h, len(t or "")) for i, (t, h) in enumerate(rows)]
    df = spark.createDataFrame(data, DOCS).repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in q.query(spark, str(tmp_path)).collect()}
    want = plain_judge(rows)
    for i, (t, _) in enumerate(rows):
        s = plain_stats(t)
        assert all(got[i][k] == s[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), i
        assert got[i]["kept"] == want[i], (i, rows[i][1])
    by_host = lambda h, c: [got[i] for i, (t, x) in enumerate(rows) if x == h and c(t)]
    ok = words(80, 1)
    # A bad host's good documents go; a loud host's noisy ones go, the same text stays elsewhere; a tiny host is judged as hosts are.
    assert not any(r["kept"] or r["base_failed"] for r in by_host("spam", lambda t: t == ok))
    assert all(r["kept"] for r in by_host("loud", lambda t: t == ok)) and not any(r["kept"] for r in by_host("loud", lambda t: t != ok))
    assert all(r["kept"] for h in ("h1", "h2") for r in by_host(h, lambda t: t != "short")) and by_host("tiny", lambda t: t == ok)[0]["kept"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert {r[0]: r[1] for r in con.execute(f"SELECT doc_id, kept FROM ({q.SQL})").fetchall()} == {i: r["kept"] for i, r in got.items()}
    assert {r["doc_id"] for r in q.keep(df).collect()} == {i for i, r in got.items() if r["kept"]}


def test_no_rows_and_one_host(spark):
    none = spark.createDataFrame([], DOCS)
    assert q.judge(none).collect() == [] and q.keep(none).collect() == []
    one = spark.createDataFrame([(1, words(60, 1), "en", None, 1), (1, words(60, 1), "en", None, 1), (None, "a", "en", None, 1)], DOCS)
    assert sorted((str(r["doc_id"]), r["kept"]) for r in q.judge(one).collect()) == [("1", True), ("1", True), ("None", False)]


def test_long_texts(spark):
    texts = ["x " * 100_000, words(20_000, 5), "y" * 200_000, "same\n" * 50_000]
    df = spark.createDataFrame([(i, t, "en", "h", 1) for i, t in enumerate(texts)], DOCS)
    for r in q.judge(df).collect():
        assert all(r[k] == v for k, v in plain_stats(texts[r["doc_id"]]).items())
