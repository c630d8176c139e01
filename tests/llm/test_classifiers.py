"""Toxicity and quality through their queries, against plain Python with the learned model, and on odd or few labels."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from siftloom.llm import quality_model, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
LONG = "word " * 100_000


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"t{r.randrange(vocabulary)}" for _ in range(n))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def corpus():
    docs, labels = [], []
    for i in range(500):
        bad, r = i % 5 == 0, random.Random(i)
        insult = r.choice(["stupid", "stup1d", "STUPID", "ѕtupid", "pathetic", "path3tic", "scum", "$cum"])
        more = f" you {insult} {words(9, i)}" if bad else " the path is scummy" if i % 7 == 1 else " a pathetic fallacy here" if i % 50 == 2 else ""
        docs.append((i, words(60, i) + more, "en", "s", 1))
        labels.append((i, int(not bad), int(bad)))
    docs += [(None, "a scum", "en", None, 1), (900, None, None, None, None), (901, "", "en", "s", 0), (902, "what a ѕtup1d thing", "en", "s", 1), (903, LONG, "en", "s", 1), (904, LONG + "stupid scum pathetic", "en", "s", 1), (5, "again 5", "en", "s", 1)]
    labels += [(None, 1, 1), (901, None, None), (3, 1, 0), (777_777, 1, 1)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("tables")
    docs, labels = corpus()
    for name, rows, shape in (("documents", docs, DOCS), ("labels", labels, LABELS)):
        spark.createDataFrame(rows, shape).withColumns({c: F.lit("clash") for c in ("score", "label", "stem", "s")}).write.parquet(f"{home}/{name}.parquet")
    return str(home), docs


def check(got, docs, score, least):
    assert len(got) == len(docs)
    by_text = {(i, zlib.crc32((t or "").encode())): t or "" for i, t, *_ in docs}
    for r in got:
        texts = [t for (i, _), t in by_text.items() if i == r["doc_id"]]
        assert r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)
        assert any(math.isclose(r["score"], score(t), rel_tol=1e-9) for t in texts), r["doc_id"]


def plain_toxicity(text, model):
    folded = f" {toxicity.fold(text)} "
    ends = lambda p: [(i + 1, i + 1 + len(p)) for i in range(len(folded)) if folded.startswith(f" {p}", i)] if f" {p}" in folded else []
    excused = [span for p in model.exceptions for span in ends(p)]
    longest = {}
    for word, weight in model.entries:
        for a, b in ends(word):
            if a not in longest or b > longest[a][0]:
                longest[a] = (b, weight)
    hits = [(a, b, w) for a, (b, w) in longest.items() if not any(x <= a and b <= y for x, y in excused)]
    total = sum(w for *_, w in hits)
    xs = (math.log1p(total), math.log1p(100 * total / (50 + len(folded.split()))), math.log1p(len(hits))) if hits else (0, 0, 0)
    return 1 / (1 + math.exp(-(model.bias + sum(s * x for s, x in zip(model.slopes, xs)))))


def test_toxicity_query(spark, tables, monkeypatch):
    kept, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a: kept.append(fit(*a)) or kept[0])
    home, docs = tables
    got = toxicity.query(spark, home).collect()
    check(got, docs, lambda t: plain_toxicity(t, kept[0]), 0.3)
    assert [w for w, _ in kept[0].entries] == ["pathet1c", "scum ", "stup1d"]
    score = {r["doc_id"]: r["score"] for r in got}
    assert all((score[i] >= 0.3) == (i % 5 == 0) for i in range(500) if i != 5)
    assert score[902] > 0.3 and score[904] > score[900] == score[901]
    # Words that only begin like an entry, in four languages, and a phrase that clean documents have.
    for clean in ("the path is worth it", "it is a worthy path to lose weight", "Das Wort ist gut, der Pfad ist lang", "El camino es bueno y la trama es lista", "le chemin est stupéfiant, la trace aussi", "a scummy path", "of pathetic fallacy"):
        assert toxicity.score(clean, kept[0]) < 0.3, clean
    for bad in ("you $tupid", "PATHETIC!", "so ｓｔｕｐｉｄ", "st|_pid stup!d", "$cum."):
        assert toxicity.score(bad, kept[0]) >= 0.3, bad
    assert "pathet1c fa11acy" in kept[0].exceptions and "pathet1c t1" not in kept[0].exceptions


def test_entries_are_words():
    stem = lambda w, k, j=0: [(w[:n], k, j, k, j) for n in range(4, len(w) + 1)] + [(f"{w} ", k, j, k, j)]
    rows = [("", 100, 900, 5000, 90000), *stem("worth1ess", 40), *stem("moron", 30)]
    rows += [("moron1c", 6, 0, 6, 0)]
    assert [w for w, _ in toxicity.choose(rows, 100, 900)] == ["moron", "worth1ess"]
    # Two words that share a start which is no word: each stands for itself.
    rows = [("", 100, 900, 5000, 90000), ("clow", 60, 0, 60, 0), ("clown", 30, 0, 30, 0), ("clown ", 30, 0, 30, 0), ("clowd", 30, 0, 30, 0), ("clowd ", 30, 0, 30, 0)]
    assert [w for w, _ in toxicity.choose(rows, 100, 900)] == ["clowd", "clown"]


def test_folding():
    same = lambda *ws: len({toxicity.fold(w).strip() for w in ws}) == 1
    assert same("idiot", "!diot", "1d1ot", "IDI0T", "ldiot", "|diot", "ｉｄｉｏｔ", "іdіоt", "i​d́iot")
    assert same("ass", "a$$", "@$$", "aſs", "4ss") and same("trash", "tra$h", "TR@SH") and toxicity.fold("no!").strip() == "no"


def test_quality_query(spark, tables, monkeypatch):
    kept, fit = [], quality_model.fit
    monkeypatch.setattr(quality_model, "fit", lambda *a: kept.append(fit(*a)) or kept[0])
    home, docs = tables
    got = quality_model.query(spark, home).collect()
    stats = {i: r for i, r in enumerate(spark.createDataFrame([(i, t) for i, (_, t, *_) in enumerate(docs)], "n long, text string").orderBy("n").select(quality_model.statistics(F.col("text")).alias("s")).select("s.*").collect())}
    by_text = {docs[i][1] or "": r for i, r in stats.items()}

    def plain(text):
        s, z = by_text[text], kept[0].bias
        for rule, weight in kept[0].rules:
            z += weight * all((s[k] <= v) if low else (s[k] > v) for k, low, v in rule)
        return 1 / (1 + math.exp(-z))

    check(got, docs, plain, 0.7)
    one = by_text[docs[0][1]]
    w = docs[0][1].split()
    assert math.isclose(one["log_words"], math.log1p(len(w))) and math.isclose(one["word_length"], sum(map(len, w)) / len(w)) and math.isclose(one["distinct_words"], len(set(w)) / len(w))


@pytest.mark.parametrize("n", [0, 1, 2, 6, 30])
@pytest.mark.parametrize("equal", [True, False])
def test_few_labels(spark, n, equal):
    """Any number of labels gives a model, constant statistics too; nothing to learn from gives one score for all."""
    rows = [(i, "same text here" if equal else words(20 + i, i), "en", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)], LABELS)
    for module in (toxicity, quality_model):
        got = [r["score"] for r in module.score_documents(docs, module.fit(docs, labels)).collect()]
        assert len(got) == 40 and all(0 <= s <= 1 for s in got) and (not equal or len(set(got)) == 1)
        assert module.score_documents(docs.limit(0), module.fit(docs.limit(0), labels)).collect() == []
