"""What terms disclose, through the query, against a recomputation in plain Python."""

import math
import random
import re
from collections import defaultdict

import pytest

from siftloom.llm import pii


def spelled(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"t{r.randrange(vocabulary)}" for _ in range(n)).translate(str.maketrans("0123456789", "abcdefghij"))


def corpus():
    rows = [(i, f"{spelled(6, i)} report zorblaxian {spelled(3, i + 90)} jo@x.example.com {spelled(5, i + 50)}") for i in range(14)]
    # A term of a domain, beside other addresses of it; a term of all phone numbers; terms of copies of one passage; a common word.
    rows += [(100 + i, f"{spelled(6, i + 300)} acmeworks {spelled(2, i + 340)} u{i}@acme.example.org {spelled(5, i + 380)}") for i in range(16)]
    rows += [(200 + i, f"{spelled(7, i + 400)} telefon +1 (386) 555-{3700 + i} {spelled(6, i + 440)}") for i in range(30)]
    rows += [(300 + i, "hidden quibblefish beside al@x.example.net here now") for i in range(20)]
    passage = spelled(14, 600).split()
    for i in range(12):
        p = [*passage]
        p[i] = "edit" + "abcdefghijkl"[i]
        rows.append((340 + i, " ".join([*p[:7], "snarkwold", "ed@x.example.net", *p[7:]])))
    once = " . ".join(f"{spelled(60, i + 700)} glimmerwick you {spelled(3, i + 790)} cy@x.example.com for {spelled(60, i + 750)}" for i in range(14))
    rows += [(360, once)] + [(361 + i, f"{spelled(20, i + 800)} for you glimmerwick {spelled(2, i + 830)} cy@x.example.com {spelled(20, i + 860)}") for i in range(12)]
    rows += [(400 + i, f"for you from report {spelled(40, i + 900)}") for i in range(500)]
    return [*rows, (1000, "Zorblaxian alone"), (1001, "Zorblaxian and zorblaxian, telefon or quibblefish snarkwold acmeworks glimmerwick"), (1002, None), (1003, ""), (None, "a null id telefon"), (7, "another text of id 7, zorblaxian"), (1003, "w " * 100_000 + "telefon")]


def plain(texts):
    """(term) -> (kind, remove) of the terms to act on."""
    n, contexts, docs_with, df, df_e = len(texts), defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for d, text in enumerate(texts):
        text = text or ""
        for w in set(re.findall(r"[^\W\d_]{3,}", text)):
            df[w.lower()].add(d)
        spans = pii.base_spans(text)
        for kind, a, b in spans:
            terms = set(pii.context(text, a, b, spans))
            for e in pii.protected(kind, text[a:b]):
                df_e[e].add(d)
                for t in terms:
                    docs_with[e, t].add(d)
                    contexts[e, t].add(tuple(sorted(terms - {t})))
    least = 2 * math.log((len(docs_with) + len(df_e)) / pii.CHANCE)
    out = {}
    for (e, t), found in contexts.items():
        taken = []
        for c in found:  # any order: the fixture's contexts are copies or far apart
            if all(len(set(c) & set(o)) < pii.COPY * len(set(c) | set(o)) for o in taken):
                taken.append(c)
        if len(taken) < pii.SUPPORT or len(df_e[e]) >= n:
            continue
        k, expected = len(docs_with[e, t]), len(df_e[e]) * len(df[t]) / n
        if k <= expected or 2 * (k * math.log(k / expected) - k + expected) <= least:
            continue
        share = math.log2(k / expected) / math.log2(n / len(df_e[e]))
        level, kind = e.split(" ")[:2]
        low, high = pii.LEVELS[level]
        if share >= low:
            old = out.get(t, (-1, "", "", False))
            best = max(old[:3], (share, e, kind))
            out[t] = (*best, old[3] or share >= high)
    return {t: (v[2], v[3]) for t, v in out.items()}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    home, rows = str(tmp_path_factory.mktemp("pii")), corpus()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{home}/documents.parquet")
    return home, rows


def test_query(spark, tables):
    home, rows = tables
    want = plain([t for _, t in rows])
    assert set(want) == {"zorblaxian", "acmeworks", "telefon", "glimmerwick"} and want["telefon"][0] == "phone" and want["acmeworks"][0] == "email"
    spans = {}
    for i, t in rows:
        base = pii.base_spans(t or "")
        more = sorted((m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t or "") if m[0].lower() in want and not any(a < m.end() and m.start() < b for _, a, b in base))
        spans.setdefault(i, []).append(pii.written(base + [("term", a, b) for a, b in more]))
    got = {}
    for r in pii.query(spark, home).collect():
        got.setdefault(r["doc_id"], []).append(r["spans"])
    assert {i: sorted(s) for i, s in got.items()} == {i: sorted(s) for i, s in spans.items()}


def test_sanitised_texts(spark, tables):
    home, rows = tables
    want = plain([t for _, t in rows])
    docs = spark.read.parquet(f"{home}/documents.parquet").selectExpr("doc_id", "text", "'clash' as hits", "length(text) as n_chars")
    for r in pii.sanitise(docs).collect():
        assert (r["text"] is None) == (r["doc_id"] == 1002) and r["hits"] == "clash" and (r["text"] is None or r["n_chars"] == len(r["text"]))
        assert not any(t in (r["text"] or "").lower() for t in want)
        if r["doc_id"] == 1001:
            for t, (kind, remove) in want.items():
                assert remove or f"[{kind.upper()} TERM]" in r["text"]
            assert "quibblefish snarkwold" in r["text"]
