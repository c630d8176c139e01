"""Personal data: patterns, and terms that give away the entities they stand beside.

Patterns find the protected entities (addresses, numbers). An entity is protected at three levels: itself, its domain (of addresses), its kind.
What a term ``t`` discloses of an entity ``e`` is estimated from the corpus as pointwise mutual information over the entity's own information,
``log2(N df(e,t) / (df(e) df(t))) / log2(N / df(e))``: 1 if ``t`` occurs with ``e`` only, 0 if they are independent.
Here df counts documents, and df(e,t) those with ``t`` in the context of ``e`` (the words wholly within ``REACH``
characters of it, ``WINDOW`` a side at most). A pair counts if it occurs in ``SUPPORT`` different contexts, so that
copies of one passage are one piece of evidence: contexts that share ``COPY`` of their terms or more, the term itself
left out, are copies. In the order of their hashes, a context that is no copy of those taken before is taken.

Thresholds follow the distribution. Of all pairs of the corpus, so many are tested that some are far from independent by chance; a pair must
exceed what ``CHANCE`` such pairs are expected to reach (deviance from the expected count). Beyond that its disclosure decides, by ``LEVELS``: a term is
generalised to the kind it tells of, or removed, wherever it occurs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parted, settled, table, write_shared

KINDS = ("email", "ip", "card", "phone")
WINDOW, REACH, SUPPORT, CHANCE = 8, 160, 3, 0.01
#: Disclosure from which terms are generalised, and removed, by level. A kind or domain is known from less than a person is.
LEVELS = {"entity": (0.8, 0.95), "domain": (0.4, 0.8), "kind": (0.25, 0.6)}
#: Jaccard similarity of the terms of two contexts from which they are copies of one passage.
COPY = 0.5
#: Bits of the filter of hashed terms that workers get: its size, 1 MB, does not depend on the corpus.
FILTER_BITS = 1 << 23

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: a long run without one costs nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind as in KINDS, then start."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if 16 <= m.end() - m.start() <= 38 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= len(digits_of(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity(kind: str, found: str) -> str:
    return f"{kind}:{found.lower() if kind in ('email', 'ip') else digits_of(found)}"


def protected(kind: str, found: str) -> list[str]:
    """What a match gives away, as ``level kind value``: itself, its domain, its kind."""
    e = entity(kind, found)
    domain = [f"domain email {e.rpartition('@')[2]}"] if kind == "email" else []
    return [f"entity {kind} {e}", *domain, f"kind {kind} "]


def context(text: str, start: int, end: int, own: list[tuple[str, int, int]]) -> list[str]:
    """Terms beside a span: the nearest on each side that lie wholly within reach and outside other spans."""
    a, b = max(0, start - REACH), min(len(text), end + REACH)
    near = [s for s in own if s[1] < b and s[2] > a]
    found = []
    for m in TERM.finditer(text, a, b):
        x, y = m.span()
        if (x == a and a and text[a - 1].isalpha()) or (y == b and b < len(text) and text[b].isalpha()):
            continue
        if not any(s[1] < y and x < s[2] for s in near):
            found.append((x, m[0].lower()))
    left = [t for x, t in found if x < start][-WINDOW:]
    return left + [t for x, t in found if x >= end][:WINDOW]


def evidence(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, list[str], list[str]]]:
    """``(entity, terms, new)`` of each context of each protected entity: its terms in order, and those the document has not shown beside the entity.

    The term "" stands for the entity itself. Contexts that a document repeats are given once.
    """
    out: list[tuple[str, list[str], list[str]]] = []
    known: dict[str, set[str]] = {}
    given: set[tuple[str, ...]] = set()
    for kind, a, b in spans:
        terms = sorted({"", *context(text, a, b, spans)})
        for e in protected(kind, text[a:b]):
            if (e, *terms) not in given:
                given.add((e, *terms))
                seen = known.setdefault(e, set())
                out.append((e, terms[1:], [t for t in terms if t not in seen]))
                seen.update(terms)
    return out


def with_key(docs: DataFrame) -> DataFrame:
    """``doc_id, key, text``: key tells rows that share a doc_id apart by their text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def find_base(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n_email, n_ip, n_card, n_phone, base_sha256, spans, seen``; seen is the evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            sha, said, seen = [], [], []
            for text in b.column(2).to_pylist():
                spans = base_spans(text)
                s = written(spans)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(x[0] == kind for x in spans))
                sha.append(hashlib.sha256(s.encode()).hexdigest())
                said.append(s)
                seen.append([{"e": e, "terms": t, "new": new} for e, t, new in evidence(text, spans)] if spans else [])
            kind = pa.list_(pa.struct([("e", pa.string()), ("terms", pa.list_(pa.string())), ("new", pa.list_(pa.string()))]))
            cols = [b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(said, pa.string()), pa.array(seen, kind)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "seen"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return with_key(docs).mapInArrow(run, f"doc_id long, key long, {counts}, base_sha256 string, spans string, seen array<struct<e: string, terms: array<string>, new: array<string>>>")


def term_filter(terms: DataFrame) -> np.ndarray:
    """Bit set of the hashes of ``term``: ``FILTER_BITS`` long whatever their number."""
    at = F.xxhash64("term").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    parts = terms.select(F.shiftright(at, 15).alias("part"), at.bitwiseAND(F.lit(32767).cast("long")).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for part, bits in parts.collect():  # FILTER_BITS / 2^15 rows at most
        out[part * 4096 : (part + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out


class Filter:
    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.known = bits.tobytes(), {}

    def __contains__(self, word: str) -> bool:
        if (hit := self.known.get(word)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            at = xxhash.xxh64_intdigest(word.lower(), 42) & (FILTER_BITS - 1)
            hit = self.known[word] = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return hit


def document_frequency(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, df)`` of the given terms over all documents."""
    bits = docs.sparkSession.sparkContext.broadcast(term_filter(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = Filter(bits.value)
        for b in batches:
            n: Counter[str] = Counter()
            for text in b.column(2).to_pylist():
                n.update({w.lower() for w in set(TERM.findall(text)) if w in among})
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "df"])

    counted = with_key(docs).mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return counted.join(terms, "term", "left_semi")


def supported(pairs: DataFrame) -> DataFrame:
    """Pairs ``(e, t)`` with SUPPORT contexts of which none is a copy of another; ``pairs`` has ``(e, t, others)``."""
    rows = pairs.withColumn("c", F.xxhash64("others")).groupBy("e", "t", "c").agg(F.first("others").alias("others"))
    rows = write_shared(rows, "contexts")
    # Fewer contexts than SUPPORT need no comparison.
    many = rows.groupBy("e", "t").count().where(F.col("count") >= SUPPORT).select("e", "t")
    rows = write_shared(rows.join(many, ["e", "t"]), "contexts")
    for _ in range(SUPPORT - 1):
        taken = rows.groupBy("e", "t").agg(F.min("c").alias("c"))
        taken = taken.join(rows, ["e", "t", "c"]).select("e", "t", F.col("others").alias("first"))
        shared, all_terms = F.size(F.array_intersect("others", "first")), F.size(F.array_union("others", "first"))
        rows = write_shared(rows.join(taken, ["e", "t"]).where(shared < COPY * all_terms).drop("first"), "contexts")
    return rows.select("e", "t").distinct()


def disclosures(docs: DataFrame, base: DataFrame) -> DataFrame:
    """``(e, t, both, df_e, df, disclosure, deviance, least)`` of the supported pairs; least is the deviance that a pair must exceed."""
    seen = base.select(F.explode("seen").alias("s")).select("s.*")
    both = write_shared(seen.select("e", F.explode("new").alias("t")).groupBy("e", "t").agg(F.count("*").alias("both")), "pairs")
    entities = both.where("t = ''").select("e", F.col("both").alias("df_e"))
    pairs = seen.select("e", F.explode("terms").alias("t"), "terms").select("e", "t", F.array_remove("terms", F.col("t")).alias("others"))
    beside = write_shared(both.where(F.col("both") > 0).join(supported(pairs), ["e", "t"], "left_semi"), "supported")
    terms = write_shared(beside.select(F.col("t").alias("term")).distinct(), "terms")
    n, df = base.count(), document_frequency(docs, terms).withColumnRenamed("term", "t")
    tested = max(1, both.count())
    all_docs = F.lit(float(n))
    expected = F.col("df_e") * F.col("df") / all_docs
    share = F.log2(F.col("both") / expected) / F.log2(all_docs / F.col("df_e"))
    # Twice the log likelihood ratio of a Poisson count; e^-x bounds the chance of twice x.
    deviance = F.when(F.col("both") > expected, 2 * (F.col("both") * F.log(F.col("both") / expected) - F.col("both") + expected)).otherwise(0.0)
    known = beside.join(df, "t").join(entities, "e").where(F.col("df_e") < n)
    return known.select("e", "t", "both", "df_e", "df", share.alias("disclosure"), deviance.alias("deviance"), F.lit(2 * math.log(tested / CHANCE)).alias("least"))


def revealing_terms(docs: DataFrame, base: DataFrame) -> DataFrame:
    """``(term, kind, remove, disclosure)`` of the terms to generalise or remove: the kind is that of the entity most disclosed, remove tells if any level asks for it."""
    level, kind = F.split("e", " ")[0], F.split("e", " ")[1]
    at = lambda i: F.coalesce(*[F.when(level == name, v[i]) for name, v in LEVELS.items()])
    told = disclosures(docs, base).where((F.col("deviance") > F.col("least")) & (F.col("disclosure") >= at(0)))
    found = told.groupBy(F.col("t").alias("term")).agg(F.max_by(kind, F.struct("disclosure", "e")).alias("kind"), F.max(F.col("disclosure") >= at(1)).alias("remove"), F.max("disclosure").alias("disclosure"))
    return write_shared(found, "revealing")


def term_hits(docs: DataFrame, revealing: DataFrame) -> DataFrame:
    """``doc_id, key, hits array<struct<start, end, remove, kind>>`` of documents with revealing terms outside base spans."""
    shape = "doc_id long, key long, hits array<struct<start: long, end: long, remove: boolean, kind: string>>"
    if revealing.isEmpty():
        return docs.sparkSession.createDataFrame([], shape)
    bits = docs.sparkSession.sparkContext.broadcast(term_filter(revealing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = Filter(bits.value)
        for b in batches:
            rows: list[tuple[int, int, str, int, int]] = []
            for i, k, text in zip(*(c.to_pylist() for c in b.columns)):
                found = [m for m in TERM.finditer(text) if m[0] in among]
                if found:
                    own = base_spans(text)
                    rows += [(i, k, m[0].lower(), m.start(), m.end()) for m in found if not any(s[1] < m.end() and m.start() < s[2] for s in own)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "key", "term", "start", "end"])

    found = with_key(docs).mapInArrow(run, "doc_id long, key long, term string, start long, end long").join(revealing, "term")
    one = F.struct("start", "end", "remove", "kind")
    return write_shared(found.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(one)).alias("hits")), "hits")


def joined(left: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows with ``doc_id`` and ``key`` and the hits of theirs, if any."""
    right = hits.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "hits")
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").drop("_id", "_key")


def find(docs: DataFrame) -> DataFrame:
    """Counts and spans of each row: base kinds, then ``term`` spans.

    Null and empty texts have no spans. Repeated rows are returned each and count as documents each; rows
    that share a doc_id are told apart by their text; a null doc_id is kept. No rows give no rows.
    """
    base = write_shared(find_base(docs), "base-spans")
    hits = term_hits(docs, revealing_terms(docs, base))
    more = F.transform("hits", lambda h: F.concat_ws(":", F.lit("term"), h["start"].cast("string"), h["end"].cast("string")))
    spans = F.concat_ws(",", F.when(F.col("spans") != "", F.col("spans")), F.array_join(more, ","))
    return joined(base, hits).select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.when(F.col("hits").isNull(), F.col("spans")).otherwise(spans).alias("spans"))


def masked(text: str, hits: Sequence[dict] | None) -> str:
    """Base spans as their kind; revealing terms as what they tell of, or removed. Overlapping spans go as one, by the first."""
    marks = [(a, b, f"[{k.upper()}]") for k, a, b in base_spans(text)]
    marks += [(h["start"], h["end"], "" if h["remove"] else f"[{h['kind'].upper()} TERM]") for h in (() if hits is None else hits)]
    out, at = [], 0
    for a, b, mark in sorted(marks, key=lambda m: m[0]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with masked text, and n_chars to match if there is such a column; null texts stay null, empty ones empty.

    Every row comes back, repeated rows and rows without id too; rows that share an id are told apart by their text. Other columns stay as they are.
    """
    hits = settled(docs.sparkSession, "hits", lambda: term_hits(docs, revealing_terms(docs, write_shared(find_base(docs), "base-spans"))))
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))

    @F.pandas_udf("string")
    def mask(text, hits):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([None if t is None else masked(t, h) for t, h in zip(text, hits)], dtype=object)

    # As one struct, the columns of docs clash with no other. Rows without hits stay where they are.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.struct("*").alias("doc"))
    among, without = parted(rows, hits)
    out = joined(among, hits).select("doc", "hits").union(without.select("doc", F.lit(None).cast(hits.schema["hits"].dataType).alias("hits")))
    out = out.select("doc", mask(F.col("doc.text").cast("string"), "hits").alias("masked"))
    new = {"text": F.col("masked"), "n_chars": F.length("masked")}
    return out.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
