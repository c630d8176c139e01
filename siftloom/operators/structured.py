"""Structured data that pages carry: JSON-LD, microdata, OpenGraph, embedded JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.normalize import lookup, normalize_enum, squash
from ..functions.urls import join_one
from ..sources.html import MOST_HELD, Node, few, parse, text_of
from .scoring import base_signal, score
from .tables import below

# Fixed values.
RECORD_TYPES = (
    "product", "offer", "article", "newsarticle", "blogposting", "jobposting", "event", "recipe", "review", "person", "organization", "localbusiness", "realestatelisting", "apartment", "house",
    "course", "book", "movie", "videoobject", "softwareapplication", "service", "vehicle", "car",
)
NESTED_KEYS = ("itemListElement", "mainEntity", "hasPart", "item")
META_PREFIXES = ("og:", "twitter:", "product:", "article:", "book:", "music:", "video:")
STATE_NAMES = ("__NEXT_DATA__", "__NUXT__", "__INITIAL_STATE__", "__PRELOADED_STATE__", "__APOLLO_STATE__", "__REDUX_STATE__", "__data", "INITIAL_STATE")
# End of fixed values.
MOST_STATE, DEPTH = 4_000_000, 3
STATE = re.compile(r"(?:window\.|self\.|globalThis\.|var\s+)?\b(" + "|".join(map(re.escape, STATE_NAMES)) + r")\s*=\s*(?=[\[{])")
BLOCK = "page_id long, source string, ix int, types array<string>, data string, leaves array<struct<name:string,value:string>>"


def loads(text: str) -> list[Any]:
    """The JSON values that follow one another in a text; what can't be read is passed over."""
    reader, at, out = json.JSONDecoder(strict=False), 0, []
    text = text.strip().removeprefix("<!--").removesuffix("-->").strip().rstrip(";")
    while at < len(text):
        try:
            value, at = reader.raw_decode(text, at)
            out.append(value)
        except (ValueError, RecursionError):
            starts = [i for i in (text.find("{", at + 1), text.find("[", at + 1)) if i > 0]
            if not starts:
                break
            at = min(starts)
        while at < len(text) and text[at] in " \t\r\n,;":
            at += 1
    return out


def objects(value: Any, depth: int = 0) -> Iterator[dict]:
    """Typed objects of a JSON-LD value: lists and graphs opened, list items and main entities entered."""
    if depth > 8:
        return
    if isinstance(value, list):
        for v in value:
            yield from objects(v, depth + 1)
    elif isinstance(value, dict):
        if "@graph" in value:
            yield from objects(value["@graph"], depth + 1)
        if "@type" in value:
            yield value
        for k in NESTED_KEYS:
            if isinstance(value.get(k), (dict, list)):
                yield from objects(value[k], depth + 1)


def type_names(value: Any) -> list[str]:
    raw = value if isinstance(value, list) else [value]
    return [str(t).rstrip("/").rsplit("/", 1)[-1].rsplit("#", 1)[-1].lower() for t in raw if t]


def leaves(value: Any, depth: int = 0) -> Iterator[tuple[str, str]]:
    """Named scalar values to a depth; of lists the first."""
    if not isinstance(value, dict) or depth >= DEPTH:
        return
    for k, v in value.items():
        if k.startswith("@") and k != "@id":
            continue
        if isinstance(v, list):
            v = v[0] if v else None
        if isinstance(v, dict):
            yield from leaves(v, depth + 1)
        elif isinstance(v, bool):
            yield k, str(v).lower()
        elif isinstance(v, (str, int, float)):
            yield k, str(v)


def item_value(n: Node, url: str | None) -> str:
    for tags, name, link in ((("meta",), "content", False), (("a", "link", "area"), "href", True), (("img", "audio", "video", "source", "iframe", "embed"), "src", True), (("time",), "datetime", False), (("data", "meter"), "value", False)):
        if n.tag in tags and n.attrs.get(name):
            return join_one(url, n.attrs[name]) if link else n.attrs[name]
    return n.attrs.get("content") or text_of(n)


def item(n: Node, url: str | None) -> dict:
    """A microdata item with the items in it. A property that repeats is a list."""
    out: dict[str, Any] = {"@type": type_names(n.attrs.get("itemtype", "").split())}
    stack = [(c, out) for c in reversed(n.children)]
    while stack:
        c, owner = stack.pop()
        names = c.attrs.get("itemprop", "").split()
        inner = owner
        if "itemscope" in c.attrs:
            inner = {"@type": type_names(c.attrs.get("itemtype", "").split())}
        if names:
            value = inner if inner is not owner else item_value(c, url)
            for k in names:
                owner[k] = value if k not in owner else [*(owner[k] if isinstance(owner[k], list) else [owner[k]]), value]
        if inner is owner or names:  # an item that is no property is another's
            stack.extend((x, inner) for x in reversed(c.children))
    return out


def page_blocks(url: str | None, html: str | None, root: Node | None = None) -> Iterator[tuple[str, list[str], Any]]:
    root = root or parse(html)
    for s in below(root, ("script",)):
        kind = s.attrs.get("type", "").lower()
        if kind.startswith("application/ld+json"):
            for value in loads(s.text):
                for o in objects(value):
                    yield "jsonld", type_names(o["@type"]), o
        elif kind == "application/json" and len(s.text) <= MOST_STATE:
            yield from (("embedded_json", [s.attrs.get("id") or "json"], v) for v in loads(s.text)[:1])
        elif not kind or "javascript" in kind:
            for m in STATE.finditer(s.text[:MOST_STATE]):
                try:
                    yield "embedded_json", [m[1]], json.JSONDecoder(strict=False).raw_decode(s.text, m.end())[0]
                except (ValueError, RecursionError):
                    pass
    stack = list(reversed(root.children))
    while stack:
        n = stack.pop()
        if "itemscope" in n.attrs and "itemprop" not in n.attrs:
            found = item(n, url)
            yield "microdata", found["@type"], found
        else:
            stack.extend(reversed(n.children))
    meta: dict[str, str] = {}
    for m in below(root, ("meta", "link")):
        key = (m.attrs.get("property") or m.attrs.get("name") or "").lower()
        if m.tag == "link" and m.attrs.get("rel", "").lower() == "canonical":
            meta.setdefault("canonical", join_one(url, m.attrs.get("href")))
        elif key == "description" or key.startswith(META_PREFIXES):
            meta.setdefault(key, m.attrs.get("content", ""))
    if any(k.startswith(META_PREFIXES) for k in meta):
        yield "opengraph", [], {k.split(":", 1)[-1]: v for k, v in reversed(meta.items()) if v}


PAIR = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
BLOCKS = pa.schema([("page_id", pa.int64()), ("source", pa.string()), ("ix", pa.int32()), ("types", pa.list_(pa.string())), ("data", pa.string()), ("leaves", PAIR)])
MOST_NESTING = 200


def page_rows(page_id: int, url: str | None, root: Node) -> list[dict]:
    """Blocks of a page as rows; what is nested too deep to be written as JSON is left out."""
    held = []
    for i, (source, types, value) in enumerate(page_blocks(url, None, root)):
        flat = [{"name": k, "value": v} for k, v in leaves(value)] if source != "embedded_json" else []
        try:
            held.append({"page_id": page_id, "source": source, "ix": i, "types": types, "data": json.dumps(cut(value), ensure_ascii=False), "leaves": flat})
        except (RecursionError, ValueError):
            continue
    return held


def cut(value: Any, depth: int = MOST_NESTING) -> Any:
    """The value down to a depth, beyond which there is null."""
    if not isinstance(value, (dict, list)):
        return value
    if not depth:
        return None
    return {k: cut(v, depth - 1) for k, v in value.items()} if isinstance(value, dict) else [cut(v, depth - 1) for v in value]


def may_have_blocks(html: Column) -> Column:
    low = F.lower(html)
    return low.contains("application/") | low.contains("itemscope") | low.rlike(r"<(meta|link)\b") | low.rlike("|".join(n.lower() for n in STATE_NAMES))


def blocks(pages: DataFrame) -> DataFrame:
    """Blocks of ``(page_id, url, html)``: source, order, types, the JSON and its named scalar values. Pages with none are not parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for page_id, url, html in few(batches):
            held += page_rows(page_id, url, parse(html))
            if len(held) > MOST_HELD:
                yield pa.RecordBatch.from_pylist(held, BLOCKS)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, BLOCKS)

    return pages.where(may_have_blocks(F.col("html"))).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, BLOCK)


def type_counts(found: DataFrame) -> DataFrame:
    return found.select("source", F.explode_outer("types").alias("type")).groupBy("source", "type").count()


def record_groups(found: DataFrame, min_records: int = 2) -> DataFrame:
    """``page_id, source, types, members``: the largest group of alike record blocks of each page, of JSON-LD before microdata."""
    typed = found.where(F.col("source").isin("jsonld", "microdata") & F.arrays_overlap("types", F.array(*map(F.lit, RECORD_TYPES))))
    groups = typed.groupBy("page_id", "source", "types").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("ix")).alias("members")).where(F.col("n") >= min_records)
    best = F.max_by(F.struct("source", "types", "members"), F.struct("n", F.when(F.col("source") == "jsonld", 1).otherwise(0), -F.element_at("members", 1)))
    return groups.groupBy("page_id").agg(best.alias("g")).select("page_id", "g.*")


def block_candidates(found: DataFrame, record_ix: str = "ix") -> DataFrame:
    """Named values of blocks as candidates, ``rank`` -1."""
    leaf = found.select("page_id", F.col(record_ix).cast("int").alias("record_ix"), "source", "ix", F.posexplode("leaves").alias("i", "leaf"))
    name = lookup(L.SCHEMA_FIELD, squash("leaf.name"))
    out = leaf.withColumn("name", name).where("name is not null and trim(leaf.value) <> ''")
    out = out.select("page_id", F.lit(-1).alias("rank"), "record_ix", (F.col("ix").cast("long") * 100_000 + F.col("i")).alias("ord"), "name", normalize_enum(F.col("leaf.value")).alias("value"), "source", F.col("leaf.name").alias("selector"), F.lit(-1).alias("node_id"), F.lit(-1).alias("end_id"), F.array(base_signal(F.col("source"))).alias("signals"))
    return score(out)
