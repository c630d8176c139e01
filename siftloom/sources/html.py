"""HTML to a table of nodes: the one operator over pages that needs Python.

The parser is tolerant. Comments go; void elements have no content; an element that cannot stand in another of its kind
closes that one (``<p>``, ``<li>``, ``<td>`` and the like, and a new block closes an open paragraph with the inline elements in it);
end tags without a start are ignored. Nodes are numbered in document order, and ``end_id`` is the last node below, so "inside" is an interval test.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import SKIP_TAGS
from ..functions.urls import join_one

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An open element of these kinds ends where the key begins, unless a boundary lies between.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody", "tr"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
BOUNDARY = {
    "li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "body": {"html"},
}
ONLY_IN_HEAD = frozenset("base link meta script style template title noscript".split())
LINKS = ("href", "src", "data-src", "data-original", "data-lazy-src")
SETS = ("srcset", "data-srcset")
TEXT_LIMIT = 4000
#: Pages that are Python's at a time, and rows that are held before they are sent on.
SLICE, MOST_HELD = 64, 4000
# Fixed value: class names that carry no meaning.
HASHY = re.compile(r"^(?:[a-z]+[-_])?[a-f0-9]{5,}$|^[\w-]*__[a-zA-Z0-9]{4,}$|^(?:css|sc|jsx)-\w+$", re.I)
SPACE = re.compile(r"\s+")

NODE = "page_id long, node_id int, end_id int, parent_id int, depth int, sib_pos int, nth_of_type int, n_of_type int, tag string, attrs map<string,string>, text string, tail string, sub_text string, n_children int, n_desc int, n_link int, n_img int, n_head int, child_tags array<string>, classes array<string>, steps array<string>, path string"


class Node:
    __slots__ = ("attrs", "children", "end", "id", "parent", "tag", "tail", "text")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.text = self.tail = ""
        self.id = self.end = 0


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, None)
        self.open = [self.root]

    def close_to(self, kinds: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        """Close the outermost open element of some kinds above a boundary, with all in it."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in until:
                below = [j for j in range(i + 1, len(self.open)) if self.open[j].tag in kinds]
                break
        else:
            below = [j for j in range(1, len(self.open)) if self.open[j].tag in kinds]
        if below:
            del self.open[below[0] :]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        if tag == "html":
            self.root.attrs = found | self.root.attrs
            return
        if tag in BLOCKS:
            self.close_to({"p"}, frozenset(BLOCKS - {"p"}) | {"td", "th", "li", "button"})
        if tag in CLOSES:
            self.close_to(CLOSES[tag], BOUNDARY[tag])
        elif tag not in ONLY_IN_HEAD and self.open[-1].tag == "head":
            self.open.pop()
        node = Node(tag, found, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body"):
                return

    def handle_data(self, data: str) -> None:
        here = self.open[-1]
        if here.children:
            here.children[-1].tail += data
        else:
            here.text += data


def parse(html: str | None) -> Node:
    builder = Builder()
    try:
        builder.feed((html or "").replace("\0", ""))
        builder.close()
    except (AssertionError, ValueError):  # what the tokenizer can't read ends the page
        pass
    return builder.root


def stable_classes(raw: str) -> list[str]:
    return sorted({re.sub(r"\d+", "#", t.lower()) for t in raw.split() if 1 < len(t) <= 40 and not HASHY.match(t)})


def whole_set(base: str | None, value: str) -> str:
    """A set of images with whole addresses."""
    parts = [p.split() for p in value.split(",")]
    return ", ".join(" ".join([join_one(base, p[0]) or p[0], *p[1:]]) for p in parts if p)


def text_of(n: Node) -> str:
    """Text of a node and all below, in one line."""
    parts: list[str] = []
    stack: list[Node | str] = [n]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        parts.append(x.text)
        for c in reversed(x.children):
            stack += [c.tail, c]
    return SPACE.sub(" ", "".join(parts)).strip()


def rows(page_id: int, url: str | None, html: str | None, root: Node | None = None) -> list[dict]:
    """Rows of NODE for one page, parsed before or now. Long chains of elements are walked without recursion, and each child list once."""
    root = root or parse(html)
    order: list[Node] = []
    stack = [root]
    while stack:
        n = stack.pop()
        n.id = len(order)
        order.append(n)
        stack.extend(reversed(n.children))
    base = next((join_one(url, n.attrs["href"]) for n in order if n.tag == "base" and n.attrs.get("href")), "") or url
    count = [[0, 0, 0, 0] for _ in order]
    said: list[str] = [""] * len(order)
    for n in reversed(order):
        n.end = n.children[-1].end if n.children else n.id
        parts, held = [n.text], len(n.text)
        for c in n.children:
            kinds = (c.tag not in SKIP_TAGS, c.tag == "a", c.tag in ("img", "picture", "source"), c.tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
            for k in range(4):
                count[n.id][k] += count[c.id][k] + kinds[k]
            if held <= TEXT_LIMIT:
                parts += [said[c.id], c.tail]
                held += len(said[c.id]) + len(c.tail)
        said[n.id] = "".join(parts)
    out: list[dict] = []
    steps: list[list[str]] = []
    paths: list[str] = []
    # Of each node: its place among its siblings, among those of its tag, and their number.
    place = [(0, 0, 1)] * len(order)
    for p in order:
        of_tag = Counter(c.tag for c in p.children)
        met: Counter[str] = Counter()
        for i, c in enumerate(p.children):
            place[c.id] = (i, met[c.tag], of_tag[c.tag])
            met[c.tag] += 1
    for n in order:
        p = n.parent
        sibling, nth, alike = place[n.id]
        classes = n.attrs.get("class", "").split()[:2]
        step = n.tag + "".join(f".{c}" for c in classes) if classes else f"{n.tag}:nth-of-type({nth + 1})" if alike > 1 else n.tag
        up = steps[p.id] if p else []
        steps.append([*up, step])
        if n.attrs.get("id"):
            path = f"#{n.attrs['id']}"
        elif p is None or n.tag == "body" or p.tag in ("html",) or not paths[p.id]:
            path = "" if p is None or n.tag == "body" else step
        else:
            path = f"{paths[p.id]} > {step}"
        paths.append(path)
        attrs = {k: (join_one(base, v) or v) if k in LINKS and not v.startswith("data:") else whole_set(base, v) if k in SETS else v for k, v in n.attrs.items()}
        out.append({
            "page_id": page_id, "node_id": n.id, "end_id": n.end, "parent_id": p.id if p else -1, "depth": len(steps[-1]) - 1, "sib_pos": sibling,
            "nth_of_type": nth + 1, "n_of_type": alike, "tag": n.tag, "attrs": list(attrs.items()), "text": n.text, "tail": n.tail, "sub_text": SPACE.sub(" ", said[n.id]).strip(),
            "n_children": len(n.children), "n_desc": count[n.id][0], "n_link": count[n.id][1], "n_img": count[n.id][2], "n_head": count[n.id][3],
            "child_tags": [c.tag for c in n.children if c.tag not in SKIP_TAGS][:24], "classes": stable_classes(n.attrs.get("class", "")), "steps": steps[-1], "path": path or n.tag,
        })
    return out


KIND = pa.schema([
    ("page_id", pa.int64()), *[(c, pa.int32()) for c in ("node_id", "end_id", "parent_id", "depth", "sib_pos", "nth_of_type", "n_of_type")], ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
    *[(c, pa.string()) for c in ("text", "tail", "sub_text")], *[(c, pa.int32()) for c in ("n_children", "n_desc", "n_link", "n_img", "n_head")], ("child_tags", pa.list_(pa.string())), ("classes", pa.list_(pa.string())),
    ("steps", pa.list_(pa.string())), ("path", pa.string()),
])


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, of which few at a time are made Python's: a batch holds up to 10,000 pages."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield from zip(*(c.to_pylist() for c in b.slice(at, SLICE).columns))


def shred(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html)`` to nodes. Null html is an empty page. Pages are dealt by page_id afterwards: what follows groups by page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for page in few(batches):
            held += rows(*page)
            if len(held) > MOST_HELD:
                yield pa.RecordBatch.from_pylist(held, KIND)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, KIND)

    columns = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return columns.mapInArrow(run, NODE)
