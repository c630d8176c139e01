"""From pages to records: every strategy a plan of its own, the best one of each page kept."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalize import normalize_text
from ..operators import alignment, collections, css, fields, records, scoring, structured, tables
from ..shared import apart, write_shared
from ..sources.html import KIND, MOST_HELD, NODE, few, parse, shred
from ..sources.html import rows as html_rows

STRUCTURED_QUALITY, SINGLE_QUALITY, PAGE_NODES = 0.95, 0.3, 4000
# Fixed value: elements that show nothing.
INVISIBLE = ("script", "style", "noscript", "template", "svg", "head", "meta", "link")
COLUMNS = ("page_id", "rank", "record_ix", "ord", "name", "value", "source", "selector", "node_id", "end_id", "signals")


@dataclass
class Options:
    """What a job may set; see the README."""

    collection: str | None = None
    fields: dict[str, dict] = field(default_factory=dict)
    wanted: list[str] | None = None
    renames: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    required: list[str] = field(default_factory=list)
    min_confidence: float = 0.0
    min_records: int = 2
    max_records_per_page: int = 5000
    include_tables: bool = True
    include_structured: bool = True


def nodes_of(pages: DataFrame) -> DataFrame:
    """The pages' nodes, dealt by page: all later steps group by page and find its rows together."""
    return write_shared(shred(pages).repartition("page_id"), "nodes")


def parts_of(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, table cells and structured blocks of ``(page_id, url, html)``: each page is parsed once.

    A row of the written table is one of the three, in a column of its own, so each is read without the others.
    """
    kinds = {"node": KIND, "cell": tables.CELLS, "block": structured.BLOCKS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(name: str, held: list[dict]) -> pa.RecordBatch:
            columns = [pa.array(held, pa.struct(k)) if n == name else pa.nulls(len(held), pa.struct(k)) for n, k in kinds.items()]
            return pa.RecordBatch.from_arrays([pa.array([r["page_id"] for r in held], pa.int64()), *columns], ["page_id", *kinds])

        nodes: list[dict] = []
        for page_id, url, html in few(batches):
            root = parse(html)
            nodes += html_rows(page_id, url, None, root)
            low = (html or "").lower()
            cells = tables.page_cells(page_id, url, root) if "<table" in low else []
            for name, held in (("cell", cells), ("block", structured.page_rows(page_id, url, root))):
                if held:
                    yield batch(name, held)
            if len(nodes) > MOST_HELD:
                yield batch("node", nodes)
                nodes = []
        if nodes:
            yield batch("node", nodes)

    columns = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    shape = f"_page long, node struct<{fields_of(NODE)}>, cell struct<{fields_of(tables.CELL)}>, block struct<{fields_of(structured.BLOCK)}>"
    parsed = write_shared(columns.mapInArrow(run, shape.replace("_page", "page_id", 1)).repartition("page_id"), "parts")
    one = lambda name: parsed.where(F.col(name).isNotNull()).select(f"{name}.*")
    return one("node"), one("cell"), one("block")


def fields_of(ddl: str) -> str:
    """A column list as the fields of a struct."""
    return re.sub(r"(^|, )(\w+) ", r"\1\2: ", ddl)


def configured(nodes: DataFrame, members: DataFrame, specs: dict[str, dict]) -> DataFrame | None:
    """Candidates of configured fields: ``{selector, attribute, regex, value, default, many}``, full confidence."""
    found = None
    for i, (name, spec) in enumerate(specs.items()):
        place = spec.get("selector", ":scope")
        if "value" in spec:
            hit = members.select("page_id", "rank", "record_ix", "node_id", "end_id", F.lit(spec["value"]).alias("value"))
        else:
            hit = css.select_within(nodes, members, place)
            if spec.get("regex") and not spec.get("attribute"):
                hit = with_whole_text(nodes, hit)
            value = F.element_at("attrs", spec["attribute"]) if spec.get("attribute") else F.col("whole" if spec.get("regex") else "sub_text")
            if spec.get("regex"):
                value = F.nullif(F.regexp_extract(value, spec["regex"], 1 if "(" in spec["regex"].replace("\\(", "").replace("(?:", "") else 0), F.lit(""))
            hit = hit.withColumn("value", value).where("value is not null and value <> ''")
            if spec.get("many"):
                rows = hit.groupBy("page_id", "rank", "record_ix").agg(F.min("node_id").alias("node_id"), F.min("end_id").alias("end_id"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "value"))), lambda x: x["value"])).alias("value"))
                hit = rows
            if "default" in spec:
                hit = members.select("page_id", "rank", "record_ix", F.col("node_id").alias("r"), F.col("end_id").alias("e")).join(hit.select("page_id", "rank", "record_ix", "node_id", "end_id", "value"), ["page_id", "rank", "record_ix"], "left")
                hit = hit.select("page_id", "rank", "record_ix", F.coalesce("node_id", "r").alias("node_id"), F.coalesce("end_id", "e").alias("end_id"), F.coalesce("value", F.lit(spec["default"])).alias("value"))
        out = hit.select("page_id", "rank", "record_ix", (F.lit(i) * 1000 + F.col("node_id")).cast("long").alias("ord"), F.lit(name).alias("name"), F.col("value").cast("string").alias("value"), F.lit("config").alias("source"), F.lit(place).alias("selector"), "node_id", "end_id", F.array(scoring.base_signal("config")).alias("signals"))
        found = out if found is None else found.unionByName(out)
    return found


def with_whole_text(nodes: DataFrame, hit: DataFrame) -> DataFrame:
    """Rows of nodes with ``whole``: all of their text, of any length."""
    key = ["page_id", "rank", "record_ix", "node_id"]
    spans = hit.select(*key[:3], F.col("node_id").alias("top"), F.col("end_id").alias("last"))
    inside = nodes.select("page_id", "node_id", "end_id", "depth", "text", "tail").join(apart(spans), "page_id").where("node_id between top and last and (text <> '' or tail <> '')")
    own = F.struct(F.col("node_id").alias("at"), F.lit(0).alias("k"), F.lit(0).alias("d"), F.col("text").alias("s"))
    after = F.struct(F.col("end_id").alias("at"), F.lit(1).alias("k"), (-F.col("depth")).alias("d"), F.when(F.col("node_id") == F.col("top"), "").otherwise(F.col("tail")).alias("s"))
    pieces = inside.select(*key[:3], "top", F.explode(F.array(own, after)).alias("p")).groupBy(*key[:3], "top").agg(F.array_sort(F.collect_list("p")).alias("p"))
    whole = pieces.select(*key[:3], F.col("top").alias("node_id"), normalize_text(F.array_join(F.transform("p", lambda x: x["s"]), "")).alias("whole"))
    return hit.join(apart(whole), key, "left")


def dom_members(nodes: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """The items of each page's collection, and its quality."""
    if o.collection:
        hit = css.select(nodes, o.collection)
        ix = F.row_number().over(W.partitionBy("page_id").orderBy("node_id")) - 1
        members = hit.select("page_id", F.lit(1).alias("rank"), ix.alias("record_ix"), "node_id", "end_id", "depth")
        return members, members.select("page_id", F.lit(1.0).alias("quality")).distinct()
    first = collections.discover(nodes, o.min_records).where("rank = 1")
    first = write_shared(first, "collections")
    return collections.records(first), first.select("page_id", F.col("confidence").alias("quality"))


def dom_fields(nodes: DataFrame, members: DataFrame, o: Options) -> DataFrame:
    found = fields.candidates(nodes, members).select(*COLUMNS).unionByName(alignment.candidates(nodes, members).select(*COLUMNS))
    own = configured(nodes, members, o.fields)
    # Supports are counted over the candidates and joined to them: they are written, so that they are made once.
    return scoring.apply_consistency(write_shared(scoring.score(found if own is None else found.unionByName(own.select(*COLUMNS))), "candidates"))


def extract(pages: DataFrame, options: Options | None = None) -> DataFrame:
    """Fields of the records of ``(page_id, url, html)``, long: ``page_id, strategy, record_ix, name, value, raw, type, source, selector, confidence, signals``.

    Structured data, the best table and the best collection each make an attempt; a page keeps the attempt of highest quality, then of most records,
    then in that order. A page without any is one record of what it says of itself, if that is more than its address.
    """
    return extract_parts(pages, *parts_of(pages), options)


def extract_parts(pages: DataFrame, nodes: DataFrame, cells: DataFrame, blocks: DataFrame, options: Options | None = None) -> DataFrame:
    """As ``extract``, of pages that are parsed."""
    o = options or Options()
    members, quality = dom_members(nodes, o)
    shape = [*COLUMNS, "confidence"]
    attempts = [(3, "dom", scoring.best_per_field(dom_fields(nodes, members, o)).select(*shape), quality)]
    if o.include_tables:
        best = tables.tables(cells, o.min_records).where("rank = 1")
        attempts.append((2, "table", tables.table_fields(cells, best).select(*shape), best.select("page_id", F.col("confidence").alias("quality"))))
    if o.include_structured:
        chosen = structured.record_groups(blocks, o.min_records).select("page_id", F.posexplode("members").alias("record_ix", "ix"))
        one = blocks.join(apart(chosen), ["page_id", "ix"])
        attempts.append((1, "structured", scoring.best_per_field(structured.block_candidates(one, "record_ix")).select(*shape), chosen.select("page_id", F.lit(STRUCTURED_QUALITY).alias("quality")).distinct()))
    attempts.append((4, "page", scoring.best_per_field(single_record(pages, nodes, blocks)).select(*shape), pages.select(F.col("page_id").cast("long"), F.lit(SINGLE_QUALITY).alias("quality"))))
    every = None
    for n, name, rows, q in attempts:
        part = rows.join(apart(q), "page_id").withColumns({"attempt": F.lit(n), "strategy": F.lit(name)})
        every = part if every is None else every.unionByName(part)
    every = write_shared(every, "attempts")
    # The page's own record stands in only where nothing else does.
    sizes = every.select("page_id", "attempt", "record_ix").distinct().groupBy("page_id", "attempt").agg(F.count("*").alias("size"))
    state = F.struct((F.col("attempt") < 4).alias("a"), F.col("quality").alias("q"), F.col("size").alias("s"), (-F.col("attempt")).alias("o"))
    ranked = every.join(apart(sizes), ["page_id", "attempt"]).withColumn("state", state).withColumn("best", F.max("state").over(W.partitionBy("page_id"))).where("state = best")
    ranked = ranked.where(F.col("record_ix") < o.max_records_per_page)
    typed = records.finalize(ranked, o.wanted, o.renames, o.types)
    alone = F.count("*").over(W.partitionBy("page_id", "record_ix"))
    out = typed.withColumn("_n", alone).where((F.col("strategy") != "page") | (F.col("_n") > 1)).drop("_n")
    return out.select("page_id", "strategy", F.lit(1).alias("rank"), "record_ix", "name", "value", "raw", "type", "source", "selector", "confidence", "signals")


def single_record(pages: DataFrame, nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """What a page says of itself, as candidates of one record: its structured data, title and address."""
    own = structured.block_candidates(blocks.where("source <> 'embedded_json'").withColumn("zero", F.lit(0)), "zero").select(*COLUMNS, "confidence")
    titles = page_titles(nodes).where("title <> ''")
    row = lambda df, name, value, source, selector, *more: df.select(F.col("page_id").cast("long"), F.lit(-1).alias("rank"), F.lit(0).alias("record_ix"), F.lit(0).cast("long").alias("ord"), F.lit(name).alias("name"), value.alias("value"), F.lit(source).alias("source"), F.lit(selector).alias("selector"), F.lit(-1).alias("node_id"), F.lit(-1).alias("end_id"), F.array(scoring.base_signal(source), *more).alias("signals"))
    title = row(titles, "title", F.col("title"), "position", "title")
    url = row(pages.where("url is not null"), "url", F.col("url"), "semantic", "@location", scoring.signal("page identity", 0.3))
    return own.unionByName(scoring.score(title.unionByName(url)))


def page_titles(nodes: DataFrame) -> DataFrame:
    """``page_id, title``: the title element, else og:title, else the first h1."""
    text = F.nullif("sub_text", F.lit(""))
    meta = F.nullif(F.trim(F.element_at("attrs", "content")), F.lit(""))
    is_og = (F.col("tag") == "meta") & (F.element_at("attrs", "property") == "og:title")
    first = lambda value, cond: F.min_by(value, F.when(cond & value.isNotNull(), F.col("node_id")))
    relevant = nodes.where(F.col("tag").isin("title", "meta", "h1"))
    found = relevant.groupBy("page_id").agg(F.coalesce(first(text, F.col("tag") == "title"), first(meta, is_og), first(text, F.col("tag") == "h1")).alias("title"))
    return found.where("title is not null")


def process(pages: DataFrame, options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of pages, and the problems of those that did not pass."""
    return process_parts(pages, *parts_of(pages), options)


def process_parts(pages: DataFrame, nodes: DataFrame, cells: DataFrame, blocks: DataFrame, options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``process``, of pages that are parsed."""
    o = options or Options()
    return records.validate(records.assemble(extract_parts(pages, nodes, cells, blocks, o)), o.required, o.min_confidence)


def main_content(nodes: DataFrame) -> DataFrame:
    """The node of each page that holds what it is about: main, article, by role or id, else the body, else the root."""
    known = (F.col("tag") == "main", F.col("tag") == "article", F.element_at("attrs", "role") == "main", F.element_at("attrs", "id") == "content", F.element_at("attrs", "id") == "main", F.col("tag") == "body", F.col("node_id") == 0)
    place = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), i) for i, c in enumerate(known)])
    first = nodes.withColumn("_p", place).where("_p is not null").groupBy("page_id").agg(F.min_by(F.struct("node_id", "end_id", "depth"), F.struct("_p", "node_id")).alias("m"))
    return first.select("page_id", F.lit(1).alias("rank"), F.lit(0).alias("record_ix"), "m.*")


def extract_one(pages: DataFrame, options: Options | None = None) -> DataFrame:
    """``page_id, fields, confidence``: all that each page says of the one thing it is about.

    Its structured data, title and address come first; then pairs of a label and a value in its tables; then what its main content's markup
    names. A field is taken from the first of these that has it. Configured fields go before all.
    """
    o = options or Options()
    nodes, cells, blocks = parts_of(pages)
    shape = [*COLUMNS, "confidence"]
    members = main_content(nodes)
    own = scoring.best_per_field(single_record(pages, nodes, blocks)).select(*shape)
    row = lambda df: df.select("page_id", F.lit(1).alias("rank"), F.lit(0).alias("record_ix"), F.lit(0).cast("long").alias("ord"), "name", "value", F.lit("table").alias("source"), F.concat(F.lit("table "), "name").alias("selector"), F.lit(-1).alias("node_id"), F.lit(-1).alias("end_id"), F.array(scoring.base_signal("table")).alias("signals"))
    tiers = [(1, own), (2, scoring.score(row(tables.property_pairs(cells))).select(*shape)), (3, scoring.best_per_field(fields.candidates(nodes, members, most=PAGE_NODES)).select(*shape))]
    named = configured(nodes, members, o.fields)
    if named is not None:
        tiers.append((0, scoring.best_per_field(scoring.score(named)).select(*shape)))
    every = None
    for tier, df in tiers:
        df = df.withColumn("tier", F.lit(tier))
        every = df if every is None else every.unionByName(df)
    first = every.withColumn("_n", F.row_number().over(W.partitionBy("page_id", "name").orderBy("tier", F.desc("confidence"), "ord"))).where("_n = 1").drop("_n", "tier")
    one = first.withColumns({"rank": F.lit(1), "record_ix": F.lit(0)})
    return records.assemble(records.finalize(one, o.wanted, o.renames, o.types)).drop("rank", "record_ix")


def page_links(nodes: DataFrame) -> DataFrame:
    """``page_id, n, url, text, rel, title`` of each page's links, in order."""
    said = lambda a: normalize_text(F.element_at("attrs", a))
    a = nodes.where((F.col("tag") == "a") & ~F.coalesce(F.element_at("attrs", "href"), F.lit("")).rlike("(?i)^\\s*($|#|javascript:|mailto:|tel:)"))
    n = F.row_number().over(W.partitionBy("page_id").orderBy("node_id"))
    return a.select("page_id", n.alias("n"), F.element_at("attrs", "href").alias("url"), F.substring("sub_text", 1, 300).alias("text"), said("rel").alias("rel"), said("title").alias("title"))


def page_images(nodes: DataFrame) -> DataFrame:
    """``page_id, n, url, alt, title, width, height`` of each page's images, in order; those without an address are left out."""
    size = lambda a: F.element_at("attrs", a).try_cast("double").cast("int")
    said = lambda a: normalize_text(F.element_at("attrs", a))
    img = nodes.where(F.col("tag") == "img").withColumn("url", fields.image_url()).where("url is not null")
    n = F.row_number().over(W.partitionBy("page_id").orderBy("node_id"))
    return img.select("page_id", n.alias("n"), "url", said("alt").alias("alt"), said("title").alias("title"), size("width").alias("width"), size("height").alias("height"))


def hydrate(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """``page_id, url, title, text, links, images`` of each page; links and images are arrays in the page's order. A page without any has empty ones."""

    def listed(df: DataFrame, name: str) -> DataFrame:
        one = F.struct(*[c for c in df.columns if c != "page_id"])
        return df.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias(name))

    out = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    parts = (page_titles(nodes), visible_text(nodes), listed(page_links(nodes), "links"), listed(page_images(nodes), "images"))
    for part in parts:
        out = out.join(apart(part), "page_id", "left")
    empty = {"links": "array<struct<n:int,url:string,text:string,rel:string,title:string>>", "images": "array<struct<n:int,url:string,alt:string,title:string,width:int,height:int>>"}
    return out.withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in empty.items()} | {"text": F.coalesce("text", F.lit(""))})


def visible_text(nodes: DataFrame) -> DataFrame:
    """``page_id, text``: what a reader sees of each page: of each element that shows its own text, then what follows it, a space between."""
    shown = nodes.where(~F.col("tag").isin(*INVISIBLE))
    pieces = F.filter(F.array("text", "tail"), lambda x: x != "")
    held = shown.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("node_id", pieces.alias("p")))).alias("p"))
    return held.select("page_id", normalize_text(F.array_join(F.flatten(F.transform("p", lambda x: x["p"])), " ")).alias("text"))
