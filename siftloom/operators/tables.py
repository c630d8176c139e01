"""Data tables of a page: a grid with spans resolved, headers, one record for each body row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.normalize import infer_type, lookup, squash, tokens_of
from ..shared import apart
from ..sources.html import Node, few, parse, text_of
from ..functions.urls import join_one
from .scoring import base_signal, confidence, signal

MOST_SPAN, MOST_COLUMNS, LONGEST_NAME = 20, 60, 48
CELL = "page_id long, table_id int, nested boolean, inside boolean, row int, column int, head boolean, span int, text string, link string, image string, row_node int"


def below(n: Node, tags: tuple[str, ...], stop: tuple[str, ...] = ()) -> list[Node]:
    out, stack = [], list(reversed(n.children))
    while stack:
        x = stack.pop()
        if x.tag in tags:
            out.append(x)
        if x.tag not in stop:
            stack.extend(reversed(x.children))
    return out


def span(n: Node, name: str) -> int:
    raw = n.attrs.get(name, "1").strip()
    return min(MOST_SPAN, max(1, int(raw))) if raw.isdigit() and len(raw) < 6 else 1


def grid(table: Node, url: str | None) -> list[list[dict]]:
    """Rows of cells; a cell with spans stands in each place that it covers. Rows without cells are left out."""
    carried: dict[int, tuple[int, dict]] = {}
    out = []
    for tr in below(table, ("tr",), ("table",)):
        cells = [c for c in tr.children if c.tag in ("td", "th")]
        if not cells:
            continue
        row: dict[int, dict] = {}
        for col, (left, cell) in list(carried.items()):
            row[col] = cell
            if left > 1:
                carried[col] = (left - 1, cell)
            else:
                del carried[col]
        at = 0
        for c in cells:
            link = next((x.attrs["href"] for x in below(c, ("a",)) if x.attrs.get("href")), None)
            image = next((x.attrs["src"] for x in below(c, ("img",)) if x.attrs.get("src")), None)
            wide = span(c, "colspan")
            cell = {"head": c.tag == "th", "span": wide, "text": text_of(c), "link": link and join_one(url, link), "image": image and join_one(url, image), "row_node": tr.id}
            for _ in range(wide):
                while at in row:
                    at += 1
                if at >= MOST_COLUMNS:
                    break
                row[at] = cell
                if (deep := span(c, "rowspan")) > 1:
                    carried[at] = (deep - 1, cell)
        out.append([row[k] for k in sorted(row)])
    return out


CELLS = pa.schema([("page_id", pa.int64()), ("table_id", pa.int32()), ("nested", pa.bool_()), ("inside", pa.bool_()), ("row", pa.int32()), ("column", pa.int32()), ("head", pa.bool_()), ("span", pa.int32()), ("text", pa.string()), ("link", pa.string()), ("image", pa.string()), ("row_node", pa.int32())])


def page_cells(page_id: int, url: str | None, root: Node) -> list[dict]:
    """Cells of all tables of a page; tables are named by their node's place in document order."""
    number, stack = 0, [root]
    while stack:
        n = stack.pop()
        n.id, number = number, number + 1
        stack.extend(reversed(n.children))
    every = below(root, ("table",))
    within = {id(x) for t in every for x in below(t, ("table",))} if len(every) > 1 else set()
    return [
        {"page_id": page_id, "table_id": t.id, "nested": bool(below(t, ("table",))), "inside": id(t) in within, "row": i, "column": j, **c}
        for t in every for i, row in enumerate(grid(t, url)) for j, c in enumerate(row)
    ]


def cells(pages: DataFrame) -> DataFrame:
    """Cells of all tables of ``(page_id, url, html)``; pages without a table are not parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page_id, url, html in few(batches):
            held = page_cells(page_id, url, parse(html))
            if held:
                yield pa.RecordBatch.from_pylist(held, CELLS)

    has = pages.where(F.lower("html").contains("<table"))
    return has.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, CELL)


def slug_name(x: Column) -> Column:
    return F.substring(F.array_join(tokens_of(x), "_"), 1, LONGEST_NAME)


def laid_out(cells: DataFrame) -> DataFrame:
    """Cells with ``header_row``: leading rows made of ``th`` only."""
    rows = cells.groupBy("page_id", "table_id", "row").agg(F.bool_and("head").alias("all_head"), F.count("*").alias("width"))
    first_body = F.min(F.when(~F.col("all_head"), F.col("row"))).over(W.partitionBy("page_id", "table_id"))
    rows = rows.withColumn("header_row", F.coalesce(F.col("row") < first_body, F.lit(True)))
    return cells.join(apart(rows), ["page_id", "table_id", "row"])


def tables(cells: DataFrame, min_rows: int = 2) -> DataFrame:
    """``page_id, table_id, rows, width, headed, confidence`` of the tables that hold data, ``rank`` 1 the best of its page."""
    rows = laid_out(cells).groupBy("page_id", "table_id", "row").agg(F.first("header_row").alias("header_row"), F.first("width").alias("width"), F.first("nested").alias("nested"), F.first("inside").alias("inside"))
    body = rows.where("not header_row")
    modal = body.groupBy("page_id", "table_id", "width").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    modal = modal.groupBy("page_id", "table_id").agg(F.max_by("width", F.struct("n", -F.col("first"))).alias("modal"))
    shape = rows.join(apart(modal), ["page_id", "table_id"]).groupBy("page_id", "table_id").agg(
        F.sum(F.when(~F.col("header_row"), 1).otherwise(0)).alias("rows"), F.first("modal").alias("width"), F.bool_or("header_row").alias("headed"), F.bool_or("nested").alias("nested"), F.bool_or("inside").alias("inside"),
        F.avg(F.when(~F.col("header_row"), (F.col("width") == F.col("modal")).cast("double"))).alias("even"),
    )
    when = lambda c, w: F.when(c, w).otherwise(0.0)
    score = 0.3 + when(F.col("headed"), 0.25) + 0.25 * F.col("even") + when(F.col("nested"), -0.3) + when(F.col("inside"), -0.15) + when((F.col("rows") >= 3) & (F.col("width") >= 3), 0.1)
    found = shape.where((F.col("rows") >= min_rows) & (F.col("width") >= 2)).withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 4))
    best = W.partitionBy("page_id").orderBy(F.desc("confidence"), F.desc("rows"), "table_id")
    return found.withColumn("rank", F.row_number().over(best)).select("page_id", "table_id", "rows", "width", "headed", "confidence", "rank")


def column_names(cells: DataFrame) -> DataFrame:
    """``page_id, table_id, column, name, header``: the deepest header that spans one column, else the first with text; in canonical words; repeated names numbered."""
    heads = laid_out(cells).where("header_row and text <> ''")
    named = heads.groupBy("page_id", "table_id", "column").agg(F.coalesce(F.max_by("text", F.when(F.col("span") == 1, F.col("row"))), F.min_by("text", "row")).alias("header"))
    every = cells.select("page_id", "table_id", "column").distinct().join(apart(named), ["page_id", "table_id", "column"], "left")
    base = F.coalesce(F.nullif(slug_name(F.col("header")), F.lit("")), F.concat(F.lit("column_"), (F.col("column") + 1).cast("string")))
    every = every.withColumn("base", F.coalesce(lookup(L.TOKEN_FIELD, squash(base)), base))
    n = F.row_number().over(W.partitionBy("page_id", "table_id", "base").orderBy("column"))
    return every.withColumn("name", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("_", "base", n.cast("string")))).drop("base")


def table_fields(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Cells of body rows as candidates, ``rank`` 0, record_ix the row's place among the table's body rows."""
    chosen = found.where("rank = 1").select("page_id", "table_id", "headed", F.col("confidence").alias("table_confidence"))
    body = laid_out(cells).where("not all_head").join(apart(chosen), ["page_id", "table_id"]).join(apart(column_names(cells)), ["page_id", "table_id", "column"])
    value = F.coalesce(F.nullif("text", F.lit("")), "link", "image")
    weight = F.least(F.when(F.col("headed"), 0.55).otherwise(0.35) + F.when(F.col("column") == 0, 0.05).otherwise(0.0), F.col("table_confidence") + 0.15)
    signals = F.array(base_signal("table"), signal("table column", weight - L.SOURCES["table"]))
    w = W.partitionBy("page_id", "table_id").orderBy("row")
    out = body.withColumns({"record_ix": F.dense_rank().over(w) - 1, "value": value}).where("value is not null")
    out = out.select("page_id", F.lit(0).alias("rank"), "record_ix", F.col("column").cast("long").alias("ord"), "name", "value", F.lit("table").alias("source"), F.concat(F.lit("td:nth-child("), F.col("column") + 1, F.lit(")")).alias("selector"), F.col("row_node").alias("node_id"), F.col("row_node").alias("end_id"), signals.alias("signals"))
    return out.withColumn("confidence", confidence(F.col("signals"))).withColumn("inferred", infer_type("value"))


def property_pairs(cells: DataFrame) -> DataFrame:
    """``page_id, name, value`` of tables whose rows are all a label and a value; the first of a label wins."""
    rows = cells.groupBy("page_id", "table_id", "row").agg(F.count("*").alias("width"), F.min_by("text", "column").alias("label"), F.max_by("text", "column").alias("value"))
    pairs = rows.withColumn("even", F.bool_and(F.col("width") == 2).over(W.partitionBy("page_id", "table_id"))).where("even and label <> '' and value <> ''")
    name = slug_name(F.col("label"))
    pairs = pairs.withColumn("name", F.coalesce(lookup(L.TOKEN_FIELD, squash(name)), name))
    return pairs.groupBy("page_id", "name").agg(F.min_by("value", F.struct("table_id", "row")).alias("value"))
