"""Pages rendered from tables: what is extracted from them can be held against the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def page(rows: DataFrame, key: Column, per_page: int, item: Column, before: str, after: str, url: str, order: str) -> DataFrame:
    """Pages of about ``per_page`` items each: consecutive keys together, in order."""
    numbered = rows.select(F.floor(key / per_page).cast("long").alias("page_id"), F.col(order).alias("at"), item.alias("item"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]), "")
    made = numbered.groupBy("page_id").agg(body.alias("body"))
    return made.select("page_id", text(url, F.col("page_id").cast("string")).alias("url"), text("<!DOCTYPE html><html><head><title>Page</title></head><body>", before, F.col("body"), after, "</body></html>").alias("html"))


def supplier_tables(supplier: DataFrame) -> DataFrame:
    cell = lambda x: text("<td>", x, "</td>")
    item = text("<tr>", cell(F.col("s_suppkey").cast("string")), cell(escaped(F.col("s_name"))), cell(F.col("s_nationkey").cast("string")), "</tr>")
    head = "<table><thead><tr><th>Supplier key</th><th>Company</th><th>Nation key</th></tr></thead><tbody>"
    return page(supplier, F.col("s_suppkey"), 20, item, head, "</tbody></table>", "http://suppliers.example.com/", "s_suppkey")


def part_cards(part: DataFrame, first: int = 0) -> DataFrame:
    """Twenty cards a page; keys are counted from ``first``."""
    key = F.col("p_partkey").cast("string")
    item = text(
        '<div class="product-card"><a href="/p/', key, '"><img src="/i/', key, '.jpg" alt=""></a><h2 class="title"><a href="/p/', key, '">', escaped(F.col("p_name")), "</a></h2>",
        '<span class="price">$', F.format_string("%,.2f", "p_retailprice"), '</span><p class="brand">', escaped(F.col("p_brand")), '</p><div class="sku">SKU: PART-', key, "</div></div>",
    )
    before = '<nav><ul class="menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav><div class="products">'
    return page(part, F.col("p_partkey") - first, 20, item, before, "</div>", "http://parts.example.com/list/", "p_partkey")


def order_jsonld(orders: DataFrame) -> DataFrame:
    data = F.to_json(F.struct(F.lit("http://schema.org").alias("@context"), F.lit("Product").alias("@type"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("name"), F.concat(F.lit("O-"), F.col("o_orderkey")).alias("sku"), F.struct(F.lit("Offer").alias("@type"), F.format_string("%.2f", "o_totalprice").alias("price"), F.lit("https://schema.org/InStock").alias("availability")).alias("offers")))
    return page(orders, F.col("o_orderkey"), 50, text('<script type="application/ld+json">', data, "</script>"), "", "<p>Orders</p>", "http://orders.example.com/", "o_orderkey")


def nation_microdata(nation: DataFrame, kind: str = "Place") -> DataFrame:
    item = text(f'<div itemscope itemtype="http://schema.org/{kind}"><span itemprop="name">', F.col("n_name"), '</span><meta itemprop="identifier" content="N', F.col("n_nationkey").cast("string"), '"></div>')
    return page(nation, F.col("n_nationkey"), 5, item, "", "", "http://nations.example.com/", "n_nationkey")


def customer_pages(customer: DataFrame, per_page: int = 100) -> DataFrame:
    """Pages that lead on to the next, ``http://customers.example.com/list?page=1`` the first."""
    first = customer.agg(F.min("c_custkey")).first()[0] or 0
    n = F.floor((F.col("c_custkey") - first) / per_page) + 1
    items = customer.withColumn("n", n).groupBy("n").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<li>"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"), F.lit("</li>")))), "").alias("body"))
    last = items.agg(F.max("n")).first()[0] or 0
    following = F.when(F.col("n") < last, text('<a rel="next" href="?page=', (F.col("n") + 1).cast("string"), '">Next</a>')).otherwise("")
    return items.select(F.col("n").cast("long").alias("page_id"), text("http://customers.example.com/list?page=", F.col("n").cast("string")).alias("url"), text("<html><body><ul>", F.col("body"), '</ul><div class="pager">', following, "</div></body></html>").alias("html"))


def mixed_pages(part: DataFrame, nation: DataFrame) -> DataFrame:
    """Pages for different strategies: a table of the nations, cards of all parts, the nations as structured data."""
    row = text("<tr><td>", F.col("n_name"), "</td><td>", F.col("n_nationkey").cast("string"), "</td><td>", F.col("n_regionkey").cast("string"), "</td></tr>")
    table = page(nation, F.col("n_nationkey"), 100, row, "<table><tr><th>Name</th><th>Key</th><th>Region</th></tr>", "</table>", "http://mixed.example.com/table/", "n_nationkey")
    dealt = lambda df, i: df.select((F.col("page_id") * 3 + i).alias("page_id"), "url", "html")
    return dealt(table, 0).unionByName(dealt(part_cards(part, 1), 1)).unionByName(dealt(nation_microdata(nation, "Organization"), 2))
