"""More queries over pages rendered from the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import patterns as P
from ..operators import alignment, brief, collections, records, scoring, structured, tables
from ..shared import shared_dir, write_shared
from ..sources import load
from ..sources.html import shred
from . import job, rendered, sinks
from .catalogue import line_candidates, order_records, query, table
from .extract import extract_one, hydrate, nodes_of, page_images, page_links, visible_text
from .rendered import text

# Values


@query(r"""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'rating' WHEN 1 THEN 'date' WHEN 2 THEN 'email' WHEN 3 THEN 'availability' WHEN 4 THEN 'duration' WHEN 5 THEN 'date' ELSE 'discount' END AS field,
  CASE event_id % 7 WHEN 0 THEN (event_id % 5 + 1) || '.0' WHEN 1 THEN event_id || ' days ago' WHEN 2 THEN 'user' || event_id || '@mail.example.com' WHEN 3 THEN CASE event_id % 2 WHEN 0 THEN 'in stock' ELSE 'sold out' END
  WHEN 4 THEN '12:' || lpad((event_id % 60)::VARCHAR, 2, '0') WHEN 5 THEN '2024-03-' || lpad((event_id % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00' ELSE (event_id % 90 + 5) || '.0' END AS value, event_id % 3 <> 2 AS phone, event_id % 2 = 0 AS price FROM events""")
def text_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest guess of short texts of each kind, and the tests for phone numbers and prices."""
    k = F.col("event_id")
    said = (
        F.when(k % 7 == 0, F.concat(F.repeat(F.lit("★"), (k % 5 + 1).cast("int")), F.repeat(F.lit("☆"), (4 - k % 5).cast("int")))).when(k % 7 == 1, text(k.cast("string"), " days ago")).when(k % 7 == 2, text("user", k.cast("string"), "@mail.example.com"))
        .when(k % 7 == 3, F.when(k % 2 == 0, "In Stock").otherwise("SOLD OUT")).when(k % 7 == 4, text("12:", F.lpad((k % 60).cast("string"), 2, "0"))).when(k % 7 == 5, text("Posted Mar ", (k % 28 + 1).cast("string"), ", 2024"))
        .otherwise(text("-", (k % 90 + 5).cast("string"), "%"))
    )
    said = F.when(k % 7 == 6, text("Save ", (k % 90 + 5).cast("string"), "%")).otherwise(said)
    first = F.get(P.detect(said), 0)
    phone = F.when(k % 3 == 0, "+1 555 123 4567").when(k % 3 == 1, "(020) 7946-0958").otherwise("call us")
    price = F.when(k % 2 == 0, "EUR 12,50").otherwise("12 pieces")
    return table(spark, sf_dir, "events").select("event_id", first["field"].alias("field"), first["value"].alias("value"), phone.rlike(f"^{P.PHONE}$").alias("phone"), P.looks_like_price(price).alias("price"))


@query(r"""SELECT p_partkey, lower(regexp_replace(p_name, '[^\p{L}\p{N}]', '', 'g')) AS squashed, array_to_string(list_transform(regexp_extract_all(p_name, '[\p{L}\p{N}]+'), lambda x: lower(x)), '|') AS tokens,
  'p_' || p_partkey AS slug, NULL::VARCHAR AS none, true AS same FROM part""")
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    one, two = F.create_map(F.lit("a"), F.col("p_name"), F.lit("b"), key), F.create_map(F.lit("b"), key, F.lit("a"), F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", N.squash("p_name").alias("squashed"), F.array_join(N.tokens_of("p_name"), "|").alias("tokens"), N.slug(text("P ", key)).alias("slug"), N.slug(F.lit("9%!")).alias("none"), (N.identity(one) == N.identity(two)).alias("same")
    )


@query("SELECT min(c_custkey) AS source_id, 'https://example' || (c_custkey % 50) || '.com/' AS url FROM customer WHERE c_custkey % 7 <> 0 GROUP BY url")
def source_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made whole, refused ones left out, the first of equals kept."""
    k = F.col("c_custkey")
    raw = F.when(k % 7 == 0, text("ftp://example", k.cast("string"))).when(k % 3 == 0, text("https://example", (k % 50).cast("string"), ".com")).otherwise(text(" example", (k % 50).cast("string"), ".com/#part"))
    return load.resolve(table(spark, sf_dir, "customer").select(k.alias("source_id"), raw.alias("raw")))


# Parts of pages


@query("SELECT 'http://parts.example.com/p/' || p_partkey AS url, unnest(['', p_name]) AS text, '' AS rel FROM part")
def page_link_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(shred(rendered.part_cards(table(spark, sf_dir, "part")))).where(F.col("url").contains("/p/")).select("url", "text", "rel")


@query("SELECT 'Part ' || p_partkey AS alt, 'http://parts.example.com/i/' || p_partkey || '.jpg' AS url, p_size::INTEGER AS width, 10 AS height FROM part")
def page_image_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by their address, a lazy one, or the widest of a set."""
    k = F.col("p_partkey")
    key = k.cast("string")
    place = F.when(k % 3 == 0, text('src="/i/', key, '.jpg"')).when(k % 3 == 1, text('src="data:x" data-src="/i/', key, '.jpg"')).otherwise(text('srcset="/s.jpg 100w, /i/', key, '.jpg 300w, /t.jpg 200w"'))
    item = text("<img ", place, ' alt=" Part  ', key, '" width="', F.col("p_size").cast("string"), '" height="10.5">')
    return page_images(shred(rendered.page(table(spark, sf_dir, "part"), k, 20, item, "<p>", "</p>", "http://parts.example.com/list/", "p_partkey"))).select("alt", "url", "width", "height")


@query("SELECT s_suppkey AS page_id, 'T ' || s_suppkey || ' ' || s_name || ' end' AS text FROM supplier")
def visible_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    html = text("<html><head><title>T ", key, "</title><style>x {}</style></head><body><p>", rendered.escaped(F.col("s_name")), "</p><script>no()</script>hidden<b>  end</b></body></html>")
    return visible_text(shred(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"), F.lit("http://s.example.com/").alias("url"), html.alias("html"))))


@query("""WITH n AS (SELECT c_custkey, (c_custkey - min(c_custkey) OVER ()) // 100 AS p FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY p) AS m FROM n)
  SELECT c_custkey, CASE WHEN m > 1 THEN 'ul > li:nth-of-type(' || i || ')' ELSE 'ul > li' END AS path FROM r""")
def selector_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred(rendered.customer_pages(table(spark, sf_dir, "customer"))).where("tag = 'li'").select(F.col("sub_text").cast("long").alias("c_custkey"), "path")


@query("SELECT n_nationkey AS page_id, 'box-#,price' AS classes FROM nation")
def stable_class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = text('<p class="Price box-', F.col("n_nationkey").cast("string"), ' a1b2c3 css-x1y2 x">n</p>')
    return shred(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))).where("tag = 'p'").select(F.col("page_id").cast("int").alias("page_id"), F.array_join("classes", ",").alias("classes"))


@query("WITH p AS (SELECT (c_custkey - min(c_custkey) OVER ()) // 100 + 1 AS page_id FROM customer) SELECT page_id, count(*) AS items, 1 AS shapes, 0.8::DOUBLE AS similarity FROM p GROUP BY page_id HAVING count(*) > 1")
def shapes_of_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and similarity of list items: of one shape, and as alike as elements without classes can be."""
    items = collections.digest(collections.fingerprints(shred(rendered.customer_pages(table(spark, sf_dir, "customer"))).where("tag = 'li'")))
    me = F.struct(*collections.PRINT)
    alike = items.withColumn("s", collections.similarity(F.lag(me).over(W.partitionBy("page_id").orderBy("node_id")), me))
    return alike.groupBy("page_id").agg(F.count("*").alias("items"), F.countDistinct("digest").cast("int").alias("shapes"), F.min("s").alias("similarity")).where("items > 1")


@query("SELECT p_partkey // 20 AS page_id, 1 AS rank, count(*) AS count, 'product' AS label, 'div.products > div.product-card' AS selector FROM part GROUP BY 1 HAVING count(*) > 1")
def card_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest collection of each page of cards: the cards, not the menu nor what is in the cards."""
    found = collections.discover(nodes_of(rendered.part_cards(table(spark, sf_dir, "part")))).where("rank = 1 and label = 'product'")
    return found.select("page_id", "rank", "count", "label", "selector")


@query("""SELECT page_id, url, len(regexp_extract_all(html, '<a href="[^#"]')) AS links, len(regexp_extract_all(html, '<img ')) AS images, regexp_extract(html, '<a href="/([^"]*)"', 1) <> '' AS linked FROM pages""")
def hydrated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their title, text, links and images."""
    pages = table(spark, sf_dir, "pages")
    found = hydrate(pages, nodes_of(pages))
    return found.select("page_id", "url", F.size("links").alias("links"), F.size("images").alias("images"), F.exists("links", lambda x: x["n"] == 1).alias("linked"))


@query("""SELECT 'h' || (c_custkey % 20) || '.example.com' AS host, c_custkey,
  ((row_number() OVER (PARTITION BY c_custkey % 20 ORDER BY c_custkey % 7, c_custkey) - 1) // 2 * CASE WHEN c_custkey % 20 BETWEEN 2 AND 9 THEN c_custkey % 20 ELSE 1 END)::DOUBLE AS start FROM customer""")
def polite_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each page may be asked for: two of a host at a time, as far apart as its robots file asks, or a second."""
    k = F.col("c_custkey")
    met = table(spark, sf_dir, "customer").select(text("http://h", (k % 20).cast("string"), ".example.com/", F.lpad(k.cast("string"), 12, "0")).alias("url"), (k % 7).alias("depth"))
    robots = spark.createDataFrame([(f"h{i}.example.com", f"User-agent: *\nCrawl-delay: {i}") for i in range(2, 10)], "host string, rules string")
    zero = spark.createDataFrame([("h0.example.com", "")], "host string, rules string")
    found = job.pacing(met, robots.unionByName(zero), 1.0, 2)
    return found.select("host", F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("c_custkey"), "start")


# Columns of records


def obscured_pages(orders: DataFrame) -> DataFrame:
    """Records whose markup names nothing but one column: dates, money and prose must show themselves."""
    key = F.col("o_orderkey").cast("string")
    prose = text("order ", key, " of customer ", F.col("o_custkey").cast("string"), " was handed over at the counter in the hall by clerk ", key)
    item = text(
        '<div class="rx"><a href="/o/', key, '">Order ', key, '</a><span class="aa">', F.date_format("o_orderdate", "MMM d, yyyy"), '</span><i class="qq">$', F.format_string("%,.2f", "o_totalprice"), '</i><span class="entry-clerk">C',
        F.col("o_custkey").cast("string"), '</span><p class="zz">', prose, "</p><em>Add to cart</em></div>",
    )
    return rendered.page(orders, F.col("o_orderkey"), 40, item, '<div class="list">', "</div>", "http://orders.example.com/", "o_orderkey")


@query("""WITH p AS (SELECT o_orderkey // 40 AS page_id FROM orders GROUP BY 1 HAVING count(*) >= 3)
  SELECT page_id, s AS selector, CASE s WHEN 'span.aa' THEN 'date' WHEN 'i.qq' THEN 'price' WHEN 'span.entry-clerk' THEN 'clerk' WHEN 'p.zz' THEN 'description' END AS name, 1.0::DOUBLE AS coverage
  FROM p, unnest(['a', 'span.aa', 'i.qq', 'span.entry-clerk', 'p.zz', 'em']) AS u(s)""")
def aligned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_of(obscured_pages(table(spark, sf_dir, "orders")))
    hit = nodes.where("tag = 'div' and element_at(attrs, 'class') = 'rx'")
    members = hit.select("page_id", F.lit(1).alias("rank"), F.col("node_id").alias("record_ix"), "node_id", "end_id", "depth")
    return alignment.columns(nodes, write_shared(members, "members")).select("page_id", "selector", "name", "coverage")


@query("""WITH p AS (SELECT o_orderkey // 40 AS page_id FROM orders GROUP BY 1 HAVING count(*) >= 3)
  SELECT page_id, 'c' || i AS id, ['price', 'description', 'date', 'clerk', NULL, NULL][i] AS name, 3 AS samples FROM p, range(1, 7) AS u(i)""")
def column_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on columns: named ones first, with samples."""
    nodes = nodes_of(obscured_pages(table(spark, sf_dir, "orders")))
    hit = nodes.where("tag = 'div' and element_at(attrs, 'class') = 'rx'")
    ix = F.row_number().over(W.partitionBy("page_id").orderBy("node_id")) - 1
    members = hit.select("page_id", F.lit(1).alias("rank"), ix.alias("record_ix"), "node_id", "end_id", "depth")
    return brief.brief(nodes, write_shared(members, "members")).select("page_id", "id", "name", F.size("samples").alias("samples"))


# Tables and details


@query("SELECT r_name AS region, n_name AS nation, n_nationkey AS nation_key FROM nation JOIN region ON n_regionkey = r_regionkey")
def spanned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with two header rows and cells that span rows: each nation has its region again."""
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = text("<td>", rendered.escaped(F.col("n_name")), "</td><td>", F.col("n_nationkey").cast("string"), "</td>")
    group = both.groupBy("r_name").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    group = group.select("r_name", text('<tr><td rowspan="', F.size("rows").cast("string"), '">', rendered.escaped(F.col("r_name")), "</td>", F.array_join("rows", "</tr><tr>"), "</tr>").alias("item"))
    body = group.agg(F.array_join(F.array_sort(F.collect_list("item")), "").alias("body"))
    head = "<table><thead><tr><th rowspan=2>Region</th><th colspan=2>Nation</th></tr><tr><th>Label</th><th>Number</th></tr></thead>"
    cells = tables.cells(body.select(F.lit(1).alias("page_id"), F.lit("u").alias("url"), text(head, F.col("body"), "</table>").alias("html")))
    cells = write_shared(cells, "cells")
    found = tables.table_fields(cells, tables.tables(cells, 1)).groupBy("page_id", "record_ix").pivot("ord", [0, 1, 2]).agg(F.first("value"))
    return found.select(F.col("0").alias("region"), F.col("1").alias("nation"), F.col("2").cast("int").alias("nation_key"))


@query("""SELECT s_suppkey // 20 AS page_id, count(*) AS rows, 3 AS width, true AS headed, CASE WHEN count(*) >= 3 THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence FROM supplier GROUP BY 1""")
def best_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of data wins over a table that only lays out."""
    pages = rendered.supplier_tables(table(spark, sf_dir, "supplier"))
    pages = pages.withColumn("html", F.replace("html", F.lit("<body>"), F.lit("<body><table><tr><td>menu</td></tr><tr><td>more</td></tr></table><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>")))
    found = tables.tables(write_shared(tables.cells(pages), "cells"), 1).where("rank = 1")
    return found.select("page_id", "rows", "width", "headed", "confidence")


def part_site(part: DataFrame) -> DataFrame:
    """A shop: listing pages that lead on, ten parts each, and a page of its own for each part."""
    key = F.col("p_partkey").cast("string")
    item = text('<div class="product-card"><a href="/p/', key, '"><img src="/i/', key, '.jpg" alt=""></a><h2 class="title"><a href="/p/', key, '">', rendered.escaped(F.col("p_name")), '</a></h2><span class="price">$', F.format_string("%,.2f", "p_retailprice"), "</span></div>")
    numbered = part.select("p_partkey", (F.floor(F.col("p_partkey") / 10) + 1).cast("long").alias("n"), item.alias("item"))
    listing = numbered.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))), lambda x: x["item"]), "").alias("body"))
    lead = text('<a class="go" href="/list?page=', (F.col("n") + 1).cast("string"), '">Next</a>')
    pages = listing.select(text("http://shop.example.com/list?page=", F.col("n").cast("string")).alias("url"), text('<html><body><div class="products">', F.col("body"), "</div>", lead, "</body></html>").alias("html"))
    pair = lambda label, value: text("<tr><th>", label, "</th><td>", value, "</td></tr>")
    html = text("<html><head><title>", rendered.escaped(F.col("p_name")), " - Shop</title></head><body><nav><a href=/>Home</a></nav><main><h1>", rendered.escaped(F.col("p_name")), "</h1><table>", pair("SKU", text("PART-", key)), pair("Brand", rendered.escaped(F.col("p_brand"))), pair("Kind of part", rendered.escaped(F.col("p_type"))), "</table></main></body></html>")
    return pages.unionByName(part.select(text("http://shop.example.com/p/", key).alias("url"), html.alias("html")))


@query("SELECT p_partkey, p_name || ' - Shop' AS title, p_brand AS brand, p_type AS kind_of_part FROM part")
def single_things(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages of one part each say of it: title, and the pairs of its table."""
    pages = part_site(table(spark, sf_dir, "part")).where(F.col("url").contains("/p/")).withColumn("page_id", F.xxhash64("url"))
    found = extract_one(pages)
    value = lambda n: records.value(n)
    return found.select(F.substring(value("sku"), 6, 20).cast("long").alias("p_partkey"), value("title").alias("title"), value("brand").alias("brand"), value("kind_of_part").alias("kind_of_part"))


# Jobs


@query("SELECT p_partkey, p_name AS title, round(p_retailprice, 2) AS price, p_brand AS brand FROM part")
def job_with_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job from the first listing page to the last, each record with what its own page says."""
    site = write_shared(part_site(table(spark, sf_dir, "part")), "site")
    start = spark.createDataFrame([(1, "http://shop.example.com/list?page=1")], "source_id long, url string")
    n = site.count()
    done = job.run(site, start, job.Plan(max_pages=n, max_items=n, follow=True, follow_pages=n, stop_on_duplicate_page=False))
    value = lambda f: records.value(f)
    return done.records.select(F.substring(value("sku"), 6, 20).cast("long").alias("p_partkey"), value("title").alias("title"), value("price").cast("double").alias("price"), value("brand").alias("brand"))


@query("""SELECT n_nationkey AS source_id, CASE n_nationkey % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'blocked' WHEN 4 THEN 'blocked' ELSE 'failed' END AS status,
  CASE n_nationkey % 5 WHEN 1 THEN 'BLOCKED' WHEN 2 THEN 'HTTP_ERROR' WHEN 3 THEN 'SOURCE_ERROR' WHEN 4 THEN 'ROBOTS_DISALLOWED' END AS error FROM nation""")
def job_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's sources with what became of them: pages that are fine, blocked, gone, absent, or that robots files refuse."""
    k = F.col("n_nationkey")
    url = text("http://h", (k % 5).cast("string"), ".example.com/", k.cast("string"))
    nation = table(spark, sf_dir, "nation")
    html = F.when(k % 5 == 1, "<p>Just a moment...</p>").otherwise(text("<title>", F.col("n_name"), "</title><p>text"))
    archive = nation.where(k % 5 != 3).select(url.alias("url"), html.alias("html"), F.when(k % 5 == 2, 404).otherwise(200).alias("status"))
    robots = spark.createDataFrame([("h4.example.com", "User-agent: *\nDisallow: /"), ("h0.example.com", "User-agent: *\nDisallow: /private")], "host string, rules string")
    return job.run(archive, nation.select(k.alias("source_id"), url.alias("url")), robots=robots).sources.select(F.col("source_id").cast("int").alias("source_id"), "status", "error")


@query("""WITH c AS (SELECT c_custkey, c_custkey % 6 AS t FROM customer)
  SELECT c_custkey AS page_id, 'http://c.example.com/list?page=' || (c_custkey + 1) AS url, ['link text', 'glyph', 'class', 'numbered', 'url pattern'][t + 1] AS source FROM c WHERE t < 5""")
def next_page_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sign by which each page leads on, of every kind; some do not."""
    from ..operators import navigation

    k = F.col("c_custkey")
    to = text('<a href="?page=', (k + 1).cast("string"), '"')
    body = (
        F.when(k % 6 == 0, text(to, ">Next page</a>")).when(k % 6 == 1, text(to, ">»</a>")).when(k % 6 == 2, text(to, ' class="pager-next">more</a>')).when(k % 6 == 3, text('<div class="pagination">', to, ">", (k + 1).cast("string"), "</a></div>"))
        .when(k % 6 == 4, '<div class="pagination"><span>...</span></div>').otherwise('<a href="/other">back</a>')
    )
    pages = table(spark, sf_dir, "customer").select(k.alias("page_id"), text("http://c.example.com/list?page=", k.cast("string")).alias("url"), text("<html><body>", body, "</body></html>").alias("html"))
    return navigation.next_pages(nodes_of(pages), pages).select("page_id", "url", "source")


@query("""SELECT c_custkey AS page_id, CASE WHEN c_custkey % 2 = 0 THEN 'http://c.example.com/go/' || c_custkey ELSE 'http://c.example.com/list?page=' || (c_custkey + 1) END AS url, CASE WHEN c_custkey % 2 = 0 THEN 'configured' ELSE 'template' END AS source FROM customer""")
def configured_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configured selector, and a template where that finds nothing."""
    from ..operators import navigation

    k = F.col("c_custkey")
    body = F.when(k % 2 == 0, text('<a rel="next" href="/wrong">Next</a><a class="go" href="/go/', k.cast("string"), '">x</a>')).otherwise('<a rel="next" href="/wrong">Next</a>')
    pages = table(spark, sf_dir, "customer").select(k.alias("page_id"), text("http://c.example.com/list?page=", k.cast("string")).alias("url"), body.alias("html"))
    return navigation.next_pages(nodes_of(pages), pages, selector="a.go", template="http://c.example.com/list?page={page}").select("page_id", "url", "source")


@query("""SELECT c_custkey, c_custkey % 10 AS host, CASE WHEN c_custkey % 10 < 5 THEN (c_custkey % 10)::DOUBLE ELSE 0.0 END AS delay FROM customer WHERE c_custkey % 10 >= 5 OR c_custkey % 3 <> 0""")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that their hosts' robots files allow, with the wait that these ask for; half of the hosts have none."""
    k = F.col("c_custkey")
    url = text("http://h", (k % 10).cast("string"), ".example.com/", F.when(k % 3 == 0, "private/").otherwise("open/"), k.cast("string"))
    rules = spark.createDataFrame([(f"h{i}.example.com", f"User-agent: *\nCrawl-delay: {i}\nDisallow: /private") for i in range(5)], "host string, rules string")
    pages = load.robots_filter(table(spark, sf_dir, "customer").select("c_custkey", url.alias("url")), rules)
    waits = load.crawl_delays(rules).withColumnRenamed("host", "h")
    out = pages.join(waits, N.host_of("url") == F.col("h"), "left")
    return out.select("c_custkey", (k % 10).alias("host"), F.coalesce("delay", F.lit(0.0)).alias("delay"))


# Candidates and records


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag AS name, l_linenumber * 10 AS node, l_linenumber * 10 + CASE l_linestatus WHEN 'O' THEN 15 ELSE 0 END AS last, round(l_discount * 5, 2) AS w FROM lineitem),
  n AS (SELECT *, min(node) OVER (PARTITION BY l_orderkey, name ORDER BY node RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead FROM c)
  SELECT l_orderkey AS record_ix, l_linenumber AS ord, round(greatest(0.0, least(1.0, w + CASE WHEN ahead <= last THEN -0.15 ELSE 0.0 END)), 4) AS confidence FROM n""")
def container_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that hold another of their field lose a little."""
    last = F.col("ord") * 10 + F.when(F.col("selector") == "td.O", 15).otherwise(0)
    found = scoring.demote_containers(line_candidates(spark, sf_dir).withColumns({"node_id": F.col("ord") * 10, "end_id": last}))
    return found.select("record_ix", F.col("ord").cast("int").alias("ord"), "confidence")


@query("SELECT l_orderkey AS record_ix, l_returnflag AS name, l_partkey::VARCHAR AS value, 'given' AS signal, round(l_discount * 5, 2) AS weight FROM lineitem")
def explained_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.explain(scoring.score(line_candidates(spark, sf_dir)))
    return found.select("record_ix", "name", "value", "signal", "weight")


@query("""WITH c AS (SELECT l_orderkey, l_returnflag, l_partkey, l_linenumber, round(greatest(0, least(1, round(l_discount * 5, 2))), 4) AS confidence, CASE WHEN l_linestatus = 'O' THEN 8 ELSE 10 END AS src FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY confidence DESC, src, length(l_partkey::VARCHAR) DESC, l_linenumber, l_partkey::VARCHAR) AS n FROM c)
  SELECT l_orderkey AS record_ix, max(CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS returned, max(CASE WHEN l_returnflag = 'A' THEN l_partkey END) AS a, count(*) AS fields, round(avg(confidence), 3) AS confidence
  FROM r WHERE n = 1 AND l_returnflag IN ('R', 'A') GROUP BY l_orderkey""")
def wanted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the wanted fields, one under another name, with their mean confidence."""
    best = scoring.best_per_field(scoring.score(line_candidates(spark, sf_dir)))
    made = records.assemble(records.finalize(best, ["returned", "A"], {"R": "returned"}, {"A": "integer"}))
    value = lambda n: records.value(n).cast("long")
    return made.select("record_ix", value("returned").alias("returned"), value("A").alias("a"), F.size("fields").cast("long").alias("fields"), F.round("confidence", 3).alias("confidence"))


@query("SELECT o_orderkey AS record_ix FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def unseen_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose key is not among those of earlier ones."""
    rows = order_records(spark, sf_dir)
    seen = rows.where(records.value("status") == "F").select(records.dedupe_key().alias("key")).distinct()
    return records.unseen(rows, seen).select("record_ix")


@query("""WITH r AS (SELECT l_suppkey AS source_id, l_linenumber AS depth, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
  SELECT source_id, depth, sum(n)::BIGINT AS records FROM c WHERE before < 200 GROUP BY ALL""")
def pages_up_to_a_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each source until their records reach a number."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("depth"))
    return records.cut_pages(rows, 200).groupBy("source_id", "depth").agg(F.count("*").alias("records"))


@query("""WITH u AS (SELECT 'http://h' || (o_custkey % 3) || '.example.com/' || o_custkey AS url, min(o_orderkey) AS first_at FROM orders WHERE o_custkey % 3 = 1 GROUP BY 1) SELECT url FROM u ORDER BY first_at LIMIT 500""")
def follow_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first addresses to follow, of one host, each once, as many as the budget has."""
    k = F.col("o_custkey")
    url = text("http://h", (k % 3).cast("string"), ".example.com/", k.cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.lit(1).alias("page_id"), F.lit(1).alias("rank"), F.col("o_orderkey").alias("record_ix"), F.create_map(F.lit("url"), F.struct(url.alias("value"))).alias("fields"))
    return records.follow_budget(rows, 500, N.host_of(records.value("url")) == "h1.example.com").select("url")


@query("SELECT o_orderkey AS record_ix, 'C' || o_custkey AS sku, nullif(o_orderstatus, 'P') AS status FROM orders")
def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records saved as a table of JSON by all executors, and read again."""
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    sinks.save_table(order_records(spark, sf_dir), path)
    data = lambda n: F.get_json_object("data_json", f"$.{n}")
    return spark.read.parquet(path).select("record_ix", data("sku").alias("sku"), data("status").alias("status"))


# Structured data


@query("SELECT r_regionkey AS page_id, 'product' AS type, r_name || '-' || i AS name FROM region, range(3) AS u(i)")
def forgiving_jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph, an object after it in the same script, and one after something unreadable."""
    name = lambda i: text('{"@type": "http://schema.org/Product", "name": "', F.col("r_name"), f'-{i}"}}')
    html = text('<script type="application/ld+json">{"@graph": [', name(0), "]} ", name(1), " oops {bad} ", name(2), "</script>")
    pages = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    found = structured.blocks(pages).where("source = 'jsonld'")
    return found.select(F.col("page_id").cast("int").alias("page_id"), F.get("types", 0).alias("type"), F.get_json_object("data", "$.name").alias("name"))


@query("""SELECT r_regionkey AS page_id, '["' || r_name || '","second"]' AS names, 'offer' AS inner_type, r_regionkey || '.5' AS price FROM region""")
def nested_microdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property that repeats is a list; an item within an item is its value."""
    html = text('<div itemscope itemtype="http://schema.org/Product"><b itemprop="name">', F.col("r_name"), '</b><b itemprop="name">second</b><div><div itemprop="offers" itemscope itemtype="http://schema.org/Offer"><meta itemprop="price" content="', F.col("r_regionkey").cast("string"), '.5"></div></div></div>')
    pages = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    data = lambda p: F.get_json_object("data", p)
    found = structured.blocks(pages).where("source = 'microdata'")
    return found.select(F.col("page_id").cast("int").alias("page_id"), data("$.name").alias("names"), data("$.offers['@type'][0]").alias("inner_type"), data("$.offers.price").alias("price"))


@query("SELECT n_nationkey AS page_id, CASE WHEN n_nationkey % 4 < 2 THEN n_nationkey % 4 + 2 ELSE 0 END AS members, CASE WHEN n_nationkey % 4 = 0 THEN 'car' WHEN n_nationkey % 4 = 1 THEN 'service' END AS type FROM nation")
def record_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of blocks that are records by their type; breadcrumbs, places and single blocks are none."""
    k = F.col("n_nationkey")
    block = lambda t, i: f'<script type="application/ld+json">{{"@type": "{t}", "name": "x{i}"}}</script>'
    html = (
        F.when(k % 4 == 0, "".join(block("Car", i) for i in range(2))).when(k % 4 == 1, "".join(block("Service", i) for i in range(3))).when(k % 4 == 2, "".join(block("BreadcrumbList", i) for i in range(4)) + block("Product", 0))
        .otherwise("".join(block("Place", i) for i in range(3)))
    )
    pages = table(spark, sf_dir, "nation").select(k.alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    found = structured.record_groups(structured.blocks(pages)).select(F.col("page_id").alias("p"), F.size("members").alias("m"), F.get("types", 0).alias("type"))
    return pages.join(found, F.col("page_id") == F.col("p"), "left").select("page_id", F.coalesce("m", F.lit(0)).alias("members"), "type")


@query("SELECT n_nationkey AS page_id, ['__NEXT_DATA__', '__NUXT__', '__INITIAL_STATE__', '__PRELOADED_STATE__', '__APOLLO_STATE__', '__REDUX_STATE__', '__data', 'INITIAL_STATE'][n_nationkey % 8 + 1] AS name, n_nationkey AS k FROM nation")
def state_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page state assigned to a variable, under each of its usual names."""
    names = F.array(*map(F.lit, structured.STATE_NAMES))
    k = F.col("n_nationkey")
    owner = F.when(k % 3 == 0, "window.").when(k % 3 == 1, "globalThis.").otherwise("")
    html = text("<script>var a = 1; ", owner, F.get(names, (k % 8).cast("int")), ' = {"k": ', k.cast("string"), "}; go()</script>")
    pages = table(spark, sf_dir, "nation").select(k.alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    found = structured.blocks(pages).where("source = 'embedded_json'")
    return found.select(F.col("page_id").cast("int").alias("page_id"), F.get("types", 0).alias("name"), F.get_json_object("data", "$.k").cast("int").alias("k"))
