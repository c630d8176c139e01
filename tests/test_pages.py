"""From HTML to nodes, structures and records."""

import json

import pytest

from siftloom.config import Config
from siftloom.operators import css, navigation, structured, tables
from siftloom.plans import catalogue, sinks
from siftloom.plans.extract import nodes_of, process
from siftloom.sources.html import rows

CARD = '<div class="product-card"><a href="/p/{i}"><img src="/i/{i}.jpg"></a><h2><a href="/p/{i}">Product number {i}</a></h2><span class="price">$1,{i}99.00</span></div>'
SHOP = '<html><body><nav><ul class=menu><li><a href="/">Home</a></li><li><a href="/b">B</a></li></ul></nav><div class=products>' + "".join(CARD.format(i=i) for i in range(1, 5)) + '</div><a rel=next href="?page=3">more</a></body></html>'
NEWS = "<table><thead><tr><th>Name</th><th>Price</th></tr></thead>" + "".join(f"<tr><td>n{i}</td><td>9.9{i}</td></tr>" for i in range(3)) + "</table>"
LD = '<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "Book", "sku": "S1", "offers": {"@type": "Offer", "price": "12.50", "availability": "https://schema.org/InStock"}}]}</script>'


def pages(spark, *html):
    return spark.createDataFrame([(i, f"http://shop.example.com/list?page=2&n={i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def test_nodes_nest():
    found = rows(1, "http://a/", "<!doctype html><p><b>one<br><p>two<ul><li>a<li>b<table><tr><td>x<td>y</table></ul><!-- c -->")
    tags = [r["tag"] for r in found]
    assert tags == ["html", "p", "b", "br", "p", "ul", "li", "li", "table", "tr", "td", "td"]
    for r in found:
        assert r["parent_id"] < r["node_id"] <= r["end_id"]
        inside = [x for x in found if r["node_id"] < x["node_id"] <= r["end_id"]]
        assert all(x["depth"] > r["depth"] for x in inside)
    assert found[0]["sub_text"] == "onetwoabxy" and rows(1, None, None)[0]["tag"] == "html"


def test_deep_pages():
    assert len(rows(1, "http://a/", "<div>" * 5000)) == 5001


def test_records_of_cards_and_of_a_table(spark):
    found, problems = process(pages(spark, SHOP, NEWS, LD))
    by_page = {}
    for r in found.collect():
        by_page.setdefault(r["page_id"], []).append({k: f["value"] for k, f in r["fields"].items()})
    assert problems.collect() == []
    first = by_page[0][0]
    assert len(by_page[0]) == 4 and first["title"] == "Product number 1" and first["price"] == "1199.0" and first["url"] == "http://shop.example.com/p/1"
    assert len(by_page[1]) == 3 and by_page[1][0]["price"] == "9.9"
    assert len(by_page[2]) == 1 and by_page[2][0] | {"url": ""} == {"title": "Book", "sku": "S1", "price": "12.5", "availability": "in stock", "url": ""}


def test_export(spark, tmp_path):
    found, _ = process(pages(spark, NEWS))
    found = found.persist()
    assert sinks.export(found, tmp_path / "a.json", pretty=False) == 3 and len(json.loads((tmp_path / "a.json").read_text())) == 3
    assert sinks.export(found, tmp_path / "a.json") == 3 and len(json.loads((tmp_path / "a.json").read_text())) == 3
    assert sinks.export(found, tmp_path / "a.jsonl") == 3 and sinks.export(found, tmp_path / "a.db") == 3
    sinks.export(found, tmp_path / "a.csv")
    assert (tmp_path / "a.csv").read_text().splitlines()[:2] == ["title,price", "n0,9.9"]
    with pytest.raises(sinks.ExportError):
        sinks.export(found, tmp_path / "a.xyz")
    sinks.export(found.limit(0), tmp_path / "b.json")
    assert json.loads((tmp_path / "b.json").read_text()) == []


def test_spans():
    from siftloom.sources.html import parse

    table = parse("<table><tr><th rowspan=2>A<th colspan=2>B<tr><th>C<th>D<tr><td>1<td>2<td>3</table>").children[0]
    assert [[c["text"] for c in row] for row in tables.grid(table, None)] == [["A", "B", "B"], ["A", "C", "D"], ["1", "2", "3"]]


def test_json_ld():
    assert structured.loads('{"a": 1} junk {"b": 2}') == [{"a": 1}, {"b": 2}]
    html = '<div itemscope itemtype="http://schema.org/Product"><span itemprop=name>N</span><div itemprop=offers itemscope itemtype="x/Offer"><meta itemprop=price content=5></div></div>'
    ((source, types, data),) = structured.page_blocks("http://a/", html)
    assert (source, types, data["offers"]["price"]) == ("microdata", ["product"], "5")


def test_selectors_and_next_page(spark):
    p = pages(spark, SHOP)
    nodes = nodes_of(p)
    count = lambda s: css.select(nodes, s).count()
    assert (count("div.products > div.product-card"), count("a[href]"), count("li:nth-of-type(2)"), count("nav a, span.price"), count("#none")) == (4, 11, 1, 6, 0)
    assert [(r["url"], r["source"]) for r in navigation.next_pages(nodes, p).collect()] == [("http://shop.example.com/list?page=3", "rel=next")]
    more = {"h2 + span": 4, "a ~ h2": 4, "a + span": 0, "div.product-card > :not(a)": 8, "div.product-card:nth-child(2)": 1, "div.product-card:last-of-type": 1, "nav ul > li:first-of-type > a": 1, "span:only-of-type": 4, "[class|=product]": 4}
    more |= {"//div[@class='products']/div": 4, "//a[@rel='next']": 1, "//li[2]/a": 1, ".//a[starts-with(@href, 'http://shop')][contains(@href, '/p/')]": 8, "(//span)": 4}
    assert {s: count(s) for s in more} == more
    with pytest.raises(ValueError):
        css.steps("a >")
    with pytest.raises(ValueError):
        css.from_xpath("//a[last()]")


def test_config():
    c = Config.model_validate({"extraction": {"fields": {"name": "h2", "all": "auto"}}})
    assert c.options().fields == {"name": {"selector": "h2"}} and c.merged({"pagination": {"max_pages": 3}}).pagination.max_pages == 3
    with pytest.raises(ValueError):
        Config.model_validate({"nonsense": 1})


def test_crawl_without_a_bound(spark):
    """A chain is followed to its end, past any number of pages; a circle ends."""
    n = 40
    archive = spark.createDataFrame([(f"u{i}",) for i in range(n)], "url string")
    links = spark.createDataFrame([(f"u{i}", f"u{(i + 1) % n}") for i in range(n)], "url string, next_url string")
    starts = spark.createDataFrame([(1, "u0")], "source_id long, url string")
    got = navigation.crawl(archive, links, starts, max_pages=None).collect()
    assert sorted((r["depth"], r["url"]) for r in got) == [(i, f"u{i}") for i in range(n)]
    assert navigation.crawl(archive, links, starts, max_pages=3).count() == 3


def test_pagination_chain_has_no_bound(spark, tmp_path, monkeypatch):
    bounds, crawl = [], navigation.crawl
    monkeypatch.setattr(navigation, "crawl", lambda *a, max_pages=25: bounds.append(max_pages) or crawl(*a, max_pages=max_pages))
    spark.range(1, 251).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    got = catalogue.pagination_chain(spark, str(tmp_path))
    assert bounds == [None] and sorted(r["c_custkey"] for r in got.collect()) == list(range(1, 251))


def test_nodes_of_records_side_by_side_and_nested(spark):
    from siftloom.operators.fields import record_nodes

    nodes = nodes_of(pages(spark, "<div><p>a<b>b</b></p><i>no</i><p>c</p></div>", "<div>x<div>y<p>z</p></div><p>w</p></div>"))
    members = nodes.where("(page_id = 0 and tag = 'p') or (page_id = 1 and tag = 'div')")
    records = members.selectExpr("page_id", "1 as rank", "node_id as record_ix", "node_id", "end_id", "depth")
    got = {}
    for r in record_nodes(nodes, records).orderBy("page_id", "record_ix", "node_id").collect():
        got.setdefault((r["page_id"], r["record_ix"]), []).append((r["tag"], r["selector"]))
    assert got == {(0, 2): [("p", ":scope"), ("b", "b")], (0, 5): [("p", ":scope")], (1, 1): [("div", ":scope"), ("div", "div"), ("p", "div > p"), ("p", "p")], (1, 2): [("div", ":scope"), ("p", "p")]}
