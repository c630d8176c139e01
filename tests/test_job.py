"""A job over a small site: pages that lead on, details, failures, robots, duplicates, the store and a retry."""

import json

import pytest
from pyspark.sql import functions as F

from siftloom.operators import jobs
from siftloom.plans import job, sinks
from siftloom.plans.extract import Options, extract_one, hydrate, nodes_of, page_images, page_links, parts_of, visible_text
from siftloom.sources import load

SITE = "http://shop.example.com"
ITEMS = [(f"Product number {i}", f"{i}99.00") for i in range(1, 7)]


def listing(n, last):
    cards = "".join(
        f'<div class="product-card"><a href="/p/{i}"><img src="/i/{i}.jpg"></a><h2><a href="/p/{i}">{ITEMS[i - 1][0]}</a></h2><span class="price">${ITEMS[i - 1][1]}</span></div>' for i in (2 * n - 1, 2 * n)
    )
    more = "" if last else f'<a class="more" href="/list?page={n + 1}">Next</a>'
    return f"<html><head><title>Shop {n}</title></head><body><main class=products>{cards}</main>{more}</body></html>"


def detail(i):
    return f"<html><head><title>{ITEMS[i - 1][0]} - Shop</title></head><body><nav><a href=/>Home</a></nav><main><h1>{ITEMS[i - 1][0]}</h1><table><tr><th>SKU</th><td>SKU-{i}</td></tr><tr><th>Brand</th><td>Acme {i}</td></tr><tr><th>Weight</th><td>{i} kg</td></tr></table></main></body></html>"


@pytest.fixture(scope="module")
def archive(spark):
    rows = [(f"{SITE}/list?page={n}", listing(n, n == 3), 200) for n in (1, 2, 3)] + [(f"{SITE}/p/{i}", detail(i), 200) for i in range(1, 7)]
    rows += [("http://blocked.example.com/", "<p>Just a moment...</p>", 200), ("http://gone.example.com/", "<p>no</p>", 404), ("http://private.example.com/x", listing(1, True), 200), ("http://twice.example.com/", listing(2, True), 200)]
    rows += [(f"{SITE}/list?page=1", listing(1, False), 200), (None, "x", 200), ("http://null.example.com/", None, 200)]
    return spark.createDataFrame(rows, "url string, html string, status int")


def start(spark, *urls):
    return spark.createDataFrame(list(enumerate(urls, 1)), "source_id long, url string")


def test_pages_records_and_errors(spark, archive, tmp_path):
    sources = start(spark, f"{SITE}/list?page=1", "http://blocked.example.com/", "http://gone.example.com/", "http://absent.example.com/", "http://private.example.com/x", None)
    robots = spark.createDataFrame([("private.example.com", "User-agent: *\nDisallow: /x\nCrawl-delay: 3"), ("shop.example.com", "User-agent: *\nCrawl-delay: 2")], "host string, rules string")
    done = job.run(archive, sources, robots=robots)
    titles = [r["fields"]["title"]["value"] for r in done.records.orderBy("source_id", "depth", "record_ix").collect()]
    assert titles == [t for t, _ in ITEMS]
    assert {(r["source_id"], r["status"], r["error"]) for r in done.sources.collect()} == {(1, "done", None), (2, "blocked", "BLOCKED"), (3, "failed", "HTTP_ERROR"), (4, "failed", "SOURCE_ERROR"), (5, "blocked", "ROBOTS_DISALLOWED")}
    s = done.summary().first()
    assert (s["sources"], s["failed"], s["pages"], s["records"]) == (5, 4, 6, 6) and s["errors"] == {"BLOCKED": 1, "HTTP_ERROR": 1, "SOURCE_ERROR": 1, "ROBOTS_DISALLOWED": 1}
    waits = {r["url"]: r["start"] for r in job.pacing(done.pages, robots).collect()}
    assert [waits[f"{SITE}/list?page={n}"] for n in (1, 2, 3)] == [0, 2, 4]
    path = tmp_path / "job.db"
    assert sinks.write_job(done, path) == 1 and sinks.write_job(done, path) == 2
    assert [json.loads(r["data_json"])["title"] for r in sinks.read_job(spark, path).collect()] == [t for t, _ in ITEMS] and sinks.read_job(spark, path, 1).count() == 6
    folder = str(tmp_path / "store")
    assert job.save(done, folder) == 1
    tables = job.reopen(spark, folder)
    assert job.fields_of(tables, 1).where("name = 'price'").count() == 6
    last, failed = job.latest_failed(tables)
    assert last == 1 and {r["source_id"] for r in failed.collect()} == {3, 4}
    whole = archive.where("url <> 'http://gone.example.com/'").unionByName(spark.createDataFrame([("http://gone.example.com/", listing(3, True), 200), ("http://absent.example.com/", listing(2, True), 200)], archive.schema))
    again = job.retry(whole, folder)
    assert {r["status"] for r in again.sources.collect()} == {"done"} and again.records.count() == 4
    stored = job.reopen(spark, folder)
    assert job.latest(stored) == 2 and [tuple(r) for r in job.counts(stored).orderBy("job_id").collect()] == [(1, 5, 6, 6, 4), (2, 2, 2, 4, 0)]
    job.put_meta(spark, folder, "note", "a")
    job.put_meta(spark, folder, "note", "b")
    assert [tuple(r) for r in job.get_meta(spark, folder).collect()] == [("note", "b")]
    assert sorted(r["job_id"] for r in job.reopen(spark, folder)["jobs"].collect()) == [1, 2] and job.retry(whole, folder) is None
    assert job.reopen(spark, str(tmp_path / "none")) == {} and job.retry(whole, str(tmp_path / "none")) is None


@pytest.mark.parametrize(("plan", "records", "pages"), [
    ({"max_pages": 2, "max_items": 1}, 2, 2), ({"paginate": False}, 2, 1), ({"next_selector": "a.none", "url_template": SITE + "/list?page={page}"}, 6, 3),
])
def test_ways(spark, archive, plan, records, pages):
    done = job.run(archive, start(spark, f"{SITE}/list?page=1"), job.Plan(**plan))
    assert (done.records.count(), done.pages.count()) == (records, pages)


def test_scopes_of_duplicates(spark, archive):
    sources = start(spark, f"{SITE}/list?page=2", f"{SITE}/list?page=2", f"{SITE}/list?page=1")
    n = lambda **kw: job.run(archive, sources, job.Plan(**kw)).records.count()
    assert (n(scope="source"), n(keys=("price",))) == (14, 6)


def test_follow(spark, archive):
    done = job.run(archive, start(spark, f"{SITE}/list?page=1"), job.Plan(follow=True, max_pages=1))
    rows = [{k: f["value"] for k, f in r["fields"].items()} for r in done.records.orderBy("record_ix").collect()]
    assert [(r["title"], r["sku"], r["brand"], r["url"]) for r in rows] == [(ITEMS[i - 1][0], f"SKU-{i}", f"Acme {i}", f"{SITE}/p/{i}") for i in (1, 2)]
    one = job.run(archive, start(spark, f"{SITE}/list?page=1"), job.Plan(follow=True, follow_pages=1, max_pages=1))
    assert sum("sku" in r["fields"] for r in one.records.collect()) == 1


def test_one_thing_of_a_page(spark):
    pages = spark.createDataFrame([(1, f"{SITE}/p/1", detail(1)), (2, "u", None), (3, "u", "<p>")], "page_id long, url string, html string")
    found = {r["page_id"]: {k: f["value"] for k, f in r["fields"].items()} for r in extract_one(pages, Options(fields={"kind": {"value": "thing"}})).collect()}
    assert found[1] | {"url": 0} == {"title": "Product number 1 - Shop", "sku": "SKU-1", "brand": "Acme 1", "weight": "1 kg", "kind": "thing", "url": 0}


def test_page_parts(spark):
    html = '<html><head><title>T</title><style>x{}</style></head><body><p>one <b>two</b> three</p><a href="/a" rel="nofollow" title=" t  t ">A  a</a><a href="#x">no</a><img src="/i.png" alt="I" width="10.5" height=x><img data-src="/j.png"><img></body></html>'
    pages = spark.createDataFrame([(1, "http://h/p/", html)], "page_id long, url string, html string")
    nodes = nodes_of(pages)
    assert [tuple(r) for r in page_links(nodes).collect()] == [(1, 1, "http://h/a", "A a", "nofollow", "t t")]
    assert [tuple(r) for r in page_images(nodes).orderBy("n").collect()] == [(1, 1, "http://h/i.png", "I", "", 10, None), (1, 2, "http://h/j.png", "", "", None, None)]
    assert visible_text(nodes).first()["text"] == "T one two three A a no"
    whole = hydrate(pages.unionByName(spark.createDataFrame([(2, "u", None)], pages.schema)), nodes).orderBy("page_id").collect()
    assert (whole[0]["title"], len(whole[0]["links"]), [i["url"] for i in whole[0]["images"]]) == ("T", 1, ["http://h/i.png", "http://h/j.png"]) and (whole[1]["links"], whole[1]["text"]) == ([], "")


def test_codes_and_waits(spark):
    assert [jobs.code_of(e) for e in (TimeoutError(), FileNotFoundError(), KeyError(), sinks.ExportError())] == ["NAVIGATION_TIMEOUT", "SOURCE_ERROR", "UNKNOWN", "EXPORT_ERROR"]
    assert set(jobs.RETRYABLE) | set(jobs.TERMINAL) < set(jobs.CODES) and not set(jobs.RETRYABLE) & set(jobs.TERMINAL)
    k = F.col("id")
    waits = spark.range(1, 5).select(jobs.backoff(k).alias("w"), jobs.backoff(k, jitter=0.25, key=k).alias("j")).collect()
    assert [r["w"] for r in waits] == [1, 2, 4, 8] and all(0.75 * r["w"] <= r["j"] <= 1.25 * r["w"] and r["j"] != r["w"] for r in waits)


def test_large_and_deep_pages(spark):
    """Siblings by the ten thousand, cells and items thousands of elements deep."""
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    html = ["<ul>" + "<li>a" * 60_000 + "</ul>", f"<table><tr><td>{deep}<td>1<tr><td>a<td>b</table>", f'<div itemscope itemtype="http://schema.org/Product"><span itemprop=name>N</span>{deep}</div>', "<div itemscope itemprop=a>" * 3000]
    pages = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(4)
    nodes, cells, blocks = parts_of(pages)
    assert nodes.where("page_id = 0 and tag = 'li'").agg({"nth_of_type": "max"}).first()[0] == 60_000
    assert sorted(r["text"] for r in cells.collect()) == ["1", "a", "b", "x"] and blocks.where("page_id = 2").count() == 1


def test_robots():
    rules = "User-agent: *\nDisallow: /private\nCrawl-delay: 4"
    assert load.allowed(rules, "http://h/a") and not load.allowed(rules, "http://h/private/x") and load.allowed(None, "http://h/") and load.crawl_delay(rules) == 4 and load.crawl_delay("") == 0
