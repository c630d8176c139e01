"""What a review of larger tables found."""

import duckdb

from siftloom.plans import catalogue


def same_as_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got, want = catalogue.QUERIES[name](spark, str(folder)), con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    want = sorted(map(str, want.fetchall()))
    assert want and sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == want


def html_pages(spark, *html):
    return spark.createDataFrame([(i, f"http://a.example.com/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")


CUT = ("<title>one &quot;two&quot; &amp;&amp;&amp</title><p>x", "<title>a &amp;lt; &lt;b&gt; &eacute; & c</title><p>x")


def test_titles_with_other_references(spark, tmp_path):
    same_as_sql(spark, tmp_path, "page_title", pages=html_pages(spark, *CUT))


def test_identities_with_other_references(spark, tmp_path):
    same_as_sql(spark, tmp_path, "page_identities", pages=html_pages(spark, *CUT))


def test_unlikely_collections(spark, tmp_path):
    """Two short paragraphs of unlike content score under the least that a job asks for."""
    menu = "<nav><ul>" + '<li><a href="/some">Some</a></li>' * 4 + "</ul></nav>"
    same_as_sql(spark, tmp_path, "top_collections", pages=html_pages(spark, f"<body>{menu}<article><h1>Zu.</h1><p><b>Heat the to.<br><p>By hentha reshon.</p></article></body>"))


def test_patterns_of_one_field(spark):
    """What is asked for alone is what stands among all, and costs no other field's patterns."""
    from pyspark.sql import functions as F

    from siftloom.functions import patterns as P

    texts = ["4.5 out of 5, $1,200.00, 20% off", "★★★☆ 3 stars in stock 2024-01-02", "SKU: L-12X a@b.com", "12:30", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for field in ("price", "rating", "date", "sku", "email", "availability", "discount", "duration"):
        alone = P.detect("t", field)
        both = df.select(alone.alias("a"), F.filter(P.detect("t"), lambda h: h["field"] == field).alias("b")).collect()
        assert [r["a"] for r in both] == [r["b"] for r in both]
        assert len(str(alone)) < len(str(P.detect("t"))) / 2


def test_blocks_are_sent_on_in_pieces(spark):
    """A batch of many pages of many blocks is not held as Python's rows at once."""
    import pyarrow as pa

    from siftloom.operators import structured

    made = {}

    class Pages:
        def __getattr__(self, name):
            return lambda *a: self

        def mapInArrow(self, run, schema):
            made["run"] = run
            return self

    structured.blocks(Pages())
    html = '<script type="application/ld+json">{"@type": "Product", "name": "n"}</script>' * 50
    batch = pa.RecordBatch.from_pylist([{"page_id": i, "url": "u", "html": html} for i in range(300)])
    sizes = [b.num_rows for b in made["run"](iter([batch]))]
    assert sum(sizes) == 15_000 and max(sizes) <= 4050
