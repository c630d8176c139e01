"""Scalar functions on the cases that matter."""

import pytest
from pyspark.sql import functions as F

from siftloom.functions import normalize as N
from siftloom.functions import patterns as P
from siftloom.functions import urls as U
from siftloom.sources.load import allowed, jsonc


def each(spark, f, cases):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f("v")).collect()]


def test_parse_number(spark):
    cases = {"$1,299.00": 1299, "1 299,00 €": 1299, "1.299,00": 1299, "12.99": 12.99, "12,99": 12.99, "1,299": 1299, "1299": 1299, "-15.5%": -15.5, "4.8/5": 4.8, "none": None, "1, 2, 3": None, "": None, "1'234'567": 1234567}
    assert each(spark, N.parse_number, cases) == list(cases.values())


def test_parse_currency_and_boolean(spark):
    cases = {"$5": "USD", "5 €": "EUR", "£5": "GBP", "10 USD": "USD", "10": None, "R$ 3": "BRL", None: None}
    assert each(spark, N.parse_currency, cases) == list(cases.values())
    cases = {"yes": True, "In Stock": True, "Out of  stock": False, "no": False, "maybe": None, None: None}
    assert each(spark, N.parse_boolean, cases) == list(cases.values())


def test_parse_date(spark):
    cases = {"2026-09-08": "2026-09-08T00:00:00", "Sep 8, 2026": "2026-09-08T00:00:00", "2026-09-08T10:00:00Z": "2026-09-08T10:00:00+00:00", "8 September 2026": "2026-09-08T00:00:00", "yesterday": None, "12": None, "": None, "2026-13-40": None}
    assert each(spark, N.parse_date, cases) == list(cases.values())


def test_detect(spark):
    cases = {"$19.99": "price", "4.5 out of 5": "rating", "★★★☆☆": "rating", "Sep 8, 2026": "date", "3 hours ago": "date", "SKU: AB-1234": "sku", "a@b.co": "email", "Sold out": "availability", "15% off": "discount", "12:30": "duration", "plain words": None, "x" * 500: None}
    assert each(spark, lambda v: F.get(P.detect(v), 0)["field"], cases) == list(cases.values())


def test_urls(spark):
    cases = {"http://a/b?page=2&x=1": "http://a/b?page=3&x=1", "http://a/b?p=9": "http://a/b?p=10", "http://a/page/3/": "http://a/page/4/", "http://a/?offset=20": "http://a/?offset=40", "http://a/x": None}
    assert each(spark, U.next_url_by_pattern, cases) == list(cases.values())
    cases = {"example.com": "https://example.com/", "http://a/b#c": "http://a/b", "ftp://a/": None, "mailto:a@b.c": None, "file:///x.html": "file:///x.html"}
    assert each(spark, U.normalize_source_url, cases) == list(cases.values())
    assert U.join_one("http://a/b/c", "../d#e") == "http://a/d" and U.join_one("http://a/", "javascript:x") == ""


def test_jsonc():
    assert jsonc('{"a": "//no", /* c */ "b": [1, 2,], // d\n}') == {"a": "//no", "b": [1, 2]}
    with pytest.raises(ValueError):
        jsonc("{")


def test_robots():
    assert allowed(None, "http://a/x") and not allowed("User-agent: *\nDisallow: /x", "http://a/x")
