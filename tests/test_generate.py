"""Job files from pages, their reading, and collecting pages wave by wave with a stand-in for HTTP."""

import json

import pytest
from pyspark.sql import functions as F

from siftloom import cli
from siftloom.config import Config
from siftloom.plans import generate, job
from siftloom.plans.collect import collect
from siftloom.sources.load import jsonc

from test_job import ITEMS, SITE, detail, listing


def page(spark, html):
    return spark.createDataFrame([(1, f"{SITE}/list?page=1", html)], "page_id long, url string, html string")


SHOP = "<html><body><div class=grid>" + "".join(f'<div class="card-x"><a href="/p/{i}">Thing number {i}</a><span class="entry-capital">City {i}</span><span class="entry-area">{i * 7} km</span><em>Add to basket</em></div>' for i in range(8)) + "</div></body></html>"


def test_job_file(spark):
    found = generate.report(spark, page(spark, SHOP))
    ids = {c["selector"]: c["id"] for c in found["columns"]}
    capital, area = ids["span.entry-capital"], ids["span.entry-area"]
    assert found["collection"]["records"] == 8 and capital in generate.question(found, "city") and "city" in generate.question(found, "city")
    answer = 'Sure:\n```json\n' + json.dumps({"collection": "g1", "fields": [{"name": "City name", "column": capital, "why": "a\ncity"}, {"name": "9", "column": area}, {"name": "city_name", "column": area}, {"name": "other", "column": "c99"}], "drop": [area, "c98"], "notes": "n"}) + "\n``` done"
    text, verdict = generate.generate(spark, page(spark, SHOP), answer, "city", found=found)
    assert {(r["field"], r["reason"]) for r in verdict.collect()} == {("City name", None), ("9", "not a usable field name"), ("city_name", "duplicate name"), ("other", "no such column")}
    read = Config.model_validate(jsonc(text))
    assert list(read.extraction.fields) == ["city_name"] and read.extraction.collection == found["collection"]["selector"] and "// a city" in text and f"Ignored {area}" in text
    plain, none = generate.generate(spark, page(spark, SHOP), "no json here", found=found)
    assert none is None and "no JSON object" in plain and all(s.mode == "auto" for s in Config.model_validate(jsonc(plain)).extraction.fields.values())


@pytest.mark.parametrize(("text", "fields"), [
    ('{"title": "c4", "x": "words"}', (("title", "c4", ""),)), ('{"title": {"column_id": "c1"}}', (("title", "c1", ""),)), ('{"fields": [{"name": "a", "column": "c2", "why": null}, {"name": 3}]}', (("a", "c2", ""),)), ('a {b} {"k": "g1"}', (("k", "g1", ""),)),
])
def test_answers(text, fields):
    assert generate.read_proposal(text).fields == fields


def test_waves(spark):
    site = {f"{SITE}/list?page={n}": listing(n, n == 3) for n in (1, 2, 3)} | {f"{SITE}/p/{i}": detail(i) for i in range(1, len(ITEMS) + 1)}
    archive = spark.createDataFrame(list(site.items()), "url string, html string")
    asked = []

    def fetch(wave):
        asked.append(sorted(r["url"] for r in wave.collect()))
        return wave.join(archive, "url", "left").select("url", "html", F.when(F.col("html").isNull(), 404).otherwise(200).alias("status"), F.when(F.col("html").isNull(), "HTTP_ERROR").alias("error"))

    sources = spark.createDataFrame([(1, f"{SITE}/list?page=1"), (2, "http://gone.example.com/"), (3, None)], "source_id long, url string")
    plan = job.Plan(follow=True, follow_pages=4)
    got = collect(sources, plan, fetch)
    assert [len(a) for a in asked] == [2, 1, 1, 4] and got.count() == 8
    done = job.run(got, sources, plan)
    assert done.records.count() == 6 and {r["error"] for r in done.sources.collect()} == {None, "HTTP_ERROR"}


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    rows = [(n, f"{SITE}/list?page={n}", listing(n, n == 3)) for n in (1, 2, 3)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "site.parquet"))
    conf = tmp_path / "job.jsonc"
    conf.write_text(f'{{"sources": {{"url": "{SITE}/list?page=1", "archive": "{tmp_path}/site.parquet"}}, // all\n "extraction": {{"fields": {{"name": {{"field": "title"}}, "price": {{"mode": "auto", "type": "integer", "required": true}}}}}}, "db": "{tmp_path}/store", }}')
    assert cli.main(["scrape", "--config", str(conf), "-o", str(tmp_path / "out.jsonl")]) == 0
    got = [json.loads(x) for x in (tmp_path / "out.jsonl").read_text().splitlines()]
    assert sorted(g["name"] for g in got) == [t for t, _ in ITEMS] and all(isinstance(g["price"], int) for g in got)
    assert cli.main(["retry", str(tmp_path / "store"), "--config", str(conf)]) == 0
    assert cli.main(["generate", str(tmp_path / "site.parquet"), "-o", str(tmp_path / "made.jsonc")]) == 0 and "title" in jsonc((tmp_path / "made.jsonc").read_text())["extraction"]["fields"]


def test_specs():
    c = Config.model_validate({"extraction": {"fields": {"a": "auto", "b": "h2", "c": {"regex": "x(.)"}, "d": {"value": True}, "e": {"field": "title", "type": "string"}, "f": {"selector": "a", "attribute": "href", "required": True}}}})
    o = c.options()
    assert o.fields == {"b": {"selector": "h2"}, "c": {"regex": "x(.)"}, "d": {"value": "true"}, "f": {"selector": "a", "attribute": "href"}} and o.renames == {"title": "e"} and o.required == ["f"] and o.types == {"e": "string"}
    for bad in ({"mode": "attribute", "selector": "a"}, {"mode": "regex"}, {"mode": "field"}):
        with pytest.raises(ValueError):
            Config.model_validate({"extraction": {"fields": {"x": bad}}})
    for bad in ({"acquirer": "browser"}, {"sources": {"type": "file"}}, {"pagination": {"max_pages": 0}}, {"browser": {"block_resources": ["nonsense"]}}):
        with pytest.raises(ValueError):
            Config.model_validate(bad)
