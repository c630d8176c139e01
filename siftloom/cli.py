"""Command line: ``scrape`` pages to records, ``inspect`` what a page holds, ``generate`` a job file, ``retry`` what failed."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as settings
from .operators import collections, records, scoring, structured
from .plans import generate, job, sinks
from .plans.collect import collect
from .plans.extract import extract_parts, page_titles, parts_of, process
from .operators.navigation import next_pages
from .sources import load


def acquirer(target: str | None, c: settings.Config) -> str:
    """What reads a target: an ``archive`` table, saved ``file`` pages, or ``http``."""
    if target and target.rstrip("/").endswith(".parquet"):
        return "archive"
    if c.acquirer == "file" or (target and (target.lower().endswith((".html", ".htm")) or target.startswith("file:"))):
        return "file"
    return "http" if not c.sources.archive else "archive"


def sources_of(spark: SparkSession, target: str | None, c: settings.Config) -> DataFrame:
    """``source_id, url``: a target before the configured sources; of those, an address, addresses, a file of them, standard input."""
    s = c.sources
    if target and load.urlparse(target).scheme in ("http", "https"):
        return load.addresses(spark, [target])
    if target == "-" or (not target and s.type == "stdin"):
        return load.address_stdin(spark)
    if target or (s.type == "file" and s.path):
        return load.address_file(spark, target or str(s.path))
    return load.addresses(spark, [*([s.url] if s.url else []), *s.urls])


def archive_of(spark: SparkSession, target: str | None, c: settings.Config, sources: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The archive that a job runs on, and the hosts' robots files if they were asked for."""
    if sources is None or c.sources.archive:
        return spark.read.parquet(target if sources is None else c.sources.archive), None
    robots = load.fetch_robots(sources) if c.politeness.respect_robots else None
    delay = c.politeness.delay_s

    def fetch(wave: DataFrame) -> DataFrame:
        waits = load.crawl_delays(robots) if robots is not None and c.politeness.obey_crawl_delay else None
        return load.fetch_all(wave, delay, attempts=c.retry.attempts, base_s=c.retry.base_delay_s, most_s=c.retry.max_delay_s, jitter=c.retry.jitter, delays=waits)

    return collect(sources, c.plan(), fetch, robots), robots


def scrape(spark: SparkSession, target: str | None, c: settings.Config) -> int:
    kind = acquirer(target, c)
    if kind == "file" or (kind == "archive" and not c.sources.archive):
        pages = load.saved_pages(spark, target) if kind == "file" else spark.read.parquet(target)
        found, problems = process(pages.select("page_id", "url", "html"), c.options())
        if c.dedupe.enabled:
            found = records.dedupe(found, c.dedupe.keys or None, () if c.dedupe.scope == "job" else ("page_id",))
        told = f"{problems.count()} left out"
    else:
        sources = sources_of(spark, target, c)
        archive, robots = archive_of(spark, target, c, sources)
        done = job.run(archive, sources, c.plan(), robots)
        if c.db:
            job.save(done, str(c.db), c.model_dump_json(exclude_defaults=True), c.name or "job")
        found, s = done.records, done.summary().first()
        told = f"{s['sources']} sources, {s['failed']} failed, {s['pages']} pages, {s['left_out']} left out" + "".join(f", {k}: {n}" for k, n in (s["errors"] or {}).items())
    o = c.output
    more = {"json": {"pretty": o.pretty, "provenance": o.provenance}, "jsonl": {"provenance": o.provenance}, "csv": {"columns": o.columns or None, "delimiter": o.csv_delimiter}}
    n = sinks.export(found, o.path, o.kind, **more.get(o.kind or "", {}))
    print(f"{n} records; {told}", file=sys.stderr)
    return 0


def pages_of(spark: SparkSession, target: str, c: settings.Config) -> DataFrame:
    """The pages of one target, for a look at them."""
    kind = acquirer(target, c)
    if kind == "archive":
        return spark.read.parquet(target).select("page_id", "url", "html")
    if kind == "file":
        return load.saved_pages(spark, target).select("page_id", "url", "html")
    return load.fetch_all(load.addresses(spark, [target]), attempts=c.retry.attempts).where("error is null").select("page_id", "url", "html")


def inspect(spark: SparkSession, target: str, c: settings.Config, schema: bool, field: str | None) -> int:
    pages = pages_of(spark, target, c)
    nodes, cells, blocks = parts_of(pages)
    found = extract_parts(pages, nodes, cells, blocks, c.options())
    if schema:
        scoring.schema_of(found).show(100, False)
    elif field:
        scoring.explain(found.where(F.col("name") == field)).show(100, False)
    else:
        page_titles(nodes).show(20, False)
        collections.discover(nodes, c.extraction.min_records, 5).select("page_id", "rank", "selector", "count", "confidence", "label").show(100, False)
        structured.type_counts(blocks).orderBy(F.desc("count")).show(8, False)
        next_pages(nodes, pages).show(20, False)
        scoring.schema_of(found).show(100, False)
        records.assemble(found).select("page_id", "record_ix", sinks.json_column().alias("record")).orderBy("page_id", "record_ix").show(3, False)
    return 0


def make_job_file(spark: SparkSession, target: str, c: settings.Config, out: str | None, want: str | None, answer: str | None, ask: bool) -> int:
    page = pages_of(spark, target, c).orderBy("page_id").limit(1)  # a job file is made from one page
    if ask:
        print(generate.question(generate.report(spark, page, c.options()), want))
        return 0
    text, _ = generate.generate(spark, page, Path(answer).read_text(encoding="utf-8") if answer else None, want, c.options(), c.assist.min_coverage, c.assist.max_fields)
    if out:
        Path(out).write_text(text, encoding="utf-8")
    else:
        print(text, end="")
    return 0


def again(spark: SparkSession, folder: str, c: settings.Config) -> int:
    tables = job.reopen(spark, folder)
    last, failed = job.latest_failed(tables) if tables else (None, None)
    if last is None:
        print("nothing to retry", file=sys.stderr)
        return 0
    archive, robots = archive_of(spark, None, c, failed)
    done = job.retry(archive, folder, c.plan(), robots)
    n = sinks.export(done.records, c.output.path, c.output.kind)
    print(f"{failed.count()} sources of run {last} again, {n} records", file=sys.stderr)
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    known = ("scrape", "inspect", "generate", "retry")
    if argv and argv[0] not in (*known, "-h", "--help"):
        argv.insert(0, "scrape")
    parser = argparse.ArgumentParser(prog="siftloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in known:
        p = commands.add_parser(name)
        p.add_argument("target", nargs="?" if name == "scrape" else None)
        p.add_argument("--config")
        if name != "inspect":
            p.add_argument("-o", "--output")
        if name == "inspect":
            p.add_argument("--schema", action="store_true")
            p.add_argument("--explain", metavar="FIELD")
        if name == "generate":
            p.add_argument("--want", help="the fields that are wanted, in words")
            p.add_argument("--answer", help="a file with the proposal")
            p.add_argument("--ask", action="store_true", help="print what to ask, instead of a job file")
    args = parser.parse_args(argv)
    c = settings.load(args.config) if args.config else settings.Config()
    if args.command in ("scrape", "retry") and args.output:
        c = c.merged({"output": {"path": args.output}})
    spark = SparkSession.builder.appName("siftloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if args.command == "inspect":
        return inspect(spark, args.target, c, args.schema, args.explain)
    if args.command == "generate":
        return make_job_file(spark, args.target, c, args.output, args.want, args.answer, args.ask)
    return again(spark, args.target, c) if args.command == "retry" else scrape(spark, args.target, c)


if __name__ == "__main__":
    sys.exit(main())
