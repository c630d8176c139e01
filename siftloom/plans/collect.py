"""Collecting the pages of a job over HTTP into an archive, wave by wave; the job itself then runs on the archive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import host_of
from ..operators import navigation, records
from ..shared import write_shared
from .extract import parts_of, process_parts
from .job import Plan

#: From addresses ``(source_id, url)`` to pages ``(url, html, status, error)``.
Fetch = Callable[[DataFrame], DataFrame]


def collect(sources: DataFrame, plan: Plan, fetch: Fetch, robots: DataFrame | None = None) -> DataFrame:
    """``(url, html, status, error)`` of all that the sources lead to: a wave for each page of the longest way, one more for details.

    An address is asked for once. Addresses that robots files refuse are not asked for and have their error.
    """
    keep = ["url", "html", "status", "error"]
    spark = sources.sparkSession
    archive = spark.createDataFrame([], "url string, html string, status int, error string")
    wave = sources.where("url is not null").select("source_id", "url").dropDuplicates(["url"])
    found = None
    for _ in range(plan.max_pages if plan.paginate else 1):
        if wave.isEmpty():
            break
        pages = write_shared(asked(wave, fetch, robots, plan).select(*keep), "fetched")
        archive = archive.unionByName(pages)
        fine = pages.where("error is null").withColumn("page_id", F.xxhash64("url"))
        nodes, cells, blocks = parts_of(fine)
        if plan.follow:
            rows = process_parts(fine, nodes, cells, blocks, plan.options)[0].join(fine.select("page_id", F.col("url").alias("page_url")), "page_id")
            found = write_shared(rows if found is None else found.unionByName(rows), "listed")
        ahead = navigation.next_pages(nodes, fine, selector=plan.next_selector, template=plan.url_template)
        wave = write_shared(ahead.select(F.lit(0).cast("long").alias("source_id"), "url").dropDuplicates(["url"]).join(archive.select("url"), "url", "left_anti"), "wave")
    if found is not None:
        address = records.value(plan.follow_field)
        host = (host_of(address) == host_of("page_url")) if plan.same_host else F.lit(True)
        chosen = records.follow_budget(found, plan.follow_pages, host, by=plan.follow_field).join(archive.select("url"), "url", "left_anti")
        details = asked(chosen.select(F.lit(0).cast("long").alias("source_id"), "url"), fetch, robots, plan)
        archive = archive.unionByName(write_shared(details.select(*keep), "fetched"))
    return archive


def asked(wave: DataFrame, fetch: Fetch, robots: DataFrame | None, plan: Plan) -> DataFrame:
    from ..sources.load import robots_filter

    if robots is None or not plan.respect_robots:
        return fetch(wave)
    allowed = write_shared(robots_filter(wave, robots), "allowed")
    barred = wave.join(allowed.select("url"), "url", "left_anti").select("url", F.lit("").alias("html"), F.lit(0).alias("status"), F.lit("ROBOTS_DISALLOWED").alias("error"))
    return fetch(allowed).select("url", "html", "status", "error").unionByName(barred)
