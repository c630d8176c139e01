"""URL functions. Joining a reference to its base needs the standard's algorithm and runs in Arrow batches; the rest is columns."""

from __future__ import annotations

from urllib.parse import urldefrag, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon as L
from .normalize import col, let

PATH_PAGE = r"(?i)(/(?:page|seite|pagina|p)/)(\d+)(/?)$"


def join_one(base: str | None, ref: str | None) -> str:
    """The reference made absolute, without fragment; empty for what is no page."""
    ref = (ref or "").strip()
    if not ref or ref.startswith("#") or ref.lower().startswith(("javascript:", "mailto:", "tel:")):
        return ""
    try:
        return urldefrag(urljoin(base or "", ref)).url
    except ValueError:
        return ""


def web_url(base: str | None, ref: str | None) -> str:
    """As ``join_one``, with the fragment kept and other schemes refused."""
    try:
        url = urljoin(base or "", (ref or "").strip())
        return url if urlparse(url).scheme in ("http", "https", "file") else ""
    except ValueError:
        return ""


@F.pandas_udf(StringType())
def url_join(base: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([join_one(b, r) for b, r in zip(base, ref)], dtype=object)


@F.pandas_udf(StringType())
def normalize_url(ref: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([web_url(b, r) for b, r in zip(base, ref)], dtype=object)


def looks_like_url(x: Column | str) -> Column:
    return F.trim(col(x)).rlike(r"(?i)^(https?://[^/?#\s]+|file://\S+)")


def normalize_source_url(x: Column | str) -> Column:
    """A source's address: https unless it says otherwise, no fragment, a path at least; null for other schemes and for nothing."""
    text = F.trim(col(x))
    has = text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(//|[^0-9])")
    full = F.regexp_replace(F.when(has, text).otherwise(F.concat(F.lit("https://"), text)), "#.*$", "")
    scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    path = F.regexp_replace(full, r"^(https?://[^/?#]+)(?=$|\?)", "$1/")
    web = scheme.isin("http", "https") & full.rlike(r"(?i)^https?://[^/?#\s]+")
    return F.when(web, path).when((scheme == "file") & full.rlike(r"^file://\S"), full)


def query_value(url: Column, key: str) -> Column:
    """Value of a query parameter, null without it."""
    return F.when(url.rlike(rf"^[^#]*\?(?:[^#]*&)?{key}="), F.regexp_extract(url, rf"^[^#?]*\?(?:[^#]*&)?{key}=([^&#]*)", 1))


def next_url_by_pattern(x: Column | str) -> Column:
    """The address with its page number raised: the first of the known parameters that is a number, else a page path; else null."""

    def read(url: Column) -> Column:
        place = F.regexp_extract(url, r"^[^?#]*", 0)
        piece = lambda i: F.regexp_extract(place, PATH_PAGE, i)
        out = F.when(place.rlike(PATH_PAGE), F.concat(F.regexp_replace(place, PATH_PAGE, "$1"), (piece(2).cast("bigint") + 1).cast("string"), piece(3), F.regexp_extract(url, r"[?#].*$", 0)))
        for key in reversed(L.PAGE_PARAMS):
            number = rf"^([^#?]*\?(?:[^#]*&)?{key}=)(\d{{1,15}})(?=[&#]|$)(.*)$"
            raw = F.regexp_extract(url, number, 2).cast("bigint")
            step = F.when(raw > 0, raw).otherwise(F.lit(1)) if key in L.STEP_PARAMS else F.lit(1)
            bumped = F.concat(F.regexp_extract(url, number, 1), (raw + step).cast("string"), F.regexp_extract(url, number, 3))
            out = F.when(url.rlike(number), bumped).otherwise(out)
        return out

    return let(col(x), read)


def current_page_number(x: Column | str) -> Column:
    url = col(x)
    params = [F.when(query_value(url, k).rlike(r"^\d{1,9}$"), query_value(url, k)).cast("int") for k in ("page", "p", "pg", "pagina", "seite")]
    path = F.nullif(F.regexp_extract(F.regexp_extract(url, r"^[^?#]*", 0), PATH_PAGE, 2), F.lit("")).cast("int")
    return F.coalesce(*params, path)
