"""Normalisation as column expressions: nothing here runs Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

#: Spaces that text may hold besides the plain one.
ODD_SPACES = "       "
ISO_DATE = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(?:\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?$"
#: Date formats after ISO, with the shape of the texts they read; month names are English.
DATE_FORMATS = (
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"), ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"), ("M.d.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("MMM d yyyy", r"^[A-Z][a-z]{2} \d{1,2} \d{4}$"), ("MMMM d yyyy", r"^[A-Z][a-z]{3,} \d{1,2} \d{4}$"), ("d MMM yyyy", r"^\d{1,2} [A-Z][a-z]{2} \d{4}$"), ("d MMMM yyyy", r"^\d{1,2} [A-Z][a-z]{3,} \d{4}$"),
    ("MMM yyyy", r"^[A-Z][a-z]{2} \d{4}$"), ("MMMM yyyy", r"^[A-Z][a-z]{3,} \d{4}$"), ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"), ("yyyy.M.d", r"^\d{4}\.\d{1,2}\.\d{1,2}$"),
)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once and named: what a body mentions often is not written out as often."""
    return F.transform(F.array(value), body)[0]


def normalize_text(x: Column | str) -> Column:
    """Odd spaces to plain ones, runs of white space to one space, trimmed; null to empty.

    Composed and decomposed letters are left as they are: Spark has no normalisation form.
    """
    plain = F.translate(F.coalesce(col(x), F.lit("")), ODD_SPACES, " " * len(ODD_SPACES))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def parse_number(x: Column | str) -> Column:
    """The first number of a text as a double, whichever way it is punctuated; null if there is none.

    Of two kinds of separators the last is the decimal one. One kind that occurs again groups digits, and so does a single one with three
    digits after it and three at most before. Spaces group.
    """
    raw = F.regexp_extract(F.replace(normalize_text(x), F.lit("'"), F.lit("")), r"[-+]?\d[\d\s.,]*\d|\d", 0)

    def read(raw: Column) -> Column:
        sign = F.when(raw.startswith("-"), -1.0).otherwise(1.0)
        return F.when(raw != "", sign * let(F.regexp_replace(raw, r"^[+-]+", ""), digits).try_cast("double"))

    def digits(d: Column) -> Column:
        kinds = d.contains(".").cast("int") + d.contains(",").cast("int") + d.contains(" ").cast("int")
        bare = F.translate(d, "., ", "")
        mixed = (
            F.when(d.rlike(r"\.[^., ]*$"), F.translate(d, ", ", "")).when(d.rlike(r",[^., ]*$"), F.translate(F.translate(d, ". ", ""), ",", "."))
            .otherwise(F.translate(F.translate(d, ".,", ""), " ", "."))
        )
        groups = d.rlike(r" |[.,].*[.,]|^\d{1,3}[.,]\d{3}$")
        return F.when(kinds == 0, d).when(kinds > 1, mixed).when(groups, bare).otherwise(F.translate(d, ",", "."))

    return let(raw, read)


def parse_currency(x: Column | str) -> Column:
    """ISO code: one that stands as a word, else that of the longest symbol found."""

    def read(text: Column) -> Column:
        code = F.nullif(F.regexp_extract(F.upper(text), rf"\b({'|'.join(L.CURRENCY_CODES)})\b", 1), F.lit(""))
        longest = sorted(L.CURRENCY_SYMBOLS, key=lambda s: (-len(s), s))
        return F.coalesce(code, *[F.when(text.contains(s), L.CURRENCY_SYMBOLS[s]) for s in longest])

    return let(normalize_text(x), read)


def parse_boolean(x: Column | str) -> Column:
    return let(F.lower(normalize_text(x)), lambda word: F.when(word.isin(*L.TRUE_WORDS), True).when(word.isin(*L.FALSE_WORDS), False))


def parse_date(x: Column | str) -> Column:
    """ISO-8601 text of a date, or null.

    A fixed list of formats, month first where both would do; what a text lacks is the first day, never today's. ISO texts keep their time
    and zone. Texts over 64 characters or with fewer than four digits are no dates.
    """

    def iso(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, ISO_DATE, i)
        time = F.when(part(2) == "", "00:00:00").otherwise(F.concat(part(2), F.when(part(3) != "", part(3)).otherwise(":00")))
        zone = F.when(part(4) == "Z", "+00:00").otherwise(part(4))
        return F.when(F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd")).isNotNull(), F.concat(part(1), F.lit("T"), time, zone))

    def other(words: Column) -> Column:
        # Each shape of a date is tried by the formats of its shape alone.
        tried = [F.when(words.rlike(shape), F.try_to_timestamp(words, F.lit(f))) for f, shape in DATE_FORMATS]
        return F.date_format(F.coalesce(*tried), "yyyy-MM-dd'T'HH:mm:ss")

    def read(text: Column) -> Column:
        words = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i),|(?<=[a-z])\.", " "), r"\s+", " ")))
        words = F.regexp_replace(words, r"\bSept\b", "Sep")
        unlike = (F.length(text) > 64) | ~text.rlike(r"\d.*\d.*\d.*\d")
        return F.when(unlike, None).when(text.rlike(ISO_DATE), iso(text)).otherwise(let(words, other))

    return let(normalize_text(x), read)


def normalize_enum(x: Column | str) -> Column:
    """``https://schema.org/InStock`` to ``in stock``; other texts as they are."""
    name = F.regexp_extract(F.trim(col(x)), r"(?i)^https?://schema\.org/(\w+)$", 1)
    return F.when(name != "", F.lower(F.regexp_replace(name, r"(?<=[a-z])(?=[A-Z])", " "))).otherwise(col(x))


def infer_type(x: Column | str) -> Column:
    """Type of a text value."""
    return F.when(col(x).isNull(), "null").when(col(x).rlike(r"^https?://"), "url").otherwise("string")


def coerce(x: Column | str, target: Column | str) -> Column:
    """Struct ``(value, type)``: the text in the target type's form if it has one, else as it is, a string."""
    target = target if isinstance(target, Column) else F.lit(target)

    def read(x: Column) -> Column:
        value = (
            F.when(target == "number", parse_number(x).cast("string")).when(target == "integer", parse_number(x).cast("bigint").cast("string")).when(target == "boolean", parse_boolean(x).cast("string"))
            .when(target == "url", F.when(x.rlike(r"(?i)^(https?|file)://"), x)).when(target.isin("date", "datetime"), parse_date(x)).otherwise(normalize_text(x))
        )
        return let(value, lambda v: F.struct(F.coalesce(v, x).alias("value"), F.when(x.isNull(), "null").when(v.isNull(), "string").otherwise(target).alias("type")))

    return let(col(x), read)


def squash(x: Column | str) -> Column:
    """Lower-case letters and digits only."""
    return F.lower(F.regexp_replace(col(x), r"(?U)[^\p{L}\p{N}]", ""))


def tokens_of(x: Column | str) -> Column:
    """Runs of letters and digits, lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower)


def lookup(words: dict[str, str], x: Column) -> Column:
    """Value of a fixed map, written as one literal: a column for each of its words would cost a call each."""
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.element_at(F.expr(f"map({', '.join(quoted(v) for kv in sorted(words.items()) for v in kv)})"), x)


def content_hash(html: Column | str) -> Column:
    return F.sha2(col(html), 256)


def identity(fields: Column | str) -> Column:
    """Digest of a map of fields, whatever their order."""
    entries = F.array_sort(F.map_entries(col(fields)))
    return F.sha2(F.to_json(F.map_from_entries(entries)), 256)


def host_of(url: Column | str) -> Column:
    """Authority of a URL, lower case, or ``-``."""
    host = F.lower(F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.when(host == "", "-").otherwise(host)


def slug(x: Column | str) -> Column:
    """A field name: separators to ``_``; null if anything else is left."""
    name = F.lower(F.regexp_replace(F.trim(col(x)), r"[\s./-]+", "_"))
    return F.when(name.rlike(r"^[a-z][a-z0-9_]*$"), name)
