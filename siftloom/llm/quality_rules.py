"""Quality rules of documents and hosts, in DataFrame functions only.

Four rules look at a document: too few words, too many words in repeated windows (these two fail it by themselves), too many
symbols for its characters, too many lines that repeat. Each rule's failures are aggregated by host (the ``source`` of a document). For
each rule a beta prior is fitted to all hosts' rates by moments; a host's posterior is its counts with that prior, so a host with few documents is
judged mostly by what hosts are like. Its verdict on a rule comes from the lower tail of the posterior, the bound that the rate exceeds with
95 %: above ``SUSPECT`` failures of that rule recur at the host, and its documents that fail the rule go; above ``REJECT``, and above the prior's mean by
its deviation, the host itself is bad and all of its documents go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, WORD, table, write_shared

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: Percent of a document's word characters that may be symbols, and of its lines that may repeat.
MAX_SYMBOL_PERCENT, MAX_LINE_PERCENT = 5, 30
SUSPECT, REJECT, TAIL, LEAST_STRENGTH, MOST_STRENGTH = 0.05, 0.3, 1.645, 1.0, 10_000.0
SYMBOLS = "#*$%&|<>"
RULES = ("words", "repeats", "symbols", "lines")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words of an array that lie in windows of WINDOW words found twice or more.

    Windows are compared by 64-bit hash. Most documents repeat none and cost one hash set; else the windows are
    sorted with their places, and what the repeated ones cover is summed in order of place.
    """

    def covered(hashes: Column) -> Column:
        tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            m = F.size(s)
            again = lambda j: ((j > 0) & (F.get(s, j - 1)["h"] == F.get(s, j)["h"])) | ((j < m - 1) & (F.get(s, j + 1)["h"] == F.get(s, j)["h"]))
            places = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), m - 1), again), lambda j: F.get(s, j)["i"]))
            steps = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(WINDOW), lambda acc, j: acc + F.least(F.lit(WINDOW), F.get(p, j) - F.get(p, j - 1)))
            return let(places, steps)

        return let(tagged, count)

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return F.when(F.size(w) < WINDOW, 0).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))

    return let(words, of).cast("long")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def statistics(text: Column) -> Column:
    """A struct of a text's ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``; null is an empty text."""
    text = F.coalesce(text, F.lit(""))
    without = lambda t, chars: F.translate(t, chars, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(without(x, SPACES)) > 0)
    words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("again")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))
    chars = F.length(without(text, SPACES)).cast("long")
    symbols = (F.length(text) - F.length(without(text, SYMBOLS))).cast("long")
    return let(F.struct(words.alias("w"), of_lines.alias("l")), lambda x: F.struct(
        x["w"]["n"].alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), x["l"]["n"].alias("n_lines"), x["l"]["again"].alias("n_dup_lines"), x["w"]["again"].alias("n_repeat_words"),
    ))


def failures(s: Column) -> Column:
    """A struct of RULES, true where the statistics fail."""
    return F.struct(
        (s["n_words"] < MIN_WORDS).alias("words"), (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"]).alias("repeats"),
        (100 * s["n_symbols"] > MAX_SYMBOL_PERCENT * s["word_chars"]).alias("symbols"), (100 * s["n_dup_lines"] > MAX_LINE_PERCENT * s["n_lines"]).alias("lines"),
    )


def base_failed(failed: Column) -> Column:
    return failed["words"] | failed["repeats"]


def host_verdicts(checked: DataFrame) -> DataFrame:
    """``(host, n, <rule>_rate, <rule>_low, suspect_<rule>, rejected)`` of each host from ``(host, failed)``; a null host is one.

    The rate is the posterior's mean, low the bound of its tail. No rows give no hosts.
    """
    counts = [F.sum(F.col(f"failed.{r}").cast("long")).alias(r) for r in RULES]
    hosts = write_shared(checked.groupBy("host").agg(F.count("*").alias("n"), *counts), "hosts")
    total = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), *[F.sum(r).alias(r) for r in RULES]).first()
    n, out, bad = total["n"] or 1, {}, F.lit(False)
    mean = {r: (total[r] or 0) / n for r in RULES}
    spread = hosts.agg(*[(F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - mean[r], 2)) / n).alias(r) for r in RULES]).first()
    for r in RULES:
        chance = mean[r] * (1 - mean[r])
        between = (spread[r] or 0.0) - chance * total["hosts"] / n  # without what chance alone gives
        strength = min(MOST_STRENGTH, max(LEAST_STRENGTH, chance / between - 1)) if between > 0 else MOST_STRENGTH
        rate = (F.col(r) + mean[r] * strength) / (F.col("n") + strength)
        low = rate - TAIL * F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1))
        limit = max(REJECT, mean[r] + (chance / (strength + 1)) ** 0.5)
        out |= {f"{r}_rate": rate, f"{r}_low": low, f"suspect_{r}": low > SUSPECT}
        bad = bad | (low > limit)
    return hosts.select("host", "n", *[v.alias(k) for k, v in out.items()], bad.alias("rejected"))


def judged(checked: DataFrame) -> DataFrame:
    """``checked``, which has ``host`` and ``failed``, with ``kept``. Hosts are few beside documents; the join is by host, and AQE splits hot ones."""
    verdicts = host_verdicts(checked).where("rejected or suspect_symbols or suspect_lines").select(F.col("host").alias("_host"), "rejected", "suspect_symbols", "suspect_lines")
    said = lambda c: F.coalesce(F.col(c), F.lit(False))
    bad = base_failed(F.col("failed")) | said("rejected") | (F.col("failed.symbols") & said("suspect_symbols")) | (F.col("failed.lines") & said("suspect_lines"))
    out = checked.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left")
    return out.withColumn("kept", ~bad).drop("_host", "rejected", "suspect_symbols", "suspect_lines")


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id, source``, statistics, ``base_failed, kept`` of each row: kept if neither its own words nor its host's verdicts fail it.

    Null texts are empty: no words, so they fail. A null source is a host, a null doc_id is kept as it is. Repeated rows are judged each and count for
    their host each. No rows give no rows; further columns are ignored.
    """
    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), statistics(F.col("text")).alias("s"))
    checked = write_shared(stats.withColumn("failed", failures(F.col("s"))), "statistics")
    return judged(checked).select("doc_id", F.col("host").alias("source"), "s.*", base_failed(F.col("failed")).alias("base_failed"), "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, nulls and repeated rows as there; their columns as they are.

    The rows are written beside their failures once, so the texts are neither split again nor shuffled unless a host's rows outgrow a broadcast.
    """
    # As one struct, the columns of docs clash with no other.
    rows = docs.select(F.struct("*").alias("doc"), F.col("source").cast("string").alias("host"), let(statistics(F.col("text")), failures).alias("failed"))
    return judged(write_shared(rows, "checked", "zstd")).where("kept").select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
windows AS (SELECT r, i, words[i:i + 2] AS w FROM split, unnest(range(1, len(words) - 1)) AS u(i)),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, unnest([0, 1, 2]) AS u(k) WHERE n > 1 GROUP BY r),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM texts, unnest(string_split(text, chr(10))) AS u(line)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
stats AS (
  SELECT doc_id, source, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered c USING (r) LEFT JOIN lines l USING (r)),
checked AS (SELECT *, n_words < 50 AS words, 100 * n_repeat_words > 50 * n_words AS repeats, 100 * n_symbols > 5 * word_chars AS symbols, 100 * n_dup_lines > 30 * n_lines AS lines FROM stats),
failed AS (SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE bad) AS k
  FROM (SELECT source, unnest(['words', 'repeats', 'symbols', 'lines']) AS rule, unnest([words, repeats, symbols, lines]) AS bad FROM checked) GROUP BY ALL),
totals AS (SELECT rule, sum(k) / sum(n) AS mean, sum(n) AS n, count(*) AS hosts FROM failed GROUP BY rule),
spread AS (SELECT rule, any_value(mean) AS mean, sum(f.n * pow(f.k / f.n - mean, 2)) / any_value(t.n) - any_value(mean * (1 - mean) * hosts / t.n) AS between_hosts
  FROM failed f JOIN totals t USING (rule) GROUP BY rule),
prior AS (SELECT rule, mean, CASE WHEN between_hosts > 0 THEN least(10000.0, greatest(1.0, mean * (1 - mean) / between_hosts - 1)) ELSE 10000.0 END AS strength FROM spread),
posterior AS (SELECT source, rule, n, mean, strength, (k + mean * strength) / (n + strength) AS rate FROM failed JOIN prior USING (rule)),
tails AS (SELECT source, rule, rate - 1.645 * sqrt(rate * (1 - rate) / (n + strength + 1)) AS low, greatest(0.3, mean + sqrt(mean * (1 - mean) / (strength + 1))) AS most FROM posterior),
verdicts AS (SELECT source, bool_or(low > most) AS rejected, bool_or(rule = 'symbols' AND low > 0.05) AS bad_symbols, bool_or(rule = 'lines' AND low > 0.05) AS bad_lines FROM tails GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words OR repeats AS base_failed,
  NOT (words OR repeats OR rejected OR (symbols AND bad_symbols) OR (lines AND bad_lines)) AS kept
FROM checked c JOIN verdicts v ON c.source IS NOT DISTINCT FROM v.source
"""
