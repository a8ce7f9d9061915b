"""Quality rules per document and per host, in built-in column expressions alone.

Each document gets its counts and fails the base rules on them. Hosts are the documents' sources: failures are added up
by host, and each host's failure rate is shrunk towards the corpus with a beta prior, so that a host with few documents
needs stronger evidence. The prior's mean is the corpus' failure rate; its strength comes from how much more the hosts'
rates vary than chance alone would make them (the moments of a beta-binomial distribution), so that the chance of few
documents does not pass for a difference between hosts. A host fails whose shrunk rate is above ``host_factor`` times the
corpus' rate and above ``host_least``, or above ``host_limit``. The verdict is joined back to the host's documents.

Defined results: a null text has no words and fails; a null host is a host of its own; repeated rows count each; an empty
table gives an empty result; columns besides id, text and host are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.session import written

SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def words(text: Column) -> Column:
    """The words of a text; the ends are trimmed first, so that the split leaves no empty word."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, f"[{SPACE}]+")).otherwise(F.array().cast("array<string>"))


def base_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", window: int = WINDOW) -> DataFrame:
    """The id, the host and the counts of every whole text, without a shuffle.

    Windows are compared by a 64-bit hash of their words' hashes. Only texts in which a window comes back are looked at
    place by place: sorted by hash and place, a window that repeats stands beside its like.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)
    counted = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(host_column).alias("host"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.transform(words(text), lambda word: F.xxhash64(word)).alias("_words"),
    )
    hashed = counted.select(
        "doc_id",
        "host",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_words").cast("long").alias("n_words"),
        F.when(F.size("_words") > window, F.transform(F.sequence(F.lit(1), F.size("_words") - (window - 1)), lambda i: F.xxhash64(F.slice("_words", i, window)))).alias("_hashes"),
    )
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    sorted_ = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    placed = hashed.withColumn("_sorted", F.when(repeats, sorted_)).drop("_hashes")
    alike = F.filter("_sorted", lambda s, i: F.get("_sorted", i - 1)["h"].eqNullSafe(s["h"]) | F.get("_sorted", i + 1)["h"].eqNullSafe(s["h"]))
    places = placed.withColumn("_places", F.array_sort(F.transform(alike, lambda s: s["i"]))).drop("_sorted")
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")),
        lambda so_far, place: F.struct(place.alias("last"), (so_far["n"] + F.least(F.lit(window), place - so_far["last"])).alias("n")),
        lambda so_far: so_far["n"],
    )
    return places.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_places")


def host_verdicts(base: DataFrame, limit: float = 0.5, factor: float = 3.0, least: float = 0.25) -> DataFrame:
    """Per host: documents, failures, shrunk failure rate and verdict. The prior is one row."""
    hosts = base.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failures"))
    docs, failures = F.col("host_docs").cast("double"), F.col("host_failures").cast("double")
    sums = hosts.agg(F.sum(failures).alias("f"), F.sum(docs).alias("s"), F.sum(docs * docs).alias("s2"), F.count(F.lit(1)).alias("hosts"), F.sum(failures * failures / docs).alias("q"))
    mean = sums.withColumn("mean", F.try_divide("f", "s"))
    # the share of the rates' spread that lies between hosts, and not in the chance of each host's documents
    room = F.col("s") - F.try_divide("s2", "s") - F.col("hosts") + 1
    spread = F.try_divide(F.col("q") - F.col("mean") * F.col("mean") * F.col("s"), F.col("mean") * (1 - F.col("mean"))) - F.col("hosts") + 1
    between = F.when((F.col("mean") > 0) & (F.col("mean") < 1) & (room > 0), F.try_divide(spread, room)).otherwise(0.0)
    prior = mean.select(F.lit(1).alias("_one"), "mean", (1 / F.least(F.greatest(between, F.lit(1e-6)), F.lit(0.5)) - 1).alias("strength"))
    shrunk = (F.col("host_failures") + F.col("mean") * F.col("strength")) / (F.col("host_docs") + F.col("strength"))
    bound = F.least(F.lit(limit), F.greatest(F.lit(least), F.lit(factor) * F.col("mean")))
    return hosts.withColumn("_one", F.lit(1)).join(F.broadcast(prior), "_one").select("host", "host_docs", "host_failures", shrunk.alias("host_rate"), (shrunk > bound).alias("host_failed"))


def apply_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", least_words: int = 20, most_repeated: int = 30, host_limit: float = 0.5, host_factor: float = 3.0, host_least: float = 0.25) -> DataFrame:
    """Counts, ``base_failed``, the host's figures and ``kept`` for every row. The texts are read once."""
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    base = written(base_counts(docs, id_column, text_column, host_column).withColumn("base_failed", failed), "quality")
    hosts = host_verdicts(base, host_limit, host_factor, host_least).withColumnRenamed("host", "_host")
    return base.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host").withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


#: DuckDB, over documents.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(0, 8)) AS o) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
  SELECT w.doc_id, w.source AS host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM words w LEFT JOIN lines l ON l.doc_id = w.doc_id LEFT JOIN covered c ON c.doc_id = w.doc_id
), rules AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
), hosts AS (
  SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS f FROM rules GROUP BY host
), moments AS (
  SELECT sum(f) / sum(n) AS m, sum(n) AS s, sum(n * n) AS s2, count(*) AS hosts, sum(f * f / n) AS q FROM hosts
), prior AS (
  SELECT m, 1 / least(greatest(CASE WHEN m > 0 AND m < 1 AND s - s2 / s - hosts + 1 > 0 THEN ((q - m * m * s) / (m * (1 - m)) - hosts + 1) / (s - s2 / s - hosts + 1) ELSE 0 END, 1e-6), 0.5) - 1 AS k FROM moments
), verdicts AS (
  SELECT host, (f + m * k) / (n + k) > least(0.5, greatest(0.25, 3.0 * m)) AS host_failed FROM hosts, prior
)
SELECT r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, NOT r.base_failed AND NOT v.host_failed AS kept
FROM rules r JOIN verdicts v ON r.host IS NOT DISTINCT FROM v.host
"""
