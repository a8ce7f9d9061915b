"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence are multiplied. The text gives a likelihood per language from byte trigrams, learned from documents
of known language, tempered because trigrams are not independent. The language that the page's markup declares and the
suffix of its address give likelihoods from how often each goes with each language over the whole table, counted with the
texts' posteriors by grouped aggregation. The host gives a prior: its pages' mean posterior, without the page itself,
shrunk to that of its domain, which is shrunk to that of all pages.

Defined results: a null page or one without text rests on the other evidence, and without any on the prior; a null or
malformed address has no host, domain or suffix of its own and takes those of all such pages; markup without a declared
language counts as a kind of its own; repeated rows count each; without labelled documents there are no languages and the
result is empty; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import written

#: At most so many documents are fitted on, shared out among the languages, and trigrams fall into so many buckets.
FIT_DOCS = 4000
BUCKETS = 1 << 15
#: A text's evidence counts as that of so many independent trigrams at most: the mean over all its trigrams, however many,
#: is raised to this power, because neighbouring trigrams repeat one another and a text's odds would grow without end.
MOST_TRIGRAMS = 60.0
_LOWER = {upper: upper + 32 for upper in range(65, 91)}
#: Pages that a parent's prior counts as.
STRENGTH = 5.0
_HIDDEN = re.compile(r"(?i)(script|style)\b")


def visible(html: str | None) -> str:
    """The text between a page's tags, without scripts, styles and comments, in one pass from left to right.

    What is opened and never closed hides nothing but its own sign, so that a broken page keeps its text.
    """
    if not html:
        return ""
    out, at, lowered, absent = [], 0, None, set()

    def after(mark: str, start: int, text: str) -> int:
        """The place behind the next ``mark``, or -1; one that is absent once is not looked for again."""
        found = -1 if mark in absent else text.find(mark, start)
        if found < 0:
            absent.add(mark)
            return -1
        return found + len(mark)

    while (begin := html.find("<", at)) >= 0:
        out.append(html[at:begin])
        end, hidden = -1, _HIDDEN.match(html, begin + 1)
        if html.startswith("<!--", begin):
            end = after("-->", begin + 4, html)
        elif hidden:
            # ASCII alone is lowered, so that places stay the same
            lowered = html.translate(_LOWER) if lowered is None else lowered
            end = after("</" + hidden[1].lower(), begin, lowered)
            end = after(">", end, html) if end >= 0 else -1
        if end < 0:
            end = after(">", begin, html)
        out.append(" ")
        at = end if end >= 0 else begin + 1
    out.append(html[at:])
    return "".join(out)


def trigrams(text: str) -> np.ndarray:
    """Buckets of a text's byte trigrams, lowered, with runs of anything but letters as one space."""
    data = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", b" " + text.lower().encode() + b" ")
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(17)).astype(np.int64) % BUCKETS if len(b) > 2 else np.empty(0, np.int64)


def fit(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages in order and the logarithms of their smoothed trigram frequencies."""
    names = sorted(set(langs))
    counts = np.full((len(names), BUCKETS), 0.1)
    for text, lang in zip(texts, langs, strict=True):
        counts[names.index(lang)] += np.bincount(trigrams(text), minlength=BUCKETS)
    return names, np.log(counts / counts.sum(axis=1, keepdims=True))


def text_posterior(html: str | None, model: np.ndarray) -> list[float]:
    """Logarithms of the tempered likelihood of a page's text per language, the highest being 0."""
    found = trigrams(visible(html))
    if not len(found):
        return [0.0] * len(model)
    mean = model[:, found].mean(axis=1)
    scaled = (mean - mean.max()) * min(len(found), MOST_TRIGRAMS)
    return scaled.tolist()


def shares(counts: dict[str, int], rows: int) -> dict[str, int]:
    """How many of at most ``rows`` documents each language gives: equal shares, at least one, no more than it has."""
    out, left = {}, rows
    for at, (lang, count) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(count, max(left // (len(counts) - at), 1))
        left = max(left - out[lang], 0)
    return out


def train(docs: DataFrame, rows: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """Fit on at most ``rows`` labelled documents, in each language those with the smallest hashes of their ids.

    Languages are counted over all documents, so that each of them is fitted; beyond ``rows`` languages, one document each.
    """
    labelled = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", F.xxhash64("doc_id").alias("_h")).distinct()
    groups = {r["lang"]: r for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("_h").alias("first")).collect()}
    if not groups:
        return [], np.zeros((0, BUCKETS))
    taken = shares({lang: r["n"] for lang, r in groups.items()}, rows)
    # hashes up to a cut hold about twice the share, so that few rows are ranked; the smallest hash always stays
    cuts = [(lang, n, max(groups[lang]["first"], min((2 * n + 100) * 2**64 // groups[lang]["n"] - 2**63, 2**63 - 1))) for lang, n in taken.items()]
    near = labelled.join(F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, _n long, _cut long")), "lang").where("_h <= _cut")
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id")))
    chosen = ranked.where("_rank <= _n").select("doc_id", "lang").distinct()
    # an id comes to the driver once for each of its languages, with its first text of that language
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    found = texts.toPandas().sort_values(["doc_id", "lang"], kind="stable")
    return fit([t or "" for t in found["text"]], list(found["lang"]))


def _evidence(pages: DataFrame, model: np.ndarray, languages: int) -> DataFrame:
    """page_id, host, domain, suffix, declared and the text's log-likelihoods, from one pass over the pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [text_posterior(h.as_py(), model) for h in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(scores, pa.list_(pa.float64()))], ["page_id", "host", "domain", "suffix", "declared", "text_log"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    parts = pages.select("page_id", host.alias("host"), declared.alias("declared"), "html")
    named = parts.select("page_id", "host", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"), F.regexp_extract("host", r"([^.]+)$", 1).alias("suffix"), "declared", "html")
    return named.mapInArrow(run, "page_id long, host string, domain string, suffix string, declared string, text_log array<double>")


def _normal(logs: Column) -> Column:
    """Probabilities from logarithms."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def _tally(rows: DataFrame, keys: list[str], languages: int, column: str, name: str) -> DataFrame:
    """Per key: the sum of an array column, component by component."""
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col(column)[i]) for i in range(languages)]).alias(name))


def identify(pages: DataFrame, docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """page_id, host, declared language, the language found and its posterior, for every row of ``pages``.

    Posteriors are added up once by host and declared language; hosts, domains, suffixes and declared languages are added
    up from those sums, and only one join takes what they say back to the pages. The sums of all pages are one row.
    """
    languages, model = train(docs, fit_docs)
    n = len(languages)
    if not n:
        return pages.sparkSession.createDataFrame([], "page_id long, host string, declared string, lang string, posterior double")
    rows = written(_evidence(pages, model, n).withColumn("post", _normal(F.col("text_log"))), "evidence")
    groups = written(_tally(rows, ["host", "domain", "suffix", "declared"], n, "post", "own"), "groups")
    total = groups.agg(*[F.coalesce(F.sum(F.col("own")[i]), F.lit(0.0)) for i in range(n)]).first()
    whole = [(t + STRENGTH / n) / (sum(total) + STRENGTH) for t in total]

    def each(make) -> Column:
        return F.array(*[make(i) for i in range(n)])

    def mass(name: str) -> Column:
        return sum((F.col(name)[i] for i in range(1, n)), F.col(name)[0])

    by_host = _tally(groups, ["host", "domain"], n, "own", "host_sum")
    by_domain = _tally(groups, ["domain"], n, "own", "domain_sum")
    by_suffix = _tally(groups, ["suffix"], n, "own", "suffix_sum")
    by_declared = _tally(groups, ["declared"], n, "own", "declared_sum")
    share = lambda name, i: F.log((F.col(name)[i] + 0.5 / n) / F.lit(total[i] + 1.0))
    told = (
        groups.join(by_host, ["host", "domain"])
        .join(by_domain, "domain")
        .join(by_suffix, "suffix")
        .join(by_declared, "declared")
        .select(
            "host",
            "declared",
            "host_sum",
            each(lambda i: (F.col("domain_sum")[i] + F.lit(STRENGTH * whole[i])) / (mass("domain_sum") + STRENGTH)).alias("parent"),
            each(lambda i: share("suffix_sum", i) + share("declared_sum", i)).alias("told"),
        )
    )
    joined = rows.select("page_id", "host", "declared", "text_log", "post").join(written(told, "told"), ["host", "declared"])
    others = joined.withColumn("others", each(lambda i: F.greatest(F.col("host_sum")[i] - F.col("post")[i], F.lit(0.0))))
    prior = lambda i: (F.col("others")[i] + STRENGTH * F.col("parent")[i]) / (mass("others") + STRENGTH)
    logs = others.withColumn("logs", each(lambda i: F.col("text_log")[i] + F.log(prior(i) + 1e-12) + F.col("told")[i]))
    raised = logs.withColumn("top", F.array_max("logs")).withColumn("raised", each(lambda i: F.exp(F.col("logs")[i] - F.col("top"))))
    best = F.array_max("raised")
    names = F.array(*map(F.lit, languages))
    return raised.select("page_id", "host", "declared", F.get(names, F.array_position("raised", best).cast("int") - 1).alias("lang"), (best / mass("raised")).alias("posterior"))


def fused(html: list[str | None], keys: list[tuple[str, str, str, str]], model: np.ndarray) -> np.ndarray:
    """The same posteriors row by row in plain Python, for tests; keys are (host, domain, suffix, declared)."""
    logs = np.array([text_posterior(h, model) for h in html])
    post = np.exp(logs) / np.exp(logs).sum(axis=1, keepdims=True)
    n = len(model)

    def sums(at: tuple[int, ...]) -> dict:
        out: dict = {}
        for k, p in zip(keys, post, strict=True):
            name = tuple(k[i] for i in at)
            out[name] = out.get(name, 0) + p
        return out

    hosts, domains, suffixes, declared, whole = sums((0, 1)), sums((1,)), sums((2,)), sums((3,)), post.sum(axis=0)
    shrink = lambda own, parent: (own + STRENGTH * parent) / (own.sum() + STRENGTH)
    out = []
    for k, p, log in zip(keys, post, logs, strict=True):
        parent = shrink(domains[k[1],], shrink(whole, np.full(n, 1 / n)))
        prior = shrink(np.maximum(hosts[k[0], k[1]] - p, 0), parent)
        x = log + np.log(prior + 1e-12) + sum(np.log((t + 0.5 / n) / (whole + 1)) for t in (suffixes[k[2],], declared[k[3],]))
        out.append(np.exp(x - x.max()) / math.fsum(np.exp(x - x.max())))
    return np.array(out)
