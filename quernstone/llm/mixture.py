"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Among all ways to give documents rates between 0 and ``cap`` that meet the
targets, the one nearest to rate 1 in relative entropy is an exponential tilt, min(cap, exp(lambda * size / mean size)),
with one dual variable per source. The dual is convex; safeguarded Newton steps solve it for all sources at once, each step
one grouped aggregation over the counts of documents by source and size, which carry all that the dual depends on.
Rates become whole copies without chance: a source's sizes, from the largest down, get a number of copies each, and what
one size misses in words is handed to the next; a hash order of the documents, counted in salted buckets, says which
documents of a size take one copy more. So a source's taken words miss its target by about its smallest document, and
reruns agree.

Defined results: a null source is a source of its own and sorts last; a document without words has size 0 and takes
nothing; repeated rows are documents of their own; an empty table gives an empty result; further columns are kept,
whatever their names. The added columns replace columns of the same name.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import cut

#: Documents of one source and size are ranked within so many hash buckets.
SALTS = 256
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(by_source: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Share all sizes among the sources by weight, none above ``cap`` times its own size.

    ``by_source`` has one row per source (source, source_size). Sources in ascending order of the ratio at which they
    reach their cap are full while the level of the rest stays above that ratio.
    """
    ranked = by_source.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    order = Window.orderBy("_full_at", "_rank")
    levels = (
        ranked.withColumn("_weight", weight)
        .withColumn("_full_at", F.lit(cap) * F.col("source_size") / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(Window.partitionBy(F.lit(1))))
        .withColumn("_before", F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_rest"))
    )
    level = F.max(F.when(F.col("_full_at") > F.col("_level"), F.col("_level"))).over(Window.partitionBy(F.lit(1)))
    capped = F.lit(cap) * F.col("source_size")
    return levels.withColumn("_at", level).select("source", "source_size", F.when(F.col("_at").isNull(), capped).otherwise(F.least(capped, F.col("_at") * F.col("_weight"))).cast("double").alias("target"))


def _rate(cap: float) -> Column:
    return F.when(F.col("saturated"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))))


def tilts(counts: DataFrame, goals: DataFrame, cap: float, tolerance: float, steps: int) -> DataFrame:
    """Solve the dual: one ``tilt`` per source. ``counts`` has (source, size, docs)."""
    means = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("mean"))
    state = cut(
        goals.join(means.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("mean", F.greatest("mean", F.lit(1e-9)))
        .withColumn("saturated", F.col("target") >= F.col("source_size") * F.lit(cap) * (1 - 1e-12))
        .withColumn("tilt", F.lit(0.0))
        .withColumn("low", F.lit(-700.0) * F.col("mean"))
        .withColumn("high", F.lit(2.0) * F.log(F.lit(cap)) * F.col("mean") + 1.0)
        .withColumn("error", F.lit(1.0))
    )
    renamed = counts.withColumnRenamed("source", "_s")
    for _ in range(steps):
        rate = _rate(cap)
        z = F.col("size") / F.col("mean")
        sums = (
            renamed.join(state.select("source", "mean", "saturated", "tilt"), F.col("_s").eqNullSafe(F.col("source")))
            .groupBy("source")
            .agg(
                F.sum(F.col("docs") * F.col("size") * rate).alias("_taken"),
                F.sum(F.when(rate < cap, F.col("docs") * F.col("size") * z * rate).otherwise(0.0)).alias("_slope"),
            )
            .withColumnRenamed("source", "_g")
        )
        gap = F.col("_taken") - F.col("target")
        newton = F.col("tilt") - gap / F.col("_slope")
        low = F.when(gap <= 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap >= 0, F.col("tilt")).otherwise(F.col("high"))
        middle = (low + high) / 2
        done = F.col("saturated") | (F.abs(gap) <= F.lit(tolerance) * F.col("target"))
        state = cut(
            state.join(sums, F.col("source").eqNullSafe(F.col("_g"))).select(
                "source",
                "source_size",
                "target",
                "mean",
                "saturated",
                F.when(done, F.col("tilt")).when((F.col("_slope") > 0) & (newton > low) & (newton < high), newton).otherwise(middle).alias("tilt"),
                low.alias("low"),
                high.alias("high"),
                F.when(done, F.lit(0.0)).otherwise(F.abs(gap)).alias("error"),
            )
        )
        if not state.where(F.col("error") > 0).take(1):
            break
    # sums of doubles depend on their order in the last digits, which must not decide about a copy
    return state.withColumn("tilt", F.round("tilt", 9)).drop("low", "high", "error")


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", size_column: str = "size", weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, tolerance: float = 1e-9, steps: int = 80) -> DataFrame:
    """Add ``source_size``, ``target``, ``rate``, ``copies`` and ``taken`` to every row of ``docs``.

    ``size_column`` holds each row's size; source and size pairs are counted once and the rows are shuffled once.
    """
    docs = docs.drop("source_size", "target", "rate", "copies", "taken")
    source, size = F.col(source_column).alias("source"), F.col(size_column).cast("long").alias("size")
    salt = F.pmod(F.xxhash64(F.col(id_column)), F.lit(SALTS)).cast("int").alias("salt")
    salted = cut(docs.select(source, size, salt).groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("docs")))
    counts = cut(salted.groupBy("source", "size").agg(F.sum("docs").alias("docs")))
    goals = cut(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")), weights, cap))
    solved = tilts(counts, goals, cap, tolerance, steps)

    rated = counts.withColumnRenamed("source", "_s").join(solved, F.col("_s").eqNullSafe(F.col("source"))).select("source", "size", "docs", "source_size", "target", _rate(cap).alias("rate"))
    kind = docs.schema[source_column].dataType.simpleString()

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        """Whole copies for each size of a source, the largest first; each hands what it missed on to the next."""
        group = group.sort_values("size", ascending=False)
        owed, copies = 0.0, []
        for words, n, rate in zip(group["size"].tolist(), group["docs"].tolist(), group["rate"].tolist(), strict=True):
            fair = n * rate
            copies.append(min(max(math.floor(fair + owed / max(words, 1) + 0.5), 0), cap * n))
            owed += (fair - copies[-1]) * words
        each = [c // n for c, n in zip(copies, group["docs"].tolist(), strict=True)]
        over = [c % n for c, n in zip(copies, group["docs"].tolist(), strict=True)]
        return group.rename(columns={"source": "_s", "size": "_z"}).drop(columns="docs").assign(_each=each, _over=over)

    # a group has one row for each distinct size of its source
    shares = rated.groupBy("source").applyInPandas(deal, f"_s {kind}, _z long, source_size long, target double, rate double, _each long, _over long")
    before = F.coalesce(F.sum("docs").over(Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # names that no column of the documents begins with
    mark = "_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    keys = [mark + "source", mark + "size", mark + "salt"]
    some = lambda name: F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))
    dealt = (
        salted.withColumn("_before", before)
        .join(shares, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
        .select(some("_s").alias(keys[0]), F.col("_z").alias(keys[1]), F.col("salt").alias(keys[2]), *[F.col(c).alias(mark + c) for c in ("source_size", "target", "rate")], F.col("_each").alias(mark + "each"), (F.col("_over") - F.col("_before")).alias(mark + "more"))
    )
    # the join and the ranks need the same keys, so the rows are shuffled once
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(F.col(id_column), F.lit(1)), F.col(id_column))
    joined = docs.withColumns({keys[0]: some(source_column), keys[1]: size, keys[2]: salt}).join(dealt, keys)
    copies = (F.col(mark + "each") + F.when(F.row_number().over(order) <= F.col(mark + "more"), 1).otherwise(0)).cast("long")
    added = [F.col(mark + c).alias(c) for c in ("source_size", "target", "rate")]
    return joined.withColumn(mark + "copies", copies).select(*docs.columns, *added, F.col(mark + "copies").alias("copies"), (F.col(mark + "copies") * F.col(keys[1])).alias("taken"))
