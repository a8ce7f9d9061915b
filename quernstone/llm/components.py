"""Connected components over a table of links: forests by task, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import cut


#: A task of the steps takes about so many edges; few edges are kept in few partitions, which spares small files.
EDGES_A_TASK = 250_000


def _large(edges: DataFrame, parts: int) -> DataFrame:
    """Hang every node's larger neighbours on the smallest node it knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(parts).distinct().coalesce(parts)


def _small(edges: DataFrame, parts: int) -> DataFrame:
    """Hang every node's smaller neighbours, and itself, on the smallest of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return hung.union(least.select("a", F.col("m").alias("b"))).coalesce(parts).distinct().coalesce(parts)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges that isn't the smallest of its component among them, with that smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        lower = np.minimum(least[x], least[y])
        hung = least.copy()
        np.minimum.at(hung, least[x], lower)
        np.minimum.at(hung, least[y], lower)
        while (further := hung[hung]).tobytes() != hung.tobytes():
            hung = further
        if (hung == least).all():
            break
        least = hung
    other = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[other], nodes[least[other]]


def _forest(edges: DataFrame, most: int | None) -> DataFrame:
    """The same components with each task's edges as stars; a task holds ``most`` edges at a time, or all that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(batch)
            if most is not None and sum(x.num_rows for x in held) >= most:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(a, b)], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, most_steps: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b), longs, that isn't the smallest of its component.

    Each task first turns its edges into a forest of stars, so that no more edges than nodes are left of a task's dense
    groups. What one task holds is then settled by that task; otherwise steps follow, which end when the edges no longer
    change and so form stars. Nothing is collected but a count and a checksum.
    """
    edges = cut(_forest(links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), EDGES_A_TASK))
    parts = 1 + edges.count() // EDGES_A_TASK
    if parts == 1:
        return _forest(edges.coalesce(1), None).select(F.col("a").alias("node"), F.col("b").alias("component"))
    edges = cut(edges.distinct().coalesce(parts))
    before = None
    for _ in range(most_steps):
        edges = cut(_small(_large(edges, parts), parts))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
    raise RuntimeError("components did not settle")
