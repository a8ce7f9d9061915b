"""Exact top-k inner products by branch and bound over a vertical layout.

Vectors become integers, floor(scale * x). Rows and queries are dealt into tiles of bounded size; within a tile the rows'
components stand dimension by dimension. Scores grow one block of dimensions at a time, the dimensions with most mass
first. What the remaining dimensions can still add to a pair is bounded by the product of the remaining norms, so a row
whose upper bound lies below the k-th best lower bound of every query is dropped, and the columns are compacted before the
next block. Ties at the bound stay. The tiles' k best meet in one ranking per query.

Defined results: vectors that are null or hold null or non-finite components, and null ids, take no part; shorter vectors
count as padded with zeros; a row with the query's id is never its candidate; repeated candidate rows are ranked each;
rows that share a query's id and its vector are one query, those with another vector a query of their own, ranked by itself
under the same id; ties go to the smaller id; fewer rows than k give fewer ranks; scores beyond a long are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LIMIT = 2**53
_LONG = 2**63 - 1


def _matrix(lists: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows as columns of a (width, rows) matrix of whole numbers in double precision."""
    offsets = lists.offsets.to_numpy()
    values = np.floor(lists.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = values[offsets[0] : offsets[-1]]
    return np.ascontiguousarray(out.T)


def _exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of all columns, for components too large for double precision; beyond a long they are an error."""
    whole = np.vectorize(int, otypes=[object])
    product = whole(queries).T.dot(whole(rows))
    if product.size and max(abs(int(product.max())), abs(int(product.min()))) > _LONG:
        raise OverflowError("a score exceeds the range of a long")
    return product.astype(np.int64)


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, block: int, group: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per group of queries: query index, row id and score of each query's ``k`` best rows of this tile."""
    width = len(rows)
    largest = width * (np.abs(queries).max(initial=0.0)) * (np.abs(rows).max(initial=0.0))
    order = np.argsort(-(rows * rows).sum(axis=1), kind="stable") if width else np.arange(0)
    rows, queries = rows[order], queries[order]
    edges = [*range(0, width, block), width]

    def rest(x: np.ndarray) -> list[np.ndarray]:
        """Norms of the dimensions from each edge on."""
        squares = x * x
        return [np.sqrt(squares[e:].sum(axis=0)) * (1 + 1e-9) for e in edges]

    rest_rows, rest_queries = rest(rows), rest(queries)
    for at in range(0, queries.shape[1], group):
        part = queries[:, at : at + group]
        names = query_ids[at : at + group]
        alive = np.arange(rows.shape[1])
        if largest >= _LIMIT:
            scores = _exact(part, rows)
        else:
            scores = np.zeros((part.shape[1], len(alive)))
            live = rows
            for step in range(len(edges) - 1):
                scores += part[edges[step] : edges[step + 1]].T @ live[edges[step] : edges[step + 1]]
                if len(alive) <= k or step == len(edges) - 2:
                    continue
                slack = np.outer(rest_queries[step + 1][at : at + group], rest_rows[step + 1][alive]) + 1e-6
                low = np.where(ids[alive][None, :] == names[:, None], -np.inf, scores - slack)
                bound = np.partition(low, len(alive) - k, axis=1)[:, len(alive) - k]
                keep = (scores + slack >= bound[:, None]).any(axis=0)
                if keep.sum() < 0.9 * len(alive):
                    alive, scores, live = alive[keep], scores[:, keep], live[:, keep]
        own = ids[alive][None, :] == names[:, None]
        for q in range(part.shape[1]):
            allowed = np.flatnonzero(~own[q])
            if len(allowed) > k:
                line = scores[q, allowed]
                kth = np.partition(line, len(line) - k)[len(line) - k]
                allowed = allowed[line >= kth]
            picked = allowed[np.lexsort((ids[alive[allowed]], -scores[q, allowed]))[:k]]
            yield np.full(len(picked), at + q), ids[alive[picked]], scores[q, picked].astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 1024, tile_rows: int = 8192, tile_queries: int = 1024, block: int = 16) -> DataFrame:
    """The ``k`` best rows for each row that ``is_query`` holds for: query_id, rank, the row's id and score.

    Rows are sent once for every ``tile_queries`` queries and queries once for every ``tile_rows`` rows.
    """
    usable = F.forall(F.col(vector_column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"), is_query.alias("asks")).where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(usable, F.lit(False)))
    totals = clean.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1)), F.max(F.size("vector"))).first()
    parts, blocks, width = max(1, -(-totals[0] // tile_rows)), max(1, -(-totals[1] // tile_queries)), totals[2] or 0

    hashed = F.xxhash64("id")
    rows = clean.select("id", "vector", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = clean.where("asks").select("id", "vector").distinct().select("id", "vector", F.xxhash64("vector").alias("which"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(hashed, F.lit(blocks)).cast("int").alias("block"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[np.empty(0, np.int64)] * 4]
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            names, which, ids = left["id"].to_numpy(), left["which"].to_numpy(), right["id"].to_numpy()
            matrices = [_matrix(t["vector"].chunk(0), width, scale) for t in (left, right)]
            found += [(names[q], which[q], v, s) for q, v, s in best(names, matrices[0], ids, matrices[1], k, block)]
        return pa.table({n: pa.array(np.concatenate(c).astype(np.int64)) for n, c in zip(("query_id", "which", "id", "score"), zip(*found, strict=True), strict=True)})

    near = queries.groupBy("part", "block").cogroup(rows.groupBy("part", "block")).applyInArrow(tile, "query_id long, which long, id long, score long")
    order = Window.partitionBy("query_id", "which").orderBy(F.col("score").desc(), F.col("id"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")
