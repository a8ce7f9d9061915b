"""Exact Jaccard join of word 5-gram sets as a metric-space join.

Jaccard distance is a metric; documents link when it is at most r = 1 - threshold. The join never compares all pairs:

1. Regions. A set's shingle hashes are cut into classes by value, their number fixed by the size level. Two linked sets
   differ in at most D = (|x| + |y|) / 9 shingles (for 0.8), so of the first D + D / 4 + 1 classes that hold something at
   least D / 4 + 1 are the same in both. Each such class, with its content, is a region; a document lies in its regions
   of its level, and of the level above if a partner can be there. Regions of one document vanish; regions with the same
   members are one, with a weight. As linked documents share a weight of D / 4 + 1, each may leave its largest regions
   up to a weight of D / 4. The rows of a region that a task meets often are dealt out by a salt.
2. Pivots. Each document is measured against the earlier document with which it shares most small regions, and against
   the pivot that every larger region elects. Within r of its pivot it is linked; a ball is connected through its pivot,
   without pairs inside.
3. Voronoi cells and windows. A larger region that still holds several components elects pivots outside its main one.
   A member belongs to the cell of its nearest pivot if that is within r, otherwise to the region's outer cell. By the
   triangle inequality a link crosses a border only within a window: a member is replicated into the cell of every pivot
   within 2 r that is at most 2 r further away than its own. Every link inside the region therefore lies inside a cell,
   between members of which one at least is at home there. Those at home in a pivot's cell are connected through it, so
   only documents of other components are replicated, and only what lies within r of their distances stays beside them.
   Only distances within 2 r count, and the counts of both sets in slices of the hash range (their distances from the
   empty set within the slices) bound a distance from below, so that few sets need to be measured exactly.
4. Recursion. Cells that are still large and hold several components are divided again in the same way, as long as that
   at least halves them. A region stays whole where its cells, replicas included, would hold as many pairs as it does, as
   in a group whose members are nearly all between r and 2 r apart. What is left is dealt into tiles of two blocks. A pair
   is measured only if its distances to the cell's pivot differ by no more than r and if its slices allow a link.
5. Counts. Linked documents are in one component, so every link is found inside components: the points of a component are
   dealt into blocks, every two blocks meet in one tile, and a tile measures all its pairs exactly by counting common
   shingles. It returns one number per point, weighted by copies, so that no pairs are shuffled. Only ``join_links`` does.

Equal sets are one point from the start. A shingle is the 64-bit hash of its words.

Defined results: words are split at ASCII white space and A-Z is lowered; fewer than five words are one shingle; a null or
empty text is an empty set, linked with nothing; an id with a set is a document, so that equal rows are one document and
rows that share an id but differ in their sets are several, each linked by what it holds; a null id is no document and
has a null component and null links; an empty table gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.components import components
from quernstone.session import cut, written

SHINGLE = 5
SLICES = 256
#: Regions up to this size pair their members; larger ones work by pivots and tiles.
SMALL_REGION = 16
#: Larger regions are cut into tiles of two blocks of about so many members.
BLOCK = 512
#: A component is counted in blocks of about so many points and at most about so many shingles.
COUNT_BLOCK = 1024
COUNT_SHINGLES = 1_000_000
#: Shingles of more points than this are counted by matrix products, rarer ones pair by pair.
COMMON = 24
#: Cells of more members elect so many pivots each and are divided, level after level; then tiles compare the rest.
CELL = 1024
PIVOTS = 4
LEVELS = 3
#: A region with so many rows in one slice of a task is dealt out by salts from then on.
HOT = 8
SALTS = 64
#: What windows are widened by against rounding.
SLACK = 1e-9
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_EMPTY = np.uint64(0x5851F42D4C957F2D)
_EDGES = np.arange(SLICES, dtype=np.uint64) << np.uint64(56)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    steps = min(width, len(words))
    last = len(words) - steps + 1
    joined = hashes[:last].copy()
    for i in range(1, steps):
        joined = joined * _A + hashes[i : last + i]
    return np.unique(_mix(joined + np.uint64(steps)))


def _differ(n: int, most: int, percent: int) -> int:
    """How many shingles a set of ``n`` may differ in from a linked set of at most ``most``."""
    return min(n * (100 - percent) // percent, (n + most) * (100 - percent) // (100 + percent))


def _most(n: int) -> int:
    """The largest size of the level that a set of ``n`` is in."""
    return 2 ** n.bit_length() - 1


def shared_at_least(n: int, percent: int) -> int:
    """How many regions a set of ``n`` and a linked set share, if that one's own number is no smaller."""
    return 1 + _differ(n, _most(n), percent) // 4


def regions(found: np.ndarray, percent: int) -> np.ndarray:
    """Region keys of a set, given its sorted shingle hashes."""
    n = len(found)
    if n == 0:
        return np.empty(0, np.uint64)
    level = n.bit_length() - 1
    out = []
    mixed = _mix(found ^ _A)
    for at in (level, level + 1):
        if at > level and n * 100 // percent < 2**at:
            break
        most = 2 ** (at + 1) - 1
        differ = _differ(n, most, percent)
        differ += differ // 4
        classes = 2 * most * (100 - percent) // (100 + percent) * 5 // 4 + 3
        edges = (np.arange(classes, dtype=np.float64) * (2.0**64 / classes)).astype(np.uint64)
        starts = np.searchsorted(found, edges)
        sizes = np.diff(starts, append=n)
        full = np.flatnonzero(sizes)
        name = _mix((np.arange(classes, dtype=np.uint64) << np.uint64(8)) + np.uint64(at))
        taken = full[: differ + 1]
        out.append(_mix(np.add.reduceat(mixed, starts[taken]) if len(taken) == len(full) else np.add.reduceat(mixed[: starts[full[len(taken)]]], starts[taken])) ^ name[taken])
        if len(full) < differ + 1:
            # too few classes hold something: a link may rest on classes that are empty in both sets
            out.append(_mix(name[np.flatnonzero(sizes == 0)] ^ _EMPTY))
    return np.concatenate(out)


def _slices(found: np.ndarray) -> bytes:
    """Counts of a set in equal slices of the hash range, held to a byte."""
    return np.minimum(np.diff(np.searchsorted(found, _EDGES), append=len(found)), 255).astype(np.uint8).tobytes()


def _point(found: np.ndarray) -> int:
    """What stands for all documents with this set."""
    return int(np.add.reduce(_mix(found ^ _C)) ^ _mix(np.array([len(found)], np.uint64) + _A)[0]) if len(found) else 0


def _region_rows(docs: DataFrame, percent: int, seen_most: int = 200_000, hot_most: int = 50_000) -> DataFrame:
    """Rows (region, salt, point, n) and, with ``doc`` set, one row per document, from one pass.

    A task gives the regions of a set that it meets again only once, so that copies are folded before the shuffle. Only
    regions of which the task has given at least HOT rows without a salt get one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        hot = np.empty(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids = batch.column(0).slice(at, 512)
                keys, points, sizes = [np.empty(0, np.uint64)], [], []
                lengths = []
                for text in batch.column(1).slice(at, 512).to_pylist():
                    found = shingles(text)
                    point = _point(found)
                    points.append(point)
                    sizes.append(len(found))
                    if point not in seen:
                        if len(seen) >= seen_most:
                            seen.clear()
                        seen.add(point)
                        keys.append(regions(found, percent))
                        lengths.append(len(keys[-1]))
                    else:
                        lengths.append(0)
                own, n = np.array(points, np.uint64).view(np.int64), np.array(sizes, np.int64)
                key = np.concatenate(keys)
                salt = np.where(np.isin(key, hot), 1 + np.repeat(own, lengths) % SALTS, 0) if len(hot) else np.zeros(len(key), np.int64)
                values, counts = np.unique(key[salt == 0], return_counts=True)
                hot = np.concatenate([hot, values[counts >= HOT]])[-hot_most:]
                spread = _mix(ids.to_numpy().view(np.uint64) ^ _EMPTY)
                columns = [
                    pa.array(np.concatenate([key, spread]).view(np.int64)),
                    pa.array(np.concatenate([salt, np.zeros(len(own), np.int64)])),
                    pa.array(np.concatenate([np.repeat(own, lengths), own])),
                    pa.array(np.concatenate([np.repeat(n, lengths), n])),
                    pa.concat_arrays([pa.nulls(len(key), pa.int64()), ids]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["region", "salt", "point", "n", "doc"])

    return docs.mapInArrow(run, "region long, salt long, point long, n long, doc long")


def _sets(docs: DataFrame) -> DataFrame:
    """(doc, n, slices, shingles) of every text, ``doc`` being its point and ``shingles`` the sorted hashes as a binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [shingles(t) for t in batch.column(1).slice(at, 512).to_pylist()]
                points = np.array([_point(s) for s in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(points), pa.array([len(s) for s in found], pa.int64()), pa.array([_slices(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())],
                    ["doc", "n", "slices", "shingles"],
                )

    return docs.mapInArrow(run, "doc long, n long, slices binary, shingles binary")


def _lowest(n: str, percent: int) -> Column:
    """``shared_at_least`` of the smallest set that a set of ``n`` can link with."""
    least = F.ceil(F.col(n) * percent / 100).cast("long")
    most = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(least))) - 1
    differ = F.least(F.floor(least * (100 - percent) / percent), F.floor((least + most) * (100 - percent) / (100 + percent)))
    return (1 + F.floor(differ / 4)).cast("long")


def _reach(percent: int) -> float:
    return (100 - percent) / 100


def _ratio(percent: int, a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _paired(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """The pairs with the columns of both sides. Written pairs have a size that Spark knows, so that it sends few pairs to
    the sets instead of the sets to the pairs, and of the second side only what occurs is sent."""
    pairs = written(pairs, "asked")
    first, second = (sets.select(F.col("doc").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns]) for c in "ab")
    return first.join(pairs, "a").join(second.join(pairs.select("b").distinct(), "b", "left_semi"), "b")


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose similarity can be ``percent`` by their sizes and slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SLICES).astype(np.int16) for i in (2, 3))
            sizes = batch.column(4).to_numpy()
            keep = pa.array(np.abs(x - y).sum(axis=1, dtype=np.int64) * (100 + percent) <= sizes * (100 - percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    sized = _paired(pairs, sets, "n", "slices").where(_ratio(percent, "n_a", "n_b"))
    return sized.select("a", "b", "slices_a", "slices_b", (F.col("n_a") + F.col("n_b")).alias("sizes")).mapInArrow(run, "a long, b long")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, total) of the pairs: the exact sizes of their intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, total = [], []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common.append(int((y[at] == x).sum()))
                total.append(len(x) + len(y) - common[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "common", "total"])

    return _paired(pairs, sets, "shingles").select("a", "b", "shingles_a", "shingles_b").mapInArrow(run, "a long, b long, common long, total long")


def _linking(measured: DataFrame, percent: int) -> DataFrame:
    return measured.where(F.col("common") * 100 >= F.col("total") * percent).select("a", "b")


def _parts(docs: DataFrame, labels: DataFrame, column: str, part: str) -> DataFrame:
    """``docs`` with the component so far of ``column``."""
    return docs.join(labels.withColumnRenamed("node", column), column, "left").withColumn(part, F.coalesce("component", column)).drop("component")


def _open(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the cells that hold more than one component, with their ``part`` and the cell's ``main`` one and size.

    Cells get short names, as lists of them are sent about.
    """
    labelled = written(_parts(cells, labels, "doc", "part"), "labelled")
    by_part = labelled.groupBy("region", "part").agg(F.count(F.lit(1)).alias("n_part"))
    shape = by_part.groupBy("region").agg(F.sum("n_part").alias("size"), F.count(F.lit(1)).alias("parts"), F.max_by("part", F.struct("n_part", "part")).alias("main")).where("parts > 1")
    named = written(shape.withColumn("name", F.monotonically_increasing_id()), "shapes")
    return written(labelled.join(named, "region").drop("region").withColumnRenamed("name", "region"), "open")


def _order(draw: int) -> Column:
    """An order of documents by hash; the same for all regions, so that those with common members elect the same."""
    return F.struct(F.xxhash64("doc", F.lit(draw)), "doc")


def _elected(large: DataFrame, percent: int) -> DataFrame:
    """Each member of a larger region with the region's pivot."""
    pivots = large.groupBy("region").agg(F.min_by("doc", _order(0)).alias("b"), F.min_by("n", _order(0)).alias("n_b"))
    faced = large.join(pivots, "region").where((F.col("doc") != F.col("b")) & _ratio(percent, "n", "n_b"))
    return faced.select(F.least("doc", "b").alias("a"), F.greatest("doc", "b").alias("b")).distinct()


def _faced(cells: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members of open cells with every elected pivot within 2 r (region, doc, n, size, pivot, apart), and the links found.

    Pivots are written first, so that Spark knows their size and need not deal out the members by region to meet them.
    Distances are quotients of whole numbers; windows are widened by SLACK, which is less than any two can differ.
    """
    drawn = cells.where("part <> main").groupBy("region").agg(F.array_distinct(F.array(*[F.min_by("doc", _order(draw)) for draw in range(PIVOTS)])).alias("pivots"))
    pivots = written(drawn.select("region", F.explode("pivots").alias("pivot")), "pivots")
    faced = written(cells.select("region", "doc", "n", "size").join(pivots, "region"), "faced")
    near = _near(faced.select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct(), sets, 2 * percent - 100)
    measured = written(_measured(near, sets).distinct(), "distances")
    apart = measured.select(F.col("a").alias("doc"), F.col("b").alias("pivot"), (1 - F.col("common") / F.col("total")).alias("apart"))
    placed = written(faced.join(apart.where(F.col("apart") <= 2 * _reach(percent) + SLACK), ["doc", "pivot"]), "placed")
    return placed, _linking(measured, percent).where("a <> b")


def _divided(cells: DataFrame, placed: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The Voronoi cells of open cells, with boundary documents wherever their window reaches: (origin, region, doc, n, apart, home, whole).

    ``apart`` is the distance to the cell's pivot, 0 in outer cells, which have none; ``origin`` is the cell before and
    ``whole`` its size.
    """
    reach = _reach(percent)
    # components are looked up once a member and once a pivot, not for each member with each pivot
    nearest = written(_parts(placed.groupBy("region", "doc").agg(F.min("apart").alias("nearest")), labels, "doc", "part"), "nearest")
    parts = placed.join(nearest, ["region", "doc"]).join(_parts(placed.select("pivot").distinct(), labels, "pivot", "part_pivot"), "pivot")
    home = (F.col("nearest") <= reach + SLACK) & (F.col("apart") == F.col("nearest"))
    window = (F.col("nearest") > reach + SLACK) | (F.col("apart") <= F.col("nearest") + 2 * reach + SLACK)
    inside = written(parts.withColumn("home", home).where(F.col("home") | (window & (F.col("part") != F.col("part_pivot")))), "inside")
    border = inside.where("NOT home").groupBy("region", "pivot").agg(F.min("apart").alias("border"))
    reached = inside.join(border, ["region", "pivot"]).where(~F.col("home") | (F.col("apart") >= F.col("border") - reach - SLACK))
    outer = cells.select("region", "doc", "n", "size").join(nearest.where(F.col("nearest") <= reach + SLACK).select("region", "doc"), ["region", "doc"], "left_anti")
    inner = reached.select(F.col("region").alias("origin"), F.xxhash64("region", "pivot").alias("region"), "doc", "n", "apart", "home", F.col("size").alias("whole"))
    return inner.union(outer.select("region", F.xxhash64("region", F.lit("outer")), "doc", "n", F.lit(0.0), F.lit(True), "size"))


def _lessened(cells: DataFrame, divided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was divided into fewer pairs, without ``origin``, and the members of the cells that hold no more pairs whole."""
    sizes = divided.groupBy("origin", "region", "whole").agg(F.count(F.lit(1)).alias("size"))
    pairs = sizes.groupBy("origin", "whole").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"))
    grown = written(pairs.where(F.col("pairs") >= F.col("whole") * F.col("whole")).select("origin"), "grown")
    return divided.join(grown, "origin", "left_anti").drop("origin"), cells.join(grown.withColumnRenamed("origin", "region"), "region", "left_semi")


def _tile_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in open cells that the cell's pivot and their slices allow to be links.

    A cell's members are dealt into blocks and every two blocks meet in a tile of bounded size. One of a pair must be at
    home; a pair at home in several cells is looked at only in the first, which the tile reads off its members' lists.
    """
    window = _reach(percent) + SLACK

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        region, low, high = (table[c][0].as_py() for c in ("region", "low", "high"))
        docs, sizes, parts, blocks, apart, home = (table[c].to_numpy() for c in ("doc", "n", "part", "block", "apart", "home"))
        lists = [np.array(x or [], np.int64) if at_home else np.empty(0, np.int64) for x, at_home in zip(table["regions"].to_pylist(), home, strict=True)]
        earlier = [x[x < region] for x in lists]
        names, at = np.unique(np.concatenate(earlier), return_inverse=True)
        held = np.zeros((len(docs), max(len(names), 1)), np.float32)
        held[np.repeat(np.arange(len(docs)), list(map(len, earlier))), at] = 1
        counts = np.frombuffer(b"".join(table["slices"].to_pylist()), np.uint8).reshape(-1, SLICES).astype(np.int16)
        left, right = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
        found = []
        for i in left.tolist():
            others = right[right > i] if low == high else right
            close = (parts[others] != parts[i]) & (np.minimum(sizes[others], sizes[i]) * 100 >= np.maximum(sizes[others], sizes[i]) * percent)
            others = others[close & (home[others] | home[i]) & (np.abs(apart[others] - apart[i]) <= window)]
            others = others[held[others] @ held[i] == 0]
            gaps = np.abs(counts[others] - counts[i]).sum(axis=1, dtype=np.int64)
            near = others[gaps * (100 + percent) <= (sizes[others] + sizes[i]) * (100 - percent)]
            found.append(np.stack([np.minimum(docs[near], docs[i]), np.maximum(docs[near], docs[i])]))
        both = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return pa.table({"a": pa.array(both[0]), "b": pa.array(both[1])})

    lists = open_.where("home").groupBy("doc").agg(F.collect_list("region").alias("regions"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    members = open_.join(sets.select("doc", "slices").join(lists, "doc", "left"), "doc").withColumn("block", F.pmod(F.xxhash64("doc", F.lit(2)), blocks).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiles = dealt.select("region", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc", "n", "part", "apart", "home", "slices", "regions")
    return tiles.groupBy("region", "low", "high").applyInArrow(run, "a long, b long").distinct()


def _common(rows: np.ndarray, found: np.ndarray, points: int, left: int, right: int) -> np.ndarray:
    """How many shingles each of the first ``left`` points shares with each of the last ``right``.

    Where the two ranges are the same points, only what lies above the diagonal is right.
    """
    common = np.zeros((left, right), np.float32)
    first = points - right
    order = np.argsort(found, kind="stable")
    found, rows = found[order], rows[order]
    starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    counts = np.diff(starts, append=len(found))
    rare = COMMON if points > 64 else 1
    for n in np.unique(counts[(counts > 1) & (counts <= rare)]).tolist():
        held = rows[starts[counts == n][:, None] + np.arange(n)]
        for i in range(n - 1):
            a, b = np.repeat(held[:, i], n - 1 - i), held[:, i + 1 :].ravel()
            across = (a < left) & (b >= first)
            np.add.at(common, (a[across], b[across] - first), np.float32(1))
    wide = np.flatnonzero(counts > rare)
    for at in range(0, len(wide), 4096):
        some = wide[at : at + 4096]
        dense = np.zeros((points, len(some)), np.float32)
        width = counts[some]
        column = np.repeat(np.arange(len(some)), width)
        dense[rows[np.repeat(starts[some] - np.cumsum(width) + width, width) + np.arange(width.sum())], column] = 1
        common += dense[:left] @ dense[first:].T
    return common


def _tile_links(table: pa.Table, percent: int) -> pa.RecordBatch:
    """(doc, linked) of one tile: how many documents the links to the other points of the tile reach."""
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    docs, copies, blocks = (table[c].to_numpy() for c in ("doc", "copies", "block"))
    order = np.lexsort((docs, blocks))
    order = order[np.concatenate([[True], docs[order][1:] != docs[order][:-1]])]
    docs, copies, blocks = docs[order], copies[order].astype(np.float64), blocks[order]
    column = table["shingles"]
    sets = [np.frombuffer(column[i].as_buffer(), np.uint64) for i in order.tolist()]
    sizes = np.array(list(map(len, sets)), np.float32)
    points = len(docs)
    left = points if low == high else int((blocks == low).sum())
    first = 0 if low == high else left
    common = _common(np.repeat(np.arange(points), sizes.astype(np.int64)), np.concatenate(sets), points, left, points - first)
    # whole numbers far below 2 ** 53
    linked = (common > 0) & (common.astype(np.float64) * (100 + percent) >= percent * (sizes[:left, None].astype(np.float64) + sizes[first:]))
    if low == high:
        linked = np.triu(linked, 1)
    linked = linked.astype(np.float64)
    reached = np.zeros(points)
    reached[:left] += linked @ copies[first:]
    reached[first:] += linked.T @ copies[:left]
    return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(reached.astype(np.int64))], ["doc", "linked"])


def _linked(labels: DataFrame, sets: DataFrame, copies: DataFrame, percent: int) -> DataFrame:
    """(doc, linked) of every point with links: the number of documents with other sets that it links with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()] if batch.num_rows else []
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if held and key != tuple(keys[:, start]):
                    yield _tile_links(pa.Table.from_batches(held), percent)
                    held = []
                key = tuple(keys[:, start])
                held.append(batch.slice(start, end - start))
        if held:
            yield _tile_links(pa.Table.from_batches(held), percent)

    members = labels.select(F.col("node").alias("doc"), "component").union(labels.select("component", "component").distinct())
    whole = members.join(sets, "doc").join(copies, "doc")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / COUNT_BLOCK), F.ceil(F.sum("n") / COUNT_SHINGLES)).cast("int").alias("blocks")
    sized = members.join(sets.select("doc", "n"), "doc").groupBy("component").agg(blocks).where("blocks > 1")
    count = F.coalesce("blocks", F.lit(1))
    dealt = whole.join(sized, "component", "left").withColumn("block", F.pmod(F.xxhash64("doc", F.lit(3)), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    tile = ["component", "low", "high"]
    tiles = dealt.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc", "copies", "shingles")
    found = tiles.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(run, "doc long, linked long")
    return found.groupBy("doc").agg(F.sum("linked").alias("linked")).where("linked > 0")


def _joined(docs: DataFrame, percent: int, id_column: str, text_column: str, count: bool) -> DataFrame:
    """doc_id, n_shingles and component_id of every row and, with ``count``, n_links."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    named = texts.where("doc IS NOT NULL")
    met = F.count(F.lit(1)).over(Window.partitionBy("region", "salt"))
    rows = written(_region_rows(named, percent).withColumn("met", met).where("met > 1 OR salt > 0 OR doc IS NOT NULL").drop("met", "salt"), "regions")
    owners = rows.where("doc IS NOT NULL").select("doc", "point", "n")
    points = written(owners.where("n > 0").distinct().groupBy("point").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("copies")), "points")

    # copies of a set from different tasks may stand twice in a region, which only lets their documents leave less
    members = rows.where("doc IS NULL").select("region", F.col("point").alias("doc"), "n")
    sizes = members.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("doc").alias("first"), F.max("doc").alias("last"), F.bit_xor(F.xxhash64("doc")).alias("who")).where("first <> last")
    alike = members.join(sizes, "region").select(F.xxhash64("who", "size", "first", "last").alias("region"), "doc", "n", "size")
    weighed = alike.groupBy("region", "doc", "n", "size").agg(F.count(F.lit(1)).alias("weight"))

    # a link shares regions of a total weight of at least `lowest`, so its smallest shared region is never among the
    # largest regions of either side that weigh less together; those are left out, and documents with too few altogether
    largest_first = Window.partitionBy("doc").orderBy(F.col("size").desc(), F.col("region")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = written(weighed.withColumn("reached", F.sum("weight").over(largest_first)).where(F.col("reached") >= _lowest("n", percent)).select("region", "doc", "n", "weight"), "kept")
    fewer = kept.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    active = kept.join(fewer, "region")
    small = active.where(F.col("size") <= SMALL_REGION)
    large = written(active.where(F.col("size") > SMALL_REGION).select("region", "doc", "n"), "large")
    sides = [small.select("region", "weight", *[F.col(c).alias(f"{c}_{x}") for c in ("doc", "n")]) for x in "ab"]
    met = sides[0].join(sides[1].drop("weight"), "region").where((F.col("doc_a") < F.col("doc_b")) & _ratio(percent, "n_a", "n_b"))
    pairs = written(met.groupBy(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).agg(F.sum("weight").alias("weight")), "pairs")
    wanted = pairs.select(F.col("a").alias("point")).union(pairs.select(F.col("b").alias("point"))).union(large.select(F.col("doc").alias("point"))).distinct()
    sets = written(_sets(named.join(wanted.join(points, "point").select(F.col("least").alias("doc")).distinct(), "doc").select("doc", "text")), "sets")

    # every document and the pivot it shares most with; then what pivots and small regions left apart
    pivots = pairs.groupBy("b").agg(F.max_by("a", F.struct("weight", -F.col("a"))).alias("a")).select("a", "b")
    links = cut(_linking(_measured(_near(pivots.union(_elected(large, percent)).distinct(), sets, percent), sets), percent))
    labels = cut(components(links))
    apart = _parts(_parts(pairs.join(pivots, ["a", "b"], "left_anti").select("a", "b"), labels, "a", "part_a"), labels, "b", "part_b")
    links = cut(links.union(_linking(_measured(_near(apart.where("part_a <> part_b").select("a", "b"), sets, percent), sets), percent)))
    labels = cut(components(links))
    cells, left = large.withColumns({"apart": F.lit(0.0), "home": F.lit(True), "whole": F.lit(2**62)}), []
    columns = cells.columns[1:]
    for level in range(LEVELS + 1):
        open_ = _open(cells, labels)
        if open_.isEmpty():
            break
        # a cell that kept more than half of its region is not divided again, as its members are all far apart
        divides = (F.col("size") > CELL) & (2 * F.col("size") <= F.col("whole")) if level < LEVELS else F.lit(False)
        left.append(open_.where(~divides).select(F.xxhash64("region", F.lit(level)).alias("region"), *columns))
        wide = open_.where(divides)
        if wide.isEmpty():
            break
        placed, found = _faced(wide, sets, percent)
        links = cut(links.union(found))
        labels = cut(components(links))
        cells, same = _lessened(wide, written(_divided(wide, placed, labels, percent), "cells"))
        left.append(same.select(F.xxhash64("region", F.lit(level)).alias("region"), *columns))
    if left:
        # where nothing was divided, no links were found since the regions were opened
        still = open_ if len(left) == 1 else _open(reduce(DataFrame.union, left), labels)
        labels = cut(components(cut(links.union(_linking(_measured(_tile_pairs(still, sets, percent), sets), percent)))))

    grouped = points.join(labels.withColumnRenamed("node", "point"), "point", "left").withColumn("group", F.coalesce("component", "point"))
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    known = grouped.join(least, "group").select("point", "copies", "component_id")
    shown = [F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component_id")]
    empty = owners.where("n = 0").withColumn("component_id", F.col("doc"))
    unnamed = _sets(texts.where("doc IS NULL")).select(F.lit(None).cast("long").alias("doc"), "n").withColumn("component_id", F.lit(None).cast("long"))
    if count:
        linked = _linked(labels, sets, points.select(F.col("point").alias("doc"), "copies"), percent)
        known = known.join(linked.withColumnRenamed("doc", "point"), "point", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("linked", F.lit(0)))
        empty = empty.withColumn("n_links", F.lit(0).cast("long"))
        unnamed = unnamed.withColumn("n_links", F.lit(None).cast("long"))
        shown.append(F.col("n_links"))
    full = owners.where("n > 0").join(known, "point")
    return full.select(*shown).union(empty.select(*shown)).union(unnamed.select(*shown))


def join_components(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest id that links reach, the own included."""
    return _joined(docs, percent, id_column, text_column, False)


def join_links(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The columns of ``join_components`` and n_links: how many other documents the row's document links with.

    Every link counts, those between copies of one text included.
    """
    return _joined(docs, percent, id_column, text_column, True)


#: DuckDB, over documents: every pair that shares a shingle, then all that links reach.
ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), held AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM texts WHERE len(w) > 0
), sizes AS MATERIALIZED (
  SELECT t.doc_id, count(h.s) AS n FROM texts t LEFT JOIN held h ON h.doc_id = t.doc_id GROUP BY t.doc_id
), links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM held x JOIN held y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes i ON i.doc_id = p.a JOIN sizes j ON j.doc_id = p.b WHERE 100 * p.n >= 80 * (i.n + j.n - p.n)
), reach AS (
  SELECT doc_id AS node, doc_id AS least FROM sizes UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.node
)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, r.least AS component_id, coalesce(c.n, 0) AS n_links
FROM sizes s JOIN (SELECT node, min(least) AS least FROM reach GROUP BY node) r ON r.node = s.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = s.doc_id
"""
