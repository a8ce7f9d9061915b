"""Row numbers over a total order, pages and runs, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import written

PAGE_ROWS = 10


def numbers_from_parts(rows: DataFrame, name: str) -> DataFrame:
    """Number rows that carry their ``part`` and 0-based ``pos`` in it, from 1. The offsets are one row per part."""
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "part").withColumn(name, F.col("offset") + F.col("pos") + 1).drop("part", "pos", "offset")


def numbered(frame: DataFrame, *order: Column | str, name: str = "row_no") -> DataFrame:
    """Add each row's number in ``order``, from 1: range partitions are sorted alone and joined with their offsets."""
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = ranged.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()})
    rows = written(marked.withColumn("pos", F.col("pos") - F.shiftleft(F.col("part").cast("long"), 33)), "numbered")
    return numbers_from_parts(rows, name)


def running(frame: DataFrame, key: str, sums: dict[str, str]) -> DataFrame:
    """Add, for each column of ``sums``, its total over all rows before this one in the order of the distinct ``key``.

    Range partitions add up alone and are joined with the totals of those before them, one row per partition.
    """
    ranged = written(frame.repartitionByRange(key).withColumn("part", F.spark_partition_id()), "running")
    parts = ranged.groupBy("part").agg(*[F.sum(c).alias(f"all_{c}") for c in sums])
    before, inside = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (Window.orderBy("part"), Window.partitionBy("part").orderBy(key)))
    offsets = parts.select("part", *[F.coalesce(F.sum(f"all_{c}").over(before), F.lit(0)).alias(f"off_{c}") for c in sums])
    added = ranged.join(F.broadcast(offsets), "part")
    return added.select(*frame.columns, *[(F.col(f"off_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(name) for c, name in sums.items()])


def occupancy(pages: DataFrame, size: int = PAGE_ROWS) -> DataFrame:
    """(page_no, n_rows, is_full, is_empty) of each page."""
    counted = pages.groupBy("page_no").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select("page_no", "n_rows", (F.col("n_rows") == size).alias("is_full"), (F.col("n_rows") == 0).alias("is_empty"))


def paged(rows: DataFrame, size: int = PAGE_ROWS) -> DataFrame:
    """Add the 0-based page of each numbered row."""
    return rows.withColumn("page_no", F.floor((F.col("row_no") - 1) / size))


def runs(pages: DataFrame, run_pages: int, key: str) -> DataFrame:
    """Sorted runs of ``run_pages`` pages: first and last key and number of rows."""
    return pages.groupBy(F.floor(F.col("page_no") / run_pages).alias("run_id")).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.lit(1)).alias("rows"))


def page_count(rows: Column, size: int = PAGE_ROWS) -> Column:
    return F.ceil(rows / size).cast("long")


def summary(frame: DataFrame, name: str) -> DataFrame:
    """One row: the table's name, its rows, pages and columns."""
    counted = frame.agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(F.lit(name).alias("table_name"), "n_rows", page_count(F.col("n_rows")).alias("n_pages"), F.lit(len(frame.columns)).cast("long").alias("n_columns"))
