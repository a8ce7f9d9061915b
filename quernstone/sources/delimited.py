"""Delimited text in and out: headed tables, bare rows, numbered lines, page files and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions.text import join_fields, split_fields, zero_padded
from quernstone.operators.paging import PAGE_ROWS, numbered, numbers_from_parts


def read_table(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A headed file as text columns. No quotes, no inference; blank lines are skipped and missing fields are empty."""
    return spark.read.options(header="true", sep=separator, quote="", inferSchema="false").csv(path).na.fill("")


def read_rows(spark: SparkSession, path: str, columns: list[str], separator: str = ";") -> DataFrame:
    """A file of bare rows, one per line, as the named text columns."""
    fields = split_fields("value", separator)
    lines = spark.read.text(path).where("value <> ''").select(fields.alias("f"))
    return lines.select(*[F.coalesce(F.get("f", i), F.lit("")).alias(c) for i, c in enumerate(columns)])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): physical lines, numbered from 1. Each file split counts its own; one row per split is joined."""
    marked = spark.read.text(path).select(F.rtrim("value", F.lit("\r")).alias("value"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"))
    return numbers_from_parts(marked.withColumn("pos", F.col("id") - F.shiftleft(F.col("part").cast("long"), 33)), "line_no").select("line_no", "value")


def line_at(lines: DataFrame, number: int) -> DataFrame:
    """The text of one line; the empty text if there is none."""
    return lines.where(F.col("line_no") == number).agg(F.coalesce(F.max("value"), F.lit("")).alias("value"))


def width_is(lines: DataFrame, width: int, separator: str = ",") -> DataFrame:
    """Lines of exactly ``width`` fields."""
    return lines.where(F.size(split_fields("value", separator)) == width)


def page_texts(paged: DataFrame, columns: list[str], separator: str = ";", order: str = "row_no") -> DataFrame:
    """(page_no, page): each page's rows as one text, a line per row. A page has a bounded number of rows."""
    rows = paged.select("page_no", F.struct(F.col(order).alias("o"), join_fields(columns, separator).alias("row")).alias("r"))
    ordered = F.array_sort(F.collect_list("r"))
    return rows.groupBy("page_no").agg(F.array_join(F.transform(ordered, lambda r: r["row"]), "\n").alias("page"))


def rows_of_pages(pages: DataFrame, separator: str = ";") -> DataFrame:
    """(page_no, row_in_page, fields): at most one page of rows of each text."""
    lines = F.slice(F.split("page", "\n"), 1, PAGE_ROWS)
    return pages.select("page_no", F.posexplode(lines).alias("row_in_page", "row")).select("page_no", "row_in_page", split_fields("row", separator).alias("fields"))


def write_pages(paged: DataFrame, path: str, columns: list[str], separator: str = ",", first: int = 1, padded: bool = True) -> None:
    """One folder per page below ``path``, without a header; older pages are replaced.

    A folder is named by the page's number from ``first`` on, of two digits at least if ``padded``.
    """
    number = F.col("page_no") + first
    named = paged.select((zero_padded(number) if padded else number.cast("string")).alias("page"), "row_no", join_fields(columns, separator).alias("value"))
    named.repartition("page").sortWithinPartitions("page", "row_no").select("page", "value").write.mode("overwrite").partitionBy("page").text(path)


def read_pages(spark: SparkSession, path: str, columns: list[str], separator: str = ",") -> DataFrame:
    """(page, row_in_page) and the named text columns of all pages below ``path``, in the order of the pages' names.

    ``scan_order`` numbers the pages by name as texts, so that unpadded page 10 comes before page 2. A page is one small
    file, whose rows keep their order; only page names, one row a page, are ordered as a whole.
    """
    texts = spark.read.option("recursiveFileLookup", "true").text(path).where("value <> ''")
    page = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"page=([^/]+)/[^/]*$", 1)
    rows = texts.select(page.alias("page"), F.monotonically_increasing_id().alias("at"), split_fields("value", separator).alias("f"))
    within = F.row_number().over(Window.partitionBy("page").orderBy("at")) - 1
    placed = rows.withColumn("row_in_page", within)
    names = numbered(rows.select("page").distinct(), "page", name="scan_order").withColumn("scan_order", F.col("scan_order") - 1)
    return placed.join(names, "page").select("scan_order", "page", "row_in_page", *[F.coalesce(F.get("f", i), F.lit("")).alias(c) for i, c in enumerate(columns)])


#: Fixed value: what the name of a join's result begins with.
RESULT = "resultado_juncao"


def result_name(left: str, right: str) -> str:
    """The name of the file that a join of two table files goes to when none is given."""
    return f"{RESULT}_{left.partition('.')[0]}_{right.partition('.')[0]}.csv"


def write_join(joined: DataFrame, folder: str, left: str, right: str, header: bool = False) -> str:
    """All rows of a join under the name made of its tables' file names; returns the path."""
    path = f"{folder.rstrip('/')}/{result_name(left, right)}"
    if header:
        joined.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in joined.columns]).write.mode("overwrite").options(header="true", quote="", escape="", emptyValue="").csv(path)
    else:
        write_rows(joined, path)
    return path


def write_rows(frame: DataFrame, path: str, separator: str = ",") -> None:
    """All rows without a header and without quotes."""
    frame.select(join_fields(frame.columns, separator).alias("value")).write.mode("overwrite").text(path)


def write_logs(log: DataFrame, path: str) -> None:
    """The access log of each item in a folder of its own, in order."""
    line = F.concat_ws(" ", "schedule", "kind", F.col("moment").cast("string"))
    log.repartition("item").sortWithinPartitions("item", "schedule", "moment").select("item", line.alias("value")).write.mode("overwrite").partitionBy("item").text(path)
