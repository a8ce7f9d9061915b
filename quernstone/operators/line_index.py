"""A secondary index as a relation of (key, line_no), and the replay of command scripts against it.

The index is a bag: inserting a key again adds its lines again. Stored as Parquet sorted by key, a lookup reads the row
groups whose range holds the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import field, int_prefix, split_fields
from quernstone.session import written


def line_keys(lines: DataFrame, position: int, width: int) -> DataFrame:
    """(key, line_no) of the lines of ``width`` fields whose field at ``position`` begins with an integer."""
    fields = lines.select("line_no", split_fields("value").alias("f")).where(F.size("f") == width)
    return fields.select(int_prefix(field("f", position)).alias("key"), "line_no").where("key IS NOT NULL")


def build(entries: DataFrame, path: str) -> None:
    """Store entries, sorted by key in range partitions; earlier ones stay."""
    entries.repartitionByRange("key").sortWithinPartitions("key", "line_no").write.mode("append").parquet(path)


ENTRY = "key int, line_no long"


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored entries; an index that is not there yet is created empty."""
    try:
        return spark.read.schema(ENTRY).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    spark.createDataFrame([], ENTRY).write.mode("append").parquet(path)
    return spark.read.schema(ENTRY).parquet(path)


def records(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, line_no, record) of all entries; a line that is not there is the empty text."""
    return entries.join(lines.select("line_no", F.col("value").alias("record")), "line_no", "left").select("key", "line_no", F.coalesce("record", F.lit("")).alias("record"))


def matches(entries: DataFrame, key: int) -> DataFrame:
    """The line numbers of a key, a row each, however many."""
    return entries.where(F.col("key") == key).select("line_no")


def search(entries: DataFrame, key: int) -> DataFrame:
    """One row: the key, how many lines it has and the answer's text."""
    found = entries.where(F.col("key") == key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("line_no")), ",").alias("lines"))
    return found.select(F.lit(key).alias("key"), "n", _answer(F.lit(key), F.col("n"), F.col("lines")).alias("answer"))


def _answer(key, n, lines):
    return F.when(n > 0, F.concat(F.lit("FOUND "), key.cast("string"), F.lit(" LINES "), lines)).otherwise(F.concat(F.lit("NOT FOUND "), key.cast("string")))


def script_order(lines: DataFrame) -> int:
    """The order that a script's header ``FLH/<order>`` gives; another header, or an order below 3, is an error."""
    first = lines.where("line_no = 1").select("value", int_prefix(F.substring("value", 5, 20)).alias("order")).first()
    if first is None or not first["value"].startswith("FLH/") or first["order"] is None or first["order"] < 3:
        raise ValueError(f"a script begins with FLH/<order> of at least 3, not with {first and first['value']!r}")
    return first["order"]


def parse_commands(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq, op, key) of insert and search commands, and the lines that are neither, blank or a comment.

    The first line of a script is its header, which ``script_order`` reads.
    """
    body = lines.where((F.col("line_no") > 1) & (F.col("value") != "") & ~F.col("value").startswith("#"))
    cut = body.select(F.col("line_no").alias("seq"), "value", F.substring_index("value", ":", 1).alias("op"), F.regexp_extract("value", r"^[^:]*:(.*)$", 1).alias("rest"))
    keyed = cut.withColumn("key", int_prefix("rest"))
    good = F.col("op").isin("INC", "BUS=") & F.col("key").isNotNull()
    return keyed.where(good).select("seq", "op", "key"), keyed.where(~F.coalesce(good, F.lit(False))).select("seq", "value")


def replay(commands: DataFrame, entries: DataFrame) -> DataFrame:
    """Answers of all searches: each sees the lines of every earlier insert of its key, as often as it was inserted.

    Inserts are counted by a join of commands with commands; the entries are aggregated by key once, and only for keys
    that the script names.
    """
    asks = commands.where("op = 'BUS='").select("seq", "key")
    puts = commands.where("op = 'INC'").select(F.col("seq").alias("put"), "key")
    times = asks.join(puts, "key", "left").groupBy("seq", "key").agg(F.count(F.when(F.col("put") < F.col("seq"), 1)).alias("times"))
    wanted = entries.join(commands.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list("line_no")).alias("once"))
    held = times.join(wanted, "key", "left").withColumn("once", F.coalesce("once", F.array().cast("array<bigint>")))
    lines = F.flatten(F.transform("once", lambda x: F.array_repeat(x, F.col("times").cast("int"))))
    counted = held.withColumn("lines", lines).withColumn("n", F.size("lines").cast("long"))
    return counted.select("seq", "key", "n", _answer(F.col("key"), F.col("n"), F.array_join("lines", ",")).alias("answer"))


def leaf_pages(numbered: DataFrame, order: int) -> DataFrame:
    """The index's leaves as pages of ``order - 1`` entries: first and last key and number of entries of each."""
    page = F.floor((F.col("row_no") - 1) / (order - 1)).alias("leaf")
    return numbered.groupBy(page).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("entries"))


def header(lines: DataFrame) -> DataFrame:
    """(root_id, next_node_id) of an index file's lines; 0 and 1 where they are missing or malformed."""
    value = lambda line, name: F.max(F.when((F.col("line_no") == line) & F.col("value").startswith(name), int_prefix(F.substring("value", len(name) + 1, 20))))
    return lines.agg(F.coalesce(value(1, "ROOT_ID:"), F.lit(0)).alias("root_id"), F.coalesce(value(2, "NEXT_NODE_ID:"), F.lit(1)).alias("next_node_id"))


def nodes(lines: DataFrame) -> DataFrame:
    """(node_id, is_leaf, keys, pointers, previous, following) of the well-formed node lines of an index file.

    From line 3 on, a node a line: ``L;n;keys;pointers;previous;next;`` or ``I;n;keys;children;`` with n + 1 children.
    """
    cut = lines.where("line_no > 2").select((F.col("line_no") - 2).alias("node_id"), split_fields("value", ";").alias("f"))
    kind, n = field("f", 0), int_prefix(field("f", 1))
    numbers = F.transform(F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0))), int_prefix)
    typed = cut.select("node_id", (kind == "L").alias("is_leaf"), kind.isin("L", "I").alias("known"), n.alias("n"), numbers.alias("x"))
    width = F.when(F.col("is_leaf"), 2 * F.col("n") + 2).otherwise(2 * F.col("n") + 1)
    good = typed.where(F.col("known") & (F.col("n") >= 0) & (F.size("x") >= width) & F.forall(F.slice("x", F.lit(1), width), lambda v: v.isNotNull()))
    pointers = F.slice("x", F.col("n") + 1, F.when(F.col("is_leaf"), F.col("n")).otherwise(F.col("n") + 1))
    end = lambda at: F.when(F.col("is_leaf"), F.get("x", 2 * F.col("n") + at))
    return good.select("node_id", "is_leaf", F.slice("x", 1, F.col("n")).alias("keys"), pointers.alias("pointers"), end(0).alias("previous"), end(1).alias("following"))


def node_entries(nodes: DataFrame) -> DataFrame:
    """(key, line_no) of all leaves."""
    return nodes.where("is_leaf").select(F.inline(F.arrays_zip("keys", "pointers"))).select(F.col("keys").alias("key"), F.col("pointers").cast("long").alias("line_no"))


def index_lines(numbered: DataFrame, order: int) -> DataFrame:
    """(line_no, value): the lines of an index file that holds the entries, numbered by key, in a tree filled from the left.

    Leaves hold ``order - 1`` entries and come first, then each level of inner nodes with ``order`` children up to the
    root; there are as many rounds as the tree has levels. An inner node's keys are the first keys of its children but one.
    """
    def joined(values: Column) -> Column:
        return F.array_join(F.transform(values, lambda v: v.cast("string")), ";")

    entry = F.array_sort(F.collect_list(F.struct("row_no", "key", "line_no")))
    level = written(numbered.groupBy(F.floor((F.col("row_no") - 1) / (order - 1)).alias("at")).agg(entry.alias("e")), "leaves")
    first, count = 1, level.count()
    following = F.when(F.col("at") + 1 < count, F.col("at") + 2).otherwise(0)
    body = F.concat_ws(";", F.lit("L"), F.size("e").cast("string"), joined(F.col("e.key")), joined(F.col("e.line_no")), F.col("at").cast("string"), following.cast("string"), F.lit(""))
    lines = [level.select((F.col("at") + 3).alias("line_no"), body.alias("value"))]
    level = level.select("at", F.col("e")[0]["key"].alias("least"))
    while count > 1:
        child = F.array_sort(F.collect_list(F.struct((F.col("at") + first).alias("id"), "least")))
        level = written(level.groupBy(F.floor(F.col("at") / order).alias("up")).agg(child.alias("c")).withColumnRenamed("up", "at"), "level")
        first, count = first + count, level.count()
        inner = F.concat_ws(";", F.lit("I"), (F.size("c") - 1).cast("string"), F.nullif(joined(F.slice("c.least", 2, F.size("c"))), F.lit("")), joined(F.col("c.id")), F.lit(""))
        lines.append(level.select((F.col("at") + first + 2).alias("line_no"), inner.alias("value")))
        level = level.select("at", F.col("c")[0]["least"].alias("least"))
    head = numbered.sparkSession.createDataFrame([(1, f"ROOT_ID:{first if count else 0}"), (2, f"NEXT_NODE_ID:{first + count}")], "line_no long, value string")
    return reduce(DataFrame.union, lines, head)
