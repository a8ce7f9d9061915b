"""Serializability of transaction schedules under timestamp ordering.

``ops`` has (schedule, moment, kind, txn, ts, item); kinds are r, w and c, moments count from 0, and ts is at least 0. A
commit, by whichever transaction, resets the timestamps of all items.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import clean_token

#: The verdict needs no abort set: before the first violation every operation was accepted, so the state is a running
#: maximum, and the first operation against it is the first violation. Runs in any SQL engine with windows.
VERDICT_SQL = """
WITH epochs AS (
  SELECT *, sum(CASE WHEN kind = 'c' THEN 1 ELSE 0 END) OVER (PARTITION BY schedule ORDER BY moment ROWS UNBOUNDED PRECEDING) AS epoch FROM {ops}
), states AS (
  SELECT schedule, moment, kind, ts,
    coalesce(max(CASE WHEN kind = 'r' THEN ts END) OVER (PARTITION BY schedule, item, epoch ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS read_ts,
    coalesce(max(CASE WHEN kind = 'w' THEN ts END) OVER (PARTITION BY schedule, item, epoch ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS write_ts
  FROM epochs
), firsts AS (
  SELECT schedule, min(CASE WHEN (kind = 'r' AND ts < write_ts) OR (kind = 'w' AND (ts < read_ts OR ts < write_ts)) THEN moment END) AS moment FROM states GROUP BY schedule
)
SELECT schedule, moment AS rollback_moment, CASE WHEN moment IS NULL THEN concat(CAST(schedule AS {text}), '-OK') ELSE concat(CAST(schedule AS {text}), '-ROLLBACK-', CAST(moment AS {text})) END AS verdict FROM firsts
"""


def verdicts(ops: DataFrame) -> DataFrame:
    """Per schedule the moment of its first rollback, if any, and the verdict's text."""
    return ops.sparkSession.sql(VERDICT_SQL.format(ops="{ops}", text="STRING"), ops=ops)


LOG = "schedule {kind}, item string, kind string, moment long, violates boolean"


def access_log(ops: DataFrame) -> DataFrame:
    """(schedule, item, kind, moment, violates) of every logged operation, by a fold over each schedule's operations.

    Operations of a transaction that was rolled back are neither logged nor applied, but take their moments; a violating
    operation is logged. Operations stream by in order, so that only the items' timestamps and the rolled back
    transactions of one schedule are held, however long it is.
    """
    kept = ops.select("schedule", "moment", "kind", "txn", F.col("ts").cast("long").alias("ts"), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reads, writes, gone = object(), {}, {}, set()
        for batch in batches:
            log = []
            for schedule, moment, kind, txn, ts, item in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if schedule != at:
                    at, reads, writes, gone = schedule, {}, {}, set()
                if kind == "c":
                    reads, writes = {}, {}
                elif txn not in gone:
                    violates = ts < writes.get(item, -1) or (kind == "w" and ts < reads.get(item, -1))
                    log.append((schedule, item, kind.upper(), moment, violates))
                    if violates:
                        gone.add(txn)
                    elif kind == "w":
                        writes[item] = ts
                    else:
                        reads[item] = max(reads.get(item, -1), ts)
            kinds = [batch.schema.field("schedule").type, pa.string(), pa.string(), pa.int64(), pa.bool_()]
            columns = list(zip(*log, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["schedule", "item", "kind", "moment", "violates"])

    ordered = kept.repartition("schedule").sortWithinPartitions("schedule", "moment")
    return ordered.mapInArrow(run, LOG.format(kind=ops.schema["schedule"].dataType.simpleString()))


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Items, schedules (schedule, name), operations and rejected operations of a schedule file's numbered lines.

    Lines 1 to 3 name items, transactions and their timestamps; each further line is a schedule ``name-op op ...``, known
    by its line's number, as names may repeat; a line without a hyphen is name and operations at once. An unknown
    transaction has timestamp 0. Operations of an unknown kind or form are rejected and take no moment.
    """

    def listed(line: int, name: str) -> DataFrame:
        cells = lines.where(F.col("line_no") == line).select(F.posexplode(F.split("value", ",")).alias("at", "cell"))
        return cells.select("at", clean_token("cell").alias(name)).where(F.col(name) != "")

    items = listed(1, "item").select("item")
    stamps = listed(2, "name").join(listed(3, "ts"), "at").select(F.regexp_replace("name", "^t", "").alias("txn"), F.col("ts").try_cast("int").alias("ts"))
    rest = F.when(F.contains("value", F.lit("-")), F.regexp_extract("value", "^[^-]*-(.*)$", 1)).otherwise(F.col("value"))
    named = lines.where((F.col("line_no") > 3) & (F.trim("value") != "")).select(F.col("line_no").alias("schedule"), F.trim(F.substring_index("value", "-", 1)).alias("name"), rest.alias("rest"))
    tokens = named.select("schedule", "name", F.posexplode(F.filter(F.split("rest", r"\s+"), lambda t: t != "")).alias("at", "token"))
    cut = tokens.withColumn("good", F.regexp_like("token", F.lit(r"^([rw]\w+\(\w+\)|c\w+);?$")))
    good = cut.where("good").select("schedule", "at", F.substring("token", 1, 1).alias("kind"), F.regexp_extract("token", r"^.(\w+)", 1).alias("txn"), F.nullif(F.regexp_extract("token", r"\((\w+)\)", 1), F.lit("")).alias("item"))
    moment = F.row_number().over(Window.partitionBy("schedule").orderBy("at")) - 1
    ops = good.withColumn("moment", moment).join(stamps, "txn", "left")
    return items, named.select("schedule", "name"), ops.select("schedule", "moment", "kind", "txn", F.coalesce("ts", F.lit(0)).alias("ts"), "item"), cut.where("NOT good").select("schedule", "name", "token")


def file_verdicts(schedules: DataFrame, ops: DataFrame) -> DataFrame:
    """(schedule, name, rollback_moment, verdict) of every schedule of a file, those without any operation included."""
    found = schedules.join(verdicts(ops).drop("verdict"), "schedule", "left")
    answer = F.when(F.col("rollback_moment").isNull(), F.lit("OK")).otherwise(F.concat(F.lit("ROLLBACK-"), F.col("rollback_moment").cast("string")))
    return found.select("schedule", "name", "rollback_moment", F.concat_ws("-", "name", answer).alias("verdict"))


def file_log(schedules: DataFrame, ops: DataFrame) -> DataFrame:
    """The access log of a file's schedules under their names; ``line_no`` tells those of one name apart."""
    named = access_log(ops).join(schedules, "schedule")
    return named.select(F.col("schedule").alias("line_no"), F.col("name").alias("schedule"), "item", "kind", "moment", "violates")
