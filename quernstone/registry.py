"""The registered queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators import joins, line_index, paging, schedules
from quernstone.session import shared_path, table
from quernstone.sources import delimited

#: A command script: sequence number, operation, key.
COMMANDS = [(2, "INC", 1996), (3, "INC", 1998), (4, "BUS=", 1996), (5, "BUS=", 1997), (6, "INC", 1996), (7, "BUS=", 1996), (8, "BUS=", 2099), (9, "INC", 2099), (10, "BUS=", 1998)]
SCHEDULE_SIZE = 12
#: A command script over customers by nation, with blank lines, a comment and commands that are not known.
SCRIPT = ["FLH/4", "INC:7", "# a note", "", "BUS=:7", "INC:3", "BUS=:3", "INC:7", "PUT:7", "BUS=:7", "BUS=:x", "BUS=:12", "no colon", "INC:12x", "BUS=:12", "BUS=:99"]


def _paged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.paged(paging.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = paging.numbered(table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("key")), "o_orderkey")
    return orders.select("key", (F.col("row_no") + 1).alias("line_no"))


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules of twelve events each, by event number."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    kind = F.when(F.col("event_type").isin("view", "click"), "r").when(F.col("event_type").isin("purchase", "signup"), "w").when(F.col("event_type") == "error", "c")
    cut = events.withColumn("schedule", F.floor(F.col("event_id") / SCHEDULE_SIZE)).withColumn("kind", kind).where("kind IS NOT NULL")
    moment = F.row_number().over(Window.partitionBy("schedule").orderBy("ts", "event_id")) - 1
    item = F.when(F.col("kind") != "c", F.element_at(F.array(F.lit("X"), F.lit("Y"), F.lit("Z")), (F.col("event_id") % 3 + 1).cast("int")))
    return cut.select("schedule", moment.alias("moment"), "kind", F.col("user_id").alias("txn"), ((F.col("user_id") * 7) % 101).alias("ts"), item.alias("item"))


_OPS_SQL = """
(SELECT schedule, CAST(row_number() OVER (PARTITION BY schedule ORDER BY ts, event_id) AS INTEGER) - 1 AS moment, kind, user_id AS txn, (user_id * 7) % 101 AS ts,
   CASE WHEN kind <> 'c' THEN CASE event_id % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE 'Z' END END AS item
 FROM (SELECT event_id, ts, user_id, event_id // 12 AS schedule,
   CASE WHEN event_type IN ('view', 'click') THEN 'r' WHEN event_type IN ('purchase', 'signup') THEN 'w' WHEN event_type = 'error' THEN 'c' END AS kind FROM events) WHERE kind IS NOT NULL)
"""


def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation")


def row_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    return region.select(text.join_fields(region.columns, " ").alias("line"))


def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paged_orders(spark, sf_dir).select("o_orderkey", "row_no", "page_no")


def page_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paged_orders(spark, sf_dir).where("page_no BETWEEN 5 AND 7").select("page_no", "o_orderkey")


def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [paging.summary(table(spark, sf_dir, t), t) for t in ("orders", "customer", "supplier", "nation", "region")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


def _nation_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return paging.paged(paging.numbered(nation, "n_nationkey")), nation.columns


def page_serialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, columns = _nation_pages(spark, sf_dir)
    return delimited.page_texts(pages, columns)


def row_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, columns = _nation_pages(spark, sf_dir)
    rows = delimited.rows_of_pages(delimited.page_texts(pages, columns))
    return rows.select("page_no", *[text.field("fields", i).alias(c) for i, c in enumerate(columns)])


def external_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "customer").select("c_custkey", "c_name", text.text_key("c_custkey").alias("sort_key"))
    return paging.numbered(keyed, "sort_key", name="sort_rank")


def sort_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = paging.paged(paging.numbered(table(spark, sf_dir, "customer").select("c_custkey", text.text_key("c_custkey").alias("k")), "c_custkey"))
    return paging.runs(pages, 4, "k").withColumn("run_pages", F.lit(4)).union(paging.runs(pages, 3, "k").withColumn("run_pages", F.lit(3)))


def merge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return joins.key_join(orders, table(spark, sf_dir, "customer"), "o_custkey", "c_custkey")


def merge_join_m2m(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, customers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return joins.key_join(suppliers, customers, "s_nationkey", "c_nationkey")


def self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return joins.key_join(nation, nation, "n_regionkey", "n_regionkey")


def join_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.counters(table(spark, sf_dir, "orders").select("o_custkey"), table(spark, sf_dir, "customer").select("c_custkey"), "o_custkey", "c_custkey")


def tuple_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(*[F.col(c).cast("string").alias(c) for c in ("n_nationkey", "n_name", "n_regionkey")])
    return paging.numbered(nation, "n_nationkey", "n_name", "n_regionkey", name="tuple_rank")


def tuple_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["c_nationkey", "c_mktsegment"]
    return table(spark, sf_dir, "customer").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_equal")).where("n_equal > 1")


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir)


def index_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index.leaf_pages(paging.numbered(_entries(spark, sf_dir), "key", "line_no"), 64)


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index.search(_entries(spark, sf_dir), 1996)


def index_search_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index.search(_entries(spark, sf_dir), 1850)


def line_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = paging.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    lines = orders.select((F.col("row_no") + 1).alias("line_no"), text.join_fields(["o_orderkey", "o_orderstatus"], ",").alias("value"))
    return delimited.line_at(lines, 42).union(delimited.line_at(lines, 0))


def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg((F.count(F.lit(1)) + 1).alias("n_lines"))


def command_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index.replay(spark.createDataFrame(COMMANDS, "seq int, op string, key int"), _entries(spark, sf_dir))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return joins.membership(probes, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key")


def txn_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamps = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("txn"), ((F.col("user_id") * 7) % 101).alias("ts")).distinct()
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("txn")).join(stamps, "txn", "left").select("event_id", "txn", F.coalesce("ts", F.lit(0)).cast("long").alias("ts"))


def schedule_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedules.verdicts(_ops(spark, sf_dir))


def schedule_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedules.access_log(_ops(spark, sf_dir))


def token_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.clean_token(F.concat(F.lit(" "), "props", F.lit("; "))).alias("token"))


def int_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.int_prefix("o_orderpriority").alias("priority"), text.int_prefix(F.concat(F.lit(" -"), F.col("o_orderkey").cast("string"), F.lit("x"))).alias("negative"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("page_"), text.zero_padded("p_partkey"), F.lit(".csv.gz")).alias("file"))
    return named.select("p_partkey", "file", text.base_name("file").alias("base"))


def _text_file(frame: DataFrame, label: str, *order: str) -> str:
    """The path of one headed file of all columns, in order, as a user would have it."""
    path = shared_path(frame.sparkSession, label)
    frame.orderBy(*order).coalesce(1).write.options(header="true", quote="", escape="", emptyValue="").csv(path)
    return path


def _line_file(spark: SparkSession, numbered: DataFrame, label: str) -> DataFrame:
    """Lines (line_no, value) written as one text file and read again as physical lines."""
    path = shared_path(spark, label)
    numbered.orderBy("line_no").select("value").coalesce(1).write.text(path)
    return delimited.read_lines(spark, path)


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.read_table(spark, _text_file(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "csv", "s_suppkey"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    path = shared_path(spark, "pages")
    delimited.write_pages(paging.paged(paging.numbered(supplier, "s_suppkey")), path, supplier.columns, ";", 0, False)
    return delimited.read_pages(spark, path, supplier.columns, ";")


def page_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.occupancy(paging.paged(paging.numbered(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")))


def join_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    path = delimited.write_join(joins.key_join(nation, region, "n_regionkey", "r_regionkey"), shared_path(spark, "joined"), "nation.csv", "region.csv")
    return delimited.read_rows(spark, path, [*nation.columns, *region.columns], ",").withColumn("file", F.lit(path.rpartition("/")[2]))


def _customer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return delimited.read_lines(spark, _text_file(customers, "lines", "c_custkey"))


def key_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index.line_keys(_customer_lines(spark, sf_dir), 2, 4)


def width_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("value"))
    return delimited.width_is(said, 3).select("conv_id", "turn")


def index_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index.matches(_entries(spark, sf_dir), 1996)


def index_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "index")
    before = line_index.open_index(spark, path).count()
    line_index.build(_entries(spark, sf_dir), path)
    return line_index.open_index(spark, path).withColumn("before", F.lit(before).cast("long"))


def record_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _customer_lines(spark, sf_dir)
    return line_index.records(line_index.line_keys(lines, 2, 4).union(spark.createDataFrame([(7, 0)], line_index.ENTRY)), lines).where("key = 7")


def _index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index.index_lines(paging.numbered(_entries(spark, sf_dir), "key", "line_no"), 64)


def index_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index.node_entries(line_index.nodes(_line_file(spark, _index_file(spark, sf_dir), "nodes")))


def index_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index.header(_index_file(spark, sf_dir))


def _script(spark: SparkSession) -> DataFrame:
    return _line_file(spark, spark.createDataFrame(list(enumerate(SCRIPT, 1)), "line_no long, value string"), "script")


def script_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = _script(spark)
    order = line_index.script_order(script)
    commands, _ = line_index.parse_commands(script)
    return line_index.replay(commands, line_index.line_keys(_customer_lines(spark, sf_dir), 2, 4)).withColumn("order", F.lit(order))


def script_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index.parse_commands(_script(spark))[1]


def prefix_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.startswith("o_orderpriority", F.lit("1-")).alias("urgent"))


def _schedule_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a schedule file: twelve events a line, names that repeat, operations of an unknown kind among them."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    kind = F.when(F.col("event_type").isin("view", "click"), "r").when(F.col("event_type").isin("purchase", "signup"), "w").when(F.col("event_type") == "error", "c").otherwise("q")
    item = F.element_at(F.array(F.lit("X"), F.lit("Y"), F.lit("Z")), (F.col("event_id") % 3 + 1).cast("int"))
    token = F.concat(kind, F.col("user_id").cast("string"), F.when(kind != "c", F.concat(F.lit("("), item, F.lit(")"))).otherwise(""))
    placed = events.select(F.floor(F.col("event_id") / SCHEDULE_SIZE).alias("s"), F.struct("ts", "event_id", token.alias("t")).alias("op"))
    ops = placed.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list("op")), lambda o: o["t"]), " ").alias("ops"))
    users = events.select("user_id").distinct().agg(F.array_sort(F.collect_list("user_id")).alias("u"))
    heads = users.select(F.array_join(F.transform("u", lambda u: F.concat(F.lit("t"), u.cast("string"))), ", ").alias("t"), F.array_join(F.transform("u", lambda u: (u * 7 % 101).cast("string")), ", ").alias("v"))
    first = heads.select(F.posexplode(F.array(F.lit("X, Y, Z;"), F.concat("t", F.lit(";")), F.concat("v", F.lit(";")))).alias("line_no", "value"))
    body = ops.select((F.col("s") + 3).alias("line_no"), F.concat(F.lit("E_"), (F.col("s") % 5).cast("string"), F.lit("-q0(Y) "), F.col("ops")).alias("value"))
    return _line_file(spark, first.union(body), "schedules")


def schedule_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, named, ops, _ = schedules.parse(_schedule_file(spark, sf_dir))
    return schedules.file_verdicts(named, ops)


def schedule_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedules.parse(_schedule_file(spark, sf_dir))[3]


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "logs")
    delimited.write_logs(schedules.access_log(_ops(spark, sf_dir)), path)
    return spark.read.text(path).select("item", "value")


_QUERIES = (
    scan_table, row_print, paginate, page_block, page_summary, page_serialise, row_roundtrip, external_sort, sort_runs, merge_join, merge_join_m2m, self_join, join_counters, tuple_order, tuple_equality,
    index_build, index_leaves, index_search, index_search_missing, line_lookup, line_count, command_replay, membership, txn_timestamps, schedule_verdict, schedule_log, token_clean, int_prefix, file_names,
    csv_scan, page_files, page_occupancy, join_result, key_lines, width_filter, index_matches, index_stored, record_fetch, index_nodes, index_header, script_replay, script_rejected, prefix_test, schedule_file, schedule_rejected, log_files,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_PAGED = "(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_no, (row_number() OVER (ORDER BY o_orderkey) - 1) // 10 AS page_no FROM orders)"
_ENTRIES = "(SELECT CAST(year(o_orderdate) AS INTEGER) AS key, row_number() OVER (ORDER BY o_orderkey) + 1 AS line_no FROM orders)"
_NATION = "(SELECT *, (row_number() OVER (ORDER BY n_nationkey) - 1) // 10 AS page_no FROM nation)"
_SEARCH = "SELECT {k} AS key, count(*) AS n, CASE WHEN count(*) > 0 THEN 'FOUND {k} LINES ' || string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) ELSE 'NOT FOUND {k}' END AS answer FROM {e} WHERE key = {k}"
_SUMMARY = "SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, CAST(ceil((SELECT count(*) FROM {t}) / 10.0) AS BIGINT) AS n_pages, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS n_columns"
_COMMANDS = "(VALUES " + ", ".join(f"({s}, '{o}', {k})" for s, o, k in COMMANDS) + ") AS c(seq, op, key)"
_RUNS = "SELECT (row_no - 1) // 10 // {n} AS run_id, min(k) AS first_key, max(k) AS last_key, count(*) AS rows, {n} AS run_pages FROM (SELECT CAST(c_custkey AS VARCHAR) AS k, row_number() OVER (ORDER BY c_custkey) AS row_no FROM customer) GROUP BY 1"

#: The fold of the access log, one moment a step, with the state of the three items in columns.
_LOG = f"""
WITH RECURSIVE ops AS {_OPS_SQL}, run AS (
  SELECT DISTINCT schedule, -1 AS moment, CAST(-1 AS BIGINT) AS rx, CAST(-1 AS BIGINT) AS ry, CAST(-1 AS BIGINT) AS rz, CAST(-1 AS BIGINT) AS wx, CAST(-1 AS BIGINT) AS wy, CAST(-1 AS BIGINT) AS wz,
    CAST([] AS BIGINT[]) AS aborted, CAST(NULL AS VARCHAR) AS item, CAST(NULL AS VARCHAR) AS kind, false AS logged, false AS bad FROM ops
  UNION ALL
  SELECT schedule, moment,
    CASE WHEN c THEN -1 WHEN ok AND kind = 'r' AND item = 'X' THEN greatest(rx, ts) ELSE rx END, CASE WHEN c THEN -1 WHEN ok AND kind = 'r' AND item = 'Y' THEN greatest(ry, ts) ELSE ry END,
    CASE WHEN c THEN -1 WHEN ok AND kind = 'r' AND item = 'Z' THEN greatest(rz, ts) ELSE rz END, CASE WHEN c THEN -1 WHEN ok AND kind = 'w' AND item = 'X' THEN ts ELSE wx END,
    CASE WHEN c THEN -1 WHEN ok AND kind = 'w' AND item = 'Y' THEN ts ELSE wy END, CASE WHEN c THEN -1 WHEN ok AND kind = 'w' AND item = 'Z' THEN ts ELSE wz END,
    CASE WHEN NOT c AND NOT gone AND bad THEN list_append(aborted, txn) ELSE aborted END, item, kind, NOT c AND NOT gone, bad
  FROM (
    SELECT *, NOT c AND NOT gone AND NOT bad AS ok FROM (
      SELECT r.*, o.moment AS m, o.kind AS k, o.item AS i, o.txn, o.ts, o.kind = 'c' AS c, list_contains(r.aborted, o.txn) AS gone,
        coalesce(o.ts < (CASE o.item WHEN 'X' THEN r.wx WHEN 'Y' THEN r.wy ELSE r.wz END) OR (o.kind = 'w' AND o.ts < (CASE o.item WHEN 'X' THEN r.rx WHEN 'Y' THEN r.ry ELSE r.rz END)), false) AS bad
      FROM (SELECT schedule, moment AS before, rx, ry, rz, wx, wy, wz, aborted FROM run) r JOIN ops o ON o.schedule = r.schedule AND o.moment = r.before + 1
    ) AS s(schedule, before, rx, ry, rz, wx, wy, wz, aborted, moment, kind, item, txn, ts, c, gone, bad)
  )
)
"""
_LOGGED = f"{_LOG} SELECT schedule, item, upper(kind) AS kind, CAST(moment AS BIGINT) AS moment, bad AS violates FROM run WHERE logged"
#: The verdict from the fold, which keeps the rolled back transactions, and not from the operator's windows.
_FIRSTS = "SELECT schedule, CAST(min(CASE WHEN logged AND bad THEN moment END) AS INTEGER) AS m FROM run GROUP BY schedule"
_VERDICT = "CASE WHEN m IS NULL THEN '-OK' ELSE '-ROLLBACK-' || m END"
_CUSTOMERS = "(SELECT *, c_custkey || ',' || c_name || ',' || c_nationkey || ',' || c_mktsegment AS record, row_number() OVER (ORDER BY c_custkey) + 1 AS line_no FROM customer)"
_SCRIPT = "(VALUES " + ", ".join(f"({i}, '{line.partition(':')[0]}', {int(''.join(c for c in line.partition(':')[2] if c.isdigit()))})" for i, line in enumerate(SCRIPT, 1) if line[:4] in ("INC:", "BUS=") and any(c.isdigit() for c in line)) + ") AS c(seq, op, key)"
_REPLAY = """
WITH c AS (SELECT * FROM {commands}), hits AS (SELECT b.seq, b.key, e.line_no FROM c b JOIN c i ON b.op = 'BUS=' AND i.op = 'INC' AND i.key = b.key AND i.seq < b.seq JOIN {entries} e ON e.key = b.key)
SELECT CAST(b.seq AS {kind}) AS seq, b.key, count(h.line_no) AS n, CASE WHEN count(h.line_no) > 0 THEN 'FOUND ' || b.key || ' LINES ' || string_agg(CAST(h.line_no AS VARCHAR), ',' ORDER BY h.line_no) ELSE 'NOT FOUND ' || b.key END AS answer{more}
FROM c b LEFT JOIN hits h ON h.seq = b.seq WHERE b.op = 'BUS=' GROUP BY b.seq, b.key"""
_LEVELS = f"""
WITH RECURSIVE levels AS (
  SELECT CAST(ceil(count(*) / 63.0) AS BIGINT) AS n FROM {_ENTRIES} UNION ALL SELECT CAST(ceil(n / 64.0) AS BIGINT) FROM levels WHERE n > 1
)
SELECT CAST(sum(n) AS INTEGER) AS root_id, CAST(sum(n) + 1 AS INTEGER) AS next_node_id FROM levels"""


def oracle_sql() -> dict[str, str]:
    return {
        "scan_table": "SELECT * FROM nation",
        "row_print": "SELECT concat_ws(' ', CAST(r_regionkey AS VARCHAR), r_name) AS line FROM region",
        "paginate": f"SELECT * FROM {_PAGED}",
        "page_block": f"SELECT page_no, o_orderkey FROM {_PAGED} WHERE page_no BETWEEN 5 AND 7",
        "page_summary": " UNION ALL ".join(_SUMMARY.format(t=t) for t in ("orders", "customer", "supplier", "nation", "region")),
        "page_serialise": f"SELECT page_no, string_agg(concat_ws(';', CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)), chr(10) ORDER BY n_nationkey) AS page FROM {_NATION} GROUP BY page_no",
        "row_roundtrip": f"SELECT page_no, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM {_NATION}",
        "external_sort": "SELECT c_custkey, c_name, CAST(c_custkey AS VARCHAR) AS sort_key, row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) AS sort_rank FROM customer",
        "sort_runs": _RUNS.format(n=4) + " UNION ALL " + _RUNS.format(n=3),
        "merge_join": "SELECT o.* REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate), c.* FROM orders o JOIN customer c ON coalesce(CAST(o_custkey AS VARCHAR), '') = coalesce(CAST(c_custkey AS VARCHAR), '')",
        "merge_join_m2m": "SELECT s_suppkey, s_nationkey, c_custkey, c_nationkey FROM supplier JOIN customer ON coalesce(CAST(s_nationkey AS VARCHAR), '') = coalesce(CAST(c_nationkey AS VARCHAR), '')",
        "self_join": "SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS n_nationkey_2, b.n_name AS n_name_2, b.n_regionkey AS n_regionkey_2 FROM nation a JOIN nation b ON CAST(a.n_regionkey AS VARCHAR) = CAST(b.n_regionkey AS VARCHAR)",
        "join_counters": """
            WITH ls AS (SELECT CAST(o_custkey AS VARCHAR) AS k, row_number() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS pos FROM orders),
              rs AS (SELECT CAST(c_custkey AS VARCHAR) AS k, row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) - 1 AS pos FROM customer),
              n AS (SELECT (SELECT count(*) FROM ls) AS l, (SELECT count(*) FROM rs) AS r, (SELECT count(*) FROM ls JOIN rs USING (k)) AS t, (SELECT max(k) FROM ls) AS lk, (SELECT max(k) FROM rs) AS rk),
              g AS (SELECT k, min(pos) AS s, max(pos) + 1 AS e FROM rs WHERE k IN (SELECT k FROM ls) GROUP BY k),
              p AS (SELECT *, (SELECT count(*) FROM g) AS g, (l + 9) // 10 AS lp, (r + 9) // 10 AS rp,
                coalesce((SELECT sum(least(e, (SELECT count(*) FROM rs) - 1) // 10 - s // 10) FROM g), 0) AS again,
                (SELECT count(*) FROM rs WHERE k < (SELECT max(k) FROM ls)) AS r_below, (SELECT count(*) FROM ls WHERE k <= (SELECT max(k) FROM rs)) AS l_upto FROM n),
              q AS (SELECT *, CASE WHEN lp > 3 THEN 4 ELSE 2 END * lp + CASE WHEN rp > 3 THEN 4 ELSE 2 END * rp AS si,
                CASE WHEN lk <= rk THEN lp + r_below // 10 + 1 ELSE l_upto // 10 + 1 + rp END + again AS mi FROM p)
            SELECT t AS tuples, g AS key_groups, (t + 9) // 10 AS pages, CAST(lp + (lp + 3) // 4 + 1 + rp + (rp + 3) // 4 + 1 + 2 * g AS BIGINT) AS io_single_pass, CAST(si AS BIGINT) AS sort_io,
              CAST(CASE WHEN lp > 3 THEN lp ELSE 0 END + CASE WHEN rp > 3 THEN rp ELSE 0 END AS BIGINT) AS sort_pages, CAST(mi AS BIGINT) AS merge_io, CAST(si + mi AS BIGINT) AS total_io FROM q""",
        "tuple_order": "SELECT *, row_number() OVER (ORDER BY n_nationkey, n_name, n_regionkey) AS tuple_rank FROM (SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation)",
        "tuple_equality": "SELECT c_nationkey, c_mktsegment, count(*) AS n_equal FROM customer GROUP BY ALL HAVING count(*) > 1",
        "index_build": f"SELECT * FROM {_ENTRIES}",
        "index_leaves": f"SELECT leaf, min(key) AS first_key, max(key) AS last_key, count(*) AS entries FROM (SELECT key, (row_number() OVER (ORDER BY key, line_no) - 1) // 63 AS leaf FROM {_ENTRIES}) GROUP BY leaf",
        "index_search": _SEARCH.format(k=1996, e=_ENTRIES),
        "index_search_missing": _SEARCH.format(k=1850, e=_ENTRIES),
        "line_lookup": "SELECT coalesce(max(concat_ws(',', CAST(o_orderkey AS VARCHAR), o_orderstatus)), '') AS value FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) + 1 AS n FROM orders) WHERE n = 42 UNION ALL SELECT ''",
        "line_count": "SELECT count(*) + 1 AS n_lines FROM orders",
        "command_replay": _REPLAY.format(commands=_COMMANDS, entries=_ENTRIES, kind="INTEGER", more=""),
        "membership": "SELECT c_custkey AS key, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS present FROM customer",
        "txn_timestamps": "SELECT event_id, user_id AS txn, CAST(CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') THEN (user_id * 7) % 101 ELSE 0 END AS BIGINT) AS ts FROM events",
        "schedule_verdict": f"{_LOG} SELECT schedule, m AS rollback_moment, schedule || {_VERDICT} AS verdict FROM ({_FIRSTS})",
        "schedule_log": _LOGGED,
        "csv_scan": "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier",
        "page_files": "SELECT dense_rank() OVER (ORDER BY page) - 1 AS scan_order, page, CAST(pos % 10 AS INTEGER) AS row_in_page, s_suppkey, s_name FROM (SELECT CAST(pos // 10 AS VARCHAR) AS page, pos, CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier))",
        "page_occupancy": "SELECT (pos - 1) // 10 AS page_no, count(*) AS n_rows, count(*) = 10 AS is_full, false AS is_empty FROM (SELECT row_number() OVER (ORDER BY s_suppkey) AS pos FROM supplier) GROUP BY ALL",
        "join_result": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, CAST(n_regionkey AS VARCHAR) AS n_regionkey, CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name, 'resultado_juncao_nation_region.csv' AS file FROM nation JOIN region ON n_regionkey = r_regionkey",
        "key_lines": f"SELECT c_nationkey AS key, line_no FROM {_CUSTOMERS}",
        "width_filter": "SELECT conv_id, turn FROM conversations WHERE len(string_split(text, ',')) - CASE WHEN text LIKE '%,' THEN 1 ELSE 0 END = 3",
        "index_matches": f"SELECT line_no FROM {_ENTRIES} WHERE key = 1996",
        "index_stored": f"SELECT key, line_no, CAST(0 AS BIGINT) AS before FROM {_ENTRIES}",
        "record_fetch": f"SELECT c_nationkey AS key, line_no, record FROM {_CUSTOMERS} WHERE c_nationkey = 7 UNION ALL SELECT 7, 0, ''",
        "index_nodes": f"SELECT * FROM {_ENTRIES}",
        "index_header": _LEVELS,
        "script_replay": _REPLAY.format(commands=_SCRIPT, entries=f"(SELECT c_nationkey AS key, line_no FROM {_CUSTOMERS})", kind="BIGINT", more=", CAST(4 AS INTEGER) AS \"order\""),
        "script_rejected": "SELECT CAST(seq AS BIGINT) AS seq, value FROM (VALUES (9, 'PUT:7'), (11, 'BUS=:x'), (13, 'no colon')) AS r(seq, value)",
        "prefix_test": "SELECT o_orderkey, starts_with(o_orderpriority, '1-') AS urgent FROM orders",
        "schedule_file": f"{_LOG} SELECT e.schedule + 4 AS schedule, 'E_' || e.schedule % 5 AS name, m AS rollback_moment, 'E_' || e.schedule % 5 || {_VERDICT} AS verdict FROM (SELECT DISTINCT event_id // 12 AS schedule FROM events) e LEFT JOIN ({_FIRSTS}) f ON f.schedule = e.schedule",
        "schedule_rejected": "SELECT DISTINCT event_id // 12 + 4 AS schedule, 'E_' || (event_id // 12) % 5 AS name, 'q0(Y)' AS token FROM events",
        "log_files": f"SELECT item, schedule || ' ' || kind || ' ' || moment AS value FROM ({_LOGGED})",
        "token_clean": "SELECT event_id, regexp_replace(' ' || props || '; ', '[\\s;]', '', 'g') AS token FROM events",
        "int_prefix": "SELECT o_orderkey, TRY_CAST(regexp_extract(o_orderpriority, '^\\s*([+-]?\\d+)', 1) AS INTEGER) AS priority, TRY_CAST('-' || o_orderkey AS INTEGER) AS negative FROM orders",
        "file_names": "SELECT p_partkey, 'page_' || CASE WHEN p_partkey < 10 THEN '0' ELSE '' END || p_partkey || '.csv.gz' AS file, 'page_' || CASE WHEN p_partkey < 10 THEN '0' ELSE '' END || p_partkey AS base FROM part",
    }
