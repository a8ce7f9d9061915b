"""Fixtures, edge cases and properties of the operators."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators import joins, line_index, paging, schedules
from quernstone.sources import delimited
from quernstone.streaming import index_stream

SCHEDULES = """X, Y, Z;
t1, t2, t3;
5, 10, 3;
E_1-r1(X) r2(Y) w2(Y) r3(Y) w1(X) c1
E_2-w2(X) r1(Y) w3(X) r2(Z) w1(Z) c1
E_3-r3(X) w3(Y) c1 r1(X) w1(Y) c2 r2(Y) w2(Z) c3"""


def lines(spark, content):
    return spark.createDataFrame(list(enumerate(content.split("\n"), 1)), "line_no long, value string")


def test_schedule_fixture(spark):
    items, named, ops, rejected = schedules.parse(lines(spark, SCHEDULES))
    assert sorted(r.item for r in items.collect()) == ["X", "Y", "Z"]
    assert rejected.count() == 0
    assert sorted(r.verdict for r in schedules.file_verdicts(named, ops).collect()) == ["E_1-ROLLBACK-3", "E_2-ROLLBACK-2", "E_3-OK"]
    log = defaultdict(list)
    for r in sorted(schedules.file_log(named, ops).collect(), key=lambda r: (r.schedule, r.moment)):
        log[r.item].append(f"{r.schedule} {r.kind} {r.moment}")
    assert log["X"] == ["E_1 R 0", "E_1 W 4", "E_2 W 0", "E_2 W 2", "E_3 R 0", "E_3 R 3"]
    assert log["Y"] == ["E_1 R 1", "E_1 W 2", "E_1 R 3", "E_2 R 1", "E_3 W 1", "E_3 W 4", "E_3 R 6"]
    assert log["Z"] == ["E_2 R 3", "E_2 W 4", "E_3 W 7"]


def test_commit_resets_all_items_and_bad_operations_are_set_aside(spark):
    content = "X;\nt1, t2;\n5, 10;\nA-r2(X) c2 w1(X)\nB-r2(X) w1(X)\nC-q1(X) r2(X) w1(X) r9\n"
    _, named, ops, rejected = schedules.parse(lines(spark, content))
    assert sorted(r.verdict for r in schedules.file_verdicts(named, ops).collect()) == ["A-OK", "B-ROLLBACK-1", "C-ROLLBACK-1"]
    assert sorted(r.token for r in rejected.collect()) == ["q1(X)", "r9"]


def test_schedules_of_one_name_without_operations_and_without_a_hyphen(spark):
    content = "X;\nt1, t2;\n5, 10;\nA-r2(X) w1(X)\nA-w1(X) r2(X)\nB-\n\nr2(X) w1(X)\nC-z"
    _, named, ops, rejected = schedules.parse(lines(spark, content))
    got = sorted((r.schedule, r.verdict) for r in schedules.file_verdicts(named, ops).collect())
    assert got == [(4, "A-ROLLBACK-1"), (5, "A-OK"), (6, "B-OK"), (8, "r2(X) w1(X)-ROLLBACK-1"), (9, "C-OK")]
    assert sorted((r.line_no, r.moment, r.violates) for r in schedules.file_log(named, ops).collect()) == [(4, 0, False), (4, 1, True), (5, 0, False), (5, 1, False), (8, 0, False), (8, 1, True)]
    assert [r.token for r in rejected.collect()] == ["z"]


def fold(ops):
    reads, writes, aborted, log, first = {}, {}, set(), [], None
    for moment, kind, txn, ts, item in ops:
        if kind == "c":
            reads, writes = {}, {}
        elif txn not in aborted:
            r, w = reads.get(item, -1), writes.get(item, -1)
            bad = ts < w or (kind == "w" and ts < r)
            log.append((item, kind.upper(), moment, bad))
            if bad:
                aborted.add(txn)
                first = moment if first is None else first
            elif kind == "r":
                reads[item] = max(r, ts)
            else:
                writes[item] = ts
    return first, log


def test_window_and_fold_agree_with_a_plain_simulation(spark):
    rng = random.Random(5)
    rows = [(s, m, (k := rng.choice("rrwwc")), (t := rng.randint(1, 4)), t * 7 % 11, rng.choice("XYZ") if k != "c" else None) for s in range(200) for m in range(rng.randint(1, 14))]
    ops = spark.createDataFrame(rows, "schedule int, moment int, kind string, txn int, ts int, item string")
    found = {r.schedule: r.rollback_moment for r in schedules.verdicts(ops).collect()}
    logs = defaultdict(list)
    for r in schedules.access_log(ops).collect():
        logs[r.schedule].append((r.moment, (r.item, r.kind, r.moment, r.violates)))
    for s in range(200):
        first, log = fold([r[1:] for r in rows if r[0] == s])
        assert found[s] == first
        assert [x for _, x in sorted(logs[s])] == log


#: A command script and the lines that its answers give by key.
GOLDEN_SCRIPT = """FLH/3
INC:1913
INC:1964
INC:1923
INC:2001
BUS=:1913
BUS=:1964
BUS=:1920
INC:1955
INC:1995
INC:1913
BUS=:1913
BUS=:1995
INC:1933
INC:1929
INC:1941
BUS=:1941
INC:1928
INC:1916
INC:1912
BUS=:1912
BUS=:2025"""
GOLDEN_LINES = {
    1913: [2, 9, 132, 162, 173, 180, 206, 215, 493, 532, 641, 919],
    1964: [3, 174, 233, 236, 292, 481, 502, 570, 676, 683, 933],
    1995: [8, 28, 53, 357, 379, 629, 772, 861, 982, 989],
    1941: [12, 13, 203, 264, 333, 625, 701, 775, 795, 917, 959, 964],
    1912: [16, 77, 148, 298, 337, 424, 437, 528, 890, 968],
    1920: [100, 200],
}


def test_golden_script(spark):
    script = lines(spark, GOLDEN_SCRIPT)
    assert line_index.script_order(script) == 3
    commands, rejected = line_index.parse_commands(script)
    entries = spark.createDataFrame([(k, n) for k, found in GOLDEN_LINES.items() for n in found], line_index.ENTRY)
    want = {6: (1913, 1), 7: (1964, 1), 8: (1920, 0), 12: (1913, 2), 13: (1995, 1), 17: (1941, 1), 21: (1912, 1), 22: (2025, 0)}
    got = {r.seq: (r.key, r.n, r.answer) for r in line_index.replay(commands, entries).collect()}
    assert rejected.count() == 0 and set(got) == set(want)
    for seq, (key, times) in want.items():
        found = sorted(GOLDEN_LINES.get(key, []) * times)
        assert got[seq] == (key, len(found), f"FOUND {key} LINES {','.join(map(str, found))}" if found else f"NOT FOUND {key}")


@pytest.mark.parametrize("header", ["", "FLH/2", "FLH/x", "flh/3", "INC:3"])
def test_scripts_need_an_order_of_three(spark, header):
    with pytest.raises(ValueError):
        line_index.script_order(lines(spark, f"{header}\nINC:3"))


def merge_reads(left, right, size=10):
    """Pages that a merge reads which seeks the right side back to a group's first page after each group."""
    left, right = sorted(map(str, left)), sorted(map(str, right))
    reads, i, j, seen_l, seen_r = 0, 0, 0, -1, -1
    while True:
        if i < len(left) and i // size > seen_l:
            seen_l, reads = i // size, reads + 1
        if j < len(right) and j // size > seen_r:
            seen_r, reads = j // size, reads + 1
        if i >= len(left) or j >= len(right):
            return reads
        if left[i] < right[j]:
            i += 1
        elif left[i] > right[j]:
            j += 1
        else:
            key, e = left[i], j
            while e < len(right) and right[e] == key:
                e += 1
                if e < len(right) and e % size == 0:
                    reads += 1
            while i < len(left) and left[i] == key:
                i += 1
                if i < len(left) and i // size > seen_l:
                    seen_l, reads = i // size, reads + 1


@pytest.mark.parametrize("seed", range(4))
def test_merge_reads_match_a_simulation(spark, seed):
    rng = random.Random(seed)
    a, b = ([rng.randint(0, 60) for _ in range(rng.choice([0, 9, 30, 95, 100]))] for _ in range(2))
    a, b = (a or [1], b or [2]) if seed else (a, b)
    left, right = (spark.createDataFrame([(x,) for x in v], "k int") for v in (a, b))
    got = joins.counters(left, right, "k", "k").first()
    assert got.merge_io == merge_reads(a, b) and got.total_io == got.sort_io + got.merge_io


def test_golden_join_counters(spark):
    """Ids 0 to 499 with ids 0 to 74, and 500 rows that refer to the 75: their tuples, and pages read and written."""
    many, few = spark.range(500).select(F.col("id").alias("a"), (F.col("id") % 75).alias("b")), spark.range(75).select(F.col("id").alias("c"))
    got = [tuple(joins.counters(many, few, k, "c").select("tuples", "key_groups", "sort_io", "total_io", "sort_pages").first()) for k in "ab"]
    assert got == [(75, 75, 232, 297, 58), (500, 75, 232, 297, 58)]


def test_a_frame_joins_itself_and_names_stay_apart(spark):
    frame = spark.createDataFrame([(1, "x", "y"), (2, "z", "w")], "v int, v_2 string, v_3 string")
    joined = joins.key_join(frame, frame, "v", "v")
    assert joined.columns == ["v", "v_2", "v_3", "v_4", "v_2_2", "v_3_2"]
    assert sorted(map(tuple, joined.collect())) == [(1, "x", "y", 1, "x", "y"), (2, "z", "w", 2, "z", "w")]


def test_index_file_of_nodes(spark):
    content = "ROOT_ID:3\nNEXT_NODE_ID:6\nL;2;1912;1912;968;890;0;2;\nL;1;1913;9;1;0;\nI;1;1913;1;2;\nI;0;\nL;2;1;x;3;4;0;0;\nQ;0;1;\n"
    found = sorted(tuple(r) for r in line_index.nodes(lines(spark, content)).collect())
    assert found == [(1, True, [1912, 1912], [968, 890], 0, 2), (2, True, [1913], [9], 1, 0), (3, False, [1913], [1, 2], None, None)]
    assert tuple(line_index.header(lines(spark, content)).first()) == (3, 6)
    assert tuple(line_index.header(lines(spark, "ROOT_ID:x")).first()) == (0, 1)
    for n in (0, 1, 2, 40):
        entries = spark.range(n).select((F.col("id") % 7).cast("int").alias("key"), F.col("id").alias("line_no"))
        file = line_index.index_lines(paging.numbered(entries, "key", "line_no"), 3).cache()
        tree = {r.node_id: r for r in line_index.nodes(file).collect()}
        root, following = line_index.header(file).first()
        assert sorted(tree) == list(range(1, following)) and (root == following - 1 or n == 0)
        assert sorted(map(tuple, line_index.node_entries(line_index.nodes(file)).collect())) == sorted(map(tuple, entries.collect()))
        for node in tree.values():
            if not node.is_leaf:
                least = lambda i: tree[i].keys[0] if tree[i].is_leaf else least(tree[i].pointers[0])
                assert node.keys == [least(i) for i in node.pointers[1:]] and len(node.pointers) <= 3
        leaf, chain = 1, 0
        while n and leaf:
            leaf, chain = tree[leaf].following, chain + 1
        assert chain == sum(node.is_leaf for node in tree.values())


def test_an_index_that_is_missing_is_created(spark, tmp_path):
    path = str(tmp_path / "fresh")
    assert line_index.open_index(spark, path).count() == 0
    line_index.build(spark.createDataFrame([(3, 10)], line_index.ENTRY), path)
    lines_ = spark.createDataFrame([(10, "a,b")], "line_no long, value string")
    found = line_index.records(line_index.open_index(spark, path).union(spark.createDataFrame([(3, 0)], line_index.ENTRY)), lines_)
    assert sorted(map(tuple, found.collect())) == [(3, 0, ""), (3, 10, "a,b")]


def test_page_folders_and_join_results(spark, tmp_path):
    frame = spark.range(105).select((F.col("id") + 100).alias("a"), F.lit("x").alias("b"))
    delimited.write_pages(paging.paged(paging.numbered(frame, "a")), str(tmp_path / "p"), frame.columns, ";", 0, False)
    rows = sorted(map(tuple, delimited.read_pages(spark, str(tmp_path / "p"), frame.columns, ";").collect()))
    assert [r[1] for r in rows if r[2] == 0] == ["0", "1", "10", "2", "3", "4", "5", "6", "7", "8", "9"]
    assert [int(r[3]) for r in rows if r[1] == "10"] == [200, 201, 202, 203, 204]
    full = {r.page_no: (r.n_rows, r.is_full, r.is_empty) for r in paging.occupancy(paging.paged(paging.numbered(frame, "a"))).collect()}
    assert full[0] == (10, True, False) and full[10] == (5, False, False)
    path = delimited.write_join(frame.limit(1), str(tmp_path), "uva.csv", "pais.tar.csv", header=True)
    assert path.endswith("/resultado_juncao_uva_pais.csv") and delimited.read_table(spark, path).columns == ["a", "b"]


def test_replay_is_a_bag_and_sees_earlier_inserts_only(spark):
    script = "FLH/3\nBUS=:1\nINC:1\n# note\n\nBUS=:1\nINC:1\nINC:2\nBUS=:1\nBUS=:2\nBUS=:x\nPUT:1\nINC:77\nBUS=:77"
    commands, rejected = line_index.parse_commands(lines(spark, script))
    data = lines(spark, "id,name,year,kind\n0,a,1,x\n1,b,2,x\n2,c,1,x\n3,d,1x,x\n4,e,y,x\n5,f,1\n6,g,1,x,")
    entries = line_index.line_keys(data, 2, 4)
    assert sorted((r.key, r.line_no) for r in entries.collect()) == [(1, 2), (1, 4), (1, 5), (1, 8), (2, 3)]
    answers = {r.seq: r.answer for r in line_index.replay(commands, entries).collect()}
    assert answers == {2: "NOT FOUND 1", 6: "FOUND 1 LINES 2,4,5,8", 9: "FOUND 1 LINES 2,2,4,4,5,5,8,8", 10: "FOUND 2 LINES 3", 14: "NOT FOUND 77"}
    assert sorted(r.value for r in rejected.collect()) == ["BUS=:x", "PUT:1"]


def test_index_is_stored_appended_to_and_searched(spark, tmp_path):
    path = str(tmp_path / "index")
    line_index.build(spark.createDataFrame([(3, 10), (1, 11)], "key int, line_no long"), path)
    source = str(tmp_path / "in")
    spark.createDataFrame([(3, 7)], "key int, line_no long").write.parquet(source)
    stream = spark.readStream.schema("key int, line_no long").parquet(source)
    index_stream.append_entries(stream, path, str(tmp_path / "ck")).awaitTermination()
    assert line_index.search(line_index.open_index(spark, path), 3).first().answer == "FOUND 3 LINES 7,10"
    assert line_index.search(line_index.open_index(spark, path), 9).first().answer == "NOT FOUND 9"


def test_join_compares_keys_as_texts_and_missing_keys_match(spark):
    left = spark.createDataFrame([("1", "a"), ("01", "b"), (None, "c"), ("", "d")], "k string, v string")
    right = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    rows = joins.key_join(left, right, "k", "k", merge=True)
    assert rows.columns == ["k", "v", "k_2", "v_2"]
    assert sorted((r.v, r.v_2) for r in rows.collect()) == [("a", "x"), ("c", "y"), ("d", "y")]
    with pytest.raises(ValueError):
        joins.key_join(left, right, "K", "k")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_join_size_is_the_sum_of_products(spark, a, b):
    left, right = (spark.createDataFrame([(x,) for x in v], "k int") for v in (a, b))
    size = sum(n * Counter(b)[k] for k, n in Counter(a).items())
    assert joins.key_join(left, right, "k", "k").count() == size
    assert joins.counters(left, right, "k", "k").first().tuples == size


@pytest.mark.parametrize("n", [0, 1, 10, 11])
def test_pages_hold_all_rows(spark, n):
    frame = spark.range(n).withColumn("id", F.lit(n) - F.col("id"))
    rows = sorted((r.row_no, r.page_no, r.id) for r in paging.paged(paging.numbered(frame, "id")).collect())
    assert rows == [(i, (i - 1) // 10, i) for i in range(1, n + 1)]
    assert paging.summary(frame, "t").first().n_pages == -(-n // 10)


def test_delimited_files_round_trip(spark, tmp_path):
    source = tmp_path / "t.csv"
    source.write_bytes("id,name,note\r\n0,\"a\",x\r\n\r\n1,,rosé\r\n2,b,".encode())
    frame = delimited.read_table(spark, str(source))
    assert frame.columns == ["id", "name", "note"]
    assert [tuple(r) for r in frame.orderBy("id").collect()] == [("0", '"a"', "x"), ("1", "", "rosé"), ("2", "b", "")]
    pages = paging.paged(paging.numbered(frame, "id"))
    delimited.write_pages(pages, str(tmp_path / "pages"), frame.columns)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "pages")).collect()) == ['0,"a",x', "1,,rosé", "2,b,"]
    texts = delimited.page_texts(pages, frame.columns)
    assert texts.first().page == '0;"a";x\n1;;rosé\n2;b;'
    assert [len(r.fields) for r in delimited.rows_of_pages(texts).orderBy("row_in_page").collect()] == [3, 3, 2]
    delimited.write_rows(frame, str(tmp_path / "rows"), ";")
    assert delimited.read_rows(spark, str(tmp_path / "rows"), frame.columns).count() == 3
    numbered = {r.line_no: r.value for r in delimited.read_lines(spark, str(source)).collect()}
    assert numbered[1] == "id,name,note" and numbered[3] == "" and numbered[5] == "2,b,"
    log = spark.createDataFrame([("E", "X", "R", 0), ("E", "Y", "W", 1)], "schedule string, item string, kind string, moment int")
    delimited.write_logs(log, str(tmp_path / "log"))
    assert [r.value for r in spark.read.text(str(tmp_path / "log" / "item=Y")).collect()] == ["E W 1"]


def test_scalars(spark):
    row = spark.createDataFrame([(" 12x", "a;b ", "7", "123", "x.tar.gz")], "a string, b string, c string, d string, e string")
    got = row.select(text.int_prefix("a"), text.clean_token("b"), text.zero_padded("c"), text.zero_padded("d"), text.base_name("e"), text.int_prefix("e"), text.int_prefix(F.lit("99999999999"))).first()
    assert tuple(got) == (12, "ab", "07", "123", "x", None, None)
