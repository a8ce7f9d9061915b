"""Every registered query of the relational part against DuckDB on the smallest tables."""

import glob

import duckdb
import pytest

from quernstone import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.split('/')[-1].split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    relation = duck.sql(registry.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    at = [relation.columns.index(c) for c in frame.columns]
    assert plain(frame.collect()) == plain([tuple(r[i] for i in at) for r in relation.fetchall()])


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
