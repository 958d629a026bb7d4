"""The registered queries and their SQL, side by side on the smallest tables."""

import duckdb
import pytest

from salegrain.llm.queries import ORACLE_SQL, QUERIES

TABLES = ("documents", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    found = QUERIES[name](spark, sf_dir)
    names = sorted(found.columns)
    cursor = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    want = [dict(zip(columns, row, strict=True)) for row in cursor.fetchall()]
    assert names == sorted(columns)
    assert sorted(tuple(r[c] for c in names) for r in found.collect()) == sorted(tuple(r[c] for c in names) for r in want)


def test_there_is_a_query_for_each_operator():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 11))
