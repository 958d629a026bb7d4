"""The registered queries beside their SQL, and the entry module without the text operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from salegrain.plans.queries import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf_dir}/events.parquet')")
    found = QUERIES[name](spark, sf_dir)
    names = sorted(found.columns)
    cursor = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    want = [dict(zip(columns, row, strict=True)) for row in cursor.fetchall()]
    assert names == sorted(columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[c] for c in names) for r in found.collect()), key=key) == sorted((tuple(r[c] for c in names) for r in want), key=key)


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 676
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_text_operators(tmp_path):
    """A copy without the subpackage and its pipeline still imports and has all other queries."""
    import shutil

    shutil.copytree(ROOT / "salegrain", tmp_path / "salegrain", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=False)
    assert done.stdout.split() == ["True", str(len(QUERIES))], done.stderr[-500:]


def test_plan_keeps_raw_messages_out_of_the_shuffles(spark, sf_dir):
    """The dedup level is combined before the exchange, and results shuffle no JSON."""
    plan = QUERIES["sales_per_window"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "mensaje_original" not in plan and "CartesianProduct" not in plan
