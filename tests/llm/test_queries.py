"""Each operator's query against its SQL, and the registry."""

from pathlib import Path

import cases
import duckdb
import pytest

import __spark_entry__
from veilframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, tmp_path, name):
    queries.QUERIES[name](spark, cases.SF).write.parquet(str(tmp_path / "out"))
    db = duckdb.connect()
    for p in Path(cases.SF).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    db.execute("CREATE TEMP TABLE want AS " + queries.ORACLES[name])
    got = f"'{tmp_path}/out/*.parquet'"
    columns = sorted(db.sql("SELECT * FROM want").columns)
    assert sorted(db.sql(f"SELECT * FROM {got}").columns) == columns
    listed = ", ".join(columns)
    for a, b in (("want", got), (got, "want")):
        assert db.sql(f"SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b}").fetchall() == []


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert "pipeline" in names
    assert {*queries.ORACLES} <= {*__spark_entry__.oracle_sql()}


def test_native_operators_run_no_python(spark):
    for name in ("op4_secret_scan", "op10_pii"):
        plan = queries.QUERIES[name](spark, cases.SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan
        assert "Arrow" not in plan
