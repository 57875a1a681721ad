"""Every registered query against its SQL in DuckDB."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from veilframe.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, tmp_path, name):
    catalog.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    if name not in catalog.ORACLES:
        return
    duck.execute("CREATE OR REPLACE TEMP TABLE want AS " + catalog.ORACLES[name])
    got = f"'{tmp_path}/out/*.parquet'"
    columns = sorted(duck.sql("SELECT * FROM want").columns)
    assert sorted(duck.sql(f"SELECT * FROM {got}").columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    for a, b in (("want", got), (got, "want")):
        assert duck.sql(f"SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b}").fetchall() == []


def test_entry_imports_without_the_rest(spark):
    import __spark_entry__

    assert {*catalog.QUERIES} <= {*__spark_entry__.queries()}
    assert {*catalog.ORACLES} <= {*__spark_entry__.oracle_sql()}
    assert __spark_entry__.entry(spark).columns == ["lang", "source", "entity_type", "n"]


def test_plans_prune_columns(spark):
    plan = catalog.entities_resolved(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "Python" not in plan
