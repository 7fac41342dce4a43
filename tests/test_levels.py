"""Levels of a session tree that a query is bound to."""

import shutil
from pathlib import Path

import duckdb
from tracewell.plans import operators_registered

ALL = Path("/root/testdata")


def test_no_tools_of_a_turn_where_no_turn_has_calls(spark, tmp_path):
    # In sf0.1 the session's main thread has calls, tools and a run, but no turn.
    spark.read.parquet(str(ALL / "sf0.1/events.parquet")).where("user_id = 1").coalesce(1).write.parquet(str(tmp_path / "part"))
    shutil.copy(next((tmp_path / "part").glob("*.parquet")), tmp_path / "events.parquet")
    shutil.copy(ALL / "sf0.001/documents.parquet", tmp_path / "documents.parquet")
    out = operators_registered.queries()["turn_tools_level"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    for name in ("events", "documents"):
        db.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    assert [tuple(r) for r in out] == db.execute(operators_registered.oracle_sql()["turn_tools_level"]).fetchall() == []
