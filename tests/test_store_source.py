"""A store as a source: order, refusals, and what hangs loose."""

import pytest
from test_storage import day, made_up

from tracewell import model
from tracewell.relations import Store
from tracewell.sources import store as source


def with_rows(spark, **rows):
    """A store of these rows (dictionaries), other tables empty."""
    out = {}
    for name, schema in (model.TABLES | model.ENRICHMENTS).items():
        out[name] = spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows.get(name, [])], schema)
    return Store(out)


SOUND = {
    "sessions": [{"id": "s", "project_dir": "/p", "started_at": day(0)}],
    "extract_state": [{"session_id": "s", "fingerprint": "f"}],
    "agent_runs": [{"session_id": "s", "id": "r", "tool_use_id": "k"}, {"session_id": "s", "id": "q", "parent_agent_id": "r"}],
    "turns": [{"session_id": "s", "source": "main", "id": "t", "replayed": False}, {"session_id": "s", "source": "r", "id": "t", "replayed": False}],
    "api_calls": [{"session_id": "s", "source": "main", "id": "c", "turn_id": "t"}, {"session_id": "s", "source": "r", "id": "c"}],
    "tool_calls": [{"session_id": "s", "source": "main", "id": "k", "api_call_id": "c", "offload_file": "o"}],
    "offload_files": [{"session_id": "s", "name": "o"}],
    "compactions": [{"session_id": "s", "source": "q", "id": "m"}],
    "raw_records": [{"session_id": "s", "source": "main", "line_no": 1}],
    "pr_links": [{"session_id": "s", "line_no": 1}],
}


def lost(spark, rows):
    return {(r["child"], r["parent"], r["key"], r["rows"]) for r in source.orphans(with_rows(spark, **rows)).collect()}


def test_a_sound_store_has_no_orphans(spark):
    assert lost(spark, SOUND) == set()


@pytest.mark.parametrize(
    ("table", "at", "change", "found"),
    [
        ("api_calls", 0, {"turn_id": "x"}, {("api_calls", "turns", '["main","x"]', 1)}),
        ("api_calls", 1, {"turn_id": "t", "source": "z"}, {("api_calls", "threads", '["z"]', 1), ("api_calls", "turns", '["z","t"]', 1)}),
        ("tool_calls", 0, {"offload_file": "gone"}, {("tool_calls", "offload_files", '["gone"]', 1)}),
        ("tool_calls", 0, {"source": "r", "api_call_id": "d"}, {("tool_calls", "api_calls", '["r","d"]', 1)}),
        ("agent_runs", 1, {"parent_agent_id": "w"}, {("agent_runs", "agent_runs", '["w"]', 1)}),
        ("agent_runs", 0, {"tool_use_id": "w"}, {("agent_runs", "tools", '["w"]', 1)}),
        ("compactions", 0, {"source": "w"}, {("compactions", "threads", '["w"]', 1)}),
        ("extract_state", 0, {"session_id": "w"}, {("extract_state", "sessions", "", 1), ("sessions", "extract_state", "", 1)}),
        ("raw_records", 0, {"session_id": "w"}, {("raw_records", "sessions", "", 1)}),
        ("pr_links", 0, {"session_id": "w"}, {("pr_links", "sessions", "", 1)}),
    ],
)
def test_orphans_of_each_kind(spark, table, at, change, found):
    rows = SOUND | {table: [r | change if i == at else r for i, r in enumerate(SOUND[table])]}
    assert lost(spark, rows) == found


def test_sessions_are_refused_or_given_in_order(spark):
    two = SOUND | {"sessions": [*SOUND["sessions"], {"id": "a", "project_dir": "/p/q"}], "extract_state": [*SOUND["extract_state"], {"session_id": "a", "fingerprint": "g"}]}
    assert [r["session_id"] for r in source.sessions(with_rows(spark, **two), "/p").collect()] == ["a", "s"]
    with pytest.raises(ValueError, match="no session of the store"):
        source.sessions(with_rows(spark, **two), "/elsewhere")
    bare = {"sessions": [{"id": "b"}], "raw_records": [{"session_id": "b", "source": "main", "line_no": 1}]}
    assert source.refusals(with_rows(spark, **bare)).isEmpty()  # lines alone refuse nothing
    work = bare | {"turns": [{"session_id": "b", "source": "main", "id": "t"}]}
    assert [tuple(r) for r in source.refusals(with_rows(spark, **work)).collect()] == [("b", "placeless", "raw_records 1, turns 1")]
    with pytest.raises(ValueError, match="session b names no project, but holds raw_records 1, turns 1"):
        source.sessions(with_rows(spark, **work), "/p")
    timeless = work | {"sessions": [{"id": "b", "project_dir": "/p"}]}
    assert [r["reason"] for r in source.refusals(with_rows(spark, **timeless)).collect()] == ["timeless"]


def test_rows_come_in_the_order_of_their_key(spark):
    store = Store(made_up(spark, {f"s{i}": day(i) for i in range(6)}, 3))
    chosen = spark.createDataFrame([("s1",), ("s4",), ("s5",)], "session_id string")
    for part in source.in_order(store, "compactions", chosen).rdd.glom().collect():
        keys = [(r["session_id"], r["source"], r["id"]) for r in part]
        assert keys == sorted(keys)
    assert {r["session_id"] for r in source.in_order(store, "turns", chosen).collect()} == {"s1", "s4", "s5"}
