"""Replacing sessions in a store, and streams of the library run to the end over files written for the tests."""

import json

import pytest

from tracewell.plans import QUESTIONS, ask, registered
from tracewell.relations import Store
from tracewell.sources import transcripts
from tracewell.storage import StoredStore, replace_sessions, write_store
from tracewell.streaming import refresh


def record(kind, uuid, second, **more):
    return json.dumps({"type": kind, "uuid": uuid, "timestamp": f"2024-03-01T10:00:{second:02d}Z", "cwd": "/w", "version": "1"} | more) + "\n"


def prompt(uuid, text, second=0):
    return record("user", uuid, second, message={"content": text})


def mark(uuid):
    return record("system", uuid, 30, subtype="compact_boundary", compactMetadata={"trigger": "auto", "preTokens": 9, "postTokens": 3, "durationMs": 5})


def call(uuid, message, tool=None):
    blocks = [{"type": "text", "text": "said"}] + ([{"type": "tool_use", "id": tool, "name": "Read", "input": {"file_path": "/x"}}] if tool else [])
    usage = {"input_tokens": 1, "output_tokens": 2, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 4}
    return record("assistant", uuid, 10, message={"id": message, "model": "claude-opus-5", "stop_reason": "end_turn", "content": blocks, "usage": usage})


def prompts(spark, path):
    return sorted(r["prompt"] for r in StoredStore.read(spark, path)["turns"].collect())


def test_watch_replaces_only_arriving_sessions(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    (root / "a.jsonl").write_text(prompt("p1", "one"))
    (root / "b.jsonl").write_text(prompt("p1", "two"))
    refresh.watch(spark, str(root), out, str(tmp_path / "check")).awaitTermination()
    (root / "c.jsonl").write_text(prompt("p1", "three"))
    refresh.watch(spark, str(root), out, str(tmp_path / "check")).awaitTermination()
    assert prompts(spark, out) == ["one", "three", "two"]
    assert refresh.refresh(spark, str(root), out) == 0
    (root / "a.jsonl").write_text(prompt("p1", "one") + prompt("p2", "more"))
    assert refresh.refresh(spark, str(root), out) == 1
    assert prompts(spark, out) == ["more", "one", "three", "two"]


def test_a_replaced_session_loses_what_it_lost(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    (root / "a.jsonl").write_text(prompt("p1", "one") + call("c1", "m1", "t1") + mark("k1") + prompt("p2", "two", 40))
    (root / "b.jsonl").write_text(prompt("p3", "other") + mark("k2"))
    assert refresh.refresh(spark, str(root), out) == 2
    assert {r["id"] for r in StoredStore.read(spark, out)["compactions"].collect()} == {"k1", "k2"}
    (root / "a.jsonl").write_text(prompt("p1", "one"))
    (root / "b.jsonl").unlink()
    assert refresh.refresh(spark, str(root), out) == 1
    store = StoredStore.read(spark, out)
    assert [r["id"] for r in store["compactions"].collect()] == ["k2"]  # a session whose file is gone keeps its rows
    assert store["api_calls"].count() == store["tool_calls"].count() == 0 and prompts(spark, out) == ["one", "other"]
    assert [r["api_calls"] for r in store.session_rollups.where("session_id = 'a'").collect()] == [0]
    assert all(store.duplicate_keys(t).isEmpty() for t in ("turns", "sessions", "extract_state"))


def test_a_broken_load_is_not_seen(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    (root / "a.jsonl").write_text(prompt("p1", "one"))
    refresh.refresh(spark, str(root), out)
    tables = transcripts.extract(spark, str(root))
    tables["raw_records"] = tables["raw_records"].selectExpr("* EXCEPT (raw)", "raise_error('disk full') AS raw")
    with pytest.raises(Exception, match="disk full"):
        replace_sessions(spark, out, tables, tables["extract_state"])
    assert prompts(spark, out) == ["one"] and StoredStore.read(spark, out).duplicate_keys("turns").isEmpty()


def test_questions_over_a_refreshed_store_equal_those_over_a_fresh_one(spark, small, tmp_path):
    """Write the store, spoil some sessions, replace them: every question answers as before, from whole relations."""
    whole = registered.open_store(spark, small)
    write_store(whole, str(tmp_path / "fresh"))
    spoiled = Store({n: t if n in ("sessions", "extract_state") else t.where("false") if "session_id" not in t.columns else t.where("session_id NOT LIKE 's1%'") for n, t in whole.tables.items()})
    kept = {n: whole.tables[n] for n in whole.tables if n.endswith("enrichments")}
    write_store(Store(spoiled.tables | kept), str(tmp_path / "mended"))
    ids = whole["sessions"].where("id LIKE 's1%'").selectExpr("id AS session_id")
    again = {n: t.where("id LIKE 's1%'" if n == "sessions" else "session_id LIKE 's1%'") for n, t in whole.tables.items()}
    replace_sessions(spark, str(tmp_path / "mended"), again, ids)
    fresh, mended = StoredStore.read(spark, str(tmp_path / "fresh")), StoredStore.read(spark, str(tmp_path / "mended"))
    assert len(fresh.version.loads) == 1 and len(mended.version.loads) == 2
    for name in ("session_counts", "tool_failures", "context_reloads", "sessions", "select_runs", "view_sessions", "session_digest", "view_run_header"):
        asked = registered.bindings(name, fresh)
        assert sorted(map(repr, ask(mended, name, **asked).collect())) == sorted(map(repr, ask(fresh, name, **asked).collect())), name
    for table in ("turns", "api_calls", "raw_records", "offload_files"):
        assert fresh[table].exceptAll(mended[table]).isEmpty() and mended[table].exceptAll(fresh[table]).isEmpty()
    assert len(QUESTIONS) >= 50


def test_spells_on_a_stream_match_the_batch(spark, small, tmp_path):
    store = Store(registered.open_store(spark, small).tables)
    calls = store["live_api_calls"].select("session_id", "source", "started_at", "output_tokens")
    calls.coalesce(1).write.parquet(str(tmp_path / "calls"))
    batch = refresh.busy_spells(spark.read.parquet(str(tmp_path / "calls")))
    stream = refresh.busy_spells(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls")), late="60 days")
    query = stream.writeStream.format("memory").queryName("spells").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.sql("SELECT * FROM spells").collect())) == sorted(map(tuple, batch.collect()))
