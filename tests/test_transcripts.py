"""Transcripts written for these tests, and the tables they turn into."""

import json

import duckdb
import pytest

from tracewell import model
from tracewell.plans import ingest_registered
from tracewell.relations import Store
from tracewell.sources import transcripts


def at(second):
    return f"2024-03-01T10:{second // 60:02d}:{second % 60:02d}.000Z"


def envelope(kind, uuid, second, parent=None, **more):
    return {"type": kind, "uuid": uuid, "parentUuid": parent, "timestamp": at(second), "cwd": "/work/app", "version": "2.0", "gitBranch": "trunk"} | more


def user(uuid, second, content, **more):
    return envelope("user", uuid, second, message={"content": content}, **more)


def assistant(uuid, second, message_id, blocks, parent=None, name="claude-opus-5", usage=None, **more):
    usage = usage or {"input_tokens": 10, "output_tokens": 4, "cache_read_input_tokens": 100, "cache_creation_input_tokens": 8}
    message = {"id": message_id, "model": name, "stop_reason": "end_turn", "content": blocks, "usage": usage}
    return envelope("assistant", uuid, second, parent, message=message, **more)


def answer(uuid, second, call, content, details=None, **block):
    more = {"toolUseResult": details} if details else {}
    return user(uuid, second, [{"type": "tool_result", "tool_use_id": call, "content": content} | block], **more)


@pytest.fixture()
def tree(tmp_path):
    def write(place, records, tail=""):
        path = tmp_path / "project" / place
        path.parent.mkdir(parents=True, exist_ok=True)
        text = records if isinstance(records, str) else "".join(json.dumps(r) + "\n" for r in records)
        path.write_text(text + tail)
        return str(tmp_path / "project")

    return write


def session_one(tree):
    tree(
        "s1.jsonl",
        [
            {"type": "mode", "mode": "x"},
            user("p1", 0, "Fix the bug"),
            assistant("a1", 5, "m1", [{"type": "thinking", "thinking": "hm"}], parent="p1"),
            assistant("a2", 6, "m1", [{"type": "text", "text": "Look"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/x/y"}}], parent="a1"),
            assistant("a3", 8, "m1", [{"type": "tool_use", "id": "t2", "name": "Bash", "input": {"command": "ls"}}], parent="a2"),
            answer("r1", 9, "t1", "does not exist", is_error=True),
            answer("r2", 12, "t2", [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], details={"persistedOutputPath": "/tmp/out-7.txt"}),
            user("c1", 20, "<command-name>/fix</command-name><command-args>now</command-args>"),
            user("n1", 21, "<task-notification>done</task-notification>"),
            assistant("b1", 30, "m2", [{"type": "text", "text": "Done"}], parent="c1", name="nameless"),
            envelope("system", "k1", 40, subtype="compact_boundary", compactMetadata={"trigger": "auto", "preTokens": 9, "postTokens": 3, "durationMs": 5}),
            envelope("system", "d1", 41, subtype="turn_duration", durationMs=1500),
            {"type": "ai-title", "aiTitle": "First"},
            {"type": "custom-title", "customTitle": "Mine"},
            {"type": "pr-link", "prNumber": 3, "prUrl": "https://example.org/3", "prRepository": "o/r", "timestamp": at(42)},
        ],
        tail='{"type": "user", "uu',
    )
    tree("s1/subagents/agent-f1.meta.json", json.dumps({"agentType": "fork", "isFork": True, "toolUseId": "t2", "spawnDepth": 1}))
    tree("s1/subagents/agent-f1.jsonl", [user("p1", 0, "Fix the bug"), user("q1", 50, "Go on"), assistant("e1", 55, "m9", [{"type": "text", "text": "ok"}], parent="q1")])
    return tree("s1/tool-results/out-7.txt", "long text")


def test_tables_of_a_session(spark, tree):
    out = transcripts.extract(spark, session_one(tree))
    rows = {n: [r.asDict() for r in t.collect()] for n, t in out.items()}
    assert {n: [f.dataType for f in out[n].schema] for n in model.TABLES} == {n: [f.dataType for f in s] for n, s in model.TABLES.items()}
    (one,) = rows["sessions"]
    assert (one["id"], one["project_dir"], one["title"], one["active_ms"]) == ("s1", "/work/app", "Mine", 1500)
    turns = sorted(rows["turns"], key=lambda t: (t["source"], t["index"]))
    assert [(t["source"], t["id"], t["replayed"], t["command_name"], t["command_args"]) for t in turns] == [
        ("f1", "p1", True, None, None),
        ("f1", "q1", False, None, None),
        ("main", "p1", False, None, None),
        ("main", "c1", False, "/fix", "now"),
    ]
    calls = {c["id"]: c for c in rows["api_calls"]}
    assert (calls["m1"]["turn_id"], calls["m1"]["text"], calls["m1"]["thinking"], calls["m1"]["index"]) == ("p1", "Look", "hm", 0)
    assert calls["m1"]["started_at"].second == 0 and calls["m1"]["ended_at"].second == 8
    assert calls["m1"]["cost_usd"] == pytest.approx((10 * 5 + 4 * 25 + 100 * 5 * 0.1 + 8 * 1.25 * 5) / 1e6)
    assert calls["m2"]["cost_usd"] is None and calls["m2"]["turn_id"] == "c1" and calls["m9"]["source"] == "f1"
    tools = {t["id"]: t for t in rows["tool_calls"]}
    assert (tools["t1"]["is_error"], tools["t1"]["result"], json.loads(tools["t1"]["input"])) == (True, "does not exist", {"file_path": "/x/y"})
    assert (tools["t2"]["result"], tools["t2"]["offload_file"], tools["t2"]["duration_synthetic"]) == ("ab", "out-7.txt", True)
    assert tools["t2"]["started_at"].second == 6 and not tools["t2"]["incomplete"]
    (run,) = rows["agent_runs"]
    assert (run["id"], run["is_fork"], run["tool_use_id"], run["started_at"].second, run["ended_at"].second) == ("f1", True, "t2", 50, 55)
    assert [(k["id"], k["pre_tokens"]) for k in rows["compactions"]] == [("k1", 9)]
    assert [(p["pr_number"], p["line_no"]) for p in rows["pr_links"]] == [(3, 15)]
    assert rows["offload_files"][0]["content"] == "long text"
    assert len(rows["raw_records"]) == 18


@pytest.mark.parametrize("name", sorted(ingest_registered.queries()))
def test_sample_transcripts_match_their_events(spark, small, name):
    """Tables read from JSON against what DuckDB derives from the events behind it."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in ("events", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    found = con.execute(ingest_registered.oracle_sql()[name])
    names = [d[0] for d in found.description]
    plain = lambda row: repr([v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v for v in row])
    got = ingest_registered.queries()[name](spark, small)
    assert sorted(map(plain, got.select(*names).collect())) == sorted(map(plain, found.fetchall())) and sorted(names) == sorted(got.columns)


def test_shapes_of_sessions(spark, tree):
    """A resumed pair, another agent's message, turns without calls, older records, and records that open no turn."""
    shared = [user("p1", 0, "Begin"), assistant("a1", 5, "m1", [{"type": "text", "text": "Yes"}], parent="p1")]
    tree("first.jsonl", shared)
    tree("resumed.jsonl", [*shared, user("p2", 60, "Go on"), assistant("a2", 65, "m2", [{"type": "text", "text": "On"}], parent="p2")])
    tree("mate.jsonl", [user("p3", 0, '<teammate-message from="other">Do this</teammate-message>')])
    tree("silent.jsonl", [user("p4", 0, "One"), user("p5", 9, "Two")])
    tree("old.jsonl", [{"type": "user", "uuid": "p6", "timestamp": at(0), "message": {"content": "Old"}}])
    root = tree("inner.jsonl", [user("p7", 0, "Summary of before", isCompactSummary=True), user("p8", 1, "Aside", isSidechain=True), user("p9", 2, "Meta", isMeta=True), user("p10", 3, "Real")])
    store = Store(transcripts.extract(spark, root))
    owned = {(r["session_id"], r["id"]) for r in store["corpus_turns"].collect()}
    assert {("first", "p1"), ("resumed", "p2")} <= owned and ("resumed", "p1") not in owned
    assert store["live_turns"].where("id = 'p1'").count() == 2 and store["corpus_api_calls"].where("id = 'm1'").count() == 1
    rolled = {r["session_id"]: r for r in store.corpus_rollups.collect()}
    assert (rolled["first"]["api_calls"], rolled["resumed"]["api_calls"], rolled["resumed"]["turns"]) == (1, 1, 1)
    assert (rolled["silent"]["turns"], rolled["silent"]["api_calls"], rolled["silent"]["cost_usd"]) == (2, 0, 0.0)
    assert [r["prompt"] for r in store["turns"].where("session_id = 'mate'").collect()] == ['<teammate-message from="other">Do this</teammate-message>']
    old = store["sessions"].where("id = 'old'").first()
    assert [old[c] for c in ("project_dir", "git_branch", "version", "entrypoint", "title")] == [None] * 5
    assert [r["id"] for r in store["turns"].where("session_id = 'inner'").collect()] == ["p10"]


def test_last_copy_of_a_record_counts(spark, tree):
    root = tree("s2.jsonl", [user("p1", 0, "a"), user("p1", 9, "a"), user("p2", 10, "b")])
    got = [(r["id"], r["started_at"].second) for r in transcripts.extract(spark, root)["turns"].orderBy("index").collect()]
    assert got == [("p1", 9), ("p2", 10)]


@pytest.mark.parametrize(
    "records",
    [
        [{"type": "novelty"}],
        [envelope("system", "x", 1, subtype="novelty")],
        [user("p", 0, "<novelty>x</novelty>")],
        [user("p", 0, [{"type": "novelty"}])],
        [user("p", 0, "a"), user("p", 1, "b")],
    ],
)
def test_unknown_shapes_raise(spark, tree, records):
    with pytest.raises(Exception, match="unknown|differs"):
        transcripts.extract(spark, tree("s3.jsonl", records))["turns"].collect()


def test_bad_line_before_the_last_raises(spark, tree):
    root = tree("s4.jsonl", '{"type": "mode"}\nnot json\n{"type": "mode"}\n')
    with pytest.raises(Exception, match="unreadable"):
        transcripts.extract(spark, root)["raw_records"].collect()


def test_run_without_meta_raises(spark, tree):
    tree("s5.jsonl", [user("p1", 0, "a")])
    root = tree("s5/subagents/agent-z.jsonl", [user("q", 1, "b")])
    with pytest.raises(Exception, match="lacks its transcript"):
        transcripts.extract(spark, root)["agent_runs"].collect()


def test_only_changed_sessions_are_read_again(spark, tree):
    root = session_one(tree)
    state = transcripts.extract(spark, root)["extract_state"]
    held = spark.createDataFrame(state.select("session_id", "fingerprint").collect())
    assert transcripts.changed(spark, root, held).count() == 0
    tree("s6.jsonl", [user("p1", 0, "a")])
    assert [r["session_id"] for r in transcripts.changed(spark, root, held).collect()] == ["s6"]
