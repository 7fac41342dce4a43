"""Growing transcripts: tables as of a full extract, from the appended bytes alone."""

import io
import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_streaming import call, mark, prompt

from tracewell import model
from tracewell.sources import transcripts
from tracewell.storage import StoredStore
from tracewell.streaming import tails


def held(store):
    return {n: sorted(map(repr, store[n].drop("extracted_at").collect())) for n in model.TABLES}


def as_extracted(spark, root, path):
    """The store holds what a full extract gives."""
    got, want = held(StoredStore.read(spark, path)), transcripts.extract(spark, root)
    for name in model.TABLES:
        assert got[name] == sorted(map(repr, want[name].drop("extracted_at").collect())), name


def test_appended_lines_give_a_full_extract(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "in", str(tmp_path / "out")
    (root / "b" / "subagents").mkdir(parents=True)
    a, b, run = root / "a.jsonl", root / "b.jsonl", root / "b" / "subagents" / "agent-r.jsonl"
    a.write_text(prompt("p1", "one") + call("c1", "m1", "t1"))
    b.write_text(prompt("p3", "zwei é€😀"))
    run.write_text(prompt("p4", "go"))
    (run.parent / "agent-r.meta.json").write_text(json.dumps({"agentType": "x", "spawnDepth": 1}))
    told = tails.refresh_tails(spark, str(root), out)
    assert told == {"sessions": 2, "files": 3, "bytes": sum(f.stat().st_size for f in (a, b, run))}
    assert tails.refresh_tails(spark, str(root), out) == {"sessions": 0, "files": 0, "bytes": 0}

    # Appended lines, the last of them unfinished; then its rest.
    more, half = call("c2", "m1") + mark("k1"), prompt("p2", "two", 40)
    with a.open("a") as f:
        f.write(more + half[:30])
    assert tails.refresh_tails(spark, str(root), out) == {"sessions": 1, "files": 1, "bytes": len(more) + 30}
    as_extracted(spark, str(root), out)
    with a.open("a") as f:
        f.write(half[30:-1])
    assert tails.refresh_tails(spark, str(root), out)["bytes"] == len(half) - 1  # readable without its line feed, and read again with it
    monkeypatch.setattr(tails, "RANGE", 50)  # a tail of many ranges
    with a.open("a") as f:
        f.write("\n" + prompt("p5", "three", 50) + prompt("p6", "four", 51))
    assert tails.refresh_tails(spark, str(root), out)["sessions"] == 1
    as_extracted(spark, str(root), out)

    # Rewritten: shorter, and of one length with other bytes at its end; a meta file alone.
    a.write_text(prompt("p1", "one") + prompt("p9", "new"))
    b.write_text(prompt("p3", "drei é€😀"))
    assert tails.refresh_tails(spark, str(root), out) == {"sessions": 2, "files": 2, "bytes": a.stat().st_size + b.stat().st_size}
    (run.parent / "agent-r.meta.json").write_text(json.dumps({"agentType": "other", "spawnDepth": 1}))
    assert tails.refresh_tails(spark, str(root), out) == {"sessions": 1, "files": 0, "bytes": 0}
    as_extracted(spark, str(root), out)


def test_a_refresh_that_broke_off_is_done_again(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    (root / "a.jsonl").write_text(prompt("p1", "one"))
    tails.refresh_tails(spark, str(root), out)
    with (root / "a.jsonl").open("a") as f:
        f.write(prompt("p2", "two"))

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(tails.Tails, "_remember", crash)
    with pytest.raises(OSError, match="lost"):
        tails.refresh_tails(spark, str(root), out)
    monkeypatch.undo()
    assert tails.refresh_tails(spark, str(root), out)["sessions"] == 1
    as_extracted(spark, str(root), out)


def test_a_stream_follows(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    (root / "a.jsonl").write_text(prompt("p1", "one"))
    tails.refresh_tails(spark, str(root), out)
    query = tails.follow(spark, str(root), out, str(tmp_path / "check"), "1 second")
    try:
        with (root / "a.jsonl").open("a") as f:
            f.write(prompt("p2", "two"))
        for _ in range(60):
            if StoredStore.read(spark, out)["turns"].count() == 2:
                break
            time.sleep(1)
        assert query.exception() is None
    finally:
        query.stop()
    as_extracted(spark, str(root), out)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60).map(lambda b: b.replace(b"\x00", b"\n")), st.integers(1, 9), st.integers(0, 20))
def test_ranges_cover_every_line_once(data, size, consumed):
    begin = data.rfind(b"\n", 0, consumed) + 1
    found = []
    for start in range(begin, max(len(data), begin + 1), size):
        found += [line for _, line, _ in tails.lines_of(io.BytesIO(data), begin, start, min(start + size, len(data)))]
    want = data[begin:].split(b"\n")
    assert found == (want if want[-1] else want[:-1])
