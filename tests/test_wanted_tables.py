"""Tables of transcripts one at a time: what they read and move, and that checks hold."""

import json

import pytest
from tracewell import model
from tracewell.functions import lineage
from tracewell.plans import ingest_registered
from tracewell.sources import sample_transcripts, transcripts


def moved_by(df, key):
    """How often a plan moves rows by a key."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and key in line]


def test_files_alone_write_nothing_and_records_move_once(spark, small, monkeypatch):
    written = []
    monkeypatch.setattr(transcripts, "cut", lambda rows: written.append(rows.columns) or lineage.cut(rows))
    queries = ingest_registered.queries()
    queries["ingest_extract_state"](spark, small)
    queries["ingest_offload_files"](spark, small)
    turns, sessions, tools = (queries[f"ingest_{n}"](spark, small) for n in ("turns", "sessions", "tool_calls"))
    assert written == []
    # Records are brought to their session once; no window moves them by record, turn or message, nor by file for numbers.
    for df in (turns, sessions, tools):
        assert len(moved_by(df, "REPARTITION_BY_COL")) == 1
        assert not [k for k in ("uuid", "_w", "turn_id", "api_call_id", "path#", "split#") if moved_by(df, k)]
    queries["ingest_marks"](spark, small)
    assert len(written) == 2 and not any({"raw", "blank"} & set(columns) for columns in written)


@pytest.mark.parametrize("table", [t for t in transcripts.NEEDS if t not in transcripts.OF_LINES])
def test_every_table_of_records_meets_every_check(spark, tmp_path, table):
    records = [{"type": "user", "uuid": "a", "timestamp": "2024-03-01T10:00:00.000Z", "message": {"content": "<strange-tag>x</strange-tag>"}}]
    (tmp_path / "s.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records))
    with pytest.raises(Exception, match="unknown leading tag in session s, line 1"):
        transcripts.extracted(transcripts.files(spark, str(tmp_path)), wanted=[table])[table].collect()


def test_tables_one_at_a_time_are_those_made_together(spark, small):
    found = transcripts.classified(sample_transcripts.files(spark, small))
    every = transcripts.extracted(found)
    for table in model.TABLES:
        one = transcripts.extracted(found, wanted=[table])[table].drop("extracted_at")
        assert sorted(map(repr, one.collect())) == sorted(map(repr, every[table].drop("extracted_at").collect())), table
