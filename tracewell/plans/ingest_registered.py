"""The transcript reader as registered queries, over transcripts made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.oracle import ingest
from tracewell.sources import sample_transcripts, transcripts


def _tables(spark, sf_dir: str, *wanted: str) -> dict[str, DataFrame]:
    return transcripts.extracted(transcripts.classified(sample_transcripts.files(spark, sf_dir)), wanted=wanted)


def _columns(table: str, *names: str, **renamed: str):
    def run(spark, sf_dir: str) -> DataFrame:
        return _tables(spark, sf_dir, table)[table].select(*names, *[F.col(old).cast("long").alias(new) for new, old in renamed.items()])

    return run


def _calls(spark, sf_dir: str) -> DataFrame:
    rows = _tables(spark, sf_dir, "api_calls")["api_calls"]
    return rows.select(
        *"session_id source id turn_id model fallback_from effort attribution_skill request_id started_at ended_at input_tokens output_tokens".split(),
        *"cache_5m_tokens cache_1h_tokens text thinking synthetic".split(),
        F.col("index").cast("long").alias("call_index"),
        F.round("cost_usd", 8).alias("cost_usd"),
    )


def _marks(spark, sf_dir: str) -> DataFrame:
    """Compactions, links to pull requests, and archived lines counted by type."""
    tables = _tables(spark, sf_dir, "compactions", "pr_links", "record_types")
    none = F.lit(None)
    marks = tables["compactions"].select(F.lit("compaction").alias("what"), "session_id", "source", none.cast("int").alias("line_no"), "id", F.col("timestamp").alias("happened_at"), F.col("pre_tokens").alias("size"))
    links = tables["pr_links"].select(F.lit("pr-link").alias("what"), "session_id", F.lit("main").alias("source"), "line_no", F.col("pr_url").alias("id"), F.col("timestamp").alias("happened_at"), F.col("pr_number").cast("long").alias("size"))
    raw = tables["record_types"].groupBy(F.col("type").alias("what"), "session_id", "source").agg(F.max("line_no").alias("line_no"), F.count("*").alias("size"))
    raw = raw.withColumns({"id": none.cast("string"), "happened_at": none.cast("timestamp")})
    return marks.unionByName(links).unionByName(raw)


def queries():
    return {
        "ingest_turns": _columns("turns", *"session_id source id prompt command_name command_args started_at ended_at replayed".split(), turn_index="index"),
        "ingest_api_calls": _calls,
        "ingest_tool_calls": _columns(
            "tool_calls",
            *"session_id source id api_call_id name server_side input result offload_file is_error incomplete started_at ended_at duration_synthetic".split(),
            tool_index="index",
        ),
        "ingest_agent_runs": _columns("agent_runs", *"session_id id parent_agent_id tool_use_id agent_type description workflow_id spawn_depth is_fork fork_context_uuid started_at ended_at".split()),
        "ingest_sessions": _columns("sessions", *"id project_dir git_branch started_at ended_at active_ms title".split()),
        "ingest_marks": _marks,
        "ingest_offload_files": _columns("offload_files", *"session_id name content lossy_decode size_bytes".split()),
        "ingest_extract_state": _columns("extract_state", *"session_id transcript_path extractor_version".split()),
    }


oracle_sql = ingest.oracle_sql
