"""The trace model: tables, keys and column types.

No id is globally unique: a row is known by ``(session_id, source, id)``, where
``source`` is ``main`` or the id of an agent run. Absent numbers are null, never
zero; a null cost means that no price is known.
"""

from __future__ import annotations

from pyspark.sql import types as T

MAIN = "main"
SCHEMA_VERSION = 1


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def schema(columns: str) -> T.StructType:
    """A struct from ``name type, ...``; needs no session."""
    fields = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


TABLES: dict[str, T.StructType] = {
    "sessions": schema(
        "id string, project_dir string, git_branch string, version string, entrypoint string, started_at timestamp, "
        "ended_at timestamp, active_ms long, transcript_path string, title string, agent_name string"
    ),
    "turns": schema(
        "session_id string, source string, id string, index int, prompt string, command_name string, command_args string, "
        "started_at timestamp, ended_at timestamp, replayed boolean"
    ),
    "api_calls": schema(
        "session_id string, source string, id string, turn_id string, index int, model string, fallback_from string, effort string, "
        "stop_reason string, attribution_skill string, request_id string, started_at timestamp, ended_at timestamp, "
        "input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, cache_5m_tokens long, "
        "cache_1h_tokens long, text string, thinking string, cost_usd double, synthetic boolean, replayed boolean"
    ),
    "tool_calls": schema(
        "session_id string, source string, id string, api_call_id string, index int, name string, server_side boolean, input string, "
        "result string, offload_file string, is_error boolean, incomplete boolean, started_at timestamp, ended_at timestamp, "
        "duration_synthetic boolean, replayed boolean"
    ),
    "agent_runs": schema(
        "session_id string, id string, parent_agent_id string, tool_use_id string, agent_type string, description string, model string, "
        "workflow_id string, spawn_depth int, is_fork boolean, fork_context_uuid string, started_at timestamp, ended_at timestamp"
    ),
    "compactions": schema(
        "session_id string, source string, id string, timestamp timestamp, trigger string, pre_tokens long, post_tokens long, duration_ms long"
    ),
    "pr_links": schema("session_id string, line_no int, pr_number int, pr_url string, pr_repository string, timestamp timestamp"),
    "offload_files": schema("session_id string, name string, content string, lossy_decode boolean, size_bytes long"),
    "raw_records": schema("session_id string, source string, line_no int, uuid string, timestamp timestamp, type string, raw string"),
    "extract_state": schema(
        "session_id string, fingerprint string, transcript_path string, extracted_at timestamp, extractor string, extractor_version string"
    ),
}

_TAGS = (
    "description string, category string, outcome string, friction string, input_hash string, prompt_version string, "
    "taxonomy_version string, model string, enriched_at timestamp"
)
ENRICHMENTS: dict[str, T.StructType] = {
    "turn_enrichments": schema(f"session_id string, source string, turn_id string, {_TAGS}"),
    "agent_run_enrichments": schema(f"session_id string, agent_run_id string, {_TAGS}"),
    "session_enrichments": schema(f"session_id string, {_TAGS}"),
}

ROLLUPS = schema(
    "session_id string, project_dir string, title string, started_at timestamp, ended_at timestamp, wall_ms long, active_ms long, turns long, "
    "tool_calls long, agent_runs long, compactions long, api_calls long, input_tokens long, output_tokens long, cache_read_tokens long, "
    "cache_creation_tokens long, cost_usd double, unpriced_api_calls long"
)

KEYS: dict[str, tuple[str, ...]] = {
    "sessions": ("id",),
    "turns": ("session_id", "source", "id"),
    "api_calls": ("session_id", "source", "id"),
    "tool_calls": ("session_id", "source", "id"),
    "agent_runs": ("session_id", "id"),
    "compactions": ("session_id", "source", "id"),
    "pr_links": ("session_id", "line_no"),
    "offload_files": ("session_id", "name"),
    "raw_records": ("session_id", "source", "line_no"),
    "extract_state": ("session_id",),
    "turn_enrichments": ("session_id", "source", "turn_id"),
    "agent_run_enrichments": ("session_id", "agent_run_id"),
    "session_enrichments": ("session_id",),
}

#: What enrichment may say of an item: fixed values.
TAXONOMY_VERSION = "2"
CATEGORIES = (
    "design implement fix_bug refactor test debug review analyze document configure vcs_ops explore chat other".split()
)
OUTCOMES = "completed partial failed abandoned unclear".split()
