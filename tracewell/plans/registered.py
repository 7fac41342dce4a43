"""The saved questions as registered queries: each with fixed, documented bindings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.oracle import questions as oracle
from tracewell.oracle.questions import RUN, SESSION
from tracewell.plans import QUESTIONS, ask
from tracewell.relations import Store
from tracewell.sources.testdata import project

CORPUS = {"project": "/repo", "as_of": "2024-01-28", "window_days": 7}
THREAD = {"session_id": SESSION, "source": "main"}


def open_store(spark: SparkSession, sf_dir: str) -> Store:
    return Store(project(spark, sf_dir))


def first(rows: DataFrame, column: str = "id") -> str | None:
    """The least value in a session's main thread: what a keyed question is bound to."""
    mine = (F.col("session_id") == SESSION) & (F.col("source") == "main")
    return rows.where(mine).agg(F.min(column)).first()[0]


def used_turn(store: Store) -> str | None:
    turns = store["live_turns"].select("session_id", "source", F.col("id").alias("turn_id"))
    return first(store["live_api_calls"].join(turns, ["session_id", "source", "turn_id"]), "turn_id")


def bindings(name: str, store: Store) -> dict:
    """Parameters that the registered query gives a question."""
    if QUESTIONS[name].corpus:
        own = {
            "sessions": {"project": "/repo/p1"},
            "weekly_trend": {"project": "/repo/p1"},
            "missing_file_recovery": {"within_calls": 2},
            "reload_cost_split": {"short_gap_seconds": 3600},
            "select_enrichments": {"level": "turn"},
            "select_runs": {"min_runs": 2},
            "select_sessions": {"cost_quota": 3, "error_quota": 2, "compaction_quota": 2, "discovery_quota": 3, "skill_threshold": 2, "min_discovery_api_calls": 4},
        }
        return CORPUS | own.get(name, {})
    call = {"api_call_id": lambda: first(store["live_api_calls"])}
    tool = {"tool_call_id": lambda: first(store["live_tool_calls"])}
    session = {"session_id": SESSION}
    keyed: dict[str, dict] = {
        "session_digest": session,
        "run_digest": session | {"source": RUN},
        "session_overview": session,
        "enrichment_digest": session,
        "error_records": session,
        "records_slice": THREAD | {"first_line": 2, "last_line": 6, "max_chars": 40},
        "view_call_text": THREAD | call,
        "view_call_thinking": THREAD | call,
        "view_call_header": THREAD | call | {"detail_chars": 12},
        "view_tool_input": THREAD | tool,
        "view_tool_result": THREAD | tool,
        "view_tool_header": THREAD | tool,
        "view_turn_prompt": THREAD | {"turn_id": lambda: first(store["live_turns"])},
        "view_run_brief": session | {"run_id": RUN},
        "view_run_header": session | {"run_id": RUN},
        "view_runs": session,
        "view_turn_calls": THREAD | {"turn_id": lambda: used_turn(store), "page_calls": 3},
        "view_call_tools": THREAD | {"api_call_id": lambda: first(store["live_tool_calls"], "api_call_id")},
        "view_compactions": {"session_id": "s1-0", "source": "main"},
        "view_enrichment": {"session_id": "s12-1", "source": "main"},
        "view_offload": {"session_id": "s1-0", "name": "doc-1", "after_chars": 10, "chunk_chars": 500},
        "view_project_rollups": {"as_of": "2024-01-28", "head_chars": 12},
        "view_record": THREAD | {"line_no": 2},
        "view_records": THREAD | {"after": 1, "page_records": 3},
        "view_session_errors": session | {"errors": 2},
        "view_session_header": session | {"head_items": 2},
        "view_tree_calls": THREAD,
        "view_tree_tools": THREAD | {"turn_id": lambda: used_turn(store)},
        "view_tree_turns": THREAD,
        "view_turn_header": THREAD | {"turn_id": lambda: used_turn(store)},
        "view_turn_records": THREAD,
    }
    return {k: v() if callable(v) else v for k, v in keyed.get(name, {}).items()}


def flat(rows: DataFrame) -> DataFrame:
    """Array columns as JSON text, which both engines print alike."""
    lists = {c: F.to_json(F.col(c)) for c, kind in rows.dtypes if kind.startswith("array")}
    return rows.withColumns(lists) if lists else rows


def registered(name: str, **more) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = open_store(spark, sf_dir)
        return flat(ask(store, name, **(bindings(name, store) | more)))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: registered(name) for name in QUESTIONS}
    out["select_enrichments_runs"] = registered("select_enrichments", level="agent_run")
    out["select_enrichments_sessions"] = registered("select_enrichments", level="session")
    return out


def oracle_sql() -> dict[str, str]:
    return {name: oracle.sql(name) for name in queries()}
