"""A trace store as a source: what may leave it, in order, and what in it hangs loose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import model
from tracewell.sources.projects import resolve_project

#: Tables that hold work; the others are kept beside it and alone refuse nothing. Times of a row, by table.
WORK = {"turns": "started_at", "api_calls": "started_at", "tool_calls": "started_at", "agent_runs": "started_at", "compactions": "timestamp", "pr_links": "timestamp"}
BESIDE = ("offload_files", "raw_records")

_IN_THREAD = ("session_id", "source")
#: (table, columns of the reference, table referred to): all foreign keys of the model. A thread is the main one or a run's.
REFERENCES = (
    *((t, ("session_id",), "sessions") for t in (*WORK, *BESIDE, "extract_state")),
    ("sessions", ("id",), "extract_state"),
    *((t, _IN_THREAD, "threads") for t in ("turns", "api_calls", "tool_calls", "compactions")),
    ("api_calls", (*_IN_THREAD, "turn_id"), "turns"),
    ("tool_calls", (*_IN_THREAD, "api_call_id"), "api_calls"),
    ("tool_calls", ("session_id", "offload_file"), "offload_files"),
    ("agent_runs", ("session_id", "parent_agent_id"), "agent_runs"),
    ("agent_runs", ("session_id", "tool_use_id"), "tools"),
)
#: What is referred to, where it is not a table by its key.
_NAMED = {"threads": ("agent_runs", ("session_id", "id")), "tools": ("tool_calls", ("session_id", "id"))}


def _facts(rows: DataFrame, to: str, columns: tuple[str, ...], by: str | None) -> DataFrame:
    """References by a table, or (``by`` null) what they may refer to; keys with a null refer to nothing."""
    session, rest = columns[0], columns[1:]
    named = F.to_json(F.array(*[F.col(c) for c in rest])) if rest else F.lit("")
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    return rows.where(whole).select(F.lit(to).alias("to"), F.col(session).alias("session_id"), named.alias("key"), F.lit(by).cast("string").alias("by"))


def orphans(store) -> DataFrame:
    """``session_id, child, parent, key, rows``: references to what is not there, of all tables in one aggregation.

    Null references and those to the main thread are none. A session's many rows
    are counted before they meet.
    """
    parts = []
    for by, columns, to in REFERENCES:
        rows = store.tables[by]
        parts.append(_facts(rows.where(F.col("source") != model.MAIN) if to == "threads" else rows, to, columns, by))
    for to in dict.fromkeys(t for _, _, t in REFERENCES):
        table, columns = _NAMED.get(to, (to, model.KEYS.get(to)))
        parts.append(_facts(store.tables[table], to, columns, None))
    children = sorted({by for by, _, _ in REFERENCES})
    counts = [F.count_if(F.col("by") == c).alias(c) for c in children]
    met = reduce(DataFrame.unionByName, parts).groupBy("to", "session_id", "key").agg(F.count_if(F.col("by").isNull()).alias("there"), *counts)
    found = F.array(*[F.struct(F.lit(c).alias("child"), F.col(c).alias("rows")) for c in children])
    lost = met.where("there = 0").select("session_id", F.col("to").alias("parent"), "key", F.explode(found).alias("f"))
    return lost.select("session_id", "f.child", "parent", "key", "f.rows").where("rows > 0")


def refusals(store) -> DataFrame:
    """``session_id, reason, held``: sessions that no export may pass over: work without a project, or without any time.

    ``held`` tells how many rows of which tables they hold.
    """
    sessions = store.tables["sessions"].select(F.col("id").alias("session_id"), "project_dir", F.coalesce("started_at", "ended_at").alias("at"))
    parts = []
    for table in (*WORK, *BESIDE):
        at = F.col(WORK[table]) if table in WORK else F.lit(None).cast("timestamp")
        parts.append(store.tables[table].select("session_id", F.lit(table).alias("table"), at.alias("at")))
    held = reduce(DataFrame.unionByName, parts).groupBy("session_id", "table").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table", "n"))), lambda x: F.concat_ws(" ", x["table"], x["n"].cast("string"))), ", ")
    held = held.groupBy("session_id").agg(text.alias("held"), F.min("first").alias("first"), F.count_if(F.col("table").isin(*WORK)).alias("work"))
    rows = sessions.join(held, "session_id")
    placeless = F.col("project_dir").isNull() & (F.col("work") > 0)
    timeless = F.coalesce("at", "first").isNull() & (F.col("work") > 0)
    reason = F.when(placeless, "placeless").when(timeless, "timeless")
    return rows.select("session_id", reason.alias("reason"), "held").where("reason IS NOT NULL")


def sessions(store, project: str) -> DataFrame:
    """``session_id, fingerprint`` of the extracted sessions of a project, by id.

    Raises where a session without a project holds work, which would else be
    passed over in silence, and where the project has no session: its name is
    then mistaken.
    """
    lost = refusals(store).where("reason = 'placeless'").orderBy("session_id").limit(1).collect()
    if lost:
        raise ValueError(f"session {lost[0]['session_id']} names no project, but holds {lost[0]['held']}")
    place = str(resolve_project(project))
    inside = (F.col("project_dir") == place) | F.col("project_dir").startswith(f"{place}/")
    rows = store.tables["extract_state"].select("session_id", "fingerprint").join(store.tables["sessions"].where(inside).select(F.col("id").alias("session_id")), "session_id")
    if rows.isEmpty():
        raise ValueError(f"no session of the store was recorded under {project}")
    return rows.orderBy("session_id")


def in_order(store, table: str, chosen: DataFrame) -> DataFrame:
    """A table's rows of ``chosen`` sessions, each session's in one partition and in the order of the table's key."""
    column = "id" if table == "sessions" else "session_id"
    rows = store.tables[table]
    rows = rows.join(chosen.select(F.col("session_id").alias("__chosen")), rows[column] == F.col("__chosen"), "left_semi")
    order = [column, *[c for c in model.KEYS[table] if c != column]]
    if "index" in rows.columns:
        order = [column, "source", "index", "id"]
    return rows.repartition(F.col(column)).sortWithinPartitions(*order)
