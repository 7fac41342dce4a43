"""The tree of a session: threads, what spawned them, and the order to walk it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import climbing
from tracewell.plans.digests import thread
from tracewell.plans.drill import spawned

def thread_outline(store, session_id: str, source: str) -> DataFrame:
    """Turns and compactions of a thread in one line.

    A compaction stands before the first turn that starts strictly after it.
    """
    turns = thread(store["live_turns"], session_id, source)
    turns = turns.select(F.lit("turn").alias("kind"), F.col("id").alias("item_id"), "started_at", F.col("index").cast("long").alias("turn_index"))
    marks = thread(store["live_compactions"], session_id, source)
    marks = marks.select(F.lit("compaction").alias("kind"), F.col("id").alias("item_id"), F.col("timestamp").alias("started_at"), F.lit(None).cast("long").alias("turn_index"))
    rows = turns.unionByName(marks)
    at = (F.asc_nulls_last("started_at"), F.desc("kind"), F.asc_nulls_last("turn_index"), F.asc("item_id"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*at)).cast("long")
    return rows.withColumn("place", place).orderBy("place")


def placed_runs(store, session_id: str) -> DataFrame:
    """Where each run hangs: at the turn that spawned it, in its thread's bucket without a turn, or unattached."""
    rows = spawned(store, session_id)
    place = F.when(F.col("spawn_source").isNull(), "unattached").when(F.col("spawn_turn_id").isNull(), "unattributed").otherwise("turn")
    return rows.select(F.col("id").alias("run_id"), place.alias("place"), "spawn_source", "spawn_turn_id", "spawn_call_id")


def hoisted(rows: DataFrame, runs: DataFrame, edge: str) -> DataFrame:
    """A level's rows (``kind, item_id, place``) with each run behind the row that ``edge`` names.

    Runs whose row is not on the level come last. Runs of one row stand by start
    and id; places are counted anew.
    """
    at = rows.select(F.col("item_id").alias(edge), F.col("place").alias("row_place"))
    below = runs.select(F.lit("run").alias("kind"), F.col("id").alias("item_id"), "started_at", edge).join(at, edge, "left")
    below = below.select("kind", "item_id", F.coalesce("row_place", F.lit(2**62)).alias("major"), F.lit(1).alias("minor"), "started_at")
    own = rows.select("kind", "item_id", F.col("place").cast("long").alias("major"), F.lit(0).alias("minor"), F.lit(None).cast("timestamp").alias("started_at"))
    order = Window.partitionBy(F.lit(1)).orderBy("major", "minor", F.asc_nulls_last("started_at"), "item_id")
    return own.unionByName(below).select("kind", "item_id", F.row_number().over(order).cast("long").alias("place")).orderBy("place")


def _of_thread(store, session_id: str, source: str) -> DataFrame:
    """Runs that a call of the thread spawned."""
    return spawned(store, session_id).where(F.col("spawn_source") == source)


def thread_level(store, session_id: str, source: str) -> DataFrame:
    """Turns, compactions and runs of a thread; a run stands behind the turn that spawned it."""
    return hoisted(thread_outline(store, session_id, source).select("kind", "item_id", "place"), _of_thread(store, session_id, source), "spawn_turn_id")


def _calls_of(store, session_id: str, source: str, turn_id: str | None) -> DataFrame:
    turns = thread(store["live_turns"], session_id, source).select(F.col("id").alias("live_turn"))
    calls = thread(store["live_api_calls"], session_id, source)
    return calls.join(turns, calls["turn_id"] == turns["live_turn"], "left").where(F.col("live_turn").eqNullSafe(F.lit(turn_id)))


def calls_level(store, session_id: str, source: str, turn_id: str | None) -> DataFrame:
    """Calls of a turn, or of the bucket without one; a run stands behind the call that spawned it."""
    calls = _calls_of(store, session_id, source, turn_id).select(F.lit("call").alias("kind"), F.col("id").alias("item_id"), F.col("index").alias("place"))
    runs = _of_thread(store, session_id, source).where(F.col("spawn_turn_id").eqNullSafe(F.lit(turn_id)))
    return hoisted(calls, runs, "spawn_call_id")


def tools_level(store, session_id: str, source: str, turn_id: str | None) -> DataFrame:
    """Tool calls of a turn without their calls; a run stands behind the tool call that spawned it."""
    calls = _calls_of(store, session_id, source, turn_id).select(F.col("id").alias("api_call_id"))
    tools = thread(store["live_tool_calls"], session_id, source).join(calls, "api_call_id", "left_semi")
    tools = tools.select(F.lit("tool").alias("kind"), F.col("id").alias("item_id"), F.col("index").alias("place"))
    runs = _of_thread(store, session_id, source).where(F.col("spawn_turn_id").eqNullSafe(F.lit(turn_id)))
    return hoisted(tools, runs, "tool_use_id")


def runs_level(store, session_id: str, source: str) -> DataFrame:
    """Only the runs below a thread, by start."""
    rows = _of_thread(store, session_id, source).select(F.lit("run").alias("kind"), F.col("id").alias("item_id"), "started_at")
    order = Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_last("started_at"), "item_id")
    return rows.select("kind", "item_id", F.row_number().over(order).cast("long").alias("place"))


#: What stands below a node, by its kind and by how much the reader shows: everything, no model calls, or agents only.
CHILDREN = {
    ("thread", "full"): thread_level,
    ("thread", "noapi"): thread_level,
    ("thread", "agents"): runs_level,
    ("turn", "full"): calls_level,
    ("turn", "noapi"): tools_level,
}


def reading_order(edges: DataFrame) -> DataFrame:
    """Add ``path`` to nodes (``session_id, item_id, parent_id, place``): a key that sorts a session's nodes in preorder."""
    return climbing.paths(edges.withColumn("step", F.lpad(F.col("place").cast("string"), 12, "0"))).drop("step")


def parents(store, session_id: str | None = None) -> DataFrame:
    """(session, run, parent): the run recorded as parent, or the thread of the spawning call; null at the top."""
    runs, tools = store["live_agent_runs"], store["live_tool_calls"]
    if session_id is not None:
        runs, tools = runs.where(F.col("session_id") == session_id), tools.where(F.col("session_id") == session_id)
    calls = tools.select("session_id", F.col("id").alias("tool_use_id"), F.col("source").alias("spawner"))
    calls = calls.groupBy("session_id", "tool_use_id").agg(F.min("spawner").alias("spawner"))
    rows = runs.join(calls, ["session_id", "tool_use_id"], "left")
    outside = F.when((F.col("spawner") != "main") & (F.col("spawner") != F.col("id")), F.col("spawner"))
    return rows.select("session_id", F.col("id").alias("run_id"), F.coalesce("parent_agent_id", outside).alias("parent_id"))


def heights(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Round in which each run can be described: leaves in round 0, a parent after all its children.

    A cycle and a missing parent raise, and so does a forest deeper than
    ``max_depth``, where that is given.
    """
    out = climbing.heights(edges.select("session_id", "run_id", "parent_id"))
    if max_depth is not None and not out.where(F.col("height") > max_depth).isEmpty():
        raise ValueError(f"spawn links go deeper than {max_depth}")
    return out


def ancestry(edges: DataFrame) -> DataFrame:
    """(session, run, ancestor, distance) for every run and all above it."""
    return climbing.ancestry(edges.select("session_id", "run_id", "parent_id"))


def walk(nodes: DataFrame) -> DataFrame:
    """Each node's neighbours in reading order. ``nodes`` has ``path``, a sortable preorder key of each session."""
    order = Window.partitionBy("session_id").orderBy("path")
    return nodes.withColumns({"previous": F.lag("item_id").over(order), "next": F.lead("item_id").over(order)})


def error_steps(store, session_id: str) -> DataFrame:
    """Failed calls with the ones before and after, as a reader steps through them."""
    rows = store["live_tool_calls"].where((F.col("session_id") == session_id) & F.col("is_error"))
    order = Window.partitionBy("session_id").orderBy("started_at", "source", "index", "id")
    return rows.select(
        "session_id",
        F.col("id").alias("tool_call_id"),
        F.row_number().over(order).cast("long").alias("step"),
        F.lag("id").over(order).alias("previous"),
        F.lead("id").over(order).alias("next"),
    )


def capped(rows: DataFrame, cap: int, on_path: str, *order) -> DataFrame:
    """The first ``cap`` siblings of each parent; the one on the path to the shown node always stays."""
    rank = F.row_number().over(Window.partitionBy("parent_id").orderBy(*order))
    return rows.withColumn("__rank", rank).where((F.col("__rank") <= cap) | F.col(on_path)).drop("__rank")


def share_meter(cost, total, steps: int = 10, decades: int = 4):
    """How full a meter of ``steps`` is for a share of spend, by decades of its logarithm; 0 for no spend."""
    share = F.nullif(cost / F.nullif(total, F.lit(0.0)), F.lit(0.0))
    level = F.ceil(F.lit(steps) * (F.lit(1) + F.log10(share) / F.lit(decades)))
    return F.when(share.isNull(), 0).otherwise(F.least(F.greatest(level, F.lit(1)), F.lit(steps)))
