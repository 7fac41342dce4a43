"""What stands below every node of every session: one plan for each preset, of which any level is a filter.

A node is its session, kind, thread (``source``) and id. Sessions and runs hold
threads: turns with compactions between them, then the calls that answer no
turn, as one node. Presets say how much a reader sees: ``full``, ``noapi``
(tools stand under turns, calls are folded away), ``agents`` (only runs).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import climbing
from tracewell.operators.tree import walk

PRESETS = ("full", "noapi", "agents")
KINDS = ("session", "run", "turn", "unattributed", "call", "tool", "compaction", "unattached")
THREAD = ["session_id", "source"]
PARENT = ["session_id", "parent_kind", "parent_source", "parent_id"]
LAST = 2**62


def spawned(store) -> DataFrame:
    """Every run with the thread, call and turn that spawned it, where a tool call outside the run did."""
    tools = store["live_tool_calls"].select("session_id", F.col("id").alias("tool_use_id"), F.col("source").alias("spawn_source"), F.col("api_call_id").alias("spawn_call_id"))
    runs = store["live_agent_runs"].select("session_id", F.col("id").alias("run_id"), "parent_agent_id", "tool_use_id", "started_at")
    tools = tools.join(runs.select("session_id", "run_id", "tool_use_id"), ["session_id", "tool_use_id"]).where("spawn_source <> run_id").drop("tool_use_id")
    calls = calls_in_turns(store).select("session_id", F.col("source").alias("spawn_source"), F.col("item_id").alias("spawn_call_id"), F.col("turn_id").alias("spawn_turn_id"))
    placed = tools.join(calls, ["session_id", "spawn_source", "spawn_call_id"])
    return runs.join(placed, ["session_id", "run_id"], "left")


def calls_in_turns(store) -> DataFrame:
    """``session_id, source, item_id, index, turn_id`` of calls; the turn is null where it does not count."""
    turns = store["live_turns"].select(*THREAD, F.col("id").alias("turn_id"), F.lit(True).alias("live"))
    calls = store["live_api_calls"].select(*THREAD, F.col("id").alias("item_id"), F.col("index").cast("long").alias("index"), "turn_id")
    return calls.join(turns, [*THREAD, "turn_id"], "left").withColumn("turn_id", F.when(F.col("live"), F.col("turn_id"))).drop("live")


def _row(parent_kind, parent_source, parent_id, kind, source, item, major, minor=0, at=None, then=None) -> list[Column]:
    """A child; ``major``, ``minor``, ``at`` and ``then`` order it among its siblings."""
    lit = lambda x, name: (F.lit(x) if isinstance(x, (str, int)) or x is None else x).alias(name)
    none = F.lit(None).cast("string")
    return [
        F.col("session_id"),
        lit(parent_kind, "parent_kind"),
        (none if parent_source is None else parent_source).alias("parent_source"),
        parent_id.alias("parent_id"),
        lit(kind, "kind"),
        (none if source is None else source).alias("source"),
        (F.lit(item) if isinstance(item, str) else item).alias("item_id"),
        (F.lit(major) if isinstance(major, int) else major).cast("long").alias("major"),
        F.lit(minor).alias("minor"),
        (F.lit(None).cast("timestamp") if at is None else at).alias("at"),
        (F.lit("") if then is None else then).alias("then"),
    ]


def _of_thread() -> tuple[Column, Column]:
    """Kind and id of the node that holds a thread."""
    main = F.col("source") == "main"
    return F.when(main, "session").otherwise("run"), F.when(main, F.col("session_id")).otherwise(F.col("source"))


def _under_turn(turn: str) -> tuple[Column, Column]:
    """Kind and id of the node that a call of a turn, or of none, stands under."""
    return F.when(F.col(turn).isNull(), "unattributed").otherwise("turn"), F.coalesce(turn, "source")


def _threads(store) -> list[DataFrame]:
    """Turns by index, compactions before the first turn that started after them, then the calls without a turn."""
    kind, holder = _of_thread()
    turns = store["live_turns"].select(*THREAD, F.col("id"), F.col("index").cast("long").alias("index"), "started_at")
    by_index = Window.partitionBy(*THREAD).orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    # The first turn that started later is the first at which the latest start so far is later; that rises with the index.
    reached = turns.select(*THREAD, "index", F.max("started_at").over(by_index).alias("at"), F.lit(None).cast("string").alias("mark"))
    marks = store["live_compactions"].select(*THREAD, F.lit(None).cast("long").alias("index"), F.col("timestamp").alias("at"), F.col("id").alias("mark"))
    ahead = Window.partitionBy(*THREAD).orderBy(F.asc_nulls_first("at"), F.col("mark").isNotNull()).rowsBetween(1, Window.unboundedFollowing)
    before = reached.unionByName(marks).withColumn("before", F.min("index").over(ahead)).where("mark IS NOT NULL")
    loose = calls_in_turns(store).where("turn_id IS NULL").select(*THREAD).distinct()
    return [
        turns.select(*_row(kind, None, holder, "turn", F.col("source"), F.col("id"), F.col("index"), 1)),
        before.select(*_row(kind, None, holder, "compaction", F.col("source"), F.col("mark"), F.coalesce("before", F.lit(LAST - 2)), 0, F.col("at"), F.col("mark"))),
        loose.select(*_row(kind, None, holder, "unattributed", F.col("source"), F.col("source"), LAST - 1)),
    ]


def _unattached(runs: DataFrame) -> list[DataFrame]:
    """The runs that no call spawned, below a node of their own at the end of the session."""
    loose = runs.where("spawn_source IS NULL")
    return [
        loose.select("session_id").distinct().select(*_row("session", None, F.col("session_id"), "unattached", None, "unattached", LAST)),
        loose.select(*_row("unattached", None, F.lit("unattached"), "run", None, F.col("run_id"), 0, 0, F.col("started_at"), F.col("run_id"))),
    ]


def _hoisted(rows: DataFrame, runs: DataFrame, edge: str) -> list[DataFrame]:
    """Children of turns (``session_id, source, turn_id, kind, item_id, place``), each run behind the row that ``edge`` names.

    Runs whose row is not there come last, those of one row together.
    """
    kind, holder = _under_turn("turn_id")
    own = rows.select(*_row(kind, F.col("source"), holder, F.col("kind"), F.col("source"), F.col("item_id"), F.col("place")))
    at = rows.select(*THREAD, F.col("item_id").alias(edge), F.col("turn_id").alias("row_turn"), "place")
    below = runs.where("spawn_source IS NOT NULL").select("session_id", F.col("spawn_source").alias("source"), F.col("spawn_turn_id").alias("turn_id"), "run_id", "started_at", edge)
    below = below.join(at, [*THREAD, edge], "left").withColumn("place", F.when(F.col("turn_id").eqNullSafe(F.col("row_turn")), F.col("place")))
    return [own, below.select(*_row(kind, F.col("source"), holder, "run", None, F.col("run_id"), F.coalesce("place", F.lit(LAST)), 1, F.col("started_at"), F.col("run_id")))]


def _tools(store) -> DataFrame:
    """``session_id, source, turn_id, call, item_id, at``: tool calls of calls, ``at`` by call and then by tool."""
    calls = calls_in_turns(store).select(*THREAD, F.col("item_id").alias("api_call_id"), F.col("index").alias("call_index"), "turn_id")
    tools = store["live_tool_calls"].select(*THREAD, "api_call_id", F.col("id").alias("item_id"), F.col("index").alias("tool_index"))
    rows = tools.join(calls, [*THREAD, "api_call_id"])
    order = Window.partitionBy(*THREAD, "turn_id").orderBy("call_index", "tool_index", "item_id")
    return rows.withColumn("place", F.row_number().over(order))


def children(store, preset: str = "full") -> DataFrame:
    """``session_id, parent_kind, parent_source, parent_id, place, kind, source, item_id``: all levels of all sessions.

    ``place`` counts from 1 within a level. Leaves (tools, but under ``agents``
    not, and compactions) are no parents.
    """
    if preset not in PRESETS:
        raise ValueError(f"no preset is called {preset}: {', '.join(PRESETS)}")
    runs = spawned(store)
    loose = _unattached(runs)
    if preset == "agents":
        by = [F.col("started_at"), F.col("run_id")]
        run = ("run", None, F.col("run_id"), 0, 0, *by)
        placed = runs.where("spawn_source IS NOT NULL").withColumn("source", F.col("spawn_source"))
        kind, holder = _under_turn("spawn_turn_id")
        parts = [
            placed.where("source = 'main'").select(*_row("session", None, F.col("session_id"), *run)),
            runs.where("parent_agent_id IS NOT NULL").select(*_row("run", None, F.col("parent_agent_id"), *run)),
            placed.select(*_row(kind, F.col("source"), holder, *run)),
            placed.select(*_row("call", F.col("source"), F.col("spawn_call_id"), *run)),
            placed.select(*_row("tool", F.col("source"), F.col("tool_use_id"), *run)),
        ]
    else:
        tools = _tools(store)
        if preset == "full":
            rows, edge = calls_in_turns(store).withColumnsRenamed({"index": "place"}).withColumn("kind", F.lit("call")), "spawn_call_id"
        else:
            rows, edge = tools.withColumn("kind", F.lit("tool")), "tool_use_id"
        parts = [
            *_threads(store),
            *_hoisted(rows, runs, edge),
            tools.select(*_row("call", F.col("source"), F.col("api_call_id"), "tool", F.col("source"), F.col("item_id"), F.col("tool_index"))),
        ]
    every = reduce(DataFrame.unionByName, [*parts, *loose])
    level = Window.partitionBy(*PARENT).orderBy("major", "minor", F.asc_nulls_last("at"), "then", "item_id")
    return every.select(*PARENT, F.row_number().over(level).cast("long").alias("place"), "kind", "source", "item_id")


def key(kind: str, source: str, item: str) -> Column:
    return F.concat_ws("|", kind, F.coalesce(source, F.lit("")), item)


def steps(store, preset: str = "full") -> DataFrame:
    """``session_id, item_id, previous, next`` of every node below a session that the tree shows, in reading order.

    An ``item_id`` is kind, thread and id. Not for ``agents``, where one run
    stands below several nodes.
    """
    if preset == "agents":
        raise ValueError("under agents the levels are no tree")
    rows = children(store, preset)
    if preset == "noapi":
        rows = rows.where("parent_kind <> 'call'")
    parent = F.when(F.col("parent_kind") != "session", key("parent_kind", "parent_source", "parent_id"))
    nodes = rows.select("session_id", key("kind", "source", "item_id").alias("item_id"), parent.alias("parent_id"), F.lpad(F.col("place").cast("string"), 12, "0").alias("step"))
    return walk(climbing.paths(nodes)).select("session_id", "item_id", "previous", "next")
