"""Digests of one session or run, and what enrichment says of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import SPACE, clipped
from tracewell.plans.manifest import corpus, integer, keyed, text
from tracewell.plans.spend import money, spend_by, tools_by

UNATTRIBUTED = "(unattributed)"


def thread(rows: DataFrame, session_id: str, source: str) -> DataFrame:
    return rows.where((F.col("session_id") == session_id) & (F.col("source") == source))


def digest(store, session_id: str, source: str) -> DataFrame:
    """A thread's turns with their spend; spend without a live turn has rows of its own."""
    turns = thread(store["live_turns"], session_id, source)
    calls = thread(store["live_api_calls"], session_id, source)
    tools = thread(store["live_tool_calls"], session_id, source).select("api_call_id", "is_error")
    tools = tools_by(tools.join(calls.select(F.col("id").alias("api_call_id"), "turn_id"), "api_call_id"), "turn_id")
    spend = calls.groupBy("turn_id").agg(
        F.count("*").alias("api_calls"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced_api_calls"),
        F.min("started_at").alias("first_call"),
    )
    tools = tools.withColumnRenamed("turn_id", "tool_turn")
    # Tools answer to calls of the same turn, so they hang on the spend row before turns join.
    spend = spend.join(tools, F.col("turn_id").eqNullSafe(F.col("tool_turn")), "left").drop("tool_turn")
    out = turns.join(spend, turns["id"] == spend["turn_id"], "full")
    return out.select(
        F.col("index").alias("turn_index"),
        F.coalesce(turns["id"], F.lit(UNATTRIBUTED)).alias("turn_id"),
        clipped("prompt", 300).alias("prompt"),
        clipped("command_name", 60).alias("command_name"),
        clipped("command_args", 300).alias("command_args"),
        F.coalesce("started_at", "first_call").alias("started_at"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("api_calls", "tool_calls", "tool_errors")],
        F.round(F.coalesce("cost_usd", F.lit(0.0)), 4).alias("cost_usd"),
        F.coalesce("unpriced_api_calls", F.lit(0)).alias("unpriced_api_calls"),
    ).orderBy(F.asc_nulls_last("turn_index"))


@keyed(session_id=text())
def session_digest(store, session_id) -> DataFrame:
    """The main thread's turns."""
    return digest(store, session_id, "main")


@keyed(session_id=text(), source=text())
def run_digest(store, session_id, source) -> DataFrame:
    """The turns of one run."""
    return digest(store, session_id, source)


@keyed(session_id=text())
def session_overview(store, session_id) -> DataFrame:
    """A session's headline, with the skills and commands used (in order) and how it was extracted."""
    mine = F.col("session_id") == session_id
    tools = store["live_tool_calls"].where(mine).agg(F.count_if("is_error").alias("tool_errors"))

    def names(rows: DataFrame, column: str, name: str) -> DataFrame:
        joined = F.array_join(F.array_sort(F.collect_set(column)), " ")
        return rows.where(mine).agg(F.when(F.count(column) > 0, joined).alias(name))

    state = store["extract_state"].select("session_id", F.col("fingerprint").alias("extract_fingerprint"), "extractor_version")
    head = store.session_rollups.where(mine).join(state, "session_id", "left")
    return head.select(
        "session_id",
        "started_at",
        "turns",
        "api_calls",
        "tool_calls",
        tools.scalar().alias("tool_errors"),
        "agent_runs",
        "compactions",
        money("cost_usd").alias("cost_usd"),
        "unpriced_api_calls",
        names(store["live_api_calls"], "attribution_skill", "skills").scalar().alias("skills"),
        names(store["live_turns"], "command_name", "commands").scalar().alias("commands"),
        "extract_fingerprint",
        "extractor_version",
    )


TAGS = ("description", "category", "outcome", "friction", "enrichment_model", "prompt_version", "taxonomy_version", "enriched_at")


@keyed(session_id=text(), level=text(None))
def enrichment_digest(store, session_id, level) -> DataFrame:
    """All that enrichment says of one session, by level."""
    mine = F.col("session_id") == session_id
    none = F.lit(None).cast("string")
    turns = store.enriched("turn").where(mine & (F.col("source") == "main"))
    turns = turns.select(F.lit("turn").alias("level"), "source", F.col("id").alias("item_id"), F.col("index").alias("item_index"), F.col("command_name").alias("label"), "started_at", *TAGS)
    runs = store.enriched("agent_run").where(mine)
    runs = runs.select(F.lit("agent_run").alias("level"), F.col("id").alias("source"), F.col("id").alias("item_id"), F.lit(None).cast("int").alias("item_index"), F.col("agent_type").alias("label"), "started_at", *TAGS)
    whole = store.enriched("session").where(mine)
    whole = whole.select(F.lit("session").alias("level"), none.alias("source"), none.alias("item_id"), F.lit(None).cast("int").alias("item_index"), none.alias("label"), "started_at", *TAGS)
    arms = {"turn": turns, "agent_run": runs, "session": whole}
    chosen = list(arms.values()) if level is None else [arms[level]] if level in arms else [turns.where("false")]
    out = chosen[0]
    for arm in chosen[1:]:
        out = out.unionByName(arm)
    return out.orderBy("level", F.asc_nulls_last("item_index"), F.asc_nulls_last("item_id"))


@corpus()
def enrichment_coverage(store, scope) -> DataFrame:
    """Items of each level by what enrichment says of them; undescribed ones have nulls."""
    said = ["category", "outcome", "friction", "enrichment_model", "prompt_version", "taxonomy_version", "enriched_at"]

    def told(level: str, *keys: str) -> DataFrame:
        return store[f"{level}_enrichments"].withColumnRenamed("model", "enrichment_model").select(*keys, *said)

    turns = store["corpus_turns"].where("source = 'main'").select("session_id", "source", F.col("id").alias("turn_id"))
    turns = turns.join(told("turn", "session_id", "source", "turn_id"), ["session_id", "source", "turn_id"], "left")
    runs = store["corpus_agent_runs"].select("session_id", F.col("id").alias("agent_run_id"))
    runs = runs.join(told("agent_run", "session_id", "agent_run_id"), ["session_id", "agent_run_id"], "left")
    whole = describable(store.corpus_rollups).select("session_id").join(told("session", "session_id"), "session_id", "left")
    items = None
    for level, rows in (("turn", turns), ("agent_run", runs), ("session", whole)):
        arm = rows.select("session_id", F.lit(level).alias("level"), *said)
        items = arm if items is None else items.unionByName(arm)
    keys = ["period", "level", "category", "outcome", "enrichment_model", "prompt_version", "taxonomy_version"]
    out = scope.periods.join(items, "session_id").groupBy(*keys).agg(
        F.count("*").alias("items"), F.count("friction").alias("with_friction"), F.max("enriched_at").alias("last_enriched_at")
    )
    out = out.withColumn("level_items", F.sum("items").over(Window.partitionBy("period", "level")))
    out = out.withColumn("share_pct", F.round(F.lit(100.0) * F.col("items") / F.col("level_items"), 1))
    out = out.select(*keys, "items", "level_items", "share_pct", "with_friction", "last_enriched_at")
    return out.orderBy("period", "level", F.desc("items"), F.asc_nulls_first("category"), F.asc_nulls_last("outcome"))


def describable(rollups: DataFrame) -> DataFrame:
    """Sessions with something to describe."""
    return rollups.where(((F.col("turns") > 0) | (F.col("agent_runs") > 0)) & (F.col("api_calls") > 0))


@keyed(session_id=text(), source=text(None), max_chars=integer(200))
def error_records(store, session_id, source, max_chars) -> DataFrame:
    """A session's failed tool calls, and the last raw line that names each."""
    failed = store["live_tool_calls"].where((F.col("session_id") == session_id) & F.col("is_error"))
    if source is not None:
        failed = failed.where(F.col("source") == source)
    raw = store["raw_records"].where(F.col("session_id") == session_id).select("session_id", "source", "line_no", "raw")
    named = failed.select("session_id", "source", "id").join(raw, ["session_id", "source"]).where(F.contains("raw", F.col("id")))
    named = named.groupBy("session_id", "source", "id").agg(F.max("line_no").alias("line_no"))
    error = F.regexp_replace(F.trim("result"), f"{SPACE}+", " ")
    out = failed.join(named, ["session_id", "source", "id"], "left")
    return out.select(
        "source",
        "line_no",
        F.col("name").alias("tool"),
        F.col("id").alias("tool_call_id"),
        "started_at",
        F.length("result").cast("long").alias("error_chars"),
        clipped(error, max_chars).alias("error"),
    ).orderBy(F.asc_nulls_last("line_no"), "started_at", "tool_call_id")


@keyed(session_id=text(), source=text(), first_line=integer(), last_line=integer(), max_chars=integer(2000))
def records_slice(store, session_id, source, first_line, last_line, max_chars) -> DataFrame:
    """Raw lines of a thread."""
    rows = thread(store["raw_records"], session_id, source).where(F.col("line_no").between(first_line, last_line))
    return rows.select("line_no", "type", "timestamp", F.length("raw").cast("long").alias("raw_chars"), clipped("raw", max_chars).alias("raw")).orderBy("line_no")
