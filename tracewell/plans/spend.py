"""What sessions did and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import iso_week, json_field
from tracewell.operators.quantiles import exact_quantiles
from tracewell.plans.manifest import corpus, integer

MAIN_THREAD = "(main thread)"
#: Sessions whose costs one task may hold.
IN_ONE_BUFFER = 1_000_000
COUNTS = ("turns", "api_calls", "tool_calls", "agent_runs", "compactions")


def money(c, digits: int = 4):
    return F.round(c, digits)


def totals(columns) -> list:
    return [F.sum(c).alias(c) for c in columns]


def spend_by(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls, cost and unpriced calls of each key: one aggregation for all three."""
    return calls.groupBy(*keys).agg(
        F.count("*").alias("api_calls"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced_api_calls"),
    )


def tools_by(tools: DataFrame, *keys: str) -> DataFrame:
    return tools.groupBy(*keys).agg(F.count("*").alias("tool_calls"), F.count_if("is_error").alias("tool_errors"))


def with_run_work(runs: DataFrame, store, family: str = "corpus") -> DataFrame:
    """Runs with the calls, tools and spend of their own thread, zero where there are none."""
    key = ["session_id", "id"]
    calls = spend_by(store[f"{family}_api_calls"], "session_id", "source").withColumnRenamed("source", "id")
    tools = tools_by(store[f"{family}_tool_calls"], "session_id", "source").withColumnRenamed("source", "id")
    out = runs.join(calls, key, "left").join(tools, key, "left")
    return out.fillna(0, ["api_calls", "cost_usd", "unpriced_api_calls", "tool_calls", "tool_errors"])


@corpus()
def session_counts(store, scope) -> DataFrame:
    """Totals of each period."""
    rows = scope.periods.join(store.corpus_rollups, "session_id")
    return rows.groupBy("period").agg(
        F.count("*").alias("sessions"), *totals(COUNTS), money(F.sum("cost_usd")).alias("cost_usd"), F.sum("unpriced_api_calls").alias("unpriced_api_calls")
    ).orderBy("period")


@corpus()
def sessions(store, scope) -> DataFrame:
    """The project's sessions, oldest first."""
    rows = scope.sessions.select("session_id", "in_window").join(store.corpus_rollups, "session_id")
    rows = rows.select("session_id", "started_at", "in_window", *COUNTS, money("cost_usd").alias("cost_usd"), "unpriced_api_calls")
    return rows.orderBy(F.asc_nulls_last("started_at"), "session_id")


@corpus()
def weekly_trend(store, scope) -> DataFrame:
    """Totals of each ISO week; sessions without a start come as ``undated``."""
    rows = scope.sessions.select("session_id").join(store.corpus_rollups, "session_id")
    week = F.coalesce(iso_week("started_at"), F.lit("undated")).alias("week")
    return rows.groupBy(week).agg(
        F.count("*").alias("sessions"), *totals(COUNTS), money(F.sum("cost_usd")).alias("cost_usd"), F.sum("unpriced_api_calls").alias("unpriced_api_calls")
    ).orderBy("week")


@corpus()
def cost_distribution(store, scope) -> DataFrame:
    """Percentiles of session cost, and the share that the costliest tenth spent."""
    tokens = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    rows = scope.periods.join(store.corpus_rollups, "session_id").select("period", "cost_usd", tokens.alias("tokens"), "unpriced_api_calls")
    shares = {f"p{q}_cost_usd": q / 100 for q in (50, 90, 99)}
    # So few costs are sorted in one buffer of the same pass; more are found by ranks within ranges.
    few = store["sessions"].count() <= IN_ONE_BUFFER
    held = rows.groupBy("period").agg(
        F.count("*").alias("sessions"),
        F.sum("cost_usd").alias("spent"),
        F.avg("cost_usd").alias("mean_cost_usd"),
        *[F.percentile("cost_usd", q).alias(n) for n, q in shares.items() if few],
        F.max("cost_usd").alias("max_cost_usd"),
        F.sum("tokens").alias("tokens"),
        F.sum("unpriced_api_calls").alias("unpriced_api_calls"),
    )
    if not few:
        held = held.join(exact_quantiles(rows, "period", "cost_usd", shares), "period", "left")
    # A session is of the costliest tenth if at least nine in ten of the others cost less: a second pass sums what
    # lies above the 0.9 percentile, and what lies on it where enough lies below. No sort of all sessions in one task.
    cost, edge = F.col("cost_usd"), F.col("edge")
    tops = rows.join(F.broadcast(held.select("period", F.col("p90_cost_usd").alias("edge"))), "period").groupBy("period").agg(
        F.coalesce(F.sum(F.when(cost > edge, cost)), F.lit(0.0)).alias("above"),
        F.coalesce(F.sum(F.when(cost == edge, cost)), F.lit(0.0)).alias("on_it"),
        F.count_if(cost < edge).alias("below"),
    )
    enough = (F.col("below") * 10 >= (F.col("sessions") - 1) * 9) & (F.col("sessions") > 1)
    top = F.when(F.col("sessions") > 1, F.col("above") + F.when(enough, F.col("on_it")).otherwise(0.0))
    names = ("mean_cost_usd", "p50_cost_usd", "p90_cost_usd", "p99_cost_usd", "max_cost_usd")
    return held.join(tops, "period").select(
        "period",
        "sessions",
        money("spent").alias("cost_usd"),
        *[money(c).alias(c) for c in names],
        F.round(top / F.nullif(F.col("spent"), F.lit(0.0)), 4).alias("top_decile_share"),
        "tokens",
        "unpriced_api_calls",
    ).orderBy("period")


@corpus(skill_share_pct=integer(50), delegating_runs=integer(3), editing_calls=integer(5), busy_tool_calls=integer(5))
def session_shapes(store, scope, skill_share_pct, delegating_runs, editing_calls, busy_tool_calls) -> DataFrame:
    """Sessions by the first shape that fits them."""
    edits = store["corpus_tool_calls"].where(F.col("name").isin("Edit", "Write", "NotebookEdit"))
    edits = edits.groupBy("session_id").agg(F.count("*").alias("edit_calls"))
    skills = store["corpus_api_calls"].where("attribution_skill IS NOT NULL").groupBy("session_id", "attribution_skill").count()
    skills = skills.groupBy("session_id").agg(F.max("count").alias("top"))
    rows = scope.periods.join(store.corpus_rollups, "session_id").join(edits, "session_id", "left").join(skills, "session_id", "left")
    rows = rows.fillna(0, ["edit_calls", "top"])
    share = F.col("top") * 100 / F.nullif(F.col("api_calls"), F.lit(0))
    shape = (
        F.when((F.col("turns") == 0) & (F.col("agent_runs") == 0), "no-work")
        .when(share >= skill_share_pct, "skill-orchestrated")
        .when(F.col("agent_runs") >= delegating_runs, "delegation-heavy")
        .when(F.col("edit_calls") >= editing_calls, "solo-editing")
        .when((F.col("edit_calls") == 0) & (F.col("tool_calls") >= busy_tool_calls), "read-only-analysis")
        .when(F.col("tool_calls") < busy_tool_calls, "conversational")
        .otherwise("mixed")
    )
    return rows.groupBy("period", shape.alias("shape")).agg(
        F.count("*").alias("sessions"),
        *totals(("turns", "tool_calls", "edit_calls", "agent_runs", "compactions")),
        money(F.sum("cost_usd")).alias("cost_usd"),
        money(F.avg("cost_usd")).alias("cost_usd_per_session"),
        F.sum("unpriced_api_calls").alias("unpriced_api_calls"),
    ).orderBy("period", F.desc("sessions"), "shape")


@corpus()
def agent_types(store, scope) -> DataFrame:
    """Runs of each agent type, and what they did."""
    runs = with_run_work(store["corpus_agent_runs"].select("session_id", "id", "agent_type", "is_fork"), store)
    rows = scope.periods.join(runs, "session_id")
    return rows.groupBy("period", "agent_type").agg(
        F.count("*").alias("runs"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_if("is_fork").alias("forks"),
        *totals(("api_calls", "tool_calls", "tool_errors")),
        F.round(F.avg("api_calls"), 2).alias("api_calls_per_run"),
        money(F.sum("cost_usd")).alias("cost_usd"),
        money(F.avg("cost_usd")).alias("cost_usd_per_run"),
        F.sum("unpriced_api_calls").alias("unpriced_api_calls"),
    ).orderBy("period", F.desc("runs"), "agent_type")


@corpus()
def agent_compactions(store, scope) -> DataFrame:
    """Context compactions by the type of the thread that they happened in."""
    main = scope.periods.select("period", "session_id", F.lit(MAIN_THREAD).alias("agent_type"), F.lit("main").alias("source"))
    runs = store["corpus_agent_runs"].select("session_id", "agent_type", F.col("id").alias("source"))
    threads = main.unionByName(scope.periods.join(runs, "session_id"))
    counts = store["corpus_compactions"].groupBy("session_id", "source").agg(F.count("*").alias("n"))
    rows = threads.join(counts, ["session_id", "source"], "left").fillna(0, ["n"])
    return rows.groupBy("period", "agent_type").agg(
        F.count("*").alias("threads"),
        F.count_if(F.col("n") > 0).alias("compacting_threads"),
        F.sum("n").alias("compactions"),
        F.round(F.avg("n"), 2).alias("compactions_per_thread"),
        F.count_distinct("session_id").alias("sessions"),
    ).orderBy("period", F.desc("compactions"), F.desc("threads"), "agent_type")


@corpus()
def slash_commands(store, scope) -> DataFrame:
    """What the turns that a slash command opened led to."""
    turns = store["corpus_turns"].where("command_name IS NOT NULL").select("session_id", "source", F.col("id").alias("turn_id"), "command_name")
    calls = store["corpus_api_calls"]
    key = ["session_id", "source", "turn_id"]
    # A tool call answers to its call by session and id: the thread plays no part there.
    tools = store["corpus_tool_calls"].select("session_id", "api_call_id")
    tools = calls.select(*key, F.col("id").alias("api_call_id")).join(tools, ["session_id", "api_call_id"])
    tools = tools.groupBy(*key).agg(F.count("*").alias("tool_calls"))
    rows = scope.periods.join(turns, "session_id").join(spend_by(calls, *key), key, "left").join(tools, key, "left")
    rows = rows.fillna(0, ["api_calls", "cost_usd", "unpriced_api_calls", "tool_calls"])
    return rows.groupBy("period", F.col("command_name").alias("command")).agg(
        F.count("*").alias("turns"),
        F.count_distinct("session_id").alias("sessions"),
        *totals(("api_calls", "tool_calls")),
        money(F.sum("cost_usd")).alias("cost_usd"),
        F.sum("unpriced_api_calls").alias("unpriced_api_calls"),
    ).orderBy("period", F.desc("turns"), "command")


@corpus()
def skill_activity(store, scope) -> DataFrame:
    """Skills by the calls attributed to them and by their invocations; a skill may have only one."""
    calls = scope.periods.join(store["corpus_api_calls"].where("attribution_skill IS NOT NULL"), "session_id")
    used = calls.groupBy("period", F.col("attribution_skill").alias("skill")).agg(
        F.count("*").alias("api_calls"),
        F.count_distinct("session_id").alias("sessions"),
        F.sum("cost_usd").alias("cost_usd"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced_api_calls"),
    )
    asked = scope.periods.join(store["corpus_tool_calls"].where("name = 'Skill'"), "session_id")
    asked = asked.groupBy("period", json_field("input", "$.skill").alias("skill")).agg(
        F.count("*").alias("invocations"), F.count_distinct("session_id").alias("invoking_sessions")
    )
    rows = used.join(asked, ["period", "skill"], "full")
    rows = rows.fillna(0, ["invocations", "invoking_sessions", "api_calls", "sessions", "cost_usd", "unpriced_api_calls"])
    rows = rows.select("period", "skill", "invocations", "invoking_sessions", "api_calls", "sessions", money("cost_usd").alias("cost_usd"), "unpriced_api_calls")
    return rows.orderBy("period", F.desc("api_calls"), F.desc("invocations"), F.asc_nulls_last("skill"))


@corpus(min_sessions=integer(3))
def co_occurrence(store, scope, min_sessions) -> DataFrame:
    """Pairs of tools, skills or agent types that share sessions.

    A session's distinct items of a kind are few names, so the pairs are made
    inside one array per session instead of by a self-join of the incidences.
    """
    named = [
        ("tool", store["corpus_tool_calls"].select("session_id", F.col("name").alias("item"))),
        ("skill", store["corpus_api_calls"].select("session_id", F.col("attribution_skill").alias("item")).where("item IS NOT NULL")),
        ("agent_type", store["corpus_agent_runs"].select("session_id", F.col("agent_type").alias("item"))),
    ]
    parts = [rows.distinct().withColumn("kind", F.lit(kind)) for kind, rows in named]
    held = scope.periods.join(parts[0].unionByName(parts[1]).unionByName(parts[2]), "session_id")
    solo = held.groupBy("period", "kind", "item").agg(F.count("*").alias("n"))
    sets = held.groupBy("period", "kind", "session_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    pairs = F.flatten(
        F.transform("items", lambda a: F.transform(F.filter("items", lambda b: b > a), lambda b: F.struct(a.alias("item_a"), b.alias("item_b"))))
    )
    both = sets.select("period", "kind", F.explode(pairs).alias("p")).groupBy("period", "kind", "p.item_a", "p.item_b").agg(F.count("*").alias("sessions"))
    both = both.where(F.col("sessions") >= min_sessions)
    for side in ("a", "b"):
        both = both.join(solo.select("period", "kind", F.col("item").alias(f"item_{side}"), F.col("n").alias(f"sessions_{side}")), ["period", "kind", f"item_{side}"])
    rate = F.round(F.col("sessions") / F.least("sessions_a", "sessions_b"), 4)
    both = both.select("period", "kind", "item_a", "item_b", "sessions", "sessions_a", "sessions_b", rate.alias("conditional_rate"))
    return both.orderBy("period", "kind", F.desc("sessions"), F.desc("conditional_rate"), "item_a", "item_b")
