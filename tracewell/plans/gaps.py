"""Silences between calls, and the contexts that calls rebuilt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import rebuilt_context, seconds_between
from tracewell.plans.manifest import corpus, integer
from tracewell.plans.spend import MAIN_THREAD

THREAD = ("session_id", "source")


def in_thread():
    return Window.partitionBy(*THREAD).orderBy("index")


def run_types(store) -> DataFrame:
    return store["corpus_agent_runs"].select("session_id", F.col("id").alias("source"), "agent_type")


def gaps(store, scope, min_idle_seconds, min_rebuilt_tokens, min_rebuilt_pct) -> DataFrame:
    """Calls that followed a silence. The windows come before any fan-out by period."""
    calls = scope.sessions.select("session_id", "in_window").join(store["corpus_api_calls"], "session_id")
    calls = calls.select(
        *THREAD,
        "in_window",
        F.lag("started_at").over(in_thread()).alias("gap_start"),
        "started_at",
        rebuilt_context("cache_creation_tokens", "cache_read_tokens", min_rebuilt_tokens, min_rebuilt_pct).alias("reloaded"),
        F.col("cache_creation_tokens").alias("rebuilt_tokens"),
        (F.coalesce(F.lag("cache_1h_tokens").over(in_thread()), F.lit(0)) > 0).alias("cached_1h"),
    )
    calls = calls.withColumn("idle_seconds", seconds_between("gap_start", "started_at")).where(F.col("idle_seconds") >= min_idle_seconds)
    typed = calls.join(run_types(store), list(THREAD), "left")
    return typed.withColumn("agent_type", F.coalesce("agent_type", F.lit(MAIN_THREAD)))


@corpus(min_idle_seconds=integer(300), min_rebuilt_tokens=integer(20000), min_rebuilt_pct=integer(90))
def idle_gaps(store, scope, min_idle_seconds, min_rebuilt_tokens, min_rebuilt_pct) -> DataFrame:
    """Every silence of a thread, longest first."""
    rows = gaps(store, scope, min_idle_seconds, min_rebuilt_tokens, min_rebuilt_pct)
    rows = rows.select("in_window", *THREAD, "agent_type", "gap_start", "idle_seconds", "reloaded", "rebuilt_tokens", "cached_1h")
    return rows.orderBy(F.desc("idle_seconds"), *THREAD)


@corpus(short_gap_seconds=integer(), min_idle_seconds=integer(300), min_rebuilt_tokens=integer(20000), min_rebuilt_pct=integer(90))
def reload_cost_split(store, scope, short_gap_seconds, min_idle_seconds, min_rebuilt_tokens, min_rebuilt_pct) -> DataFrame:
    """Rebuilt tokens after short and after long silences, in all and by agent type."""
    rows = gaps(store, scope, min_idle_seconds, min_rebuilt_tokens, min_rebuilt_pct)
    rows = rows.withColumn("short", F.col("idle_seconds") < short_gap_seconds).select("session_id", "agent_type", "short", "reloaded", F.col("rebuilt_tokens").alias("tokens"))
    rows = scope.periods.join(rows, "session_id")
    tokens = F.col("tokens")
    out = rows.groupingSets([[F.col("period")], [F.col("period"), F.col("agent_type")]], "period", "agent_type").agg(
        F.grouping("agent_type").alias("all_types"),
        F.count("*").alias("gaps"),
        F.count_if("short").alias("short_gaps"),
        F.count_if("reloaded").alias("reloads"),
        F.count_if(F.col("reloaded") & F.col("short")).alias("short_reloads"),
        F.coalesce(F.sum(F.when(F.col("reloaded"), tokens)), F.lit(0)).alias("rebuilt_tokens"),
        F.coalesce(F.sum(F.when(F.col("reloaded") & F.col("short"), tokens)), F.lit(0)).alias("short_rebuilt_tokens"),
    )

    def share(part: str, whole: str):
        return F.round(F.lit(100.0) * F.col(part) / F.nullif(F.col(whole), F.lit(0)), 1)

    out = out.withColumns({"short_reload_pct": share("short_reloads", "reloads"), "short_token_pct": share("short_rebuilt_tokens", "rebuilt_tokens")})
    everything = F.col("all_types") == 1
    out = out.withColumn("grain", F.when(everything, "corpus").otherwise("agent_type")).withColumn("agent_type", F.when(everything, "(all)").otherwise(F.col("agent_type")))
    out = out.orderBy("period", F.desc("all_types"), F.desc("rebuilt_tokens"), "agent_type")
    return out.select(
        "period", "grain", "agent_type", "gaps", "short_gaps", "reloads", "short_reloads", "rebuilt_tokens", "short_rebuilt_tokens", "short_reload_pct", "short_token_pct"
    )


@corpus(min_rebuilt_tokens=integer(20000), min_rebuilt_pct=integer(90), idle_seconds=integer(300))
def context_reloads(store, scope, min_rebuilt_tokens, min_rebuilt_pct, idle_seconds) -> DataFrame:
    """Rebuilt contexts in all, by agent type and by thread.

    A thread's first call rebuilds nothing. A rebuild is linked to a compaction
    between the call before and it, both ends a second late.
    """
    calls = scope.sessions.select("session_id").join(store["corpus_api_calls"], "session_id")
    calls = calls.select(
        *THREAD,
        "id",
        "index",
        "started_at",
        "cache_read_tokens",
        "cache_creation_tokens",
        "cost_usd",
        F.min("index").over(Window.partitionBy(*THREAD)).alias("first_index"),
        F.lag("started_at").over(in_thread()).alias("before"),
    )
    again = calls.where(F.col("index") > F.col("first_index")).where(rebuilt_context("cache_creation_tokens", "cache_read_tokens", min_rebuilt_tokens, min_rebuilt_pct))
    again = again.withColumn("idle", seconds_between("before", "started_at") >= idle_seconds)
    # Both in one line by time: the last compaction up to a second after a rebuild tells whether any lies in its stretch.
    second = F.expr("INTERVAL '1' SECOND")
    marks = store["corpus_compactions"].select(*THREAD, F.col("timestamp").alias("at"), F.lit(0).alias("kind"), F.col("timestamp").alias("compacted_at"))
    line = again.withColumns({"at": F.col("started_at") + second, "kind": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    past = Window.partitionBy(*THREAD).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.withColumn("latest", F.last("compacted_at", ignorenulls=True).over(past)).where("kind = 1")
    joined = line.withColumn("compacting", F.coalesce(F.col("latest") > F.col("before") + second, F.lit(False)))
    totals = calls.groupBy(*THREAD).agg(F.sum("cost_usd").alias("thread_cost_usd"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced_api_calls"))
    threads = joined.groupBy(*THREAD).agg(
        F.count("*").alias("reloads"),
        F.count_if("idle").alias("idle_reloads"),
        F.count_if("compacting").alias("compaction_reloads"),
        F.sum("cache_creation_tokens").alias("rebuilt_tokens"),
        F.sum("cost_usd").alias("reload_cost_usd"),
    )
    threads = threads.join(totals, list(THREAD)).join(run_types(store), list(THREAD), "left")
    threads = threads.withColumn("agent_type", F.coalesce("agent_type", F.lit(MAIN_THREAD)))
    rows = scope.periods.join(threads, "session_id")
    p, a, s, t = (F.col(c) for c in ("period", "agent_type", "session_id", "source"))
    out = rows.groupingSets([[p], [p, a], [p, a, s, t]], p, a, s, t).agg(
        F.grouping_id().alias("grouped"),
        F.count("*").alias("threads"),
        F.count_distinct("session_id").alias("__sessions"),
        *[F.sum(c).alias(c) for c in ("reloads", "idle_reloads", "compaction_reloads", "rebuilt_tokens")],
        F.round(F.sum("reload_cost_usd"), 2).alias("reload_cost_usd"),
        F.round(F.sum("thread_cost_usd"), 2).alias("thread_cost_usd"),
        F.sum("unpriced_api_calls").alias("unpriced_api_calls"),
    )
    # At the finest grain the session is a grouping column and stands once in its group.
    grain = F.when(F.col("grouped") == 7, "corpus").when(F.col("grouped") == 3, "agent_type").otherwise("thread")
    out = out.orderBy("period", F.desc("grouped"), F.desc("rebuilt_tokens"), "agent_type", "session_id", "source")
    return out.select(
        "period",
        grain.alias("grain"),
        *[F.coalesce(c, F.lit("(all)")).alias(c) for c in ("agent_type", "session_id", "source")],
        "threads",
        F.when(F.col("grouped") == 0, F.lit(1)).otherwise(F.col("__sessions")).cast("long").alias("sessions"),
        "reloads",
        "idle_reloads",
        "compaction_reloads",
        "rebuilt_tokens",
        "reload_cost_usd",
        "thread_cost_usd",
        "unpriced_api_calls",
    )
