"""Repeatable draws of items to read: by stratum, seeded, without replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.lineage import cut
from tracewell.plans.manifest import corpus, integer, text
from tracewell.plans.spend import money, spend_by, tools_by, with_run_work

def draw_key(key, seed: str):
    """Order of a seeded draw: the same in any engine that has MD5."""
    return F.md5(F.concat(key, F.lit(seed)))


@corpus(level=text(), per_category=integer(2), seed=text("seed"))
def select_enrichments(store, scope, level, per_category, seed) -> DataFrame:
    """A few described items of each category at one level."""
    if level not in ("turn", "agent_run", "session"):
        raise ValueError(f"level: {level!r} is none of turn, agent_run, session")
    told = store[f"{level}_enrichments"].withColumnRenamed("model", "enrichment_model")
    calls = store["corpus_api_calls"]
    if level == "turn":
        spend = spend_by(calls, "session_id", "source", "turn_id")
        items = store["corpus_turns"].where("source = 'main'").select("session_id", "source", F.col("id").alias("turn_id"))
        items = items.join(told, ["session_id", "source", "turn_id"]).join(spend, ["session_id", "source", "turn_id"], "left")
        key = F.concat_ws("|", "session_id", "source", "turn_id")
        items = items.withColumns({"item_id": F.col("turn_id"), "agent_type": F.lit(None).cast("string"), "key": key})
    elif level == "agent_run":
        spend = spend_by(calls, "session_id", "source").withColumnRenamed("source", "agent_run_id")
        items = store["corpus_agent_runs"].select("session_id", F.col("id").alias("agent_run_id"), "agent_type")
        items = items.join(told, ["session_id", "agent_run_id"]).join(spend, ["session_id", "agent_run_id"], "left")
        key = F.concat_ws("|", "session_id", "agent_run_id")
        items = items.withColumns({"item_id": F.col("agent_run_id"), "source": F.col("agent_run_id"), "key": key})
    else:
        spend = store.corpus_rollups.select("session_id", "api_calls", "cost_usd", "unpriced_api_calls")
        items = spend.join(told, "session_id")
        none = F.lit(None).cast("string")
        items = items.withColumns({"item_id": none, "source": none, "agent_type": none, "key": F.col("session_id")})
    items = items.join(scope.sessions.select("session_id"), "session_id").fillna(0, ["api_calls", "cost_usd", "unpriced_api_calls"])
    place = Window.partitionBy("category").orderBy(draw_key(F.col("key"), seed), "key")
    picked = items.withColumn("draw", F.row_number().over(place).cast("long")).where(F.col("draw") <= per_category)
    return picked.select(
        F.col("category").alias("stratum"),
        "session_id",
        "source",
        "item_id",
        "agent_type",
        "api_calls",
        money("cost_usd").alias("cost_usd"),
        "unpriced_api_calls",
        "description",
        "outcome",
        "friction",
        "enrichment_model",
        "prompt_version",
        "enriched_at",
        "draw",
    ).orderBy("stratum", "draw")


@corpus(runs_per_stratum=integer(1), min_runs=integer(5))
def select_runs(store, scope, runs_per_stratum, min_runs) -> DataFrame:
    """Of each frequent agent type the runs with most errors, and of the rest the costliest."""
    runs = store["corpus_agent_runs"].join(scope.in_window, "session_id").select("session_id", "id", "agent_type", "started_at")
    runs = with_run_work(runs, store).withColumn("of_type", F.count("*").over(Window.partitionBy("agent_type")))
    runs = runs.where(F.col("of_type") >= min_runs)

    def best(rows: DataFrame, stratum: str, measure: str) -> DataFrame:
        order = Window.partitionBy("agent_type").orderBy(F.desc(measure), "session_id", "id")
        rows = rows.where(F.col(measure) > 0).withColumn("rank", F.row_number().over(order))
        return rows.where(F.col("rank") <= runs_per_stratum).drop("rank").withColumn("stratum", F.lit(stratum))

    worst = best(runs, "run-errors", "tool_errors")
    rest = runs.join(worst.select("session_id", "id"), ["session_id", "id"], "left_anti")
    out = worst.unionByName(best(rest, "run-cost", "cost_usd"))
    return out.select(
        "stratum",
        "agent_type",
        "session_id",
        F.col("id").alias("agent_id"),
        "started_at",
        "tool_calls",
        "tool_errors",
        "api_calls",
        money("cost_usd").alias("cost_usd"),
        "unpriced_api_calls",
    ).orderBy("agent_type", "stratum", "session_id", "agent_id")


@corpus(
    cost_quota=integer(8),
    error_quota=integer(5),
    compaction_quota=integer(4),
    discovery_quota=integer(8),
    skill_threshold=integer(5),
    seed=text("seed"),
    min_api_calls=integer(1),
    min_discovery_api_calls=integer(10),
)
def select_sessions(
    store, scope, cost_quota, error_quota, compaction_quota, discovery_quota, skill_threshold, seed, min_api_calls, min_discovery_api_calls
) -> DataFrame:
    """Sessions to read, stratum after stratum without replacement.

    Strata choose in turn from what the ones before left: the costliest, those
    with most failures, with most compactions, the latest of each frequent skill
    (skills by name), and a seeded draw that fills what is left of the budget of
    all quotas and one session for each skill. The pool is written once, and so
    are the offers of skills. What the first strata can choose are the top lists
    of all their quotas together; skills choose in rounds, as ``one_each`` says.
    """
    failures = tools_by(store["corpus_tool_calls"], "session_id").select("session_id", "tool_errors")
    pool = scope.in_window.join(store.corpus_rollups, "session_id").join(failures, "session_id", "left").fillna(0, ["tool_errors"])
    pool = cut(pool.where((F.col("turns") > 0) | (F.col("agent_runs") > 0)).where(F.col("api_calls") >= min_api_calls))
    strata = (("cost", "cost_usd", cost_quota), ("tool-errors", "tool_errors", error_quota), ("compactions", "compactions", compaction_quota))
    chosen, within = None, 0
    for phase, (stratum, measure, quota) in enumerate(strata):
        within += quota
        able = pool.where(F.col(measure) > 0).select("session_id", F.col(measure).cast("double").alias("m")).orderBy(F.desc("m"), "session_id").limit(within)
        left = able if chosen is None else able.join(chosen, "session_id", "left_anti")
        best = left.orderBy(F.desc("m"), "session_id").limit(quota)
        best = best.select(F.lit(phase).alias("phase"), F.lit(stratum).alias("stratum"), "session_id", (-F.col("m")).alias("place"), F.lit("").alias("draw"))
        chosen = best if chosen is None else chosen.unionByName(best)
    chosen = cut(chosen)

    uses = store["corpus_api_calls"].where("attribution_skill IS NOT NULL").select(F.col("attribution_skill").alias("skill"), "session_id").distinct()
    uses = cut(uses.join(pool.select("session_id", "started_at"), "session_id"))
    frequent = uses.groupBy("skill").count().where(F.col("count") >= skill_threshold).select("skill")
    offers = uses.join(frequent, "skill").join(chosen, "session_id", "left_anti")
    latest = Window.partitionBy("skill").orderBy(F.desc_nulls_last("started_at"), "session_id")
    picks = one_each(offers.select("skill", "session_id", F.row_number().over(latest).alias("rank")))
    taken = picks.select(F.lit(3).alias("phase"), F.concat(F.lit("skill:"), "skill").alias("stratum"), "session_id", F.lit(0.0).alias("place"), F.col("skill").alias("draw"))
    chosen = chosen.unionByName(taken)

    room = cost_quota + error_quota + compaction_quota + discovery_quota + frequent.count() - chosen.count()
    rest = pool.where(F.col("api_calls") >= min_discovery_api_calls).join(chosen, "session_id", "left_anti")
    rest = rest.select("session_id", draw_key(F.col("session_id"), seed).alias("draw")).orderBy("draw", "session_id").limit(max(room, 0))
    chosen = chosen.unionByName(rest.select(F.lit(4).alias("phase"), F.lit("discovery").alias("stratum"), "session_id", F.lit(0.0).alias("place"), "draw"))
    return chosen.join(pool, "session_id").orderBy("phase", "place", "draw", "session_id").select(
        "stratum",
        "session_id",
        "started_at",
        "turns",
        "agent_runs",
        "tool_calls",
        "tool_errors",
        "compactions",
        money("cost_usd").alias("cost_usd"),
        "unpriced_api_calls",
    )


def one_each(offers: DataFrame) -> DataFrame:
    """``skill, session_id``: what skills get that choose one after the other, by name, the best of what is left.

    ``offers`` has each skill's sessions with a ``rank`` from 1 on. In rounds,
    every skill bids for its best session that it was not refused yet, and of
    several bids the first skill's stands. When none is refused, each has what it
    would get in turn: a later skill can never hold what an earlier one wants.
    A round writes the offers that are still open, so its plan is as large as
    the first one's.
    """
    open_ = cut(offers)
    while True:
        bids = open_.groupBy("skill").agg(F.min_by("session_id", "rank").alias("session_id"))
        first = bids.groupBy("session_id").agg(F.min("skill").alias("first"))
        lost = cut(bids.join(first, "session_id").where("skill <> first").select("skill", "session_id"))
        if lost.isEmpty():
            return bids
        open_ = cut(open_.join(lost, ["skill", "session_id"], "left_anti"))
