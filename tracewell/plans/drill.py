"""Pages of one session: lists, headers, trees and whole texts by key.

Long texts come clipped with their full length beside them. Pages are keyset
pages: rows after a cursor, with the count of all that match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import clipped, millis_between
from tracewell.plans.digests import thread
from tracewell.plans.manifest import day, integer, keyed, text
from tracewell.plans.spend import money, tools_by

THREAD = dict(session_id=text(), source=text())


def chars(column: str) -> F.Column:
    return F.length(column).cast("long")


def unpriced(column: str = "cost_usd"):
    return F.col(column).isNull().cast("int").alias("unpriced_api_calls")


def page(rows: DataFrame, cursor: str, after: int, size: int, matched: str) -> DataFrame:
    """``size`` rows beyond ``after`` in the cursor's order, each with the count of all beyond.

    The count is a scalar of its own, which reads no wide column.
    """
    beyond = rows.where(F.col(cursor) > after)
    return beyond.orderBy(cursor).limit(size).withColumn(matched, beyond.agg(F.count("*")).scalar())


def calls_with_turns(store, session_id, source) -> DataFrame:
    """A thread's calls; ``live_turn`` is null where the call's turn does not count."""
    turns = thread(store["live_turns"], session_id, source).select(F.col("id").alias("live_turn"))
    calls = thread(store["live_api_calls"], session_id, source)
    return calls.join(turns, calls["turn_id"] == turns["live_turn"], "left")


def tools_per_call(store, session_id, source) -> DataFrame:
    rows = thread(store["live_tool_calls"], session_id, source)
    return rows.groupBy(F.col("api_call_id").alias("id")).agg(F.count("*").alias("tool_calls"))


def one_text(rows: DataFrame, session_id: str, source: str, item: str, column: str) -> DataFrame:
    return thread(rows, session_id, source).where(F.col("id") == item).select(F.col(column).alias("value"))


@keyed(**THREAD, api_call_id=text())
def view_call_text(store, session_id, source, api_call_id) -> DataFrame:
    """The whole text of a call."""
    return one_text(store["live_api_calls"], session_id, source, api_call_id, "text")


@keyed(**THREAD, api_call_id=text())
def view_call_thinking(store, session_id, source, api_call_id) -> DataFrame:
    """The whole thinking of a call."""
    return one_text(store["live_api_calls"], session_id, source, api_call_id, "thinking")


@keyed(**THREAD, tool_call_id=text())
def view_tool_input(store, session_id, source, tool_call_id) -> DataFrame:
    """The whole input of a tool call."""
    return one_text(store["live_tool_calls"], session_id, source, tool_call_id, "input")


@keyed(**THREAD, tool_call_id=text())
def view_tool_result(store, session_id, source, tool_call_id) -> DataFrame:
    """The whole result of a tool call."""
    return one_text(store["live_tool_calls"], session_id, source, tool_call_id, "result")


@keyed(**THREAD, turn_id=text())
def view_turn_prompt(store, session_id, source, turn_id) -> DataFrame:
    """The whole prompt of a turn."""
    return one_text(store["live_turns"], session_id, source, turn_id, "prompt")


@keyed(session_id=text(), run_id=text())
def view_run_brief(store, session_id, run_id) -> DataFrame:
    """The task that a run was given."""
    rows = store["live_agent_runs"].where((F.col("session_id") == session_id) & (F.col("id") == run_id))
    return rows.select(F.col("description").alias("value"))


_CALL = ("effort", "stop_reason", "attribution_skill", "started_at", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")


@keyed(**THREAD, api_call_id=text(), head_chars=integer(100), detail_chars=integer(4000))
def view_call_header(store, session_id, source, api_call_id, head_chars, detail_chars) -> DataFrame:
    """One call, long texts clipped a character beyond what is shown."""
    rows = calls_with_turns(store, session_id, source).where(F.col("id") == api_call_id)
    rows = rows.join(tools_per_call(store, session_id, source), "id", "left").fillna(0, ["tool_calls"])
    return rows.select(
        F.col("index").alias("call_index"),
        F.col("id").alias("api_call_id"),
        F.col("live_turn").alias("turn_id"),
        clipped("model", head_chars).alias("model"),
        clipped("fallback_from", head_chars).alias("fallback_from"),
        *_CALL,
        money("cost_usd").alias("cost_usd"),
        unpriced(),
        clipped("text", detail_chars + 1).alias("text_head"),
        chars("text").alias("text_chars"),
        clipped("thinking", detail_chars + 1).alias("thinking_head"),
        chars("thinking").alias("thinking_chars"),
        "tool_calls",
    )


@keyed(**THREAD, turn_id=text(None), after=integer(-1), page_calls=integer(12), log_chars=integer(300))
def view_turn_calls(store, session_id, source, turn_id, after, page_calls, log_chars) -> DataFrame:
    """A page of a turn's calls; a null turn means those without one."""
    rows = calls_with_turns(store, session_id, source).where(F.col("live_turn").eqNullSafe(F.lit(turn_id)))
    rows = page(rows, "index", after, page_calls, "matched_api_calls")
    rows = rows.join(tools_per_call(store, session_id, source), "id", "left").fillna(0, ["tool_calls"])
    return rows.select(
        F.col("index").alias("call_index"),
        F.col("id").alias("api_call_id"),
        clipped("model", log_chars).alias("model"),
        clipped("fallback_from", log_chars).alias("fallback_from"),
        *_CALL,
        money("cost_usd").alias("cost_usd"),
        unpriced(),
        chars("text").alias("text_chars"),
        chars("thinking").alias("thinking_chars"),
        "tool_calls",
        "matched_api_calls",
    ).orderBy("call_index")


@keyed(**THREAD, api_call_id=text(), after=integer(-1), page_tools=integer(12), log_chars=integer(300))
def view_call_tools(store, session_id, source, api_call_id, after, page_tools, log_chars) -> DataFrame:
    """A page of a call's tools."""
    rows = thread(store["live_tool_calls"], session_id, source).where(F.col("api_call_id") == api_call_id)
    return page(rows, "index", after, page_tools, "matched_tool_calls").select(
        F.col("index").alias("tool_index"),
        F.col("id").alias("tool_call_id"),
        clipped("name", log_chars).alias("name"),
        "server_side",
        "is_error",
        "incomplete",
        "offload_file",
        "started_at",
        chars("input").alias("input_chars"),
        chars("result").alias("result_chars"),
        "matched_tool_calls",
    )


@keyed(**THREAD, chip_chars=integer(60))
def view_compactions(store, session_id, source, chip_chars) -> DataFrame:
    """A thread's compactions in time order."""
    rows = thread(store["live_compactions"], session_id, source)
    return rows.select(F.col("id").alias("compaction_id"), "timestamp", clipped("trigger", chip_chars).alias("trigger"), "pre_tokens", "post_tokens", "duration_ms").orderBy("timestamp")


@keyed(head_chars=integer(100), tag_chars=integer(20), kind_chars=integer(20), head_kinds=integer(3))
def view_described_sessions(store, head_chars, tag_chars, kind_chars, head_kinds) -> DataFrame:
    """Described sessions, with the commonest kinds of work of their turns."""
    kinds = store["turn_enrichments"].groupBy("session_id", clipped("category", kind_chars).alias("name")).agg(F.count("*").alias("turns"))
    order = F.struct((-F.col("turns")).alias("o"), F.col("name").alias("name"), F.col("turns").alias("turns"))
    kinds = kinds.groupBy("session_id").agg(F.array_sort(F.collect_list(order)).alias("kinds"))
    told = store["session_enrichments"].select("session_id", "description", "category", "outcome")
    rows = told.join(kinds, "session_id", "full")
    work = F.coalesce(F.transform("kinds", lambda k: F.struct(k["name"].alias("name"), k["turns"].alias("turns"))), F.array().cast("array<struct<name:string,turns:bigint>>"))
    return rows.select(
        "session_id",
        clipped("description", head_chars).alias("description"),
        clipped("category", tag_chars).alias("category"),
        clipped("outcome", tag_chars).alias("outcome"),
        F.slice(work, 1, head_kinds).alias("work"),
        F.greatest(F.size(work) - head_kinds, F.lit(0)).cast("long").alias("work_cut"),
    ).orderBy("session_id")


@keyed(**THREAD, description_chars=integer(200), tag_chars=integer(20), head_chars=integer(100))
def view_enrichment(store, session_id, source, description_chars, tag_chars, head_chars) -> DataFrame:
    """What enrichment says of a session, its runs and one thread's turns."""
    out = None
    for level, key in (("turn", "turn_id"), ("agent_run", "agent_run_id"), ("session", "session_id")):
        rows = store[f"{level}_enrichments"].where(F.col("session_id") == session_id)
        if level == "turn":
            rows = rows.where(F.col("source") == source)
        arm = rows.select(
            F.lit(level).alias("level"),
            F.col(key).alias("item_id"),
            clipped("description", description_chars).alias("description"),
            clipped("category", tag_chars).alias("category"),
            clipped("outcome", tag_chars).alias("outcome"),
            clipped("friction", description_chars).alias("friction"),
            clipped("model", head_chars).alias("model"),
            "enriched_at",
            "prompt_version",
            "taxonomy_version",
        )
        out = arm if out is None else out.unionByName(arm)
    return out.orderBy("level", "item_id")


@keyed(session_id=text(), name=text(), after_chars=integer(0), chunk_chars=integer(50000))
def view_offload(store, session_id, name, after_chars, chunk_chars) -> DataFrame:
    """A window of a side file's text."""
    rows = store["offload_files"].where((F.col("session_id") == session_id) & (F.col("name") == name))
    chunk = F.substring("content", after_chars + 1, chunk_chars)
    return rows.select("name", "lossy_decode", "size_bytes", chars("content").alias("content_chars"), chunk.alias("chunk"))


def by_root(store) -> DataFrame:
    """Rollups with ``root``: the shortest known project folder that holds a session's own.

    A folder's ancestors are few, so each folder is looked up under all of them
    by equality; no folder is compared with every other.
    """
    dirs = store["sessions"].select("project_dir").where("project_dir IS NOT NULL").distinct()
    steps = F.split("project_dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    asked = dirs.select("project_dir", F.explode(above).alias("above")).where("above <> ''")
    roots = asked.join(dirs.select(F.col("project_dir").alias("above")), "above").groupBy("project_dir").agg(F.min_by("above", F.length("above")).alias("root"))
    return store.corpus_rollups.join(roots, "project_dir", "left")


@keyed(as_of=day(), recent_days=integer(7), window_days=integer(30), head_chars=integer(100), projects=integer(100))
def view_project_rollups(store, as_of, recent_days, window_days, head_chars, projects) -> DataFrame:
    """Totals of each root project over two windows and in all, last active first."""
    end = F.date_add(F.to_date(F.lit(as_of)), 1)

    def inside(days: int):
        start = F.date_sub(F.to_date(F.lit(as_of)), days)
        return F.coalesce((F.col("started_at") >= start) & (F.col("started_at") < end), F.lit(False))

    rows = by_root(store).withColumns({"recent": inside(recent_days), "window": inside(window_days)})

    def over(flag: str) -> list:
        chosen = F.col(flag)
        return [
            F.count_if(flag).alias(f"{flag}_sessions"),
            money(F.sum(F.when(chosen, F.col("cost_usd")))).alias(f"{flag}_cost"),
            F.sum(F.when(chosen, F.col("unpriced_api_calls"))).alias(f"{flag}_unpriced"),
        ]

    out = rows.groupBy("root").agg(
        *over("recent"),
        *over("window"),
        F.count("*").alias("sessions"),
        money(F.sum("cost_usd")).alias("cost_usd"),
        F.sum("unpriced_api_calls").alias("unpriced_api_calls"),
        F.max("started_at").alias("last_active"),
    )
    out = out.withColumn("matched_projects", F.count("*").over(Window.partitionBy(F.lit(1))))
    out = out.orderBy(F.desc_nulls_last("last_active"), F.asc_nulls_last("root")).limit(projects)
    shown = F.when(F.length("root") <= head_chars, F.col("root")).alias("project_filter")
    return out.select(clipped("root", head_chars).alias("project_dir"), shown, *out.columns[1:])


@keyed(head_chars=integer(100), head_projects=integer(10))
def view_projects(store, head_chars, head_projects) -> DataFrame:
    """The root projects with most sessions."""
    rows = by_root(store).where((F.length("root") <= head_chars))
    out = rows.groupBy(F.col("root").alias("project_dir")).agg(F.count("*").alias("sessions"))
    return out.orderBy(F.desc("sessions"), "project_dir").limit(head_projects)


@keyed(**THREAD, line_no=integer())
def view_record(store, session_id, source, line_no) -> DataFrame:
    """One raw record."""
    rows = thread(store["raw_records"], session_id, source).where(F.col("line_no") == line_no)
    return rows.select("line_no", "uuid", "type", "timestamp", chars("raw").alias("raw_chars"), "raw")


@keyed(**THREAD, after=integer(-1), page_records=integer(100), preview_chars=integer(160))
def view_records(store, session_id, source, after, page_records, preview_chars) -> DataFrame:
    """A page of a thread's raw records."""
    rows = page(thread(store["raw_records"], session_id, source), "line_no", after, page_records, "matched_records")
    return rows.select("line_no", "uuid", "type", "timestamp", chars("raw").alias("raw_chars"), clipped("raw", preview_chars).alias("raw_head"), "matched_records")


def spawned(store, session_id: str) -> DataFrame:
    """A session's runs with the call and turn that spawned them, where a tool call outside the run did."""
    mine = F.col("session_id") == session_id
    runs = store["live_agent_runs"].where(mine)
    tools = store["live_tool_calls"].where(mine).select(F.col("id").alias("tool_use_id"), F.col("source").alias("tool_source"), F.col("api_call_id").alias("spawn_call"))
    calls = store["live_api_calls"].where(mine).select(F.col("source").alias("spawn_source"), F.col("id").alias("spawn_call_id"), F.col("index").alias("spawn_call_index"), F.col("turn_id").alias("spawn_turn"))
    turns = store["live_turns"].where(mine).select(F.col("source").alias("turn_source"), F.col("id").alias("spawn_turn_id"))
    joined = runs.join(tools, (runs["tool_use_id"] == tools["tool_use_id"]) & (tools["tool_source"] != runs["id"]), "left").drop(tools["tool_use_id"])
    joined = joined.join(calls, (F.col("spawn_source") == F.col("tool_source")) & (F.col("spawn_call_id") == F.col("spawn_call")), "left")
    joined = joined.join(turns, (F.col("turn_source") == F.col("spawn_source")) & (F.col("spawn_turn_id") == F.col("spawn_turn")), "left")
    return joined.drop("tool_source", "spawn_call", "spawn_turn", "turn_source")


def run_totals(store, session_id: str) -> DataFrame:
    """Counts and sums of each run's thread in a session, one aggregation for each table."""
    mine = F.col("session_id") == session_id
    calls = store["live_api_calls"].where(mine).groupBy(F.col("source").alias("id")).agg(
        F.count("*").alias("api_calls"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("run_cost"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced_api_calls"),
    )
    tools = tools_by(store["live_tool_calls"].where(mine).withColumn("id", F.col("source")), "id")
    turns = store["live_turns"].where(mine).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("turns"))
    marks = store["live_compactions"].where(mine).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("compactions"))
    return calls.join(tools, "id", "full").join(turns, "id", "full").join(marks, "id", "full")


_RUN_COUNTS = ["api_calls", "output_tokens", "run_cost", "unpriced_api_calls", "tool_calls", "tool_errors", "turns", "compactions"]


@keyed(session_id=text(), run_id=text(), head_chars=integer(100), detail_chars=integer(4000))
def view_run_header(store, session_id, run_id, head_chars, detail_chars) -> DataFrame:
    """One run: what it was asked, where it was spawned, what it did."""
    rows = spawned(store, session_id).where(F.col("id") == run_id).join(run_totals(store, session_id), "id", "left").fillna(0, _RUN_COUNTS)
    return rows.select(
        F.col("id").alias("run_id"),
        "session_id",
        clipped("agent_type", head_chars).alias("agent_type"),
        clipped("description", detail_chars + 1).alias("description"),
        chars("description").alias("description_chars"),
        clipped("model", head_chars).alias("model"),
        "spawn_depth",
        "is_fork",
        "parent_agent_id",
        "tool_use_id",
        "started_at",
        "ended_at",
        millis_between("started_at", "ended_at").alias("wall_ms"),
        "spawn_source",
        "spawn_turn_id",
        "spawn_call_id",
        "spawn_call_index",
        "turns",
        "api_calls",
        "tool_calls",
        "tool_errors",
        "compactions",
        "output_tokens",
        F.round("run_cost", 4).alias("cost_usd"),
        "unpriced_api_calls",
    )


@keyed(session_id=text(), chip_chars=integer(60))
def view_runs(store, session_id, chip_chars) -> DataFrame:
    """A session's runs with the places that spawned them."""
    rows = spawned(store, session_id).join(run_totals(store, session_id), "id", "left").fillna(0, _RUN_COUNTS)
    return rows.select(
        F.col("id").alias("run_id"),
        clipped("agent_type", chip_chars).alias("agent_type"),
        clipped("description", chip_chars).alias("description"),
        clipped("model", chip_chars).alias("model"),
        "spawn_depth",
        "is_fork",
        "parent_agent_id",
        "tool_use_id",
        "started_at",
        "ended_at",
        F.round("run_cost", 4).alias("cost_usd"),
        "unpriced_api_calls",
        "tool_errors",
        "compactions",
        "spawn_source",
        "spawn_turn_id",
        "spawn_call_id",
        "spawn_call_index",
    ).orderBy(F.asc_nulls_last("started_at"), "run_id")


@keyed(session_id=text(), nav_chars=integer(48), errors=integer(100))
def view_session_errors(store, session_id, nav_chars, errors) -> DataFrame:
    """A session's failed tool calls in the order that a reader steps through them."""
    rows = store["live_tool_calls"].where((F.col("session_id") == session_id) & F.col("is_error"))
    rows = rows.withColumn("matched_errors", F.count("*").over(Window.partitionBy("session_id")))
    rows = rows.orderBy("started_at", "source", "index", "id").limit(errors)
    return rows.select(
        "source",
        F.col("id").alias("tool_call_id"),
        clipped("name", nav_chars + 1).alias("name"),
        clipped("input", nav_chars + 1).alias("input_head"),
        "is_error",
        "started_at",
        "matched_errors",
    )


@keyed(session_id=text(), head_chars=integer(100), item_chars=integer(60), head_items=integer(5))
def view_session_header(store, session_id, head_chars, item_chars, head_items) -> DataFrame:
    """A session's header: metadata, totals, and the first of its skills and pull requests."""
    mine = F.col("session_id") == session_id

    def distinct(rows: DataFrame, column: str):
        return rows.where(mine).agg(F.array_sort(F.collect_set(column)).alias("a")).scalar()

    rows = store.session_rollups.where(mine).drop("title", "project_dir")
    meta = store["sessions"].where(F.col("id") == session_id).drop("started_at", "ended_at", "active_ms").withColumnRenamed("id", "session_id")
    failed = store["live_tool_calls"].where(mine).agg(F.count_if("is_error").alias("n")).scalar()
    rows = rows.join(meta, "session_id").withColumns(
        {"tool_errors": failed, "all_skills": distinct(store["live_api_calls"], "attribution_skill"), "all_prs": distinct(store["pr_links"], "pr_url")}
    )

    def head(column: str, name: str) -> list:
        shown = F.transform(F.slice(column, 1, head_items), lambda x: F.substring(x, 1, item_chars))
        return [shown.alias(name), F.greatest(F.size(column) - head_items, F.lit(0)).cast("long").alias(f"{name}_cut")]

    return rows.select(
        "session_id",
        *[clipped(c, head_chars).alias(c) for c in ("title", "agent_name", "project_dir", "git_branch", "version", "entrypoint")],
        "started_at",
        "ended_at",
        "wall_ms",
        "active_ms",
        "turns",
        "api_calls",
        "tool_calls",
        "agent_runs",
        "compactions",
        "tool_errors",
        money("cost_usd").alias("cost_usd"),
        "unpriced_api_calls",
        "input_tokens",
        "output_tokens",
        "cache_read_tokens",
        "cache_creation_tokens",
        *head("all_skills", "skills"),
        *head("all_prs", "pr_urls"),
    )


@keyed(item_chars=integer(20))
def view_sessions(store, item_chars) -> DataFrame:
    """All sessions with totals, skills, agent types and pull requests, latest first."""
    kinds = store["live_agent_runs"].groupBy("session_id", clipped("agent_type", item_chars).alias("name")).agg(F.count("*").alias("runs"))
    order = F.struct((-F.col("runs")).alias("o"), F.col("name").alias("name"), F.col("runs").alias("runs"))
    kinds = kinds.groupBy("session_id").agg(F.array_sort(F.collect_list(order)).alias("k"))
    kinds = kinds.select("session_id", F.transform("k", lambda k: F.struct(k["name"].alias("name"), k["runs"].alias("runs"))).alias("agent_types"))
    skills = store["live_api_calls"].where("attribution_skill IS NOT NULL").groupBy("session_id").agg(F.array_sort(F.collect_set("attribution_skill")).alias("skills"))
    prs = store["pr_links"].where("pr_url IS NOT NULL").groupBy("session_id").agg(F.array_sort(F.collect_set("pr_url")).alias("pr_urls"))
    failed = tools_by(store["live_tool_calls"], "session_id").select("session_id", "tool_errors")
    rows = store.session_rollups
    for more in (failed, skills, kinds, prs):
        rows = rows.join(more, "session_id", "left")
    rows = rows.fillna(0, ["tool_errors"])
    return rows.select(
        "session_id",
        "started_at",
        "title",
        "project_dir",
        "turns",
        "api_calls",
        "tool_calls",
        "agent_runs",
        "compactions",
        money("cost_usd").alias("cost_usd"),
        "unpriced_api_calls",
        "input_tokens",
        "output_tokens",
        "cache_read_tokens",
        "cache_creation_tokens",
        "wall_ms",
        "active_ms",
        "tool_errors",
        "skills",
        "agent_types",
        "pr_urls",
    ).orderBy(F.desc_nulls_last("started_at"), "session_id")


@keyed(**THREAD, tool_call_id=text(), head_chars=integer(100), detail_chars=integer(4000))
def view_tool_header(store, session_id, source, tool_call_id, head_chars, detail_chars) -> DataFrame:
    """One tool call, with the run that it spawned outside its own thread."""
    tool = thread(store["live_tool_calls"], session_id, source).where(F.col("id") == tool_call_id)
    calls = calls_with_turns(store, session_id, source).select(F.col("id").alias("api_call_id"), F.col("live_turn").alias("turn_id"))
    runs = store["live_agent_runs"].where((F.col("session_id") == session_id) & (F.col("id") != source))
    runs = runs.select(F.col("tool_use_id").alias("id"), F.col("id").alias("run_id")).where("id IS NOT NULL")
    rows = tool.join(calls, "api_call_id").join(runs, "id", "left")
    return rows.select(
        F.col("index").alias("tool_index"),
        F.col("id").alias("tool_call_id"),
        "session_id",
        "api_call_id",
        "turn_id",
        clipped("name", head_chars).alias("name"),
        "server_side",
        "is_error",
        "incomplete",
        "offload_file",
        "run_id",
        "started_at",
        "ended_at",
        millis_between("started_at", "ended_at").alias("wall_ms"),
        clipped("input", detail_chars + 1).alias("input_head"),
        chars("input").alias("input_chars"),
        clipped("result", detail_chars + 1).alias("result_head"),
        chars("result").alias("result_chars"),
    )


@keyed(**THREAD, turn_id=text(None), nav_chars=integer(48))
def view_tree_calls(store, session_id, source, turn_id, nav_chars) -> DataFrame:
    """The calls of a turn, or those without one."""
    rows = calls_with_turns(store, session_id, source).where(F.col("live_turn").eqNullSafe(F.lit(turn_id)))
    return rows.select(
        F.col("index").alias("call_index"),
        F.col("id").alias("api_call_id"),
        clipped("text", nav_chars + 1).alias("text_head"),
        clipped("model", nav_chars + 1).alias("model"),
        money("cost_usd").alias("cost_usd"),
        unpriced(),
    ).orderBy("call_index")


@keyed(**THREAD, api_call_id=text(None), turn_id=text(None), nav_chars=integer(48))
def view_tree_tools(store, session_id, source, api_call_id, turn_id, nav_chars) -> DataFrame:
    """The tools of a call, or without one given those of a turn (null: of no turn)."""
    calls = calls_with_turns(store, session_id, source).select(F.col("id").alias("api_call_id"), F.col("index").alias("call_index"), "live_turn")
    rows = thread(store["live_tool_calls"], session_id, source).join(calls, "api_call_id")
    wanted = F.col("api_call_id") == api_call_id if api_call_id is not None else F.col("live_turn").eqNullSafe(F.lit(turn_id))
    return rows.where(wanted).select(
        "call_index",
        F.col("index").alias("tool_index"),
        F.col("id").alias("tool_call_id"),
        clipped("name", nav_chars + 1).alias("name"),
        clipped("input", nav_chars + 1).alias("input_head"),
        "is_error",
    ).orderBy("call_index", "tool_index")


@keyed(**THREAD, nav_chars=integer(48))
def view_tree_turns(store, session_id, source, nav_chars) -> DataFrame:
    """A thread's turns with their spend."""
    spend = thread(store["live_api_calls"], session_id, source).groupBy(F.col("turn_id").alias("id")).agg(
        money(F.sum("cost_usd")).alias("cost_usd"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced_api_calls")
    )
    rows = thread(store["live_turns"], session_id, source).join(spend, "id", "left").fillna(0, ["cost_usd", "unpriced_api_calls"])
    return rows.select(
        F.col("index").alias("turn_index"),
        F.col("id").alias("turn_id"),
        *[clipped(c, nav_chars + 1).alias(c) for c in ("prompt", "command_name", "command_args")],
        "started_at",
        "cost_usd",
        "unpriced_api_calls",
    ).orderBy("turn_index")


@keyed(**THREAD, turn_id=text(), head_chars=integer(100), detail_chars=integer(4000))
def view_turn_header(store, session_id, source, turn_id, head_chars, detail_chars) -> DataFrame:
    """One turn and what it led to."""
    calls = thread(store["live_api_calls"], session_id, source).where(F.col("turn_id") == turn_id)
    tools = thread(store["live_tool_calls"], session_id, source).join(calls.select(F.col("id").alias("api_call_id")), "api_call_id")
    spend = calls.agg(
        F.count("*").alias("api_calls"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost_usd"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced_api_calls"),
    )
    tool = tools.agg(F.count("*").alias("tool_calls"), F.count_if("is_error").alias("tool_errors"))
    turn = thread(store["live_turns"], session_id, source).where(F.col("id") == turn_id)
    rows = turn.withColumns({c: one.select(c).scalar() for one in (spend, tool) for c in one.columns})
    return rows.select(
        F.col("index").alias("turn_index"),
        F.col("id").alias("turn_id"),
        clipped("prompt", detail_chars + 1).alias("prompt"),
        chars("prompt").alias("prompt_chars"),
        clipped("command_name", head_chars).alias("command_name"),
        clipped("command_args", head_chars).alias("command_args"),
        "started_at",
        "ended_at",
        "replayed",
        "api_calls",
        "tool_calls",
        "tool_errors",
        "cost_usd",
        "unpriced_api_calls",
    )


@keyed(**THREAD)
def view_turn_records(store, session_id, source) -> DataFrame:
    """The raw line of each turn."""
    turns = thread(store["live_turns"], session_id, source).select(F.col("id").alias("turn_id"))
    raw = thread(store["raw_records"], session_id, source).select(F.col("uuid").alias("turn_id"), "line_no")
    return turns.join(raw, "turn_id")
