"""Operators that are not saved questions, as registered queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import model
from tracewell.operators import enrichment, forest, listing, rendering, spans, tree
from tracewell.operators.quantiles import exact_quantiles
from tracewell.oracle import forest as oracle_forest
from tracewell.oracle import rendering as oracle_rendering
from tracewell.oracle.questions import SESSION, USED_TURN
from tracewell.oracle.store import with_store
from tracewell.plans.registered import flat, open_store, used_turn
from tracewell.relations import Store
from tracewell.sources import store as source
from tracewell.streaming.refresh import busy_spells

_LIST = """SELECT session_id, started_at, turns, round(cost_usd, 4) AS cost_usd, coalesce(n, 0) AS tool_errors FROM session_rollups
    LEFT JOIN (SELECT session_id, count(*) AS n FROM live_tool_calls WHERE is_error GROUP BY 1) USING (session_id)"""
_LISTED = ("session_id", "started_at", "turns", "cost_usd", "tool_errors")


def _on_store(build):
    def run(spark, sf_dir):
        return flat(build(open_store(spark, sf_dir)))

    return run


def _counted(family: str):
    def build(store):
        out = None
        for name in ("turns", "api_calls", "tool_calls", "agent_runs", "compactions"):
            arm = store[f"{family}_{name}"].agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).withColumn("relation", F.lit(name))
            out = arm if out is None else out.unionByName(arm)
        return out

    return build


def _counted_sql(family: str) -> str:
    names = ("turns", "api_calls", "tool_calls", "agent_runs", "compactions")
    return with_store(" UNION ALL ".join(f"SELECT '{n}' AS relation, count(*) AS n, count(DISTINCT id) AS ids FROM {family}_{n}" for n in names))


def _stale(store):
    items = store["live_turns"].where("source = 'main'").select("session_id", "source", F.col("id").alias("turn_id"), F.md5("id").alias("input_hash"))
    out = enrichment.stale(items, store["turn_enrichments"], ["session_id", "source", "turn_id"], "p1", "tagger-a")
    return out.select("session_id", "turn_id")


def _swept(store):
    # Enrichment of a turn that only a copy holds goes when the copies do.
    _, gone = enrichment.sweep(store["turn_enrichments"].withColumnRenamed("turn_id", "id"), store["corpus_turns"], ["session_id", "source", "id"])
    return gone.groupBy("category").agg(F.count("*").alias("gone"))


def _span_rows(store):
    out = spans.session_spans(store)
    return out.select("session_id", "kind", "span_id", "parent_span_id", "started_at", "ended_at", "trace_id")


def _span(kind: str, source: str, item: str) -> str:
    return f"left(sha256(session_id || '/{kind}/' || {source} || '/' || {item}), 16)"


def _over(source: str) -> str:
    return f"CASE WHEN {source} = 'main' THEN {_span('session', chr(39) * 2, 'session_id')} ELSE {_span('agent_run', chr(39) * 2, source)} END"


_SPANS = f"""SELECT * EXCLUDE (e), greatest(e, started_at + INTERVAL 1 MILLISECOND) AS ended_at, left(sha256(session_id), 32) AS trace_id FROM (
    SELECT session_id, 'turn' AS kind, {_span("turn", "source", "id")} AS span_id, {_over("source")} AS parent_span_id, started_at, ended_at AS e FROM live_turns
    UNION ALL SELECT c.session_id, 'api_call', {_span("api_call", "c.source", "c.id").replace("(session_id", "(c.session_id")},
        CASE WHEN t.id IS NOT NULL THEN {_span("turn", "c.source", "t.id").replace("(session_id", "(c.session_id")} ELSE {_over("c.source").replace("(session_id", "(c.session_id").replace("|| session_id", "|| c.session_id")} END, c.started_at, c.ended_at
        FROM live_api_calls c LEFT JOIN live_turns t ON t.session_id = c.session_id AND t.source = c.source AND t.id = c.turn_id
    UNION ALL SELECT session_id, 'tool_call', {_span("tool_call", "source", "id")}, {_span("api_call", "source", "api_call_id")}, started_at, coalesce(ended_at, started_at) FROM live_tool_calls k
        WHERE NOT EXISTS (FROM agent_runs a WHERE a.session_id = k.session_id AND a.tool_use_id = k.id AND a.id <> k.source)
    UNION ALL SELECT a.session_id, 'agent_run', {_span("agent_run", "''", "a.id").replace("(session_id", "(a.session_id")},
        CASE WHEN k.id IS NULL THEN {_span("session", "''", "a.session_id").replace("(session_id", "(a.session_id")} ELSE {_span("api_call", "k.source", "k.api_call_id").replace("(session_id", "(a.session_id")} END, a.started_at, a.ended_at
        FROM agent_runs a LEFT JOIN live_tool_calls k ON k.session_id = a.session_id AND k.id = a.tool_use_id
    UNION ALL SELECT k.session_id, 'compaction', {_span("compaction", "k.source", "k.id").replace("(session_id", "(k.session_id")}, {_over("k.source").replace("(session_id", "(k.session_id").replace("|| session_id", "|| k.session_id")}, k.timestamp, k.timestamp + to_milliseconds(k.duration_ms)
        FROM compactions k LEFT JOIN agent_runs a ON a.session_id = k.session_id AND a.id = k.source AND a.is_fork WHERE a.id IS NULL OR k.timestamp > a.started_at)"""

_SPELLS = """, g AS (SELECT session_id, source, started_at, output_tokens, CASE WHEN started_at - lag(started_at) OVER (PARTITION BY session_id, source ORDER BY started_at) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM live_api_calls),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, source ORDER BY started_at ROWS UNBOUNDED PRECEDING) AS spell FROM g)
    SELECT session_id, source, min(started_at) AS first_at, max(started_at) + INTERVAL 5 MINUTE AS silent_at, count(*) AS calls, sum(output_tokens)::BIGINT AS output_tokens FROM s GROUP BY session_id, source, spell"""


def _runs_to_describe(store):
    """Runs that hold no description of prompt p1, and all above them."""
    held = store["agent_run_enrichments"].where("prompt_version = 'p1'").select("session_id", F.col("agent_run_id").alias("run_id"))
    missing = store["live_agent_runs"].select("session_id", F.col("id").alias("run_id")).join(held, ["session_id", "run_id"], "left_anti")
    missing = missing.where("run_id NOT LIKE 'run-%'")
    return enrichment.planned(missing, tree.parents(store))


#: Rows that a damaged store lacks, by table, and sessions in it without any time: conditions of both engines.
LACKS = {
    "sessions": "{0}id LIKE 's1%-4'",
    "turns": "{0}id LIKE '%7'",
    "api_calls": "{0}id LIKE '%13'",
    "tool_calls": "{0}id LIKE '%9'",
    "agent_runs": "({0}id LIKE 'run-s2%' OR {0}id LIKE 'sub-s1%')",
    "offload_files": "{0}name LIKE '%3'",
    "extract_state": "{0}session_id LIKE 's3%'",
}
TIMELESS = "{} LIKE 's5%'"


def _damaged(store):
    """The store without the rows of ``LACKS``."""
    return Store({n: t.where(f"NOT {LACKS[n].format('')}") if n in LACKS else t for n, t in store.tables.items()})


def _timeless(store):
    """The store with sessions that no row has a time of."""
    out = {}
    for name, rows in store.tables.items():
        times = [c for c in ("started_at", "ended_at", "timestamp") if c in rows.columns]
        late = F.expr(TIMELESS.format("id" if name == "sessions" else "session_id"))
        out[name] = rows.withColumns({c: F.when(~late, F.col(c)) for c in times})
    return Store(out)


QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}
#: Budgets that the test tables' short texts overrun.
TIGHT = rendering.Budgets(total=220, prompt=30, text=24, input_head=20, error_tail=25, command_result=18)


def _changed_items(store):
    """Turns to describe again, by the hashes of what they render to: since described, some prompts have changed, and some are new."""
    turns = store.tables["turns"]
    before = F.when(F.col("id").endswith("3"), F.regexp_replace("prompt", "^Please look", "Look")).otherwise(F.col("prompt"))
    old = Store({**store.tables, "turns": turns.withColumn("prompt", before)})
    stamp = {"prompt_version": F.lit("p1"), "taxonomy_version": F.lit(model.TAXONOMY_VERSION), "model": F.lit("tagger")}
    held = rendering.rendered_turns(old, TIGHT).where("turn_id NOT LIKE '%5'").withColumns(stamp)
    return enrichment.stale(rendering.rendered_turns(store, TIGHT), held, ["session_id", "turn_id"], "p1", "tagger").select("session_id", "turn_id", "input_hash")


def _used_turn_tools(store):
    """Tools of the turn that the query is bound to: none where no turn of the thread has a call, not those of the bucket without a turn."""
    turn = used_turn(store)
    return tree.tools_level(store, SESSION, "main", turn).where(F.lit(turn is not None))


def _walked(store):
    """Runs in reading order, each with its neighbours."""
    runs = tree.parents(store).select("session_id", F.col("run_id").alias("item_id"), "parent_id", F.lit(1).alias("place"))
    return tree.walk(tree.reading_order(runs)).select("session_id", "item_id", "previous", "next")


def queries():
    return {
        "live_relations": _on_store(_counted("live")),
        "corpus_relations": _on_store(_counted("corpus")),
        "session_rollups": _on_store(lambda s: s.session_rollups),
        "corpus_rollups": _on_store(lambda s: s.corpus_rollups),
        "list_sessions_by_cost": _on_store(lambda s: listing.list_sessions(s, "cost_usd", True, size=20).select(*_LISTED)),
        "list_sessions_by_start": _on_store(lambda s: listing.list_sessions(s, "started_at", False, page=1, size=20).select(*_LISTED)),
        "list_sessions_filtered": _on_store(
            lambda s: listing.list_sessions(s, "turns", True, size=500, project="/repo/p1", since="2024-01-07", until="2024-01-20", skill="skill1", errors="1").select(*_LISTED)
        ),
        "thread_outline": _on_store(lambda s: tree.thread_outline(s, "s1-0", "main")),
        "placed_runs": _on_store(lambda s: tree.placed_runs(s, SESSION)),
        "error_steps": _on_store(lambda s: tree.error_steps(s, SESSION)),
        "spawn_heights": _on_store(lambda s: tree.heights(tree.parents(s)).groupBy("height").agg(F.count("*").alias("runs"))),
        "enrichment_stale": _on_store(_stale),
        "enrichment_sweep": _on_store(_swept),
        "command_results": _on_store(enrichment.command_results),
        "turn_items": _on_store(lambda s: enrichment.turn_items(s).select("session_id", "source", "turn_id", "input_hash")),
        "run_items": _on_store(lambda s: enrichment.run_items(s).select("session_id", "run_id", "input_hash")),
        "run_sections": _on_store(enrichment.run_sections),
        "enrichment_plan": _on_store(_runs_to_describe),
        **{f"tree_{p}": _on_store(lambda s, p=p: forest.children(s, p)) for p in forest.PRESETS},
        **{f"tree_walk_{p}": _on_store(lambda s, p=p: forest.steps(s, p)) for p in ("full", "noapi")},
        "store_orphans": _on_store(lambda s: source.orphans(_damaged(s))),
        "store_refusals": _on_store(lambda s: source.refusals(_timeless(s))),
        "call_cost_quantiles": _on_store(lambda s: exact_quantiles(s["live_api_calls"].where("cost_usd IS NOT NULL"), "model", "cost_usd", QUANTILES).select("model", *[F.round(c, 6).alias(c) for c in QUANTILES])),
        "enrichment_changed": _on_store(_changed_items),
        "rendered_turns": _on_store(lambda s: rendering.rendered_turns(s, TIGHT)),
        "rendered_runs": _on_store(lambda s: rendering.rendered_runs(s, TIGHT)),
        "rendered_sessions": _on_store(lambda s: rendering.rendered_sessions(s, TIGHT)),
        "thread_level": _on_store(lambda s: tree.thread_level(s, SESSION, "main")),
        "turn_calls_level": _on_store(lambda s: tree.calls_level(s, SESSION, "main", None)),
        "turn_tools_level": _on_store(_used_turn_tools),
        "run_walk": _on_store(_walked),
        "span_texts": _on_store(lambda s: spans.span_texts(s, 20)),
        "span_refusals": _on_store(spans.refused),
        "session_spans": _on_store(_span_rows),
        "span_census": _on_store(lambda s: spans.census(spans.session_spans(s)).groupBy("kind").agg(F.sum("spans").alias("spans"))),
        "span_batches": _on_store(lambda s: spans.batches(_span_rows(s), 20).select("session_id", "span_id", "batch")),
        "busy_spells": _on_store(lambda s: busy_spells(s["live_api_calls"])),
    }


_ALL_SPANS = f"""FROM (WITH below AS ({_SPANS}) FROM below UNION ALL BY NAME
    SELECT s.id AS session_id, 'session' AS kind, left(sha256(s.id || '/session//' || s.id), 16) AS span_id, coalesce(s.started_at, b.first) AS started_at,
        greatest(coalesce(s.ended_at, s.started_at, b.first), b.reach, coalesce(s.started_at, b.first) + INTERVAL 1 MILLISECOND) AS ended_at, left(sha256(s.id), 32) AS trace_id
    FROM sessions s LEFT JOIN (SELECT session_id, min(started_at) AS first, max(ended_at) AS reach FROM below GROUP BY 1) b ON b.session_id = s.id)"""

_CLIMB = """, climb AS (SELECT session_id, id AS low, id, parent_agent_id AS above, 0 AS steps FROM live_agent_runs
    UNION ALL SELECT c.session_id, c.low, r.id, r.parent_agent_id, steps + 1 FROM climb c JOIN live_agent_runs r ON r.session_id = c.session_id AND r.id = c.above)"""


def _with_climb(sql: str) -> str:
    """SQL over ``climb``: every run with itself and all runs above it."""
    head = with_store("SELECT 1 FROM live_agent_runs, agent_run_enrichments")
    return head[: head.index("SELECT 1 FROM live")].rstrip() + "\n" + _CLIMB + "\n" + sql


def _level(rows: str, edge: str, turn: str) -> str:
    """A level's rows, and runs of the main thread behind the row that spawned them."""
    return with_store(
        f"""SELECT kind, item_id, row_number() OVER (ORDER BY major NULLS LAST, minor, started_at NULLS LAST, item_id) AS place FROM (
        SELECT kind, item_id, place AS major, 0 AS minor, NULL::TIMESTAMP AS started_at FROM ({rows})
        UNION ALL SELECT 'run', r.id, l.place, 1, r.started_at FROM live_agent_runs r JOIN live_tool_calls k ON k.session_id = r.session_id AND k.id = r.tool_use_id AND k.source = 'main'
            JOIN live_api_calls c ON c.session_id = r.session_id AND c.source = 'main' AND c.id = k.api_call_id
            LEFT JOIN live_turns t ON t.session_id = r.session_id AND t.source = 'main' AND t.id = c.turn_id LEFT JOIN ({rows}) l ON l.item_id = {edge}
        WHERE r.session_id = '{SESSION}' AND {turn})"""
    )


_PRINTED = r"""SELECT t.session_id, t.source, t.id AS turn_id, string_agg(regexp_extract(r.raw, '<local-command-stdout>(.*?)</local-command-stdout>', 1), chr(10) ORDER BY r.line_no) AS printed
    FROM live_turns t JOIN raw_records r ON r.session_id = t.session_id AND r.source = t.source AND contains(r.raw, '"parentUuid": "' || t.id || '"')
    WHERE t.source = 'main' AND t.command_name IS NOT NULL GROUP BY ALL"""
_RUN_CALLS = """SELECT c.session_id, c.source AS run_id, coalesce(t."index" + 1, 0)::BIGINT AS section, t.id AS turn_id, t.prompt, c.id AS call_id, c."index" AS n, c.text
        FROM live_api_calls c LEFT JOIN live_turns t ON t.session_id = c.session_id AND t.source = c.source AND t.id = c.turn_id WHERE c.source <> 'main'
    UNION ALL SELECT session_id, source, ("index" + 1)::BIGINT, id, prompt, NULL, NULL, NULL FROM live_turns WHERE source <> 'main'"""
_OUTLINE = f"""SELECT kind, item_id, row_number() OVER (ORDER BY started_at, kind DESC, turn_index, item_id) AS place FROM (
    SELECT 'turn' AS kind, id AS item_id, started_at, "index"::BIGINT AS turn_index FROM live_turns WHERE session_id = '{SESSION}' AND source = 'main'
    UNION ALL SELECT 'compaction', id, timestamp, NULL FROM live_compactions WHERE session_id = '{SESSION}' AND source = 'main')"""
_LOOSE = f"""FROM live_api_calls c WHERE c.session_id = '{SESSION}' AND c.source = 'main' AND NOT EXISTS (FROM live_turns t WHERE t.session_id = c.session_id AND t.source = 'main' AND t.id = c.turn_id)"""


def _changed_sql() -> str:
    new = oracle_rendering.rendered_turns(TIGHT)
    old = new.replace("'Please look at ' || props", "CASE WHEN event_id % 10 = 3 THEN 'Look at ' ELSE 'Please look at ' END || props")
    return f"SELECT n.session_id, n.turn_id, n.input_hash FROM ({new}) n LEFT JOIN ({old}) o ON o.session_id = n.session_id AND o.turn_id = n.turn_id AND o.turn_id NOT LIKE '%5' WHERE o.input_hash IS DISTINCT FROM n.input_hash"


def _orphans_sql() -> str:
    """Each reference on its own, by an anti join."""
    arms = []
    for child, columns, parent in source.REFERENCES:
        table, key = {"threads": ("agent_runs", ("session_id", "id")), "tools": ("tool_calls", ("session_id", "id"))}.get(parent, (parent, model.KEYS.get(parent)))
        named = "to_json([" + ", ".join(f"c.{c}" for c in columns[1:]) + "])::VARCHAR" if columns[1:] else "''"
        same = " AND ".join(f"p.{k} = c.{c}" for k, c in zip(key, columns, strict=True))
        there = " AND ".join([*(f"c.{c} IS NOT NULL" for c in columns), *(["c.source <> 'main'"] if parent == "threads" else [])])
        lacking = [f"NOT {LACKS[child].format('c.')}"] if child in LACKS else []
        gone = f" AND NOT {LACKS[table].format('p.')}" if table in LACKS else ""
        arms.append(
            f"SELECT c.{columns[0]} AS session_id, '{child}' AS child, '{parent}' AS parent, {named} AS key, count(*) AS rows FROM {child} c WHERE {' AND '.join([there, *lacking])}"
            f" AND NOT EXISTS (FROM {table} p WHERE {same}{gone}) GROUP BY ALL"
        )
    return with_store(" UNION ALL ".join(arms))


def _refusals_sql() -> str:
    late = TIMELESS.format("session_id")
    parts = " UNION ALL ".join(
        f"SELECT session_id, '{t}' AS tab, {f'CASE WHEN NOT ({late}) THEN {source.WORK[t]} END' if t in source.WORK and t != 'pr_links' else 'NULL'} AS moment FROM {t}" for t in (*source.WORK, *source.BESIDE)
    )
    return with_store(
        f"""SELECT s.id AS session_id, CASE WHEN project_dir IS NULL THEN 'placeless' ELSE 'timeless' END AS reason,
            (SELECT string_agg(tab || ' ' || n, ', ' ORDER BY tab) FROM (SELECT tab, count(*) AS n FROM ({parts}) x WHERE x.session_id = s.id GROUP BY tab)) AS held
        FROM sessions s WHERE EXISTS (FROM ({parts}) x WHERE x.session_id = s.id AND tab NOT IN ('offload_files', 'raw_records'))
            AND (project_dir IS NULL OR s.id LIKE 's5%' AND NOT EXISTS (FROM ({parts}) x WHERE x.session_id = s.id AND moment IS NOT NULL))"""
    )


def oracle_sql():
    spells = with_store("SELECT 1 FROM live_api_calls")
    return {
        **{f"tree_{p}": oracle_forest.children(p) for p in forest.PRESETS},
        **{f"tree_walk_{p}": oracle_forest.steps(p) for p in ("full", "noapi")},
        "store_orphans": _orphans_sql(),
        "store_refusals": _refusals_sql(),
        "call_cost_quantiles": with_store(
            f"SELECT model, {', '.join(f'round(quantile_cont(cost_usd, {q}), 6) AS {n}' for n, q in QUANTILES.items())} FROM live_api_calls WHERE cost_usd IS NOT NULL GROUP BY model"
        ),
        "enrichment_changed": _changed_sql(),
        "rendered_turns": oracle_rendering.rendered_turns(TIGHT),
        "rendered_runs": oracle_rendering.rendered_runs(TIGHT),
        "rendered_sessions": oracle_rendering.rendered_sessions(TIGHT),
        "live_relations": _counted_sql("live"),
        "corpus_relations": _counted_sql("corpus"),
        "session_rollups": with_store("SELECT * FROM session_rollups"),
        "corpus_rollups": with_store("SELECT * FROM corpus_rollups"),
        "list_sessions_by_cost": with_store(f"{_LIST} ORDER BY session_rollups.cost_usd DESC NULLS LAST, session_id DESC LIMIT 21").replace("round(cost_usd, 4) AS cost_usd", "round(session_rollups.cost_usd, 4) AS cost_usd"),
        "list_sessions_by_start": with_store(f"{_LIST} ORDER BY started_at NULLS LAST, session_id LIMIT 21 OFFSET 20"),
        "list_sessions_filtered": with_store(
            f"""{_LIST} WHERE (project_dir = '/repo/p1' OR starts_with(project_dir, '/repo/p1/')) AND started_at >= DATE '2024-01-07' AND started_at < DATE '2024-01-21' AND coalesce(n, 0) >= 1
            AND session_id IN (SELECT session_id FROM live_api_calls WHERE attribution_skill = 'skill1') ORDER BY turns DESC, session_id DESC LIMIT 501"""
        ),
        "thread_outline": with_store(
            """SELECT kind, item_id, started_at, turn_index, row_number() OVER (ORDER BY started_at, kind DESC, turn_index, item_id) AS place FROM (
            SELECT 'turn' AS kind, id AS item_id, started_at, "index"::BIGINT AS turn_index FROM live_turns WHERE session_id = 's1-0' AND source = 'main'
            UNION ALL SELECT 'compaction', id, timestamp, NULL FROM live_compactions WHERE session_id = 's1-0' AND source = 'main')"""
        ),
        "placed_runs": with_store(
            f"""SELECT a.id AS run_id, CASE WHEN c.id IS NULL THEN 'unattached' WHEN t.id IS NULL THEN 'unattributed' ELSE 'turn' END AS place, c.source AS spawn_source, t.id AS spawn_turn_id, c.id AS spawn_call_id
            FROM live_agent_runs a LEFT JOIN live_tool_calls k ON k.session_id = a.session_id AND k.id = a.tool_use_id AND k.source <> a.id
            LEFT JOIN live_api_calls c ON c.session_id = a.session_id AND c.source = k.source AND c.id = k.api_call_id
            LEFT JOIN live_turns t ON t.session_id = c.session_id AND t.source = c.source AND t.id = c.turn_id WHERE a.session_id = '{SESSION}'"""
        ),
        "error_steps": with_store(
            f"""SELECT session_id, id AS tool_call_id, row_number() OVER w AS step, lag(id) OVER w AS previous, lead(id) OVER w AS next FROM live_tool_calls
            WHERE session_id = '{SESSION}' AND is_error WINDOW w AS (ORDER BY started_at, source, "index", id)"""
        ),
        "spawn_heights": _with_climb("SELECT height, count(*) AS runs FROM (SELECT session_id, id, max(steps) AS height FROM climb GROUP BY ALL) GROUP BY height"),
        "run_walk": _with_climb(
            """SELECT session_id, low AS item_id, lag(low) OVER w AS previous, lead(low) OVER w AS next FROM (SELECT session_id, low, max(steps) AS depth FROM climb GROUP BY ALL)
            WINDOW w AS (PARTITION BY session_id ORDER BY depth, low)"""
        ),
        "enrichment_plan": _with_climb(
            """SELECT DISTINCT session_id, id AS run_id FROM climb c WHERE low NOT LIKE 'run-%' AND NOT EXISTS (FROM agent_run_enrichments e
            WHERE e.session_id = c.session_id AND e.agent_run_id = c.low AND e.prompt_version = 'p1')"""
        ),
        "command_results": with_store(_PRINTED),
        "turn_items": with_store(
            rf"""SELECT session_id, source, turn_id, sha256(concat_ws(chr(10), prompt, printed, string_agg(line, chr(10) ORDER BY n))) AS input_hash FROM (
                SELECT t.session_id, t.source, t.id AS turn_id, t.prompt, p.printed, c."index" AS n,
                    c.text || coalesce((SELECT string_agg(chr(10) || '  ' || k.name || ': ' || coalesce(k.result, ''), '' ORDER BY k."index") FROM live_tool_calls k
                        WHERE k.session_id = c.session_id AND k.source = c.source AND k.api_call_id = c.id), '') AS line
                FROM live_turns t LEFT JOIN live_api_calls c ON c.session_id = t.session_id AND c.source = t.source AND c.turn_id = t.id
                LEFT JOIN ({_PRINTED}) p ON p.session_id = t.session_id AND p.source = t.source AND p.turn_id = t.id) GROUP BY session_id, source, turn_id, prompt, printed"""
        ),
        "run_items": with_store(
            f"""SELECT a.session_id, a.id AS run_id, sha256(concat_ws(chr(10), a.agent_type, string_agg(part, chr(10) ORDER BY section))) AS input_hash FROM live_agent_runs a LEFT JOIN (
                SELECT session_id, run_id, section, coalesce(prompt, '(continued)') || chr(10) || coalesce(string_agg(text, chr(10) ORDER BY n), '') AS part FROM ({_RUN_CALLS}) GROUP BY session_id, run_id, section, prompt) x
                ON x.session_id = a.session_id AND x.run_id = a.id GROUP BY a.session_id, a.id, a.agent_type"""
        ),
        "run_sections": with_store(
            f"""SELECT session_id, run_id, section, turn_id, CAST(to_json(coalesce(list(call_id ORDER BY n) FILTER (call_id IS NOT NULL), [])) AS VARCHAR) AS calls
            FROM ({_RUN_CALLS}) GROUP BY session_id, run_id, section, turn_id"""
        ),
        "thread_level": _level(_OUTLINE, "t.id", "true"),
        "turn_calls_level": _level(f"SELECT 'call' AS kind, c.id AS item_id, c.\"index\"::BIGINT AS place {_LOOSE}", "c.id", "t.id IS NULL"),
        "turn_tools_level": _level(
            f"SELECT 'tool' AS kind, k.id AS item_id, k.\"index\"::BIGINT AS place FROM live_tool_calls k WHERE k.session_id = '{SESSION}' AND k.source = 'main' AND k.api_call_id IN (SELECT id FROM live_api_calls WHERE session_id = '{SESSION}' AND source = 'main' AND turn_id = {USED_TURN})",
            "k.id",
            f"t.id = {USED_TURN}",
        ),
        "span_texts": with_store(
            " UNION ALL ".join(
                f"""SELECT {session} AS session_id, left(sha256({session} || '/{kind}/' || {source} || '/' || id), 16) AS span_id, '{kind}.{column}' AS name, left({column}, 20) AS value FROM {relation} WHERE {column} IS NOT NULL"""
                for relation, kind, session, source, columns in (
                    ("sessions", "session", "id", "''", ("title", "agent_name")),
                    ("live_turns", "turn", "session_id", "source", ("prompt", "command_args")),
                    ("live_api_calls", "api_call", "session_id", "source", ("text", "thinking")),
                    ("live_tool_calls", "tool_call", "session_id", "source", ("input", "result")),
                    ("live_agent_runs", "agent_run", "session_id", "''", ("description",)),
                )
                for column in columns
            )
        ),
        "span_refusals": with_store("SELECT id AS session_id, 'placeless' AS reason FROM sessions WHERE project_dir IS NULL"),
        "enrichment_stale": with_store(
            """SELECT session_id, id AS turn_id FROM live_turns t WHERE source = 'main' AND NOT EXISTS (FROM turn_enrichments e WHERE e.session_id = t.session_id AND e.source = t.source AND e.turn_id = t.id
            AND e.input_hash = md5(t.id) AND e.prompt_version = 'p1' AND e.taxonomy_version = '2' AND e.model = 'tagger-a')"""
        ),
        "enrichment_sweep": with_store(
            """SELECT category, count(*) AS gone FROM turn_enrichments e WHERE NOT EXISTS (FROM corpus_turns t WHERE t.session_id = e.session_id AND t.source = e.source AND t.id = e.turn_id) GROUP BY 1"""
        ),
        "session_spans": with_store(_ALL_SPANS),
        "span_batches": with_store(
            f"""SELECT session_id, span_id, (row_number() OVER (PARTITION BY session_id ORDER BY (parent_span_id IS NOT NULL)::INT, started_at NULLS FIRST, span_id) - 1) // 20 AS batch FROM ({_ALL_SPANS})"""
        ),
        "span_census": with_store(f"SELECT kind, count(*) AS spans FROM ({_SPANS}) GROUP BY 1 UNION ALL SELECT 'session', count(*) FROM sessions"),
        "busy_spells": spells[: spells.index("SELECT 1 FROM")].rstrip() + "\n" + _SPELLS,
    }
