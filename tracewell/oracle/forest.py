"""SQL of the levels below every node, one arm for each kind of child."""

from __future__ import annotations

from tracewell.oracle.store import with_store

_HOLDER = "CASE WHEN {0}.source = 'main' THEN 'session' ELSE 'run' END AS parent_kind, NULL AS parent_source, CASE WHEN {0}.source = 'main' THEN {0}.session_id ELSE {0}.source END AS parent_id"
_BASE = """, spawn AS (SELECT a.session_id, a.id, a.parent_agent_id, a.tool_use_id, a.started_at, c.source AS spawn_source, c.id AS spawn_call_id, t.id AS spawn_turn_id FROM live_agent_runs a
        LEFT JOIN (live_tool_calls u JOIN live_api_calls c ON c.session_id = u.session_id AND c.source = u.source AND c.id = u.api_call_id) ON u.session_id = a.session_id AND u.id = a.tool_use_id AND u.source <> a.id
        LEFT JOIN live_turns t ON t.session_id = c.session_id AND t.source = c.source AND t.id = c.turn_id),
    called AS (SELECT c.session_id, c.source, c.id, c."index" AS n, t.id AS turn_id FROM live_api_calls c LEFT JOIN live_turns t ON t.session_id = c.session_id AND t.source = c.source AND t.id = c.turn_id),
    used AS (SELECT k.session_id, k.source, k.id, k."index" AS m, c.id AS call_id, c.n, c.turn_id FROM live_tool_calls k JOIN called c ON c.session_id = k.session_id AND c.source = k.source AND c.id = k.api_call_id)"""
_LOOSE = """SELECT DISTINCT session_id, 'session', NULL, session_id, 'unattached', NULL, 'unattached', [4e18, 0, 0], NULL::TIMESTAMP, '' FROM spawn WHERE spawn_source IS NULL
    UNION ALL SELECT session_id, 'unattached', NULL, 'unattached', 'run', NULL, id, [0, 0, 0], started_at, id FROM spawn WHERE spawn_source IS NULL"""
_COLUMNS = "session_id, parent_kind, parent_source, parent_id, kind, source, item_id, o, moment, tie"


def _levels(preset: str) -> str:
    at_turn = "CASE WHEN {0} IS NULL THEN 'unattributed' ELSE 'turn' END, {1}, coalesce({0}, {1})"
    if preset == "agents":
        run = "'run', NULL, id, [0, 0, 0], started_at, id FROM spawn WHERE spawn_source IS NOT NULL"
        arms = f"""SELECT session_id, 'session' AS parent_kind, NULL AS parent_source, session_id AS parent_id, 'run' AS kind, NULL AS source, id AS item_id, [0, 0, 0] AS o, started_at AS moment, id AS tie FROM spawn WHERE spawn_source = 'main'
            UNION ALL SELECT session_id, 'run', NULL, parent_agent_id, 'run', NULL, id, [0, 0, 0], started_at, id FROM spawn WHERE parent_agent_id IS NOT NULL
            UNION ALL SELECT session_id, {at_turn.format("spawn_turn_id", "spawn_source")}, {run}
            UNION ALL SELECT session_id, 'call', spawn_source, spawn_call_id, {run}
            UNION ALL SELECT session_id, 'tool', spawn_source, tool_use_id, {run}"""
    else:
        if preset == "full":
            rows, edge, row = "SELECT session_id, source, turn_id, id, [n, 0, 0] AS o FROM called", "spawn_call_id", "call"
        else:
            rows, edge, row = "SELECT session_id, source, turn_id, id, [n, m, 0] AS o FROM used", "tool_use_id", "tool"
        arms = f"""SELECT t.session_id, {_HOLDER.format("t")}, 'turn' AS kind, t.source, t.id AS item_id, [t."index", 1, 0] AS o, NULL::TIMESTAMP AS moment, '' AS tie FROM live_turns t
            UNION ALL SELECT k.session_id, {_HOLDER.format("k")}, 'compaction', k.source, k.id,
                [coalesce((SELECT min(t."index") FROM live_turns t WHERE t.session_id = k.session_id AND t.source = k.source AND t.started_at > k.timestamp), 1e18), 0, 0], k.timestamp, k.id FROM live_compactions k
            UNION ALL SELECT DISTINCT c.session_id, {_HOLDER.format("c")}, 'unattributed', c.source, c.source, [2e18, 0, 0], NULL::TIMESTAMP, '' FROM called c WHERE turn_id IS NULL
            UNION ALL SELECT session_id, {at_turn.format("turn_id", "source")}, '{row}', source, id, o, NULL, '' FROM ({rows})
            UNION ALL SELECT r.session_id, {at_turn.format("r.spawn_turn_id", "r.spawn_source")}, 'run', NULL, r.id, coalesce([l.o[1], l.o[2], 1], [1e18, 0, 1]), r.started_at, r.id
                FROM spawn r LEFT JOIN ({rows}) l ON l.session_id = r.session_id AND l.source = r.spawn_source AND l.id = r.{edge} AND l.turn_id IS NOT DISTINCT FROM r.spawn_turn_id WHERE r.spawn_source IS NOT NULL
            UNION ALL SELECT session_id, 'call', source, call_id, 'tool', source, id, [m, 0, 0], NULL, '' FROM used"""
    return f"""{_BASE}, every AS ({arms} UNION ALL {_LOOSE}), levels AS (SELECT session_id, parent_kind, parent_source, parent_id,
        row_number() OVER (PARTITION BY session_id, parent_kind, parent_source, parent_id ORDER BY o, moment NULLS LAST, tie, item_id) AS place, kind, source, item_id FROM every)"""


def _front() -> str:
    head = with_store("SELECT 1 FROM live_turns, live_api_calls, live_tool_calls, live_agent_runs, live_compactions")
    return head[: head.index("SELECT 1 FROM live")].rstrip()


def children(preset: str) -> str:
    return f"{_front()}{_levels(preset)} SELECT * FROM levels"


def steps(preset: str) -> str:
    name = "concat_ws('|', {0}kind, coalesce({0}{1}source, ''), {0}{2}id)"
    shown = " WHERE parent_kind <> 'call'" if preset == "noapi" else ""
    return f"""{_front()}{_levels(preset)}, nodes AS (SELECT session_id, {name.format("", "", "item_")} AS item_id,
            CASE WHEN parent_kind <> 'session' THEN concat_ws('|', parent_kind, coalesce(parent_source, ''), parent_id) END AS above, lpad(place::VARCHAR, 12, '0') AS step FROM levels{shown}),
        reach AS (SELECT session_id, item_id, step AS path FROM nodes WHERE above IS NULL
            UNION ALL SELECT n.session_id, n.item_id, r.path || '/' || n.step FROM nodes n JOIN reach r ON r.session_id = n.session_id AND r.item_id = n.above)
        SELECT session_id, item_id, lag(item_id) OVER w AS previous, lead(item_id) OVER w AS next FROM reach WINDOW w AS (PARTITION BY session_id ORDER BY path)"""
