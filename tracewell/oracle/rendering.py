"""SQL of rendered items: lines are taken one by one from both ends, until neither next one fits."""

from __future__ import annotations

from tracewell.oracle.store import with_store


def _capped(x: str, limit: int) -> str:
    room = f"({limit} - length('[+' || length({x}) || ' chars]'))"
    return f"CASE WHEN length({x}) <= {limit} THEN {x} WHEN {room} > 0 THEN substr({x}, 1, {room}) || '[+' || (length({x}) - {room}) || ' chars]' ELSE substr({x}, 1, {limit}) END"


def _tailed(x: str, limit: int) -> str:
    room = f"({limit} - length('[+' || length({x}) || ' chars]'))"
    return f"CASE WHEN length({x}) <= {limit} THEN {x} WHEN {room} > 0 THEN '[+' || (length({x}) - {room}) || ' chars]' || right({x}, {room}) ELSE right({x}, {limit}) END"


def _one_line(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _call_lines(b) -> str:
    """``session_id, source, turn_id, n, place, line`` of calls and their tools."""
    answer = "CASE WHEN k.incomplete THEN 'unanswered' WHEN k.result IS NULL THEN 'no result' ELSE 'result ' || length(k.result) || ' chars' || CASE WHEN k.is_error THEN ', ERROR' ELSE '' END END"
    ends = f"CASE WHEN k.is_error AND k.result <> '' THEN ' | ends: ' || {_one_line(_tailed('k.result', b.error_tail))} ELSE '' END"
    return f"""SELECT session_id, source, turn_id, "index" AS n, 0 AS place, '## Answer' AS line FROM live_api_calls
        UNION ALL SELECT session_id, source, turn_id, "index", 1, {_capped("trim(text)", b.text)} FROM live_api_calls WHERE trim(text) <> ''
        UNION ALL SELECT k.session_id, k.source, c.turn_id, c."index", k."index" + 2, '- ' || k.name || ' (input ' || length(k.input) || ' chars, ' || {answer} || ') ' || {_one_line(_capped("k.input", b.input_head))} || {ends}
            || coalesce(' | run: ' || {_one_line("(SELECT min(coalesce(e.description, r.agent_type)) FROM live_agent_runs r LEFT JOIN agent_run_enrichments e ON e.session_id = r.session_id AND e.agent_run_id = r.id WHERE r.session_id = k.session_id AND r.tool_use_id = k.id)")}, '')
        FROM live_tool_calls k JOIN live_api_calls c ON c.session_id = k.session_id AND c.source = k.source AND c.id = k.api_call_id"""


def _fitted(keys: str, heads: str, lines: str, budget: int, more: str = "") -> str:
    """``heads`` gives the keys and ``head``; ``lines`` the keys, ``line`` and what orders them as ``o``."""
    front = with_store("SELECT 1 FROM live_turns, live_api_calls, live_tool_calls, live_agent_runs, agent_run_enrichments, turn_enrichments, raw_records, session_rollups, sessions")
    mark = "'[… ' || {} || ' of ' || n || ' lines left out …]'"
    return (
        front[: front.index("SELECT 1 FROM live")].rstrip()
        + f"""{more}, item_heads AS ({heads}), item_parts AS ({lines}),
    item_lines AS (SELECT {keys}, line, row_number() OVER (PARTITION BY {keys} ORDER BY o) - 1 AS i FROM item_parts),
    item_facts AS (SELECT {keys}, head, count(line) AS n, length(head) + coalesce(sum(length(line) + 1), 0) AS whole, list(line ORDER BY i) FILTER (line IS NOT NULL) AS said FROM item_heads LEFT JOIN item_lines USING ({keys}) GROUP BY {keys}, head),
    item_steps AS (SELECT {keys}, 0 AS step, 0 AS lo, n - 1 AS hi, 0 AS side, false AS stuck0, false AS stuck1, {budget} - length(head) - 2 - length({mark.format("n")}) AS room FROM item_facts WHERE whole > {budget}
        UNION ALL SELECT {keys}, step + 1, lo + (side = 0 AND fits)::INT, hi - (side = 1 AND fits)::INT, 1 - side, stuck0 OR side = 0 AND NOT fits, stuck1 OR side = 1 AND NOT fits, room - CASE WHEN fits THEN size ELSE 0 END
        FROM (SELECT s.*, length(said[CASE WHEN side = 0 THEN lo ELSE hi END + 1]) + 1 AS size, size <= room AS fits FROM item_steps s JOIN item_facts USING ({keys}) WHERE lo <= hi AND NOT (stuck0 AND stuck1))),
    item_last AS (SELECT {keys}, arg_max(lo, step) AS lo, arg_max(hi, step) AS hi FROM item_steps GROUP BY {keys}),
    bodies AS (SELECT {keys}, substr(concat_ws(chr(10), head, array_to_string(CASE WHEN lo IS NULL OR lo > hi THEN said ELSE list_concat(said[:lo], [{mark.format("(hi - lo + 1)")}], said[hi + 2:]) END, chr(10))), 1, {budget}) AS body,
        CASE WHEN lo IS NULL OR lo > hi THEN 0 ELSE hi - lo + 1 END AS left_out FROM item_facts LEFT JOIN item_last USING ({keys}))
    SELECT {keys}, body, left_out::BIGINT AS left_out, sha256(body) AS input_hash FROM bodies"""
    )


_PRINTED = r"""(SELECT string_agg(regexp_extract(r.raw, '<local-command-stdout>(.*?)</local-command-stdout>', 1), chr(10) ORDER BY r.line_no) FROM raw_records r
    WHERE r.session_id = t.session_id AND r.source = t.source AND contains(r.raw, '"parentUuid": "' || t.id || '"'))"""


def rendered_turns(b) -> str:
    heads = f"""SELECT t.session_id, t.id AS turn_id, '# Turn' || chr(10) || CASE WHEN command_name IS NOT NULL
            THEN '## Command' || chr(10) || concat_ws(' ', command_name, command_args) || chr(10) || 'printed: ' || coalesce({_capped("printed", b.command_result)}, 'nothing')
            ELSE '## Prompt' || chr(10) || {_capped("prompt", b.prompt)} END AS head
        FROM (SELECT *, {_PRINTED} AS printed FROM live_turns t WHERE source = 'main') t"""
    ended = "coalesce((SELECT arg_max(c.stop_reason, c.\"index\") FROM live_api_calls c WHERE c.session_id = t.session_id AND c.source = 'main' AND c.turn_id = t.id), 'no call')"
    lines = f"""SELECT session_id, turn_id, line, row(0, n, place) AS o FROM ({_call_lines(b)}) WHERE source = 'main' AND turn_id IS NOT NULL
        UNION ALL SELECT session_id, id, 'Ended: ' || {ended}, row(1, 0, 0) FROM live_turns t WHERE source = 'main'"""
    return _fitted("session_id, turn_id", heads, lines, b.total)


def rendered_runs(b) -> str:
    own = """, own AS (SELECT c.session_id, c.source AS run_id, c."index" AS n, t.id AS turn_id, coalesce(t."index" + 1, 0) AS section FROM live_api_calls c
            LEFT JOIN live_turns t ON t.session_id = c.session_id AND t.source = c.source AND t.id = c.turn_id WHERE c.source <> 'main'),
        sections AS (SELECT DISTINCT session_id, run_id, section, turn_id FROM (SELECT session_id, run_id, section, turn_id FROM own
            UNION ALL SELECT session_id, source, "index" + 1, id FROM live_turns WHERE source <> 'main')),
        opened AS (SELECT s.session_id, s.run_id, section, CASE WHEN turn_id IS NULL THEN '## Continues another transcript'
            WHEN section = min(section) FILTER (turn_id IS NOT NULL) OVER (PARTITION BY s.session_id, s.run_id) THEN '## Task' ELSE '## Instruction' END
            || coalesce(chr(10) || PROMPT, '') AS opening, min(section) OVER (PARTITION BY s.session_id, s.run_id) AS first
            FROM sections s LEFT JOIN live_turns t ON t.session_id = s.session_id AND t.source = s.run_id AND t.id = s.turn_id)""".replace("PROMPT", _capped("prompt", b.prompt))
    heads = """SELECT r.session_id, r.id AS run_id, concat_ws(chr(10), '# Run: ' || coalesce(agent_type, 'unknown'), opening) AS head
        FROM live_agent_runs r LEFT JOIN opened o ON o.session_id = r.session_id AND o.run_id = r.id AND section = first"""
    ended = "coalesce((SELECT arg_max(c.stop_reason, c.\"index\") FROM live_api_calls c WHERE c.session_id = r.session_id AND c.source = r.id), 'no call')"
    lines = f"""SELECT session_id, run_id, opening AS line, row(section, -1, 0) AS o FROM opened WHERE section > first
        UNION ALL SELECT session_id, source, line, row(coalesce((SELECT t."index" + 1 FROM live_turns t WHERE t.session_id = l.session_id AND t.source = l.source AND t.id = l.turn_id), 0), n, place)
            FROM ({_call_lines(b)}) l WHERE source <> 'main'
        UNION ALL SELECT session_id, id, 'Ended: ' || {ended}, row(1000000, 0, 0) FROM live_agent_runs r"""
    return _fitted("session_id, run_id", heads, lines, b.total, own)


def rendered_sessions(b) -> str:
    heads = """SELECT session_id, '# Session: ' || coalesce(title, 'untitled') || chr(10) || 'wall ms ' || coalesce(wall_ms::VARCHAR, 'unknown') || ', active ms ' || coalesce(active_ms::VARCHAR, 'unknown') || chr(10)
        || 'tokens ' || concat_ws(', ', input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens) || chr(10) || '## Work' AS head
        FROM session_rollups WHERE (turns > 0 OR agent_runs > 0) AND api_calls > 0"""
    told = f"CASE WHEN e.description IS NULL THEN ' [not described yet]' ELSE ' [' || e.category || '/' || e.outcome || '] ' || {_one_line('e.description')} END"
    spawner = "(SELECT min(k.source) FROM live_tool_calls k WHERE k.session_id = r.session_id AND k.id = r.tool_use_id)"
    lines = f"""SELECT t.session_id, '- Turn' || {told} AS line, row(t.started_at IS NULL, t.started_at, 0, t.id) AS o FROM live_turns t
            LEFT JOIN turn_enrichments e ON e.session_id = t.session_id AND e.source = t.source AND e.turn_id = t.id WHERE t.source = 'main'
        UNION ALL SELECT r.session_id, '- Run (' || coalesce(r.agent_type, 'unknown') || ')' || {told}, row(r.started_at IS NULL, r.started_at, 1, r.id) FROM live_agent_runs r
            LEFT JOIN agent_run_enrichments e ON e.session_id = r.session_id AND e.agent_run_id = r.id
            WHERE r.parent_agent_id IS NULL AND coalesce({spawner}, 'main') IN ('main', r.id)"""
    return _fitted("session_id", heads, lines, b.total)
