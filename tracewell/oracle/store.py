"""The projected trace store as common table expressions over the test data."""

from __future__ import annotations

from tracewell import model

_CATEGORIES = "[" + ", ".join(f"'{c}'" for c in model.CATEGORIES) + "]"
_OUTCOMES = "[" + ", ".join(f"'{o}'" for o in model.OUTCOMES) + "]"


def _tags(n: str, what: str, at: str) -> str:
    return f"""'Did ' || {what} AS description, ({_CATEGORIES})[{n} % 14 + 1] AS category, ({_OUTCOMES})[{n} % 5 + 1] AS outcome,
        CASE WHEN {n} % 4 = 0 THEN 'slow at ' || {what} END AS friction, md5({what}) AS input_hash, 'p' || ({n} % 2) AS prompt_version,
        '2' AS taxonomy_version, CASE WHEN {n} % 3 = 0 THEN 'tagger-a' ELSE 'tagger-b' END AS model, {at} + INTERVAL 1 DAY AS enriched_at"""


_CTES: dict[str, str] = {
    "b0": """SELECT *, CAST(floor((day(ts) - 1) / 6) AS BIGINT) AS bucket FROM events""",
    "b1": """SELECT *, CASE WHEN event_id % 3 <> 0
            THEN TIMESTAMP '2024-01-01 08:00:00' + to_days(CAST(bucket * 6 AS INTEGER)) + to_milliseconds((event_id % 97) * 40000 + event_id % 1000)
            ELSE ts END AS tm FROM b0""",
    "b2": """SELECT event_id, ts, user_id, event_type, value, props, bucket, tm, false AS copied FROM b1
        UNION ALL SELECT event_id, ts, user_id, event_type, value, props, bucket + 1, tm, true FROM b1 WHERE event_id % 11 = 0 AND bucket < 4""",
    "b3": """SELECT *, 's' || user_id || '-' || bucket AS sid FROM b2""",
    "b4": """SELECT *, CASE WHEN event_id % 4 = 3 THEN 'run-' || sid ELSE 'main' END AS source,
            CASE event_type WHEN 'view' THEN 'turn' WHEN 'signup' THEN 'mark' ELSE 'call' END AS kind,
            event_type IN ('purchase', 'error') AS tool FROM b3""",
    "ev": """SELECT *, row_number() OVER (PARTITION BY sid, source ORDER BY tm, event_id) AS line,
            last_value(CASE WHEN event_type = 'view' THEN 't' || event_id END IGNORE NULLS) OVER (PARTITION BY sid, source ORDER BY tm, event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn,
            row_number() OVER (PARTITION BY sid, source, kind ORDER BY tm, event_id) - 1 AS place,
            row_number() OVER (PARTITION BY sid, source, tool ORDER BY tm, event_id) - 1 AS tool_place FROM b4""",
    "heads": """SELECT sid, min(user_id) AS u, min(tm) AS lo, max(tm) AS hi, count(*) AS n FROM ev WHERE NOT copied GROUP BY sid""",
    "sessions": """SELECT sid AS id,
            CASE WHEN u % 31 = 0 THEN NULL WHEN u % 7 = 0 THEN '/repo/p1-old' WHEN u % 3 = 0 THEN '/repo/p' || (u % 4) || '/.worktrees/w' ELSE '/repo/p' || (u % 4) END AS project_dir,
            'trunk' AS git_branch, '1.' || (u % 3) AS version, 'cli' AS entrypoint, lo AS started_at, hi AS ended_at, n * 1000 AS active_ms,
            '/logs/' || sid || '.jsonl' AS transcript_path, CASE WHEN u % 5 <> 0 THEN 'Session ' || sid END AS title,
            CASE WHEN u % 4 = 0 THEN 'agent-' || (u % 8) END AS agent_name FROM heads""",
    "turns": """SELECT sid AS session_id, source, 't' || event_id AS id, CAST(place AS INTEGER) AS "index",
            'Please look at ' || props || ' for item ' || event_id AS prompt,
            CASE WHEN event_id % 3 = 0 THEN '/cmd' || (event_id % 4) END AS command_name, CASE WHEN event_id % 3 = 0 THEN '--item ' || event_id END AS command_args,
            tm AS started_at, tm + INTERVAL 30 SECOND AS ended_at, event_id % 29 = 0 AS replayed FROM ev WHERE kind = 'turn'""",
    "api_calls": """SELECT sid AS session_id, source, 'm' || event_id AS id, turn AS turn_id, CAST(place AS INTEGER) AS "index",
            CASE WHEN event_id % 7 < 3 THEN 'model-a' WHEN event_id % 7 < 5 THEN 'model-b' WHEN event_id % 7 = 5 THEN 'model-c' ELSE 'model-x' END AS model,
            CASE WHEN event_id % 31 = 0 THEN 'model-z' END AS fallback_from, CASE WHEN event_id % 2 = 0 THEN 'high' END AS effort,
            CASE WHEN event_type = 'click' THEN 'end_turn' ELSE 'tool_use' END AS stop_reason,
            CASE WHEN event_id % 5 < 2 THEN 'skill' || (event_id % 3) END AS attribution_skill, tm AS started_at, tm + INTERVAL 2 SECOND AS ended_at,
            CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value * 3) AS BIGINT) AS output_tokens,
            CASE WHEN event_id % 5 = 0 THEN CAST(floor(value) AS BIGINT) ELSE 50000 END AS cache_read_tokens,
            CASE WHEN event_id % 5 = 0 THEN 20000 + CAST(floor(value * 100) AS BIGINT) ELSE CAST(floor(value) AS BIGINT) END AS cache_creation_tokens,
            CASE WHEN event_id % 6 = 0 THEN CAST(floor(value) AS BIGINT) + 1 END AS cache_1h_tokens,
            'Answer to ' || props || ' by ' || event_type AS text, CASE WHEN event_id % 3 = 0 THEN 'Thinking about ' || event_id ELSE '' END AS thinking,
            CASE WHEN event_id % 7 < 3 THEN floor(value * 100) * 5 / 65536 WHEN event_id % 7 < 5 THEN floor(value * 100) * 3 / 65536 WHEN event_id % 7 = 5 THEN 0 END AS cost_usd,
            event_id % 23 = 0 AS replayed FROM ev WHERE kind = 'call'""",
    "tool_calls": """SELECT sid AS session_id, source, 'u' || event_id AS id, 'm' || event_id AS api_call_id, CAST(tool_place AS INTEGER) AS "index",
            (['Bash', 'Read', 'Edit', 'Skill', 'Glob', 'Write'])[event_id % 6 + 1] AS name, event_id % 43 = 0 AS server_side,
            CASE WHEN event_id % 53 = 0 THEN 'not json'
                 WHEN event_id % 6 = 0 THEN '{"command": "' || (['cd /repo/p1 && ls -la src/d1', 'git status --short', 'FOO=1 npm run test | tail -5',
                    '/usr/bin/python -m pytest tests', 'find /repo/p1/d1 -name x'])[(event_id // 6) % 5 + 1] || '"}'
                 WHEN event_id % 6 = 3 THEN '{"skill": "skill' || (event_id % 3) || '"}'
                 WHEN event_id % 6 = 4 THEN '{"pattern": "/repo/p1/d' || (event_id % 5) || '/*.py"}'
                 ELSE '{"file_path": "/repo/p1/d' || (event_id % 5) || '/f' || (event_id % 9) || '.py"}' END AS input,
            CASE WHEN event_type = 'purchase' THEN 'ok ' || event_id ELSE CASE event_id % 4
                 WHEN 0 THEN 'File /repo/p1/d' || (event_id % 5) || '/f.py does not exist.' || chr(10) || 'Look elsewhere.'
                 WHEN 1 THEN '  Error:   denied at /tmp/x/' || event_id || ', retry later'
                 WHEN 2 THEN 'Exit code 1' || chr(10) || '  at line 3' ELSE 'command   not found: foo' END END AS result,
            CASE WHEN event_id % 37 = 0 THEN 'doc-' || (event_id % 100) END AS offload_file, event_type = 'error' AS is_error, event_id % 41 = 0 AS incomplete,
            tm AS started_at, CASE WHEN event_id % 41 <> 0 THEN tm + INTERVAL 1500 MILLISECOND END AS ended_at, event_id % 23 = 0 AS replayed FROM ev WHERE tool""",
    "runs": """SELECT sid, min(user_id) AS u, min(tm) FILTER (source <> 'main') AS lo, max(tm) FILTER (source <> 'main') AS hi,
            max(event_id) FILTER (source = 'main' AND tool AND event_id % 6 = 4) AS spawn FROM ev GROUP BY sid HAVING count(*) FILTER (source <> 'main') > 0""",
    "agent_runs": """SELECT sid AS session_id, r.name || '-' || sid AS id, r.above || '-' || sid AS parent_agent_id, CASE WHEN r.depth = 1 AND u % 7 <> 0 THEN 'u' || spawn END AS tool_use_id,
            'type' || ((u + r.depth - 1) % 3) AS agent_type, CASE r.depth WHEN 1 THEN 'Run' ELSE 'Part' END || ' for ' || sid AS description, 'model-a' AS model, r.depth AS spawn_depth,
            r.depth = 1 AND u % 5 = 0 AS is_fork, lo AS started_at, hi AS ended_at
        FROM runs, (VALUES (1, 'run', NULL), (2, 'sub', 'run'), (3, 'deep', 'sub')) r(depth, name, above) WHERE r.depth = 1 OR r.depth = 2 AND u % 3 = 1 OR u % 6 = 1""",
    "compactions": """SELECT sid AS session_id, source, 'k' || event_id AS id, tm AS timestamp, CASE WHEN event_id % 2 = 0 THEN 'auto' ELSE 'manual' END AS trigger,
            CAST(floor(value * 100) AS BIGINT) + 1000 AS pre_tokens, CAST(floor(value) AS BIGINT) AS post_tokens, event_id % 5000 AS duration_ms
            FROM ev WHERE event_type = 'signup' AND event_id % 3 <> 1""",
    "pr_links": """SELECT sid AS session_id, CAST(event_id AS INTEGER) AS line_no, 'https://example.org/pull/' || (event_id % 5) AS pr_url FROM ev WHERE NOT copied AND event_id % 17 = 0""",
    "offload_files": """SELECT 's' || (doc_id % 10) || '-0' AS session_id, 'doc-' || doc_id AS name, text AS content, false AS lossy_decode, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents""",
    "raw_records": """SELECT sid AS session_id, source, CAST(line AS INTEGER) AS line_no, CASE WHEN event_type = 'view' THEN 't' || event_id ELSE 'x' || event_id END AS uuid,
            tm AS timestamp, event_type AS type, '{"type": "' || event_type || '", "ids": "m' || event_id || ' u' || event_id || ' ", "props": ' || props
            || CASE WHEN event_id % 7 = 0 AND event_type <> 'view' AND turn IS NOT NULL THEN ', "parentUuid": "' || turn || '", "content": "<local-command-stdout>out ' || event_id || '</local-command-stdout>"' ELSE '' END || '}' AS raw FROM ev""",
    "extract_state": """SELECT sid AS session_id, md5(sid) AS fingerprint, '1' AS extractor_version FROM heads""",
    "turn_enrichments": f"""SELECT sid AS session_id, source, 't' || event_id AS turn_id, {_tags("event_id", "('t' || event_id)", "tm")}
            FROM ev WHERE kind = 'turn' AND event_id % 29 <> 0 AND event_id % 3 <> 1""",
    "agent_run_enrichments": f"""SELECT sid AS session_id, 'run-' || sid AS agent_run_id, {_tags("u", "('run-' || sid)", "lo")} FROM runs WHERE u % 2 = 0""",
    "session_enrichments": f"""SELECT sid AS session_id, {_tags("u", "sid", "lo")} FROM heads WHERE u % 3 = 0""",
}

_LIVE = {"turns": True, "api_calls": True, "tool_calls": True, "agent_runs": False, "compactions": False}
for _name, _flag in _LIVE.items():
    _CTES[f"live_{_name}"] = f"SELECT * FROM {_name}" + (" WHERE NOT replayed" if _flag else "")
    _CTES[f"corpus_{_name}"] = f"""SELECT l.* FROM live_{_name} l JOIN (
        SELECT x.id, arg_min(x.session_id, row(coalesce(s.started_at, TIMESTAMP '9999-01-01'), x.session_id)) AS owner
        FROM live_{_name} x JOIN sessions s ON s.id = x.session_id GROUP BY x.id) o ON o.id = l.id AND o.owner = l.session_id"""


def _rollup(family: str) -> str:
    return f"""SELECT s.id AS session_id, s.project_dir, s.title, s.started_at, s.ended_at, s.active_ms,
            date_diff('millisecond', s.started_at, s.ended_at) AS wall_ms,
            coalesce(t.n, 0) AS turns, coalesce(c.n, 0) AS api_calls, coalesce(l.n, 0) AS tool_calls, coalesce(a.n, 0) AS agent_runs, coalesce(k.n, 0) AS compactions,
            coalesce(c.i, 0)::BIGINT AS input_tokens, coalesce(c.o, 0)::BIGINT AS output_tokens, coalesce(c.r, 0)::BIGINT AS cache_read_tokens,
            coalesce(c.w, 0)::BIGINT AS cache_creation_tokens, coalesce(c.usd, 0) AS cost_usd, coalesce(c.free, 0) AS unpriced_api_calls
        FROM sessions s
        LEFT JOIN (SELECT session_id, count(*) AS n FROM {family}_turns GROUP BY 1) t ON t.session_id = s.id
        LEFT JOIN (SELECT session_id, count(*) AS n, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(cache_read_tokens) AS r, sum(cache_creation_tokens) AS w,
            sum(cost_usd) AS usd, count(*) - count(cost_usd) AS free FROM {family}_api_calls GROUP BY 1) c ON c.session_id = s.id
        LEFT JOIN (SELECT session_id, count(*) AS n FROM {family}_tool_calls GROUP BY 1) l ON l.session_id = s.id
        LEFT JOIN (SELECT session_id, count(*) AS n FROM {family}_agent_runs GROUP BY 1) a ON a.session_id = s.id
        LEFT JOIN (SELECT session_id, count(*) AS n FROM {family}_compactions GROUP BY 1) k ON k.session_id = s.id"""


_CTES["session_rollups"] = _rollup("live")
_CTES["corpus_rollups"] = _rollup("corpus")


def scope(project: str, as_of: str, window_days: int, since: str | None = None) -> dict[str, str]:
    chosen = f"""SELECT id AS session_id, started_at,
            coalesce(started_at >= DATE '{as_of}' - to_days({window_days}) AND started_at < DATE '{as_of}' + INTERVAL 1 DAY, false) AS in_window
        FROM sessions WHERE (project_dir = '{project}' OR starts_with(project_dir, '{project}/'))"""
    return {
        "project_sessions": chosen + (f" AND started_at >= DATE '{since}'" if since else ""),
        "session_period": """SELECT session_id, unnest(CASE WHEN in_window THEN ['corpus', 'trailing_window'] ELSE ['corpus'] END) AS period FROM project_sessions""",
    }


def with_store(sql: str, project: str = "/repo", as_of: str = "2024-01-28", window_days: int = 7, since: str | None = None) -> str:
    """``sql`` with those relations of the store in front that it uses."""
    import re

    known = _CTES | scope(project, as_of, window_days, since)
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(known[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    order = [n for n in known if n in needed and n in ("project_sessions", "session_period")]
    front = [n for n in known if n in needed and n not in order]
    head = ",\n".join(f"{n} AS ({known[n]})" for n in [*front, *order])
    # Names of the test tables stay visible: no relation of the store has one of them.
    return f"WITH RECURSIVE {head}\n{sql}" if head else sql
