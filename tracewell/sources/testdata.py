"""A trace store projected from the event and document tables of the test data.

Every event becomes a record of a session of its user's six-day bucket. Each
eleventh event is copied into the user's next session as a resumed session
does, ids and times kept; each fourth belongs to the session's agent run. Two
thirds of the events move close together, so that idle and busy gaps both occur.
Costs are multiples of 1/65536: sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import model

AT = (
    "CASE WHEN event_id % 3 <> 0 THEN TIMESTAMP '2024-01-01 08:00:00' + make_dt_interval(CAST(bucket * 6 AS INT)) "
    "+ make_dt_interval(0, 0, 0, (event_id % 97) * 40 + (event_id % 1000) / 1000.0) ELSE CAST(ts AS TIMESTAMP) END"
)


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with session, thread, time and place in the thread; copies included."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = events.withColumn("bucket", F.expr("CAST(floor((day(ts) - 1) / 6) AS BIGINT)")).withColumn("at", F.expr(AT))
    copies = base.where("event_id % 11 = 0 AND bucket < 4").withColumn("bucket", F.col("bucket") + 1)
    both = base.withColumn("copied", F.lit(False)).unionByName(copies.withColumn("copied", F.lit(True)))
    both = both.withColumn("sid", F.expr("concat('s', user_id, '-', bucket)"))
    both = both.withColumn("source", F.expr("CASE WHEN event_id % 4 = 3 THEN concat('run-', sid) ELSE 'main' END"))
    thread = Window.partitionBy("sid", "source").orderBy("at", "event_id")
    view = F.expr("CASE WHEN event_type = 'view' THEN concat('t', event_id) END")
    before = thread.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("line", F.row_number().over(thread)).withColumn("turn", F.last(view, ignorenulls=True).over(before))
    kind = F.expr("CASE WHEN event_type = 'view' THEN 'turn' WHEN event_type = 'signup' THEN 'mark' ELSE 'call' END")
    both = both.withColumn("kind", kind)
    place = Window.partitionBy("sid", "source", "kind").orderBy("at", "event_id")
    both = both.withColumn("place", F.row_number().over(place) - 1)
    tool = F.expr("event_type IN ('purchase', 'error')")
    tools = Window.partitionBy("sid", "source", tool).orderBy("at", "event_id")
    return both.withColumn("tool_place", F.row_number().over(tools) - 1)


def project(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All tables of the trace model, by name."""
    ev = staged(spark, sf_dir)

    def table(name: str, rows: DataFrame, /, **columns: str) -> DataFrame:
        schema = (model.TABLES | model.ENRICHMENTS)[name]
        return rows.select(*[F.expr(columns[f.name]).cast(f.dataType).alias(f.name) for f in schema])

    out: dict[str, DataFrame] = {}
    owned = ev.where("NOT copied")
    heads = owned.groupBy("sid").agg(F.min("user_id").alias("u"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"))
    out["sessions"] = table(
        "sessions",
        heads,
        id="sid",
        project_dir="CASE WHEN u % 31 = 0 THEN NULL WHEN u % 7 = 0 THEN '/repo/p1-old' WHEN u % 3 = 0 THEN concat('/repo/p', u % 4, '/.worktrees/w') ELSE concat('/repo/p', u % 4) END",
        git_branch="'trunk'",
        version="concat('1.', u % 3)",
        entrypoint="'cli'",
        started_at="lo",
        ended_at="hi",
        active_ms="n * 1000",
        transcript_path="concat('/logs/', sid, '.jsonl')",
        title="CASE WHEN u % 5 = 0 THEN NULL ELSE concat('Session ', sid) END",
        agent_name="CASE WHEN u % 4 = 0 THEN concat('agent-', u % 8) END",
    )
    out["turns"] = table(
        "turns",
        ev.where("kind = 'turn'"),
        session_id="sid",
        source="source",
        id="concat('t', event_id)",
        index="place",
        prompt="concat('Please look at ', props, ' for item ', event_id)",
        command_name="CASE WHEN event_id % 3 = 0 THEN concat('/cmd', event_id % 4) END",
        command_args="CASE WHEN event_id % 3 = 0 THEN concat('--item ', event_id) END",
        started_at="at",
        ended_at="at + INTERVAL '30' SECOND",
        replayed="event_id % 29 = 0",
    )
    calls = ev.where("kind = 'call'")
    cents = "floor(value * 100)"
    out["api_calls"] = table(
        "api_calls",
        calls,
        session_id="sid",
        source="source",
        id="concat('m', event_id)",
        turn_id="turn",
        index="place",
        model="CASE WHEN event_id % 7 < 3 THEN 'model-a' WHEN event_id % 7 < 5 THEN 'model-b' WHEN event_id % 7 = 5 THEN 'model-c' ELSE 'model-x' END",
        fallback_from="CASE WHEN event_id % 31 = 0 THEN 'model-z' END",
        effort="CASE WHEN event_id % 2 = 0 THEN 'high' END",
        stop_reason="CASE WHEN event_type = 'click' THEN 'end_turn' ELSE 'tool_use' END",
        attribution_skill="CASE WHEN event_id % 5 < 2 THEN concat('skill', event_id % 3) END",
        request_id="concat('r', event_id)",
        started_at="at",
        ended_at="at + INTERVAL '2' SECOND",
        input_tokens="floor(value * 10)",
        output_tokens="floor(value * 3)",
        cache_read_tokens="CASE WHEN event_id % 5 = 0 THEN floor(value) ELSE 50000 END",
        cache_creation_tokens=f"CASE WHEN event_id % 5 = 0 THEN 20000 + {cents} ELSE floor(value) END",
        cache_5m_tokens="NULL",
        cache_1h_tokens="CASE WHEN event_id % 6 = 0 THEN floor(value) + 1 END",
        text="concat('Answer to ', props, ' by ', event_type)",
        thinking="CASE WHEN event_id % 3 = 0 THEN concat('Thinking about ', event_id) ELSE '' END",
        cost_usd=f"CASE WHEN event_id % 7 < 3 THEN {cents} * 5 / 65536 WHEN event_id % 7 < 5 THEN {cents} * 3 / 65536 WHEN event_id % 7 = 5 THEN 0 END",
        synthetic="false",
        replayed="event_id % 23 = 0",
    )
    command = (
        "CASE floor(event_id / 6) % 5 WHEN 0 THEN 'cd /repo/p1 && ls -la src/d1' WHEN 1 THEN 'git status --short' "
        "WHEN 2 THEN 'FOO=1 npm run test | tail -5' WHEN 3 THEN '/usr/bin/python -m pytest tests' ELSE 'find /repo/p1/d1 -name x' END"
    )
    out["tool_calls"] = table(
        "tool_calls",
        calls.where("event_type IN ('purchase', 'error')"),
        session_id="sid",
        source="source",
        id="concat('u', event_id)",
        api_call_id="concat('m', event_id)",
        index="tool_place",
        name="CASE event_id % 6 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Read' WHEN 2 THEN 'Edit' WHEN 3 THEN 'Skill' WHEN 4 THEN 'Glob' ELSE 'Write' END",
        server_side="event_id % 43 = 0",
        input=(
            "CASE WHEN event_id % 53 = 0 THEN 'not json' "
            f"WHEN event_id % 6 = 0 THEN concat('{{\"command\": \"', {command}, '\"}}') "
            "WHEN event_id % 6 = 3 THEN concat('{\"skill\": \"skill', event_id % 3, '\"}') "
            "WHEN event_id % 6 = 4 THEN concat('{\"pattern\": \"/repo/p1/d', event_id % 5, '/*.py\"}') "
            "ELSE concat('{\"file_path\": \"/repo/p1/d', event_id % 5, '/f', event_id % 9, '.py\"}') END"
        ),
        result=(
            "CASE WHEN event_type = 'purchase' THEN concat('ok ', event_id) ELSE CASE event_id % 4 "
            "WHEN 0 THEN concat('File /repo/p1/d', event_id % 5, '/f.py does not exist.\\nLook elsewhere.') "
            "WHEN 1 THEN concat('  Error:   denied at /tmp/x/', event_id, ', retry later') "
            "WHEN 2 THEN 'Exit code 1\\n  at line 3' ELSE 'command   not found: foo' END END"
        ),
        offload_file="CASE WHEN event_id % 37 = 0 THEN concat('doc-', event_id % 100) END",
        is_error="event_type = 'error'",
        incomplete="event_id % 41 = 0",
        started_at="at",
        ended_at="CASE WHEN event_id % 41 = 0 THEN NULL ELSE at + INTERVAL '1.5' SECOND END",
        duration_synthetic="false",
        replayed="event_id % 23 = 0",
    )
    runs = ev.groupBy("sid").agg(
        F.min("user_id").alias("u"),
        F.expr("min(at) FILTER (WHERE source <> 'main')").alias("lo"),
        F.expr("max(at) FILTER (WHERE source <> 'main')").alias("hi"),
        F.expr("max(event_id) FILTER (WHERE source = 'main' AND event_type IN ('purchase', 'error') AND event_id % 6 = 4)").alias("spawn"),
    )
    # Runs of a session: one for its side thread, and in some a run below it and one below that.
    nested = F.expr("""filter(array(named_struct('depth', 1, 'name', 'run', 'above', CAST(NULL AS STRING)), IF(u % 3 = 1, named_struct('depth', 2, 'name', 'sub', 'above', 'run'), NULL),
        IF(u % 6 = 1, named_struct('depth', 3, 'name', 'deep', 'above', 'sub'), NULL)), r -> r IS NOT NULL)""")
    out["agent_runs"] = table(
        "agent_runs",
        runs.where("lo IS NOT NULL").select("*", F.inline(nested)),
        session_id="sid",
        id="concat(name, '-', sid)",
        parent_agent_id="concat(above, '-', sid)",
        tool_use_id="CASE WHEN depth = 1 AND u % 7 <> 0 THEN concat('u', spawn) END",
        agent_type="concat('type', (u + depth - 1) % 3)",
        description="concat(CASE depth WHEN 1 THEN 'Run' ELSE 'Part' END, ' for ', sid)",
        model="'model-a'",
        workflow_id="NULL",
        spawn_depth="depth",
        is_fork="depth = 1 AND u % 5 = 0",
        fork_context_uuid="NULL",
        started_at="lo",
        ended_at="hi",
    )
    out["compactions"] = table(
        "compactions",
        ev.where("event_type = 'signup' AND event_id % 3 <> 1"),
        session_id="sid",
        source="source",
        id="concat('k', event_id)",
        timestamp="at",
        trigger="CASE WHEN event_id % 2 = 0 THEN 'auto' ELSE 'manual' END",
        pre_tokens="floor(value * 100) + 1000",
        post_tokens="floor(value)",
        duration_ms="event_id % 5000",
    )
    out["pr_links"] = table(
        "pr_links",
        owned.where("event_id % 17 = 0"),
        session_id="sid",
        line_no="event_id",
        pr_number="event_id % 500",
        pr_url="concat('https://example.org/pull/', event_id % 5)",
        pr_repository="'org/repo'",
        timestamp="at",
    )
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out["offload_files"] = table(
        "offload_files",
        documents,
        session_id="concat('s', doc_id % 10, '-0')",
        name="concat('doc-', doc_id)",
        content="text",
        lossy_decode="false",
        size_bytes="octet_length(text)",
    )
    out["raw_records"] = table(
        "raw_records",
        ev,
        session_id="sid",
        source="source",
        line_no="line",
        uuid="CASE WHEN event_type = 'view' THEN concat('t', event_id) ELSE concat('x', event_id) END",
        timestamp="at",
        type="event_type",
        raw="""concat('{"type": "', event_type, '", "ids": "m', event_id, ' u', event_id, ' ", "props": ', props,
            CASE WHEN event_id % 7 = 0 AND event_type <> 'view' AND turn IS NOT NULL THEN concat(', "parentUuid": "', turn, '", "content": "<local-command-stdout>out ', event_id, '</local-command-stdout>"') ELSE '' END, '}')""",
    )
    out["extract_state"] = table(
        "extract_state",
        heads,
        session_id="sid",
        fingerprint="md5(sid)",
        transcript_path="concat('/logs/', sid, '.jsonl')",
        extracted_at="hi",
        extractor="'transcripts'",
        extractor_version="'1'",
    )

    def tags(n: str, what: str, at: str) -> dict[str, str]:
        categories = ", ".join(f"'{c}'" for c in model.CATEGORIES)
        outcomes = ", ".join(f"'{o}'" for o in model.OUTCOMES)
        return {
            "description": f"concat('Did ', {what})",
            "category": f"element_at(array({categories}), CAST({n} % 14 + 1 AS INT))",
            "outcome": f"element_at(array({outcomes}), CAST({n} % 5 + 1 AS INT))",
            "friction": f"CASE WHEN {n} % 4 = 0 THEN concat('slow at ', {what}) END",
            "input_hash": f"md5({what})",
            "prompt_version": f"concat('p', {n} % 2)",
            "taxonomy_version": "'2'",
            "model": f"CASE WHEN {n} % 3 = 0 THEN 'tagger-a' ELSE 'tagger-b' END",
            "enriched_at": f"{at} + INTERVAL '1' DAY",
        }

    out["turn_enrichments"] = table(
        "turn_enrichments",
        ev.where("kind = 'turn' AND event_id % 29 <> 0 AND event_id % 3 <> 1"),
        session_id="sid",
        source="source",
        turn_id="concat('t', event_id)",
        **tags("event_id", "concat('t', event_id)", "at"),
    )
    out["agent_run_enrichments"] = table(
        "agent_run_enrichments",
        runs.where("lo IS NOT NULL AND u % 2 = 0"),
        session_id="sid",
        agent_run_id="concat('run-', sid)",
        **tags("u", "concat('run-', sid)", "lo"),
    )
    out["session_enrichments"] = table(
        "session_enrichments", heads.where("u % 3 = 0"), session_id="sid", **tags("u", "sid", "lo")
    )
    return out
