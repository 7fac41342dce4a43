"""Sessions as trace spans: ids, parents, times. Delivery is not the library's concern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BATCH = 2000
MAPPER_VERSION = "1"


def digest(*parts: Column, size: int) -> Column:
    return F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, size * 2)


def trace_id(session: Column) -> Column:
    """Sixteen bytes in hex."""
    return digest(session, size=16)


def span_id(session: Column, kind: str | Column, source: Column, item: Column) -> Column:
    """Eight bytes in hex of a row's key. A part that holds the separator raises."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    odd = session.contains("/") | source.contains("/") | item.contains("/")
    problem = F.raise_error(F.lit("an id holds the separator of span keys")).cast("string")
    return F.when(odd, problem).otherwise(digest(session, kind, source, item, size=8))


def session_spans(store) -> DataFrame:
    """A span for each session, run, turn, model call, tool call and compaction that counts.

    What a fork replayed has none; a tool call that spawned a run is that run's
    span; a compaction at or before a fork's own start is a copy. Spans last a
    millisecond at least, and a session's span reaches over all of its others.
    """
    runs = store["live_agent_runs"]
    session, none = F.col("session_id"), F.lit("")

    def thread_parent(source: Column) -> Column:
        return F.when(source == "main", span_id(session, "session", none, session)).otherwise(span_id(session, "agent_run", none, source))

    def rows(frame: DataFrame, kind: str, source: Column, item: Column, parent: Column, name: Column, start: Column, end: Column) -> DataFrame:
        return frame.select(
            session,
            F.lit(kind).alias("kind"),
            source.alias("source"),
            item.alias("item_id"),
            span_id(session, kind, source, item).alias("span_id"),
            parent.alias("parent_span_id"),
            name.alias("name"),
            start.alias("started_at"),
            end.alias("ended_at"),
        )

    source, item = F.col("source"), F.col("id")
    turns = store["live_turns"]
    calls = store["live_api_calls"]
    live_turns = turns.select("session_id", "source", F.col("id").alias("turn_id"), F.lit(True).alias("counts"))
    tools = store["live_tool_calls"]
    spawns = runs.where("tool_use_id IS NOT NULL").select("session_id", F.col("tool_use_id").alias("id"), F.col("id").alias("run_id")).dropDuplicates(["session_id", "id"])
    forks = runs.where("is_fork").select("session_id", F.col("id").alias("source"), F.col("started_at").alias("fork_start"))
    marks = store["live_compactions"].join(forks, ["session_id", "source"], "left").where("fork_start IS NULL OR timestamp > fork_start")

    called = calls.join(live_turns, ["session_id", "source", "turn_id"], "left")
    call_parent = F.when(F.col("counts"), span_id(session, "turn", source, F.col("turn_id"))).otherwise(thread_parent(source))
    plain = tools.join(spawns.where("id IS NOT NULL"), ["session_id", "id"], "left").where("run_id IS NULL OR run_id = source")
    spawned = tools.select("session_id", F.col("id").alias("tool_use_id"), F.col("source").alias("spawn_source"), "api_call_id")
    placed = runs.join(spawned, ["session_id", "tool_use_id"], "left")
    inside = F.col("spawn_source") == item
    run_parent = (
        F.when(F.col("spawn_source").isNull(), span_id(session, "session", none, session))
        .when(inside, thread_parent(F.coalesce("parent_agent_id", F.lit("main"))))
        .otherwise(span_id(session, "api_call", F.col("spawn_source"), F.col("api_call_id")))
    )
    late = lambda end: F.greatest(end, F.col("started_at") + F.expr("INTERVAL '0.001' SECOND"))
    children = [
        rows(placed, "agent_run", none, item, run_parent, F.concat(F.lit("invoke_agent "), F.col("agent_type")), F.col("started_at"), F.coalesce("ended_at", "started_at")),
        rows(turns, "turn", source, item, thread_parent(source), F.coalesce("command_name", F.lit("turn")), F.col("started_at"), F.coalesce("ended_at", "started_at")),
        rows(called, "api_call", source, item, call_parent, F.concat(F.lit("chat "), F.col("model")), F.col("started_at"), F.coalesce("ended_at", "started_at")),
        rows(plain, "tool_call", source, item, span_id(session, "api_call", source, F.col("api_call_id")), F.concat(F.lit("execute_tool "), F.col("name")), F.col("started_at"), F.coalesce("ended_at", "started_at")),
        rows(marks, "compaction", source, item, thread_parent(source), F.lit("compaction"), F.col("timestamp"), F.timestamp_add("MILLISECOND", F.col("duration_ms"), F.col("timestamp"))),
    ]
    below = children[0]
    for more in children[1:]:
        below = below.unionByName(more)
    below = below.withColumn("ended_at", late(F.col("ended_at")))
    reach = below.groupBy("session_id").agg(F.max("ended_at").alias("reach"), F.min("started_at").alias("first"))
    heads = store["sessions"].withColumn("session_id", item).join(reach, "session_id", "left")
    start = F.coalesce("started_at", "first")
    heads = rows(heads, "session", none, session, F.lit(None).cast("string"), F.lit("session"), start, F.greatest(F.coalesce("ended_at", start), F.col("reach")))
    return heads.withColumn("ended_at", late(F.col("ended_at"))).unionByName(below).withColumn("trace_id", trace_id(session))


def batches(spans: DataFrame, size: int = BATCH) -> DataFrame:
    """Add ``batch``: a session's spans in posts of ``size``, the root first."""
    order = Window.partitionBy("session_id").orderBy(F.col("parent_span_id").isNotNull(), "started_at", "span_id")
    return spans.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("long"))


def census(spans: DataFrame) -> DataFrame:
    """Spans of each kind in each session, to hold a delivery against."""
    return spans.groupBy("session_id", "kind").agg(F.count("*").alias("spans"))


def ambiguous(spans: DataFrame) -> DataFrame:
    """Span ids that more than one row has: none in a sound store."""
    return spans.groupBy("session_id", "span_id").count().where("count > 1")


def undelivered(state: DataFrame, ledger: DataFrame, backend: str) -> DataFrame:
    """Sessions whose present content the ledger does not hold for a backend."""
    sent = ledger.where((F.col("backend") == backend) & (F.col("mapper_version") == MAPPER_VERSION))
    return state.join(sent.select("session_id", "fingerprint"), ["session_id", "fingerprint"], "left_anti").select("session_id", "fingerprint")


#: Fields of a span that hold text of a transcript, which is private: relation, the span's kind, columns.
_TEXTS = (
    ("sessions", "session", ("title", "agent_name")),
    ("live_turns", "turn", ("prompt", "command_args")),
    ("live_api_calls", "api_call", ("text", "thinking")),
    ("live_tool_calls", "tool_call", ("input", "result")),
    ("live_agent_runs", "agent_run", ("description",)),
)


def span_texts(store, max_chars: int | None = None) -> DataFrame:
    """``session_id, span_id, name, value``: the texts that go with spans, cut to ``max_chars``; without a bound, none."""
    out = None
    for relation, kind, columns in _TEXTS:
        rows = store[relation]
        session = F.col("id" if kind == "session" else "session_id")
        source = F.lit("") if kind in ("session", "agent_run") else F.col("source")
        named = F.array(*[F.struct(F.lit(f"{kind}.{c}").alias("name"), F.substring(c, 1, max_chars or 0).alias("value")) for c in columns])
        part = rows.select(session.alias("session_id"), span_id(session, kind, source, F.col("id")).alias("span_id"), F.inline(named)).where("value IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out if max_chars is not None else out.where("false")


def refused(store) -> DataFrame:
    """``session_id, reason``: sessions that cannot be sent, for they have no time anywhere or no place."""
    spans = session_spans(store).groupBy("session_id").agg(F.min("started_at").alias("first"))
    rows = store["sessions"].select(F.col("id").alias("session_id"), "project_dir").join(spans, "session_id", "left")
    reason = F.when(F.col("first").isNull(), "timeless").when(F.col("project_dir").isNull(), "placeless")
    return rows.select("session_id", reason.alias("reason")).where("reason IS NOT NULL")


def delivered(ledger: DataFrame, state: DataFrame, sent: DataFrame, backend: str, at) -> DataFrame:
    """The ledger with a row for each session of ``sent`` (``session_id, spans``) in place of what it held for the backend."""
    new = sent.groupBy("session_id").agg(F.sum("spans").alias("spans_sent")).join(state.select("session_id", "fingerprint"), "session_id")
    new = new.withColumns({"backend": F.lit(backend), "mapper_version": F.lit(MAPPER_VERSION), "delivered_at": at})
    old = ledger.join(new.select("session_id", "backend"), ["session_id", "backend"], "left_anti")
    return old.unionByName(new.select(*old.columns))
