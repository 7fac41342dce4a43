"""Which tools, commands and paths fail, and how."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import clipped, command_head, folder_tail, json_field, signature_line, thread_key
from tracewell.plans.manifest import corpus, integer, text


def spread() -> list:
    return [F.count_distinct("session_id").alias("sessions"), F.count_distinct(thread_key()).alias("threads")]


@corpus()
def tool_failures(store, scope) -> DataFrame:
    """Calls and failures of each tool."""
    rows = scope.periods.join(store["corpus_tool_calls"], "session_id")
    out = rows.groupBy("period", F.col("name").alias("tool")).agg(
        F.count("*").alias("calls"),
        F.count_if("is_error").alias("errors"),
        F.round(F.count_if("is_error") / F.count("*"), 4).alias("error_rate"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct(F.when(F.col("is_error"), F.col("session_id"))).alias("erring_sessions"),
    )
    return out.orderBy("period", F.desc("errors"), F.desc("calls"), "tool")


@corpus(signature=text(None), min_occurrences=integer(5), signature_chars=integer(120))
def error_signatures(store, scope, signature, min_occurrences, signature_chars) -> DataFrame:
    """Failures that recur, by tool and first line."""
    failed = store["corpus_tool_calls"].where("is_error")
    if signature is not None:
        failed = failed.where(F.col("result").contains(signature))
    rows = scope.periods.join(failed, "session_id")
    out = rows.groupBy("period", F.col("name").alias("tool"), clipped(signature_line("result"), signature_chars).alias("signature"))
    out = out.agg(F.count("*").alias("errors"), *spread()).where(F.col("errors") >= min_occurrences)
    return out.orderBy("period", F.desc("errors"), F.desc("sessions"), "tool", "signature")


@corpus(mentions=text(None), min_occurrences=integer(5), head_chars=integer(60), signature_chars=integer(120))
def command_failures(store, scope, mentions, min_occurrences, head_chars, signature_chars) -> DataFrame:
    """Shell commands by their first words and by how they failed.

    ``head_errors`` sums the failures of the groups that are reported for a head.
    """
    command = json_field("input", "$.command")
    rows = store["corpus_tool_calls"].select("session_id", "source", "name", "is_error", "result", command.alias("command")).where("command IS NOT NULL")
    if mentions is not None:
        rows = rows.where(F.col("command").contains(mentions))
    bare, head = command_head("command", head_chars)
    rows = rows.withColumns({"bare": bare, "command_head": head})
    rows = rows.withColumn("signature", F.when(F.col("is_error"), clipped(signature_line("result"), signature_chars)))
    out = scope.periods.join(rows, "session_id").groupBy("period", F.col("name").alias("tool"), "command_head", "signature")
    out = out.agg(
        F.count("*").alias("calls"), *spread(), F.count_if(F.col("bare").rlike(r"&&|\||;")).alias("chained"), F.count_if("is_error").alias("errors")
    ).where(F.col("calls") >= min_occurrences)
    out = out.withColumn("head_errors", F.sum("errors").over(Window.partitionBy("period", "tool", "command_head"))).drop("errors")
    return out.orderBy("period", F.desc("head_errors"), "command_head", F.desc("calls"), F.asc_nulls_last("signature"))


@corpus(min_occurrences=integer(5), tail_segments=integer(1))
def path_failures(store, scope, min_occurrences, tail_segments) -> DataFrame:
    """File calls by the end of the file's folder."""
    path = json_field("input", "$.file_path")
    rows = store["corpus_tool_calls"].select("session_id", "source", "is_error", path.alias("path")).where("path IS NOT NULL")
    tail = folder_tail("path", tail_segments)
    rows = rows.withColumn("directory", F.when(tail == "", "(no directory)").otherwise(tail))
    failed = F.col("is_error")
    out = scope.periods.join(rows, "session_id").groupBy("period", "directory").agg(
        F.count("*").alias("calls"),
        F.count_if("is_error").alias("errors"),
        F.count_distinct(F.when(failed, F.col("session_id"))).alias("sessions"),
        F.count_distinct(F.when(failed, thread_key())).alias("threads"),
        F.count_if(failed & (F.col("source") != "main")).alias("run_errors"),
    )
    return out.where(F.col("errors") >= min_occurrences).orderBy("period", F.desc("errors"), "directory")


#: Labels that results must name.
DISPOSITIONS = ("listed the directory", "listed elsewhere", "no listing")
_LISTING = r"(^|[;&|][\t\n\f\r ]*)(ls|find|tree|rg --files)\b"


@corpus(within_calls=integer(1), missing=text(None))
def missing_file_recovery(store, scope, within_calls, missing) -> DataFrame:
    """What the next calls did after a call failed on a file.

    Each call looks ahead over its own thread with a window frame of
    ``within_calls`` indexes, so the band join is a sort inside the thread.
    """
    tools = store["corpus_tool_calls"]
    command = F.coalesce(json_field("input", "$.command"), F.lit(""))
    listing = F.col("name").isin("Glob", "LS") | command.rlike(_LISTING)
    ahead = Window.partitionBy("session_id", "source").orderBy("index").rangeBetween(1, within_calls)
    looked = F.collect_list(F.when(F.col("listing"), F.coalesce("input", F.lit("")))).over(ahead)
    rows = tools.withColumn("listing", listing).withColumn("looked", looked)
    path = json_field("input", "$.file_path")
    failed = rows.where("is_error").withColumn("path", path).where("path IS NOT NULL")
    if missing is not None:
        failed = failed.where(F.col("result").contains(missing))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*\z", 1)
    rank = (
        F.when((folder != "") & F.exists("looked", lambda x: x.contains(folder)), 1).when(F.size("looked") > 0, 2).otherwise(3)
    )
    judged = failed.select("session_id", "source", rank.alias("rank"))
    counts = scope.periods.join(judged, "session_id").groupBy("period", "rank").agg(F.count("*").alias("failures"), *spread())
    named = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(d).alias("recovery")) for i, d in enumerate(DISPOSITIONS)]))
    frame = scope.periods.select("period").distinct().select("period", named.alias("d")).select("period", "d.rank", "d.recovery")
    out = frame.join(counts, ["period", "rank"], "left").fillna(0, ["failures", "sessions", "threads"])
    return out.orderBy("period", "rank").select("period", "recovery", "failures", "sessions", "threads")
