"""Enrichment bookkeeping: what is stale, in which round, what to keep of answers.

The model that writes descriptions is a callable that the user brings; here are
the plans around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import model
from tracewell.operators import tree

STAMP = ("input_hash", "prompt_version", "taxonomy_version", "model")
#: Prices of an estimate: characters of a token, and tokens that every item costs besides.
CHARS_PER_TOKEN, INPUT_OVERHEAD, OUTPUT_TOKENS = 3.3, 700, 230
#: Shapes of credentials that answers are refused for, as the contract lists them.
SECRETS = (
    r"sk-[A-Za-z0-9_\-]{16,}",
    r"AKIA[0-9A-Z]{16}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"AIza[0-9A-Za-z_\-]{35}",
)


def elide(text: Column, limit: int, mark: str = " … ") -> Column:
    """A text within ``limit`` characters: its head and tail around a mark."""
    keep = limit - len(mark)
    head = (keep + 1) // 2
    short = F.concat(F.substring(text, 1, head), F.lit(mark), F.right(text, F.lit(keep - head)))
    return F.when(F.length(text) > limit, short).otherwise(text)


def turn_items(store, call_chars: int = 400, result_chars: int = 200) -> DataFrame:
    """A turn's prompt with its calls and their tools, as one text and its hash."""
    tools = store["live_tool_calls"].groupBy("session_id", "source", "api_call_id").agg(
        F.array_sort(F.collect_list(F.struct("index", "name", elide(F.coalesce("result", F.lit("")), result_chars).alias("said")))).alias("tools")
    )
    calls = store["live_api_calls"].withColumnRenamed("id", "api_call_id").join(tools, ["session_id", "source", "api_call_id"], "left")
    lines = F.array_join(F.transform("tools", lambda t: F.concat(F.lit("\n  "), t["name"], F.lit(": "), t["said"])), "")
    calls = calls.withColumn("line", F.concat(elide(F.col("text"), call_chars), F.coalesce(lines, F.lit(""))))
    said = calls.where("turn_id IS NOT NULL").groupBy("session_id", "source", "turn_id").agg(F.array_sort(F.collect_list(F.struct("index", "line"))).alias("calls"))
    turns = store["live_turns"].select("session_id", "source", F.col("id").alias("turn_id"), "prompt")
    body = F.array_join(F.transform("calls", lambda c: c["line"]), "\n")
    rows = turns.join(said, ["session_id", "source", "turn_id"], "left").join(command_results(store), ["session_id", "source", "turn_id"], "left")
    rows = rows.withColumn("body", F.concat_ws("\n", "prompt", "printed", body)).drop("calls", "prompt", "printed")
    return rows.withColumn("input_hash", F.sha2("body", 256))


_PRINTED = r"(?s)<local-command-stdout>(.*?)</local-command-stdout>"


def command_results(store) -> DataFrame:
    """``session_id, source, turn_id, printed``: what each command turn of a main thread printed, in the order of lines.

    The text stands in a record that answers the turn, in its message or in the
    record itself. A record that names the tag and has it in neither raises.
    """
    told = store["raw_records"].where(F.col("raw").contains("<local-command-stdout>"))
    carrier = F.coalesce(F.get_json_object("raw", "$.message.content"), F.get_json_object("raw", "$.content"))
    told = told.select("session_id", "source", "line_no", F.get_json_object("raw", "$.parentUuid").alias("turn_id"), carrier.alias("carrier"))
    turns = store["live_turns"].where("source = 'main' AND command_name IS NOT NULL").select("session_id", "source", F.col("id").alias("turn_id"))
    told = told.join(turns, ["session_id", "source", "turn_id"])
    strange = F.raise_error(F.concat(F.lit("a command result of session "), "session_id", F.lit(" cannot be read, line "), F.col("line_no").cast("string"))).cast("string")
    text = F.when(F.coalesce(F.col("carrier").rlike(_PRINTED), F.lit(False)), F.regexp_extract("carrier", _PRINTED, 1)).otherwise(strange)
    parts = told.groupBy("session_id", "source", "turn_id").agg(F.array_sort(F.collect_list(F.struct("line_no", text.alias("text")))).alias("parts"))
    return parts.select("session_id", "source", "turn_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("printed"))


def run_sections(store) -> DataFrame:
    """``session_id, run_id, section, turn_id, calls``: a run's parts in order, each with the ids of its calls.

    Section 0 is work on a conversation that another transcript opened: the
    run's calls that belong to no turn of its own. The others are its turns.
    """
    turns = store["live_turns"].where("source <> 'main'").select("session_id", "source", F.col("id").alias("turn_id"), (F.col("index") + 1).alias("place"))
    calls = store["live_api_calls"].where("source <> 'main'").select("session_id", "source", "turn_id", "index", "id")
    both = calls.join(turns, ["session_id", "source", "turn_id"], "left").withColumn("turn_id", F.when(F.col("place").isNotNull(), F.col("turn_id")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("index", "id"))), lambda c: c["id"])
    held = both.groupBy("session_id", "source", F.coalesce("place", F.lit(0)).alias("place"), "turn_id").agg(ordered.alias("calls"))
    empty = turns.join(held.where("turn_id IS NOT NULL").select("session_id", "source", "turn_id"), ["session_id", "source", "turn_id"], "left_anti")
    rows = held.unionByName(empty.withColumn("calls", F.array().cast("array<string>")))
    return rows.select("session_id", F.col("source").alias("run_id"), F.col("place").cast("long").alias("section"), "turn_id", "calls")


def run_items(store, call_chars: int = 400) -> DataFrame:
    """``session_id, run_id, body, input_hash``: each run's sections as one text, a turn's prompt before its calls."""
    text = store["live_api_calls"].select("session_id", F.col("source").alias("run_id"), F.col("id").alias("call"), elide(F.col("text"), call_chars).alias("said"))
    parts = run_sections(store).select("session_id", "run_id", "section", "turn_id", F.posexplode_outer("calls").alias("at", "call"))
    parts = parts.join(text, ["session_id", "run_id", "call"], "left")
    said = F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda c: c["said"])
    parts = parts.groupBy("session_id", "run_id", "section", "turn_id").agg(F.array_join(said, "\n").alias("said"))
    prompts = store["live_turns"].select("session_id", F.col("source").alias("run_id"), F.col("id").alias("turn_id"), "prompt")
    parts = parts.join(prompts, ["session_id", "run_id", "turn_id"], "left").withColumn("part", F.concat_ws("\n", F.coalesce("prompt", F.lit("(continued)")), "said"))
    whole = parts.groupBy("session_id", "run_id").agg(F.array_sort(F.collect_list(F.struct("section", "part"))).alias("parts"))
    runs = store["live_agent_runs"].select("session_id", F.col("id").alias("run_id"), "agent_type")
    body = F.concat_ws("\n", "agent_type", F.array_join(F.transform("parts", lambda p: p["part"]), "\n"))
    return runs.join(whole, ["session_id", "run_id"], "left").select("session_id", "run_id", body.alias("body")).withColumn("input_hash", F.sha2("body", 256))


def session_items(store) -> DataFrame:
    """``session_id, body, input_hash``: each describable session's title, totals and what its turns and runs were described as."""
    rolled = store.session_rollups.where("(turns > 0 OR agent_runs > 0) AND api_calls > 0")
    turns = store.enriched("turn").where("source = 'main'").select("session_id", F.lit(0).alias("kind"), F.col("index").alias("place"), "id", "description")
    runs = store.enriched("agent_run").select("session_id", F.lit(1).alias("kind"), F.lit(0).alias("place"), "id", "description")
    told = turns.unionByName(runs).where("description IS NOT NULL").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("kind", "place", "id", "description"))).alias("parts"))
    facts = F.concat_ws(" ", F.coalesce("title", F.lit("")), *[F.col(c).cast("string") for c in ("wall_ms", "active_ms", "input_tokens", "output_tokens")])
    body = F.concat_ws("\n", facts, F.array_join(F.transform("parts", lambda p: p["description"]), "\n"))
    return rolled.join(told, "session_id", "left").select("session_id", body.alias("body")).withColumn("input_hash", F.sha2("body", 256))


def planned(stale_runs: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """``session_id, run_id``: stale runs and all above them, whose texts hold their descriptions; the first ``limit`` by key."""
    above = tree.ancestry(edges).join(stale_runs.select("session_id", "run_id"), ["session_id", "run_id"], "left_semi")
    out = stale_runs.select("session_id", "run_id").unionByName(above.select("session_id", F.col("ancestor").alias("run_id"))).distinct()
    return out if limit is None else out.orderBy("session_id", "run_id").limit(limit)


def sendable(stale_runs: DataFrame, failed: DataFrame, edges: DataFrame) -> DataFrame:
    """Stale runs but for those above a failed one: described now, they would keep the hole that it left."""
    above = tree.ancestry(edges).join(failed.select("session_id", "run_id"), ["session_id", "run_id"], "left_semi")
    blocked = above.select("session_id", F.col("ancestor").alias("run_id")).distinct()
    return stale_runs.join(blocked, ["session_id", "run_id"], "left_anti")


def stale(items: DataFrame, held: DataFrame, keys: list[str], prompt_version: str, tagger: str, taxonomy_version: str = model.TAXONOMY_VERSION) -> DataFrame:
    """Items whose held description has another stamp, or that have none."""
    wanted = items.withColumns({"prompt_version": F.lit(prompt_version), "taxonomy_version": F.lit(taxonomy_version), "model": F.lit(tagger)})
    return wanted.join(held.select(*keys, *STAMP), [*keys, *STAMP], "left_anti")


def upsert(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``held`` with ``new`` rows in place of those of the same key; of several new ones the latest."""
    both = held.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    latest = Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc_nulls_last("enriched_at"))
    return both.withColumn("__rank", F.row_number().over(latest)).where("__rank = 1").drop("__new", "__rank")


def sweep(held: DataFrame, base: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose item still exists, rows that go)."""
    there = base.select(*keys).distinct()
    return held.join(there, keys, "left_semi"), held.join(there, keys, "left_anti")


def reconciled(asked: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Problems of a round's answers: keys that are unknown, missing or repeated."""
    n = answers.groupBy(*keys).agg(F.count("*").alias("answers"))
    both = asked.select(*keys, F.lit(True).alias("asked")).join(n, keys, "full")
    problem = F.when(F.col("asked").isNull(), "unknown").when(F.col("answers").isNull(), "missing").when(F.col("answers") > 1, "repeated")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").drop("asked")


def invalid(answers: DataFrame) -> DataFrame:
    """Answers without a description, that repeat something secret, or outside the taxonomy; the first reason counts."""
    shape = "|".join(SECRETS)
    leak = F.coalesce(F.col("description").rlike(shape), F.lit(False)) | F.coalesce(F.col("friction").rlike(shape), F.lit(False))
    reason = (
        F.when(F.coalesce(F.trim("description"), F.lit("")) == "", "no description")
        .when(leak, "secret")
        .when(~F.coalesce(F.col("category").isin(model.CATEGORIES), F.lit(False)), "category")
        .when(~F.coalesce(F.col("outcome").isin(model.OUTCOMES), F.lit(False)), "outcome")
    )
    return answers.withColumn("reason", reason).where("reason IS NOT NULL")


def estimate(items: DataFrame) -> DataFrame:
    """Tokens that describing ``items`` will take."""
    tokens = F.ceil(F.length("body") / CHARS_PER_TOKEN) + INPUT_OVERHEAD
    return items.agg(
        F.count("*").alias("items"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("input_tokens"),
        (F.count("*") * OUTPUT_TOKENS).alias("output_tokens"),
    )


def stale_tags(rows: DataFrame, prompt_version: str, taxonomy_version: str = model.TAXONOMY_VERSION) -> DataFrame:
    """Add ``tag_stale``: described under another prompt or taxonomy."""
    other = (F.col("prompt_version") != prompt_version) | (F.col("taxonomy_version") != taxonomy_version)
    return rows.withColumn("tag_stale", F.coalesce(other, F.lit(False)))
