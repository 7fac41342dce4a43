"""The trace store and the relations that define what counts.

``live_*`` leaves out what a fork replayed; ``corpus_*`` also leaves out what an
earlier session already holds, and is what questions across sessions read. Each
rollup is one aggregation per table, joined on the session.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import model
from tracewell.functions.text import millis_between

REPLAYABLE = ("turns", "api_calls", "tool_calls")
COUNTED = (*REPLAYABLE, "agent_runs", "compactions")


def live_rows(rows: DataFrame, table: str) -> DataFrame:
    """Rows that no fork replayed."""
    return rows.where(~F.col("replayed")) if table in REPLAYABLE else rows


class Store:
    """Tables of the trace model by name, and relations derived from them."""

    def __init__(self, tables: Mapping[str, DataFrame], derived: Mapping[str, DataFrame] | None = None):
        self.tables = dict(tables)
        self.derived = dict(derived or {})
        self.spark: SparkSession = next(iter(self.tables.values())).sparkSession
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if name in self.derived:
            return self.derived[name]
        family, _, table = name.partition("_")
        if family == "live" and table in COUNTED:
            return self.live(table)
        if family == "corpus" and table in COUNTED:
            return self.corpus(table)
        raise KeyError(name)

    def live(self, table: str) -> DataFrame:
        return live_rows(self.tables[table], table)

    def corpus(self, table: str) -> DataFrame:
        """Rows of the earliest session that holds their id, by start and then by session."""
        rows = self.live(table)
        started = self.tables["sessions"].select(F.col("id").alias("session_id"), F.col("started_at").alias("__start"))
        rank = F.struct(F.col("__start").isNull().alias("undated"), F.col("__start").alias("start"), F.col("session_id").alias("sid"))
        ranked = rows.join(started, "session_id").withColumn("__rank", rank)
        ranked = ranked.withColumn("__owner", F.min("__rank").over(Window.partitionBy("id")))
        return ranked.where("__rank = __owner").select(*rows.columns)

    def rollups(self, family: str) -> DataFrame:
        """One row for each session with counts and sums of ``family``'s rows, zero where it has none."""
        calls = self[f"{family}_api_calls"].groupBy("session_id").agg(
            F.count("*").alias("api_calls"),
            *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cost_usd")],
            F.count_if(F.col("cost_usd").isNull()).alias("unpriced_api_calls"),
        )
        out = self.tables["sessions"].select(
            F.col("id").alias("session_id"),
            "project_dir",
            "title",
            "started_at",
            "ended_at",
            millis_between("started_at", "ended_at").alias("wall_ms"),
            "active_ms",
        )
        for table in ("turns", "tool_calls", "agent_runs", "compactions"):
            counts = self[f"{family}_{table}"].groupBy("session_id").agg(F.count("*").alias(table))
            out = out.join(counts, "session_id", "left")
        out = out.join(calls, "session_id", "left")
        return out.fillna(0, ["turns", "tool_calls", "agent_runs", "compactions", *calls.columns[1:]])

    @cached_property
    def session_rollups(self) -> DataFrame:
        return self.derived["session_rollups"] if "session_rollups" in self.derived else self.rollups("live")

    @cached_property
    def corpus_rollups(self) -> DataFrame:
        return self.derived["corpus_rollups"] if "corpus_rollups" in self.derived else self.rollups("corpus")

    def enriched(self, level: str) -> DataFrame:
        """Rows of a level with what enrichment says of them, if anything."""
        tags = ["description", "category", "outcome", "friction", "prompt_version", "taxonomy_version", "enriched_at"]
        if level == "turn":
            base, keys = self.live("turns"), {"session_id": "session_id", "source": "source", "turn_id": "id"}
        elif level == "agent_run":
            base, keys = self.live("agent_runs").drop("description", "model"), {"session_id": "session_id", "agent_run_id": "id"}
        else:
            base, keys = self.session_rollups, {"session_id": "session_id"}
        told = self.tables[f"{level}_enrichments"].select(
            *[F.col(k).alias(v) for k, v in keys.items()], *tags, F.col("model").alias("enrichment_model")
        )
        return base.join(told, list(keys.values()), "left")

    def narrowed(self, session_id: str) -> Store:
        """A store that need hold no other session; a written one reads no other's files."""
        return self

    def duplicate_keys(self, table: str) -> DataFrame:
        """Keys that ``table`` holds more than once: none in a sound store."""
        return self.tables[table].groupBy(*model.KEYS[table]).count().where("count > 1")


class Scope:
    """The sessions of a project, and the two periods that corpus counts are given for."""

    def __init__(self, store: Store, project: str, as_of: str, window_days: int = 28, since: str | None = None):
        self.store = store
        sessions = store["sessions"]
        inside = (F.col("project_dir") == project) | F.col("project_dir").startswith(f"{project}/")
        if since is not None:
            inside &= F.col("started_at") >= F.to_date(F.lit(since))
        recent = (F.col("started_at") >= F.date_sub(F.to_date(F.lit(as_of)), window_days)) & (
            F.col("started_at") < F.date_add(F.to_date(F.lit(as_of)), 1)
        )
        self.sessions = sessions.where(inside).select(
            F.col("id").alias("session_id"), "started_at", F.coalesce(recent, F.lit(False)).alias("in_window")
        )

    @property
    def periods(self) -> DataFrame:
        """A row for each session and period; windows over calls are taken before this fans out."""
        both = F.when(F.col("in_window"), F.array(F.lit("corpus"), F.lit("trailing_window"))).otherwise(F.array(F.lit("corpus")))
        return self.sessions.select("session_id", F.explode(both).alias("period"))

    @property
    def in_window(self) -> DataFrame:
        return self.sessions.where("in_window").select("session_id")
