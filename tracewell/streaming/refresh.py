"""Streams over growing transcripts: refresh by session, and silences as they happen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracewell.functions.lineage import cut
from tracewell.sources import transcripts
from tracewell.storage import Folder, StoredStore, load_version, replace_sessions

_FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def refresh(spark: SparkSession, root: str, path: str) -> int:
    """Extract the sessions below ``root`` that the store at ``path`` lacks or holds otherwise, and put them in place of what it has.

    Sessions whose files are gone keep their rows. Returns how many were extracted.
    """
    if load_version(Folder(spark, path)) is not None:
        todo = transcripts.changed(spark, root, StoredStore.read(spark, path)["extract_state"])
    else:
        todo = transcripts.fingerprints(transcripts.files(spark, root))
    todo = cut(todo.select("session_id"))
    n = todo.count()
    if n:
        replace_sessions(spark, path, transcripts.extract(spark, root, todo), todo)
    return n


def watch(spark: SparkSession, root: str, path: str, checkpoint: str) -> StreamingQuery:
    """Refresh the sessions whose files arrive; a batch replaces whole sessions."""
    arrived = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(root).select("path")
    session = F.coalesce(
        F.nullif(F.regexp_extract("path", r"([^/]+)/(?:subagents|tool-results|workflows)/", 1), F.lit("")),
        F.regexp_extract("path", r"([^/]+)\.jsonl\z", 1),
    )

    def apply(batch: DataFrame, _: int) -> None:
        todo = cut(batch.select(session.alias("session_id")).where("session_id <> ''").distinct())
        if not todo.isEmpty():
            here = batch.sparkSession
            replace_sessions(here, path, transcripts.extract(here, root, todo), todo)

    return arrived.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def busy_spells(calls: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Spells of work of each thread between silences of ``gap``; runs on batches and on streams.

    Late calls are taken up to ``late``; a spell is final once the watermark has
    passed it.
    """
    timed = calls.withWatermark("started_at", late)
    spell = F.session_window("started_at", gap)
    out = timed.groupBy("session_id", "source", spell).agg(F.count("*").alias("calls"), F.sum("output_tokens").alias("output_tokens"))
    return out.select("session_id", "source", F.col("session_window.start").alias("first_at"), F.col("session_window.end").alias("silent_at"), "calls", "output_tokens")
