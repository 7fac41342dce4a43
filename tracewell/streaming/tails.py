"""Growing transcripts: what was appended is read and parsed, the rest is remembered.

Beside a store lies what its transcripts have said so far: their parsed lines,
and for each file how many bytes those lines take (``consumed``) and a checksum
of the bytes just before. A refresh lists the files, opens those that changed at
the first byte not consumed, and parses what follows. A last line without its
line feed counts, if it can be read, but is not consumed: it may be half of what
it will be. A file that became shorter, or whose bytes before the tail are not
what they were, was rewritten and is read anew.

The tables of a changed session are made of its remembered and its new lines,
and replace what the store holds; then the tail is remembered. If a refresh
breaks off in between, the next one does the same again.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell import model
from tracewell.functions.lineage import cut
from tracewell.sources import transcripts
from tracewell.storage import Folder, replace_sessions, versions

#: A file's new bytes are dealt out in ranges of so many; so many bytes before them tell whether the file is the one that was.
RANGE, GUARD, BLOCK = 64 << 20, 64, 1 << 20

_ENDS = model.schema("path string, life string, consumed long, length long, modified timestamp, guard long, seen long")
_READ = "path string, life string, split long, at long, line binary, stop long, guard long, bytes long"


def lines_of(stream, begin: int, start: int, stop: int) -> Iterator[tuple[int, bytes, bool]]:
    """``(end, line, whether its line feed is there)`` of lines that begin in ``[start, stop)`` of a file; ``begin`` is where lines begin at all."""
    at = start if start == begin else start - 1
    stream.seek(at)
    held, skip = b"", start != begin
    while True:
        block = stream.read(BLOCK)
        held += block
        *whole, held = held.split(b"\n")
        for line in whole:
            begun, at = at, at + len(line) + 1
            if skip:
                skip = False
            elif begun >= stop:
                return
            else:
                yield at, line, True
        if not block:
            if held and not skip and at < stop:
                yield at + len(held), held, False
            return
        if at >= stop and not skip:
            return


def read_ranges(ranges: DataFrame) -> DataFrame:
    """The lines of ``ranges`` (``path, life, begin, start, stop``), and for each a row of where its last whole line ends.

    That row has the checksum of the ``GUARD`` bytes before ``begin`` and how
    many bytes the range holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "life", "split", "at", "line", "stop", "guard", "bytes"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for r in batch.to_pylist():
                # Hadoop writes a local path with one slash.
                uri = r["path"].replace("file:/", "file:///", 1) if r["path"].startswith("file:/") and not r["path"].startswith("file:///") else r["path"]
                system, place = (pa.fs.LocalFileSystem(), uri.removeprefix("file://")) if uri.startswith("file://") else pa.fs.FileSystem.from_uri(uri)
                rows, end, size, held = [], r["start"] if r["start"] == r["begin"] else -1, 0, 0
                with system.open_input_file(place) as f:
                    before = f.read_at(min(GUARD, r["begin"]), max(r["begin"] - GUARD, 0))
                    for k, (over, line, closed) in enumerate(lines_of(f, r["begin"], r["start"], r["stop"])):
                        end, size, held = over if closed else end, size + len(line) + closed, held + len(line)
                        rows.append((r["path"], r["life"], r["start"], k, line, None if closed else -1, None, None))
                        if held > BLOCK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                rows.append((r["path"], r["life"], r["start"], -1, None, end, zlib.crc32(before), size))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return ranges.mapInArrow(run, _READ)


def guards(ends: DataFrame) -> DataFrame:
    """``path, life, guard`` of files read up to ``consumed``: the checksum of the bytes before."""
    none = ends.select("path", "life", F.col("consumed").alias("begin"), F.col("consumed").alias("start"), F.col("consumed").alias("stop"))
    return read_ranges(none).where("line IS NULL").select("path", "life", "guard")


class Tails:
    """What is remembered of the transcripts below ``root`` for the store at ``path``."""

    def __init__(self, spark: SparkSession, root: str, path: str):
        self.spark, self.root, self.path = spark, root, path
        self.folder = Folder(spark, f"{path}/tails")
        held = versions(self.folder)
        self.number = held[-1] if held else 0
        self.loads = json.loads(self.folder.read(f"versions/{self.number:012d}.json")) if held else []

    def _table(self, name: str, schema) -> DataFrame:
        paths = [f"{self.path}/tails/{name}/{x}" for x in self.loads]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ends(self) -> DataFrame:
        """The newest row of each file."""
        newest = self._table("ends", _ENDS).groupBy("path").agg(F.max_by(F.struct(*_ENDS.names[1:]), "seen").alias("e"))
        return newest.select("path", "e.*")

    def lines(self, schema) -> DataFrame:
        """The remembered lines of all files as they are now."""
        return self._table("lines", schema).join(self.ends().select("path", "life"), ["path", "life"], "left_semi")

    def refresh(self) -> dict[str, int]:
        """Bring the store up to date; how many ``sessions`` were replaced, ``files`` opened, and ``bytes`` of lines read."""
        spark = self.spark
        listed = transcripts.files(spark, self.root)
        now = listed.select("path", "session_id", "role", "length", F.col("modificationTime").alias("modified"))
        told = self.ends().select("path", "life", "consumed", "guard", "seen", F.col("length").alias("had"), F.col("modified").alias("was"))
        changed = cut(now.join(told, "path", "left").where("had IS NULL OR had <> length OR was <> modified"))
        sessions = cut(changed.select("session_id").distinct())
        count = sessions.count()
        if not count:
            return {"sessions": 0, "files": 0, "bytes": 0}
        moved = changed.where(transcripts.TRANSCRIPTS)
        # A file goes on in its life only if it has the bytes that were read last; else it has a new one.
        able = moved.where("life IS NOT NULL AND length >= consumed")
        same = guards(able.select("path", "life", "consumed")).join(able.select("path", "life", F.col("guard").alias("held")), ["path", "life"]).where("guard = held").select("path", F.lit(True).alias("goes_on"))
        fresh = F.col("goes_on").isNull()
        name, seen = uuid.uuid4().hex, self.number + 1
        begun = cut(
            moved.join(same, "path", "left").select(
                "path", "session_id", "length", "modified", F.when(fresh, F.lit(name)).otherwise(F.col("life")).alias("life"), F.when(fresh, F.lit(0)).otherwise(F.col("consumed")).cast("long").alias("begin")
            )
        )
        starts = F.sequence("begin", F.greatest(F.col("begin"), F.col("length") - 1), F.lit(RANGE).cast("long"))
        ranges = begun.select("path", "life", "begin", "length", F.explode(starts).alias("start"))
        ranges = ranges.select("path", "life", "begin", "start", F.least(F.col("start") + RANGE, F.col("length")).alias("stop"))
        read = cut(read_ranges(ranges.repartition(F.col("path"), F.col("start"))))
        new = read.where("line IS NOT NULL").select("path", "life", "split", "at", F.decode("line", "UTF-8").alias("raw"), (F.col("stop").isNull()).alias("closed"))
        new = transcripts.placed(new).where(transcripts.TRANSCRIPTS).drop("workflow_id", "name")
        new = cut(transcripts.parsed(new))
        kept = [f for f in new.schema.fields if f.name != "closed"]
        schema = type(new.schema)(kept)
        ends = read.where("line IS NULL").groupBy("path").agg(F.max("stop").alias("consumed"), F.sum("bytes").alias("bytes"))
        ends = begun.join(ends, "path").withColumn("consumed", F.greatest("consumed", "begin"))
        found = listed.join(sessions, "session_id", "left_semi")

        mine = self._table("lines", schema).join(sessions, "session_id", "left_semi").join(self._lives(begun), ["path", "life"], "left_semi")
        tables = transcripts.tables_of(found, cut(mine.unionByName(new.select(*mine.columns))))
        replace_sessions(spark, self.path, tables, sessions)
        new.where("closed").select(*mine.columns).write.parquet(f"{self.path}/tails/lines/{name}")
        self._remember(name, seen, ends, changed)
        bytes_ = read.where("line IS NULL").agg(F.sum("bytes"), F.count_distinct("path")).first()
        return {"sessions": count, "files": bytes_[1] or 0, "bytes": bytes_[0] or 0}

    def _lives(self, begun: DataFrame) -> DataFrame:
        """``path, life`` of all files, those just opened as they are now."""
        old = self.ends().select("path", "life").join(begun.select("path"), "path", "left_anti")
        return old.unionByName(begun.select("path", "life"))

    def _remember(self, name: str, seen: int, ends: DataFrame, changed: DataFrame) -> None:
        spark = self.spark
        told = ends.select("path", "life", "consumed", "length", "modified")
        marks = guards(told.select("path", "life", "consumed"))
        rows = told.join(marks, ["path", "life"]).withColumn("seen", F.lit(seen).cast("long"))
        # Files that are no transcripts are only known by length and time.
        others = changed.where(~F.expr(transcripts.TRANSCRIPTS)).select("path", F.lit("").alias("life"), F.lit(0).cast("long").alias("consumed"), "length", "modified", F.lit(0).cast("long").alias("guard"), F.lit(seen).cast("long").alias("seen"))
        rows.select(*_ENDS.names).unionByName(others.select(*_ENDS.names)).write.parquet(f"{self.path}/tails/ends/{name}")
        if not self.folder.claim(f"versions/{seen:012d}.json", json.dumps([*self.loads, name])):
            raise RuntimeError(f"another refresh of {self.path} came first; this one's rows are in the store, and are read again by the next")
        self.loads, self.number = [*self.loads, name], seen


def refresh_tails(spark: SparkSession, root: str, path: str) -> dict[str, int]:
    """Bring the store at ``path`` up to date with what the transcripts below ``root`` have grown by."""
    return Tails(spark, root, path).refresh()


def follow(spark: SparkSession, root: str, path: str, checkpoint: str, every: str = "1 minute") -> StreamingQuery:
    """Refresh by tails, again and again, until the query is stopped; a refresh that failed ends it."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, _: refresh_tails(batch.sparkSession, root, path) and None).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
