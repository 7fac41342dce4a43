"""The trace store on disk: loads of Parquet files, and numbered versions that say which loads count.

A load is one writing of whole sessions. The first load of a version holds the
store as it was last written whole; each later one replaces the sessions that it
covers. Rows lie below ``<table>/load=<name>/bucket=<n>/``, by a hash of the
session and sorted by session and key: a question about one session lists and
reads the files of one bucket, and of those the pages that hold the session.

What decides which session owns a row that several hold is kept, not derived at
each reading: ``ids`` has a row for every id and session that holds it, by a
hash of the id; each row of a first load knows whether its session owns it; a
later load says of which rows that changed (``rulings``). So replacing a session
looks up the ids that it held or holds, and writes rollups of the sessions whose
ownership moved, and of no others.

A version is a small file with the next number, which only one writer can make.
Whoever comes second reads the version that got there first, rules again on top
of it, and tries the next number. A reader keeps the version that it opened.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import model
from tracewell.relations import COUNTED, Store, live_rows

#: Buckets of sessions and slots of ids that a new store is given.
BUCKETS, SLOTS = 16, 16
#: Small pages, whose least and greatest session tell a reader which to skip.
PAGE_BYTES = 64 * 1024
#: So many folders are named one by one, more are left to partition pruning.
LISTED = 256
#: Tables of a load that are written at one time.
AT_ONCE = 4

_IDS = model.schema("kind string, id string, session_id string, start timestamp")
_RULINGS = model.schema("kind string, session_id string, id string, owned boolean")
_COVERAGE = model.schema("kind string, session_id string")
ROWS, CORPUS = "rows", "corpus_rollups"
_LOAD = [T.StructField("load", T.StringType()), T.StructField("bucket", T.IntegerType())]


class Folder:
    """The file system calls that the store needs, on whatever Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(name))] if self.exists(name) else []

    def age(self, name: str) -> float:
        """Seconds since a file or folder was changed."""
        return time.time() - self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def claim(self, name: str, text: str) -> bool:
        """Make a file with this text, whole, unless there is one of its name; whether it was made.

        On a local disk a hard link decides, elsewhere a rename, which HDFS
        refuses where the target exists.
        """
        self.fs.mkdirs(self._path(name).getParent())
        draft = self._path(f"drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                to_file = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    self.jvm.java.nio.file.Files.createLink(to_file(self._path(name)), to_file(draft))
                except Exception as error:
                    if "FileAlreadyExistsException" in str(error):
                        return False
                    raise
                return True
            return not self.exists(name) and self.fs.rename(draft, self._path(name))
        finally:
            self.fs.delete(draft, False)


@dataclass(frozen=True)
class Version:
    """Which loads count, oldest first: of each the name of its rows, and of what was ruled and rolled up for them."""

    number: int
    loads: tuple[tuple[str, str], ...]
    buckets: int = BUCKETS
    slots: int = SLOTS
    schema: int = model.SCHEMA_VERSION

    @property
    def file(self) -> str:
        return f"versions/{self.number:012d}.json"

    def text(self) -> str:
        return json.dumps({"schema": self.schema, "buckets": self.buckets, "slots": self.slots, "loads": self.loads})


def versions(folder: Folder) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in folder.names("versions") if n.endswith(".json"))


def load_version(folder: Folder, number: int | None = None) -> Version | None:
    """A version by number, or the newest; None where there is no store. One of another schema is refused."""
    held = versions(folder)
    if not held:
        return None
    if number is not None and number not in held:
        raise ValueError(f"the store at {folder.path} has no version {number}")
    at = held[-1] if number is None else number
    told = json.loads(folder.read(f"versions/{at:012d}.json"))
    if told["schema"] != model.SCHEMA_VERSION:
        raise ValueError(f"the store at {folder.path} has schema version {told['schema']}, this library {model.SCHEMA_VERSION}")
    return Version(at, tuple(map(tuple, told["loads"])), told["buckets"], told["slots"])


def bucket_of(column: str, buckets: int) -> F.Column:
    return (F.crc32(F.coalesce(F.col(column), F.lit(""))) % buckets).cast("int")


def bucket_number(session_id: str, buckets: int) -> int:
    return zlib.crc32(session_id.encode()) % buckets


def session_column(table: str) -> str:
    return "id" if table == "sessions" else "session_id"


class _Tables(Mapping):
    """The tables of a stored store, each planned when it is asked for."""

    def __init__(self, store: StoredStore):
        self.store, self.held = store, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in model.TABLES and name not in model.ENRICHMENTS:
            raise KeyError(name)
        if name not in self.held:
            self.held[name] = self.store.rows(name).select(*(model.TABLES | model.ENRICHMENTS)[name].names)
        return self.held[name]

    def __iter__(self) -> Iterator[str]:
        return iter(model.TABLES | model.ENRICHMENTS)

    def __len__(self) -> int:
        return len(model.TABLES | model.ENRICHMENTS)


class StoredStore(Store):
    """One version of a written store; of one session if ``session_id`` is given."""

    def __init__(self, spark: SparkSession, path: str, version: Version, session_id: str | None = None, only: DataFrame | None = None, buckets: list[int] | None = None):
        self.spark, self.path, self.version = spark, path, version
        self.folder = Folder(spark, path)
        self.session_id, self.only, self.buckets = session_id, only, buckets
        if session_id is not None:
            self.buckets = [bucket_number(session_id, version.buckets)]
        self.tables, self.derived = _Tables(self), {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    @classmethod
    def read(cls, spark: SparkSession, path: str, number: int | None = None) -> StoredStore:
        version = load_version(Folder(spark, path), number)
        if version is None:
            raise ValueError(f"there is no store at {path}")
        return cls(spark, path, version)

    def narrowed(self, session_id: str) -> StoredStore:
        return StoredStore(self.spark, self.path, self.version, session_id)

    def restricted(self, sessions: DataFrame, buckets: list[int]) -> StoredStore:
        """The rows of ``sessions``, which lie in ``buckets``."""
        return StoredStore(self.spark, self.path, self.version, only=sessions.select(F.col("session_id").alias("__only")), buckets=buckets)

    # --- scans

    def files(self, name: str, schema: T.StructType, loads: list[str], buckets: list[int] | None = None, by: str = "bucket") -> DataFrame:
        """Rows of a table in ``loads`` with their ``load``; of ``buckets`` only those that exist are listed."""
        whole = T.StructType([*schema.fields, _LOAD[0], T.StructField(by, T.IntegerType())])
        folders = [f"{name}/load={x}" for x in loads]
        folders = [f for f in folders if self.folder.exists(f)]
        if buckets is not None and len(folders) * len(buckets) <= LISTED:
            folders = [f"{f}/{by}={b}" for f in folders for b in buckets]
            folders = [f for f in folders if self.folder.exists(f)]
        if not folders:
            return self.spark.createDataFrame([], whole)
        rows = self.spark.read.schema(whole).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{f}" for f in folders])
        return rows if buckets is None else rows.where(F.col(by).isin(buckets))

    def _mine(self, rows: DataFrame, column: str) -> DataFrame:
        if self.session_id is not None:
            return rows.where(F.col(column) == self.session_id)
        if self.only is not None:
            return rows.join(self.only, rows[column] == F.col("__only"), "left_semi")
        return rows

    def order(self) -> F.Column:
        """The place of a row's load among those of this version; a load is named twice, by its rows and by what was ruled for it."""
        places = {name: i for i, pair in enumerate(self.version.loads) for name in pair}
        return F.element_at(F.create_map(*[F.lit(x) for pair in places.items() for x in pair]), F.col("load"))

    @cached_property
    def _one(self) -> dict[str, int]:
        """The place of the load that counts for the session of a narrowed store, of its rows and of its corpus rollups."""
        if len(self.version.loads) == 1:
            return {ROWS: 0, CORPUS: 0}
        told = self._mine(self.files("coverage", _COVERAGE, [d for _, d in self.version.loads[1:]], self.buckets), "session_id")
        found = {r["kind"]: r["place"] for r in told.groupBy("kind").agg(F.max(self.order()).alias("place")).collect()}
        return {ROWS: 0, CORPUS: 0} | found

    def newest(self, kind: str) -> DataFrame:
        """For each session that a later load covers, the place of the newest such load."""
        told = self._mine(self.files("coverage", _COVERAGE, [d for _, d in self.version.loads[1:]], self.buckets), "session_id")
        return told.where(F.col("kind") == kind).groupBy(F.col("session_id").alias("__session")).agg(F.max(self.order()).alias("__newest"))

    def counting(self, name: str, schema: T.StructType, kind: str = ROWS, column: str = "session_id", buckets: list[int] | None = None, by: str = "bucket") -> DataFrame:
        """Rows of a table in the newest load that covers their session, with their ``load``."""
        part = 0 if kind == ROWS and name not in ("session_rollups",) else 1
        loads = [pair[part] for pair in self.version.loads]
        if self.session_id is not None:
            loads = [loads[self._one[kind]]]
        rows = self._mine(self.files(name, schema, loads, buckets if buckets is not None else self.buckets, by), column)
        if len(loads) == 1:
            return rows
        rows = rows.join(self.newest(kind), rows[column] == F.col("__session"), "left")
        return rows.where(self.order() == F.coalesce("__newest", F.lit(0))).drop("__session", "__newest")

    def rows(self, name: str) -> DataFrame:
        if name in model.ENRICHMENTS:
            return self._mine(self.files(name, model.ENRICHMENTS[name], [self.version.loads[0][0]], self.buckets), "session_id")
        return self.counting(name, model.TABLES[name], column=session_column(name))

    # --- what is derived

    def corpus(self, table: str) -> DataFrame:
        """Rows of the sessions that own them: as the first load has it, unless a later one has ruled otherwise."""
        schema = model.TABLES[table]
        rows = live_rows(self.counting(table, T.StructType([*schema.fields, T.StructField("owned", T.BooleanType())])), table)
        if len(self.version.loads) == 1:
            return rows.where("owned").select(*schema.names)
        told = self.rulings(table).withColumnsRenamed({"session_id": "__s", "id": "__i", "owned": "__owned"})
        both = rows.join(told, (rows["session_id"] == told["__s"]) & (rows["id"] == told["__i"]), "left")
        return both.where(F.when(F.col("__place") >= self.order(), F.col("__owned")).otherwise(F.col("owned"))).select(*schema.names)

    def rulings(self, table: str) -> DataFrame:
        """``session_id, id, owned``, and the place of the load that ruled so last."""
        loads = [d for _, d in self.version.loads[1:]]
        told = self._mine(self.files("rulings", _RULINGS, loads, self.buckets), "session_id").where(F.col("kind") == table)
        return told.groupBy("session_id", "id").agg(F.max_by("owned", self.order()).alias("owned"), F.max(self.order()).alias("__place"))

    def holders(self, slots: list[int] | None = None) -> DataFrame:
        """``kind, id, session_id, start`` of every session that holds a live row of an id."""
        return self.counting("ids", _IDS, buckets=slots, by="slot").select(*_IDS.names)

    @cached_property
    def session_rollups(self) -> DataFrame:
        return self.counting("session_rollups", model.ROLLUPS).select(*model.ROLLUPS.names)

    @cached_property
    def corpus_rollups(self) -> DataFrame:
        return self.counting("corpus_rollups", model.ROLLUPS, CORPUS).select(*model.ROLLUPS.names)

    # --- the loads

    def compact(self, keep: int = 1) -> StoredStore:
        """Write the version anew as one load; loads that others added meanwhile stay behind it."""
        name = uuid.uuid4().hex
        held = {n: self.rows(n) for n in model.TABLES | model.ENRICHMENTS}
        for table in COUNTED:
            held[table] = self._with_owned(table)
        loader = _Loader(self.spark, self.path, self.version, name)
        loader.rows(held)
        loader.put("ids", self.holders(), "slot", "id", ["kind", "id"])
        loader.put("session_rollups", self.session_rollups, "bucket", "session_id")
        loader.put("corpus_rollups", self.corpus_rollups, "bucket", "session_id")
        while True:
            now = load_version(self.folder)
            if now.loads[: len(self.version.loads)] != self.version.loads:
                raise RuntimeError(f"another compaction of {self.path} came first; vacuum removes what this one wrote")
            new = replace(now, number=now.number + 1, loads=((name, name), *now.loads[len(self.version.loads) :]))
            if self.folder.claim(new.file, new.text()):
                return StoredStore(self.spark, self.path, new)

    def _with_owned(self, table: str) -> DataFrame:
        """All rows of a table, also those that do not live, with ``owned``."""
        rows = self.counting(table, T.StructType([*model.TABLES[table].fields, T.StructField("owned", T.BooleanType())]))
        if len(self.version.loads) == 1:
            return rows
        told = self.rulings(table).withColumnsRenamed({"session_id": "__s", "id": "__i", "owned": "__owned"})
        both = rows.join(told, (rows["session_id"] == told["__s"]) & (rows["id"] == told["__i"]), "left")
        return both.withColumn("owned", F.when(F.col("__place") >= self.order(), F.col("__owned")).otherwise(F.col("owned")))


def together(jobs: list[Callable[[], None]]) -> None:
    """Run Spark jobs that do not wait for each other at one time; the first error is raised when all have ended."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


class _Loader:
    """Writes the parts of one load."""

    def __init__(self, spark: SparkSession, path: str, version: Version, name: str):
        self.spark, self.path, self.version, self.name = spark, path, version, name

    def put(self, table: str, rows: DataFrame, by: str, column: str, order: list[str] | None = None) -> None:
        """Rows by bucket or slot of a column, in as many files as their bytes ask for, sorted within each."""
        count = self.version.buckets if by == "bucket" else self.version.slots
        dealt = rows.withColumn(by, bucket_of(column, count)).hint("rebalance", F.col(by))
        dealt = dealt.sortWithinPartitions(by, *(order or [column]))
        writer = dealt.write.partitionBy(by).option("parquet.page.size", PAGE_BYTES)
        writer.parquet(f"{self.path}/{table}/load={self.name}")

    def rows(self, tables: Mapping[str, DataFrame]) -> None:
        def one(table: str) -> None:
            rows, schema = tables[table], (model.TABLES | model.ENRICHMENTS)[table]
            more = [F.col("owned")] if "owned" in rows.columns else [F.lit(True).alias("owned")] if table in COUNTED else []
            self.put(table, rows.select(*schema.names, *more), "bucket", session_column(table), list(model.KEYS[table]))

        together([lambda t=t: one(t) for t in tables])

    def ids(self, tables: Mapping[str, DataFrame]) -> None:
        """Which sessions hold which ids in live rows."""
        started = tables["sessions"].select(F.col("id").alias("session_id"), F.col("started_at").alias("start"))
        every = None
        for table in COUNTED:
            held = live_rows(tables[table], table).select(F.lit(table).alias("kind"), "id", "session_id").distinct()
            every = held if every is None else every.unionByName(held)
        self.put("ids", every.join(started, "session_id").select(*_IDS.names), "slot", "id", ["kind", "id"])


def rank() -> F.Column:
    """The order in which sessions have a claim to a row: by start, undated ones last, then by session."""
    return F.struct(F.col("start").isNull().alias("undated"), F.col("start"), F.col("session_id"))


def write_store(store: Store, path: str, buckets: int = BUCKETS, slots: int = SLOTS) -> StoredStore:
    """Write a store whole, as the first load of a new version.

    Readers of a version that was there keep it until ``vacuum``. Ids that
    several sessions hold are found in the narrow table of ids; the rows are
    joined with those alone, not ranked all.
    """
    spark = store.spark
    folder, name = Folder(spark, path), uuid.uuid4().hex
    old = load_version(folder)
    version = Version((old.number if old else 0) + 1, ((name, name),), buckets, slots)
    loader, made = _Loader(spark, path, version, name), StoredStore(spark, path, version)
    loader.ids(store.tables)
    claims = made.holders().groupBy("kind", "id").agg(F.min(rank()).alias("first"), F.count("*").alias("many"))
    claims = claims.where("many > 1").select("kind", F.col("id").alias("__id"), F.col("first.session_id").alias("__owner"))
    tables = dict(store.tables)
    for table in COUNTED:
        contested = claims.where(F.col("kind") == table).drop("kind")
        rows = tables[table].join(contested, F.col("id") == F.col("__id"), "left")
        tables[table] = rows.withColumn("owned", F.coalesce(F.col("__owner") == F.col("session_id"), F.lit(True)))
    loader.rows(tables)
    names = {"live": "session_rollups", "corpus": "corpus_rollups"}
    together([lambda f=f: loader.put(names[f], made.rollups(f), "bucket", "session_id") for f in names])
    while not folder.claim(version.file, version.text()):
        version = replace(version, number=load_version(folder).number + 1)
    return StoredStore(spark, path, version)


def distinct_numbers(rows: DataFrame, number: F.Column) -> list[int]:
    """The different buckets or slots of some rows: no more than there are of those."""
    return sorted(r[0] for r in rows.select(number).distinct().collect())


def replace_sessions(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], sessions: DataFrame) -> StoredStore:
    """Put ``tables`` in place of all rows of ``sessions`` (``session_id``), or begin a store with them.

    Rows are written first, then what they change in others' ownership and in
    rollups; the version that names both is made last. Until then, and if it
    breaks off, readers see what they saw before. Sessions without rows in
    ``tables`` are gone.
    """
    folder = Folder(spark, path)
    version = load_version(folder)
    if version is None:
        empty = {n: spark.createDataFrame([], s) for n, s in model.ENRICHMENTS.items()}
        whole = Store({n: tables.get(n, empty.get(n)) for n in [*model.TABLES, *model.ENRICHMENTS]})
        return write_store(whole, path)
    name = uuid.uuid4().hex
    loader = _Loader(spark, path, version, name)
    loader.rows({n: tables[n] for n in model.TABLES})
    loader.put("coverage", sessions.select(F.lit(ROWS).alias("kind"), "session_id").distinct(), "bucket", "session_id")
    alone = StoredStore(spark, path, replace(version, loads=((name, name),)))
    loader.ids(alone.tables)
    while True:
        before = StoredStore(spark, path, load_version(folder))
        ruled = uuid.uuid4().hex
        after = replace(before.version, number=before.version.number + 1, loads=(*before.version.loads, (name, ruled)))
        _rule(before, StoredStore(spark, path, after), alone, name, ruled)
        if folder.claim(after.file, after.text()):
            return StoredStore(spark, path, after)


def _rule(before: StoredStore, after: StoredStore, alone: StoredStore, name: str, ruled: str) -> None:
    """Write what the load ``name`` changes on top of ``before``: ownership, coverage and rollups."""
    spark, path, version = before.spark, before.path, before.version
    loader = _Loader(spark, path, version, ruled)
    covered = alone.files("coverage", _COVERAGE, [name]).select("session_id")
    here = distinct_numbers(covered, bucket_of("session_id", version.buckets))
    new = alone.holders().withColumn("part", F.lit("new"))
    old = before.restricted(covered, here)
    started = old.tables["sessions"].select(F.col("id").alias("session_id"), F.col("started_at").alias("start"))
    gone = None
    for table in COUNTED:
        held = live_rows(old.tables[table], table).select(F.lit(table).alias("kind"), "id", "session_id").distinct()
        gone = held if gone is None else gone.unionByName(held)
    gone = gone.join(started, "session_id").select(*_IDS.names).withColumn("part", F.lit("old"))
    touched = new.unionByName(gone).select("kind", "id").distinct()
    slots = distinct_numbers(touched, bucket_of("id", version.slots))
    others = before.holders(slots).join(touched, ["kind", "id"], "left_semi").join(covered, "session_id", "left_anti")
    claims = new.unionByName(gone).unionByName(others.withColumn("part", F.lit("other")))
    owner = claims.groupBy("kind", "id").agg(
        F.min(F.when(F.col("part") != "new", rank()))["session_id"].alias("was"), F.min(F.when(F.col("part") != "old", rank()))["session_id"].alias("now")
    )
    told = claims.where("part <> 'old'").join(owner, ["kind", "id"])
    owned = F.col("now") == F.col("session_id")
    # New rows are written as owned, others as they were ruled before.
    stood = F.when(F.col("part") == "new", F.lit(True)).otherwise(F.col("was") == F.col("session_id"))
    rulings = told.where(owned != stood).select("kind", "session_id", "id", owned.alias("owned"))
    loader.put("rulings", rulings, "bucket", "session_id", ["kind", "session_id", "id"])
    moved = after.files("rulings", _RULINGS, [ruled]).select("session_id").union(covered).distinct()
    coverage = covered.select(F.lit(ROWS).alias("kind"), "session_id").union(moved.select(F.lit(CORPUS).alias("kind"), "session_id"))
    loader.put("coverage", coverage, "bucket", "session_id", ["kind", "session_id"])
    there = distinct_numbers(moved, bucket_of("session_id", version.buckets))
    live, corpus = after.restricted(covered, here).rollups("live"), after.restricted(moved, there).rollups("corpus")
    together([lambda: loader.put("session_rollups", live, "bucket", "session_id"), lambda: loader.put("corpus_rollups", corpus, "bucket", "session_id")])


def vacuum(spark: SparkSession, path: str, keep_versions: int = 1, older_than: float = 86_400.0) -> list[str]:
    """Delete versions but the newest ``keep_versions``, and loads that none of those names; returns the loads' names.

    Loads changed within ``older_than`` seconds stay: they may be being written
    or read.
    """
    folder = Folder(spark, path)
    for number in versions(folder)[:-keep_versions]:
        folder.delete(f"versions/{number:012d}.json")
    named = {x for number in versions(folder) for pair in load_version(folder, number).loads for x in pair}
    dead = set()
    for table in folder.names(""):
        for entry in folder.names(table) if table not in ("versions", "drafts") else []:
            load = entry.removeprefix("load=")
            if entry.startswith("load=") and load not in named and folder.age(f"{table}/{entry}") >= older_than:
                folder.delete(f"{table}/{entry}")
                dead.add(load)
    return sorted(dead)
