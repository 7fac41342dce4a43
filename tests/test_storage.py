"""The store on disk: what is derived stays right under replacement, and nothing is lost to races or crashes."""

import random
import re
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from tracewell import model, storage
from tracewell.plans import QUESTIONS, ask, registered
from tracewell.relations import COUNTED, Store
from tracewell.storage import Folder, StoredStore, replace_sessions, vacuum, write_store


def made_up(spark, sessions, seed, ids=30):
    """Tables of sessions {name: start}, whose rows share ids with each other."""
    rng = random.Random(seed)
    rows = {n: [] for n in model.TABLES}
    for name, start in sessions.items():
        rows["sessions"].append({"id": name, "project_dir": "/p", "started_at": start, "ended_at": start, "active_ms": rng.randrange(100)})
        for table in COUNTED:
            for k in rng.sample(range(ids), 8):
                row = {"session_id": name, "source": rng.choice(["main", "run"]), "id": f"{table}{k}", "replayed": rng.random() < 0.2, "input_tokens": k, "cost_usd": float(k)}
                rows[table].append(row)
    out = {}
    for table, schema in (model.TABLES | model.ENRICHMENTS).items():
        keys = {tuple(r.get(k) for k in model.KEYS[table]): r for r in rows.get(table, [])}
        columns = {c: [r.get(c) for r in keys.values()] for c in schema.names}
        out[table] = spark.createDataFrame(pa.table(columns, schema=to_arrow_schema(schema))).select(*schema.names)
    return out


def day(n):
    return datetime(2024, 1, 1) + timedelta(days=n)


def merged(old, new, gone):
    """``old`` with ``new`` in place of the sessions ``gone``."""
    out = {}
    for table in model.TABLES:
        column = storage.session_column(table)
        kept = old[table].where(~old[table][column].isin(gone))
        out[table] = kept.unionByName(new[table])
    return out | {n: old[n] for n in model.ENRICHMENTS}


def laid_down(tables, path):
    for n, rows in tables.items():
        rows.write.parquet(f"{path}/{n}")
    return {n: rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{n}") for n, rows in tables.items()}


def same(a, b):
    assert a.schema.names == b.schema.names
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def agrees(stored, plain):
    """A stored store holds what a plain one derives anew."""
    for table in COUNTED:
        same(stored[f"corpus_{table}"], plain[f"corpus_{table}"])
        same(stored[f"live_{table}"], plain[f"live_{table}"])
    same(stored.session_rollups, plain.session_rollups)
    same(stored.corpus_rollups, plain.corpus_rollups)
    same(stored["sessions"], plain["sessions"])


@pytest.fixture
def base(spark, tmp_path):
    plain = made_up(spark, {f"s{i}": day(i) if i % 5 else None for i in range(12)}, 1)
    return write_store(Store(plain), str(tmp_path / "store"), buckets=4, slots=4), plain, str(tmp_path / "store")


def test_replacing_keeps_what_is_derived(spark, base):
    """Sessions that start earlier or later, that come new, that lose rows, and that go."""
    stored, plain, path = base
    agrees(stored, Store(plain))
    steps = [({"s3": day(-5)}, ["s3"]), ({"s1": day(90), "new": day(-9)}, ["s1", "new"]), ({"s3": None}, ["s3"]), ({}, ["new", "s2"])]
    for seed, (sessions, names) in enumerate(steps):
        new = made_up(spark, sessions, seed + 7)
        stored = replace_sessions(spark, path, new, spark.createDataFrame([(n,) for n in names], "session_id string"))
        plain = laid_down(merged(plain, new, names), f"{path}-plain{seed}")
        agrees(stored, Store(plain))
    assert len(stored.version.loads) == 5
    agrees(StoredStore.read(spark, path), Store(plain))
    for session in ("s3", "s4", "new"):
        one = stored.narrowed(session)
        same(one["corpus_turns"], Store(plain)["corpus_turns"].where(f"session_id = '{session}'"))
        same(one.corpus_rollups, Store(plain).corpus_rollups.where(f"session_id = '{session}'"))
    compacted = stored.compact()
    assert len(compacted.version.loads) == 1
    agrees(compacted, Store(plain))
    new = made_up(spark, {"s5": day(-20)}, 99)
    agrees(replace_sessions(spark, path, new, spark.createDataFrame([("s5",)], "session_id string")), Store(merged(plain, new, ["s5"])))


def test_only_what_moved_is_written(spark, tmp_path):
    """A session that shares no id with others changes its own rollups alone; one that takes ids over, also their old owner's."""
    path = str(tmp_path / "store")
    plain = made_up(spark, {"a": day(3)}, 1, ids=10)
    far = {n: t.selectExpr(*[f"concat('far-', {c}) AS {c}" if c == "id" and n in COUNTED else c for c in t.columns]) for n, t in made_up(spark, {f"x{i}": day(i) for i in range(20)}, 2).items()}
    write_store(Store({n: plain[n].unionByName(far[n]) for n in plain}), path, buckets=8, slots=8)
    alone = {n: t.selectExpr(*[f"concat('own-', {c}) AS {c}" if c == "id" and n in COUNTED else c for c in t.columns]) for n, t in made_up(spark, {"b": day(1)}, 1, ids=10).items()}
    names = spark.createDataFrame([("b",)], "session_id string")
    first = replace_sessions(spark, path, alone, names)
    part = first.version.loads[-1][1]
    read = lambda table, load: spark.read.parquet(f"{path}/{table}/load={load}")
    assert [r["session_id"] for r in read("corpus_rollups", part).collect()] == ["b"]
    assert not any("part-" in f for f in Folder(spark, path).names(f"rulings/load={part}"))
    second = replace_sessions(spark, path, made_up(spark, {"b": day(1)}, 1, ids=10), names)
    part = second.version.loads[-1][1]
    assert {r["session_id"] for r in read("corpus_rollups", part).collect()} == {"a", "b"}
    assert [r["session_id"] for r in read("session_rollups", part).collect()] == ["b"]
    assert {(r["session_id"], r["owned"]) for r in read("rulings", part).collect()} == {("a", False)}


def test_a_session_is_read_from_one_bucket(spark, small, tmp_path):
    """Keyed questions list one bucket's files of each table, and skip pages by the session."""
    path = str(tmp_path / "store")
    store = write_store(registered.open_store(spark, small), path)
    for name, question in QUESTIONS.items():
        if not question.corpus and "session_id" in question.params:
            given = registered.bindings(name, store)
            asked = ask(store, name, **given)
            bucket = storage.bucket_number(given["session_id"], storage.BUCKETS)
            files = asked.inputFiles()
            assert all(f"/bucket={bucket}/" in f for f in files), name
            tables = {re.search(r"store/(\w+)/load=", f)[1] for f in files}
            assert len(files) <= 2 * len(tables), name
    plan = ask(store, "view_call_text", **registered.bindings("view_call_text", store))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(session_id" in plan and "PushedFilters" in plan
    whole = ask(store, "view_sessions").inputFiles()
    assert len({re.search(r"bucket=(\d+)", f)[1] for f in whole}) == storage.BUCKETS


def test_files_are_sorted_by_session(spark, small, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "store")
    write_store(registered.open_store(spark, small), path, buckets=2)
    for f in (tmp_path / "store" / "api_calls").rglob("*.parquet"):
        rows = pq.read_table(f, columns=["session_id", "source", "id"], partitioning=None).to_pylist()
        keys = [tuple(r.values()) for r in rows]
        assert keys == sorted(keys)


def test_only_one_writer_makes_a_version(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: folder.claim("versions/000000000001.json", f"{k}"), range(16)))
    assert won.count(True) == 1
    assert folder.read("versions/000000000001.json") == str(won.index(True))
    assert folder.names("drafts") == []


def test_interleaved_loads_are_both_kept(spark, base, monkeypatch):
    """Another load gets in between a load's reading of the version and its own: it rules again on top of that."""
    stored, plain, path = base
    one, two = made_up(spark, {"s3": day(-5)}, 21), made_up(spark, {"s4": day(-6)}, 22)
    names = lambda n: spark.createDataFrame([(n,)], "session_id string")
    claim, between = Folder.claim, [lambda: replace_sessions(spark, path, two, names("s4"))]

    def late(self, name, text):
        if between:
            between.pop()()
        return claim(self, name, text)

    monkeypatch.setattr(Folder, "claim", late)
    last = replace_sessions(spark, path, one, names("s3"))
    assert [len(last.version.loads), last.version.number] == [3, 3]
    agrees(last, Store(merged(merged(plain, two, ["s4"]), one, ["s3"])))
    # A compaction that is overtaken keeps the later load behind it.
    between.append(lambda: replace_sessions(spark, path, made_up(spark, {"s5": day(-7)}, 23), names("s5")))
    agrees(last.compact(), Store(merged(merged(merged(plain, two, ["s4"]), one, ["s3"]), made_up(spark, {"s5": day(-7)}, 23), ["s5"])))
    assert len(StoredStore.read(spark, path).version.loads) == 2
    with pytest.raises(RuntimeError, match="came first"):
        last.compact()


def test_crashed_loads_are_not_seen_and_swept(spark, base, monkeypatch):
    stored, plain, path = base
    names = spark.createDataFrame([("s3",)], "session_id string")

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(storage, "_rule", crash)
    with pytest.raises(OSError, match="lost"):
        replace_sessions(spark, path, made_up(spark, {"s3": day(-5)}, 31), names)
    monkeypatch.undo()
    agrees(StoredStore.read(spark, path), Store(plain))
    assert vacuum(spark, path) == []  # too young to be known as dead
    assert len(vacuum(spark, path, older_than=0)) == 1
    agrees(StoredStore.read(spark, path), Store(plain))
    new = made_up(spark, {"s3": day(-5)}, 31)
    replace_sessions(spark, path, new, names)
    agrees(StoredStore.read(spark, path, stored.version.number), Store(plain))  # a version stays as it was
    with pytest.raises(ValueError, match="no version 9"):
        StoredStore.read(spark, path, 9)
    StoredStore.read(spark, path).compact()
    assert len(vacuum(spark, path, older_than=0)) == 3
    assert storage.versions(Folder(spark, path)) == [3]
    agrees(StoredStore.read(spark, path), Store(merged(plain, new, ["s3"])))


def test_a_store_begun_by_a_load(spark, tmp_path):
    path = str(tmp_path / "store")
    plain = made_up(spark, {"a": day(1), "b": day(0)}, 4)
    tables = {n: plain[n] for n in model.TABLES}
    agrees(replace_sessions(spark, path, tables, spark.createDataFrame([("a",), ("b",)], "session_id string")), Store(plain))
    empty = {n: t.where("false") for n, t in plain.items()}
    agrees(write_store(Store(empty), str(tmp_path / "none")), Store(empty))
