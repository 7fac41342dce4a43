"""Transcripts read in byte ranges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracewell.sources import transcripts

PLACES = ["a.jsonl", "with space+%.jsonl", "c/subagents/agent-r.jsonl", "c.jsonl", "[odd]{x}*.jsonl"]


@pytest.fixture
def small_ranges(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def write(root, place, lines, tail=""):
    path = root / place
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n" + tail, newline="", encoding="utf-8")
    return path.stat().st_size


def line(rng, k):
    return json.dumps({"type": "summary", "uuid": f"u{k}", "text": rng.choice(["é", "€", "😀", "x", " "]) * rng.randrange(200)}, ensure_ascii=False)


def numbers(rows):
    out = transcripts.numbered(transcripts.parsed(rows))
    return sorted((r["session_id"], r["source"], r["line_no"], r["last"], r["raw"]) for r in out.collect())


def test_ranges_number_lines_as_whole_files(spark, tmp_path, small_ranges):
    rng = random.Random(6)
    size = sum(write(tmp_path, place, [rng.choice([line(rng, k), line(rng, k), "", " \r"]) for k in range(60)] + [line(rng, 60)], tail=rng.choice(["", "\n\n", '{"type": "summ'])) for place in PLACES)
    ranges = transcripts.split_lines(spark, str(tmp_path))
    assert ranges.rdd.getNumPartitions() > size // 997 > 20
    got = numbers(ranges)
    # A last line that is empty for its line feed is a line in whole files only.
    whole = [r for r in numbers(transcripts.content_lines(transcripts.files(spark, str(tmp_path)))) if not (r[4] == "" and r[2] > r[3])]
    assert [r for r in got if not (r[4] == "" and r[2] > r[3])] == whole
    assert {r[0] for r in got} == {"a", "with space+%", "c", "[odd]{x}*"}
    records = transcripts.judged(transcripts.numbered(transcripts.parsed(ranges)))
    assert records.where("raw RLIKE 'summ$'").isEmpty() and records.where("trim(raw) = ''").isEmpty()
    wanted = {(r[0], r[1], r[2]) for r in whole if r[4].strip(" \r") and not r[4].endswith("summ")}
    assert {(r["session_id"], r["source"], r["line_no"]) for r in records.collect()} == wanted


def test_an_unreadable_line_within_a_file_raises_its_number(spark, tmp_path, small_ranges):
    rng = random.Random(7)
    lines = [line(rng, k) for k in range(80)]
    write(tmp_path, "s.jsonl", [*lines[:57], '{"type": "summ', *lines[57:]])
    with pytest.raises(Exception, match="unreadable record in session s, line 58"):
        transcripts.judged(transcripts.numbered(transcripts.parsed(transcripts.split_lines(spark, str(tmp_path))))).select("raw").collect()


@pytest.mark.parametrize("named", [100, 1])
def test_a_chosen_session_opens_its_files_alone(spark, tmp_path, monkeypatch, named):
    rng = random.Random(8)
    for n, place in enumerate(PLACES):
        write(tmp_path, place, [line(rng, 5 * n + k) for k in range(5)])
    (tmp_path / "c/subagents/agent-r.meta.json").write_text('{"agentType": "x", "spawnDepth": 1}')
    opened = []
    monkeypatch.setattr(transcripts, "NAMED_FILES", named)
    real = transcripts.split_lines
    monkeypatch.setattr(transcripts, "split_lines", lambda s, p: (opened.append(real(s, p).inputFiles()), real(s, p))[1])
    only = spark.createDataFrame([("c",), ("[odd]{x}*",)], "session_id string")
    tables = transcripts.extract(spark, str(tmp_path), only)
    assert {r["session_id"] for r in tables["raw_records"].collect()} == {"c", "[odd]{x}*"}
    assert tables["raw_records"].where(F.col("session_id") == "c").count() == 10
    assert len(opened[0]) == (3 if named == 100 else 5)
