"""Answers as CSV and as text."""

import csv
from pathlib import Path

from tracewell.plans import registered
from tracewell.plans.answers import Answer, answer

ODD = [(1, "a, \"b\"\nc", ["x"]), (None, "", None), (3, None, [])]


def test_csv_round_trip_and_remarks(spark, tmp_path):
    rows = spark.createDataFrame(ODD, "n long, t string, l array<string>")
    out = str(tmp_path / "out")
    Answer(rows.coalesce(1), "-- some n=1", 4).write_csv(out)
    back = spark.read.options(header=True, multiLine=True, quote='"', escape='"', nullValue=None, emptyValue="").csv(out)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([("1", "a, \"b\"\nc", '["x"]'), (None, "", None), ("3", None, "[]")], key=repr)
    (part,) = Path(out).glob("part-*.csv")
    assert next(csv.reader(part.open(newline=""))) == ["n", "t", "l"]
    assert (Path(out) / "_remarks.txt").read_text() == "-- some n=1\n4 sessions without a project are not counted\n"


def test_table_is_aligned_and_bounded(spark):
    rows = spark.createDataFrame(ODD, "n long, t string, l array<string>").orderBy("n")
    lines = ["-- some", "n  t         l", "-  --------  -----", "", '1  a, "b" c  ["x"]', "3            []"]
    assert Answer(rows, "-- some", None).as_table().split("\n") == lines
    assert Answer(rows, "-- some", 0).as_table(1).split("\n")[-1] == "... and more than these 1 rows"


def test_an_answer_is_cited(spark, small):
    store = registered.open_store(spark, small)
    got = answer(store, "session_counts", **registered.bindings("session_counts", store))
    assert got.citation.startswith("-- session_counts project=/repo as_of=2024-01-28")
    assert got.unplaced == store["sessions"].where("project_dir IS NULL").count() > 0
    assert got.as_table().count("\n") == got.rows.count() + len(got.remarks) + 1
    assert answer(store, "view_tree_turns", session_id="s1-0", source="main").unplaced is None
