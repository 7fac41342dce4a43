"""Archives: exact round trips, and what broken ones give."""

import base64
import gzip
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import warc


def plain(rows):
    """The contract's rows, by a dictionary of payloads."""
    first = {}
    for page, _, html in rows:
        first[html or ""] = min(first.get(html or "", (True, 0)), (page is None, page))
    out, told = [], set()
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = (page is None, page) != first[html or ""] or html in told or (html or "") in told
        told.add(html or "")
        out.append((page, len(data), digest, "revisit" if again else "response", first[html or ""][1] if again else None))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def round_trip(spark, rows, path, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, row string, value int")
    warc.write_archives(df.repartition(3), path, **how)
    return warc.archived_pages(spark, path)


def test_round_trip_of_odd_pages(spark, tmp_path):
    rng = random.Random(2)
    trap = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"http://h/{i}", "".join(rng.choice("aé\n\r <>€😀") for _ in range(rng.randrange(400)))) for i in range(60)]
    rows += [(100, None, None), (101, "a b\r\nX: y", ""), (102, "u", trap), (103, "u", trap * 30), (104, "u", "0\r\n\r\n"), (105, "u", "x" * 300_000)]
    rows += [(200 + i, "copy", "the same text\n" * 40) for i in range(50)] + [(7, "again", "seven"), (None, "none", "seven"), (None, None, None)]
    for size in (64, 4096):
        assert found(round_trip(spark, rows, f"{tmp_path}/{size}", segment_bytes=size, chunk_bytes=37)) == plain(rows)


def test_rows_that_repeat_an_id(spark, tmp_path):
    rows = [(1, "u", "same"), (1, "u", "same"), (1, "v", "other"), (2, "u", "same")]
    assert found(round_trip(spark, rows, f"{tmp_path}/a")) == plain(rows)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(empty, f"{tmp_path}/none")
    assert warc.archived_pages(spark, f"{tmp_path}/none").count() == 0


def test_payloads_and_segments_come_back(spark, tmp_path):
    rows = [(i, "http://h/", f"page {i} " * (40 * i)) for i in range(12)]
    round_trip(spark, rows, f"{tmp_path}/a", segment_bytes=500)
    got = {int(r["headers"]["page-id"]): r for r in warc.read_archives(spark, f"{tmp_path}/a").collect()}
    assert {k: bytes(r["payload"]).decode() for k, r in got.items()} == {i: html for i, _, html in rows}
    for i, _, html in rows:
        block = len(warc.HTTP_HEAD) + len(warc.chunked(html.encode()))
        assert got[i]["segments"] == -(-block // 500)
        assert got[i]["headers"]["warc-target-uri"] == "http://h/" and got[i]["problem"] is None


def records_of(row, text, segment=100):
    return list(warc.page_records(row, row, "http://h/", text.encode(), None, segment, 50))


def problems(spark, tmp_path, archives):
    for k, records in enumerate(archives):
        (tmp_path / "in").mkdir(exist_ok=True)
        # One gzip member for each record, as archives are published.
        (tmp_path / "in" / f"{k}.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    rows = warc.read_archives(spark, f"{tmp_path}/in").collect()
    return sorted((r["problem"] or "", r["payload"] is None) for r in rows)


def test_segments_of_several_archives_in_any_order(spark, tmp_path):
    a, b = records_of(1, "one " * 200), records_of(2, "two " * 200)
    mixed = a + b
    random.Random(1).shuffle(mixed)
    assert problems(spark, tmp_path, [mixed[:9], mixed[9:]]) == [("", False), ("", False)]


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        (lambda r: r[:1] + r[2:], "segment numbers"),
        (lambda r: r[1:], "segment numbers"),
        (lambda r: r + r[-1:], "segment numbers"),
        (lambda r: r[:-1], "total length"),
        (lambda r: [x.replace(b"one", b"two") for x in r], "payload digest"),
        (lambda r: [x.replace(b"\r\n32\r\n", b"\r\n3g\r\n") for x in r], "chunk size is no number"),
        (lambda r: [x.replace(b"Segment-Total-Length: ", b"Segment-Total-Length: 1") for x in r], "total length"),
        (lambda r: [x.replace(b"Type: continuation", b"Type: response") for x in r], "segment types"),
    ],
)
def test_broken_segments_are_named_and_others_read(spark, tmp_path, change, problem):
    other = records_of(9, "whole")
    assert problems(spark, tmp_path, [[*change(records_of(1, "one " * 90)), *other]]) == [("", False), (problem, True)]


def test_reading_goes_on_after_a_broken_record(spark, tmp_path):
    (cut,) = records_of(1, "cut short", 4096)
    (wrong,) = records_of(2, "line\nline\nline", 4096)
    (good,) = records_of(3, "good", 4096)
    wrong = wrong.replace(b"Content-Length: ", b"Content-Length: -")
    assert problems(spark, tmp_path, [[cut[:-12]], [wrong, good], [good[:60]]]) == [("", False), ("broken off", True), ("broken off", True), ("header", True)]
    with pytest.raises(Exception, match="no gzip archive"):
        (tmp_path / "plain").mkdir()
        (tmp_path / "plain" / "a.warc").write_bytes(good)
        warc.read_archives(spark, f"{tmp_path}/plain").collect()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunk_framing(body, size):
    framed = warc.chunked(body, size)
    assert warc.unchunked(framed) == body
    for end in range(len(framed)):
        with pytest.raises(ValueError):
            warc.unchunked(framed[:end])


def test_registered_pages_match_plain_digests(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    assert found(warc.op12_warc(spark, small)) == plain(rows)
