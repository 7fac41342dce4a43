"""WARC archives with segmented records, written and read by Spark.

``write_archives`` makes one record for each page: a response whose HTTP body is
framed in chunks, or a revisit where an equal payload has a smaller id. A
record's block longer than ``segment_bytes`` is cut into a first record and
continuations, as the format has it for records that do not fit one archive.
Spark's text writer puts the records, which end with a line feed, one behind
the other into gzip files.

``read_archives`` streams the lines of each archive through a parser that counts
bytes by ``Content-Length``, so nothing in a block is taken for a header. The
records are then dealt by the identifier of their origin, sorted by segment
number, and joined one origin at a time: numbers must run from one without gap
or repetition, the total length must be that of the last segment, the chunk
framing must be whole, and the payload must have the digest that its header
names. What breaks a rule is returned with the name of its problem instead of a
payload, and reading goes on at the next record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import Scratch, annotate, remove, scratch_dir, ship, utf8
from tracewell.llm.minhash import heavy_keys, spread_join

#: Blocks are cut at so many bytes; bodies are framed in chunks of so many.
SEGMENT, CHUNK = 4096, 1500
WRITE_SLICE = 256

#: Names and values of the format: fixed values.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, bare."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(row: int, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{row}:{segment}')}>"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """``body`` in the chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The body of a chunked framing; extensions and trailers are allowed, anything else raises."""
    parts, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without size")
        size = framed[at:end].split(b";", 1)[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("chunk size is no number")
        n, at = int(size, 16), end + 2
        if n == 0:
            rest = framed[at:]
            if rest != b"\r\n" and not rest.endswith(b"\r\n\r\n"):
                raise ValueError("framing does not end")
            return b"".join(parts)
        if framed[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk shorter than its size")
        parts.append(framed[at : at + n])
        at += n + 2


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One WARC record; headers without a value are left out."""
    lines = [f"{name}: {value}" for name, value in [*headers, ("Content-Length", str(len(block)))] if value is not None]
    return b"\r\n".join([VERSION, *(utf8(line) for line in lines), b"", block, b"", b""])


def page_records(row: int, page_id: int | None, url: str | None, payload: bytes, first_row: int | None, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit of ``first_row``, or a response in as many segments as it needs."""
    safe = None if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
    head = [
        ("WARC-Record-ID", record_name(row)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", safe),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Page-Id", None if page_id is None else str(page_id)),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if first_row is not None:
        more = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_name(first_row))]
        yield record([("WARC-Type", "revisit"), *head, *more], HTTP_HEAD)
        return
    block = HTTP_HEAD + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield record([("WARC-Type", "response"), *head], block)
        return
    yield record([("WARC-Type", "response"), *head, ("WARC-Segment-Number", "1")], block[:segment_bytes])
    count = -(-len(block) // segment_bytes)
    for k in range(2, count + 1):
        told = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", record_name(row, k)),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", safe),
            ("WARC-Segment-Origin-ID", record_name(row)),
            ("WARC-Segment-Number", str(k)),
            ("WARC-Segment-Total-Length", str(len(block)) if k == count else None),
        ]
        yield record(told, block[(k - 1) * segment_bytes : k * segment_bytes])


def _writer(segment_bytes: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, WRITE_SLICE):
                rows = whole.slice(at, WRITE_SLICE).to_pylist()
                # The writer's separator is the line feed that each record ends with.
                made = [r[:-1] for p in rows for r in page_records(p["row"], p["page_id"], p["url"], utf8(p["html"]), p["first_row"], segment_bytes, chunk_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    return run


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    segment_bytes: int = SEGMENT,
    chunk_bytes: int = CHUNK,
) -> None:
    """Write every row of ``pages`` as a WARC record into gzip archives below ``path``.

    Of rows with equal payloads (UTF-8 of the html, a null one as empty) that of
    the smallest id is a response, others revisit it; of rows that repeat this
    id one is the response. Rows without an id come after those with one. Empty
    payloads are payloads. White space and controls in a URL are escaped; a null
    one is left out. Extra columns are ignored; of an empty table nothing is
    written but the folder.
    """
    scratch = Scratch(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    if rows.groupBy("page_id").count().where("count > 1 OR page_id IS NULL").isEmpty():
        rows = rows.withColumn("row", F.col("page_id"))
    else:
        rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()))

    def digests():
        return lambda htmls: ([payload_digest(utf8(h)) for h in htmls],)

    profile = scratch.table(annotate(rows, ["html"], [T.StructField("digest", T.StringType())], digests, keep=["row", "page_id"]))
    order = F.struct(F.col("page_id").isNull(), "page_id", "row")
    first = profile.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("many")).where("many > 1")
    first = scratch.table(first.select("digest", F.col("first.row").alias("first_row"), "many"))
    copied = heavy_keys(first, "digest", "many", profile.count())
    revisits = spread_join(profile, first.drop("many"), "digest", copied, "row").where("row <> first_row")
    revisits = scratch.table(revisits.select("row", "first_row"))
    records = rows.join(revisits, "row", "left").mapInArrow(_writer(segment_bytes, chunk_bytes), "value binary")
    records.select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\n").text(path)
    scratch.drop(profile, first, revisits, rows)


RECORD = pa.schema(
    [
        ("origin", pa.string()),
        ("number", pa.int64()),
        ("record_id", pa.string()),
        ("warc_type", pa.string()),
        ("total", pa.int64()),
        ("head", pa.binary()),
        ("block", pa.binary()),
        ("problem", pa.string()),
    ]
)
_RECORD = "origin string, number long, record_id string, warc_type string, total long, head binary, block binary, problem string"


def headers(head: bytes) -> dict[str, str]:
    """Names (lower case) and values of header lines; lines that begin with white space go on with the value before."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last is not None:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip().lower()
            out.setdefault(last, value.strip())
    return out


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch("[0-9]{1,18}", text) else None


class _Lines:
    """Records out of the lines of one archive, each line without its line feed."""

    def __init__(self):
        self.head: list[bytes] = []
        self.fields: dict[str, str] | None = None
        self.block: list[bytes] = []
        self.missing = 0

    def row(self, problem: str | None, block: bytes | None) -> tuple:
        f = self.fields or {}
        own = f.get("warc-record-id")
        out = (
            f.get("warc-segment-origin-id", own),
            _number(f.get("warc-segment-number", "1")),
            own,
            f.get("warc-type"),
            _number(f.get("warc-segment-total-length")),
            b"\r\n".join(self.head),
            block,
            problem,
        )
        self.head, self.fields, self.block = [], None, []
        return out

    def take(self, line: bytes) -> tuple | None:
        """A record, if ``line`` is its last."""
        if self.fields is not None:
            self.block.append(line)
            self.missing -= len(line) + 1
            if self.missing > 0:
                return None
            whole = b"\n".join(self.block)
            if self.missing == 0 and whole.endswith(b"\r\n\r"):
                return self.row(None, whole[:-3])
            return self.row("content length", None)
        if not self.head:
            if line.startswith(b"WARC/1.") and line.endswith(b"\r"):
                self.head.append(line[:-1])
            return None  # else what a broken record has left
        if line != b"\r":
            self.head.append(line.removesuffix(b"\r"))
            return None
        self.fields = headers(b"\r\n".join(self.head))
        size = _number(self.fields.get("content-length"))
        if size is None or self.fields.get("warc-record-id") is None:
            return self.row("header", None)
        self.missing = size + 4
        return None

    def end(self) -> tuple | None:
        """The record that the archive broke off in, if any."""
        return self.row("broken off", None) if self.head else None


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lines, current = _Lines(), None
    for batch in batches:
        found = []
        archives = batch.column("archive").to_pylist()
        for archive, line in zip(archives, batch.column("line"), strict=True):
            if archive != current:
                if (left := lines.end()) is not None:
                    found.append(left)
                current = archive
            if (made := lines.take(line.as_py())) is not None:
                found.append(made)
        yield _columns(found, RECORD)
    if (left := lines.end()) is not None:
        yield _columns([left], RECORD)


WHOLE = pa.schema(
    [
        ("record_id", pa.string()),
        ("warc_type", pa.string()),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("segments", pa.int64()),
        ("payload", pa.binary()),
        ("payload_digest", pa.string()),
        ("problem", pa.string()),
    ]
)
_WHOLE = "record_id string, warc_type string, headers map<string,string>, segments long, payload binary, payload_digest string, problem string"


def joined(segments: list[dict]) -> tuple:
    """One record of ``WHOLE`` from the segments of one origin in the order of their numbers."""
    first = segments[0]
    fields = headers(first["head"])
    named = (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None

    def out(payload: bytes | None, digest: str | None, problem: str | None) -> tuple:
        return first["record_id"], first["warc_type"], list(fields.items()), len(segments), payload, digest, problem

    broken = next((s["problem"] for s in segments if s["problem"]), None)
    if broken:
        return out(None, None, broken)
    if [s["number"] for s in segments] != list(range(1, len(segments) + 1)):
        return out(None, None, "segment numbers")
    if first["warc_type"] == "continuation" or any(s["warc_type"] != "continuation" for s in segments[1:]):
        return out(None, None, "segment types")
    block = b"".join(s["block"] for s in segments)
    segmented = "warc-segment-number" in fields
    totals = [s["total"] for s in segments]
    if segmented and (totals[-1] != len(block) or any(t is not None for t in totals[:-1])):
        return out(None, None, "total length")
    if not fields.get("content-type", "").startswith("application/http") or first["warc_type"] not in ("response", "revisit"):
        return out(block, payload_digest(block), None)
    if first["warc_type"] == "revisit":
        return out(None, named, None)
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return out(None, None, "http head")
    if headers(head).get("transfer-encoding", "").lower() == "chunked":
        try:
            body = unchunked(body)
        except ValueError as error:
            return out(None, None, str(error))
    digest = payload_digest(body)
    if named not in (None, digest):
        return out(None, None, "payload digest")
    return out(body, digest, None)


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments come sorted by origin and number; an origin may go on in the next batch."""
    held: list[dict] = []
    for batch in batches:
        found = []
        for i in range(batch.num_rows):
            row = {f.name: batch.column(k)[i].as_py() for k, f in enumerate(RECORD)}
            if held and (row["origin"] is None or row["origin"] != held[0]["origin"]):
                found.append(joined(held))
                held = []
            held.append(row)
        yield _columns(found, WHOLE)
    if held:
        yield _columns([joined(held)], WHOLE)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, warc_type, headers, segments, payload, payload_digest, problem`` of all records below ``path``.

    Archives are gzip files, whatever their size: a task streams one, and holds
    the lines of one batch and one segment. Joining holds the segments of one
    record. Revisits have the digest that they name, and no payload. Of a record
    with a problem (named by the rule that it breaks) the payload is null; one
    without its first segment is named by its origin's first remaining segment.
    Records that repeat an identifier break the rule of segment numbers.
    """
    ship(spark)
    name = F.col("_metadata.file_path")
    archive = F.when(F.lower(name).endswith(".gz"), F.xxhash64(name)).otherwise(F.raise_error(F.concat(F.lit("no gzip archive: "), name)))
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("line"), archive.cast("long").alias("archive"))
    segments = lines.mapInArrow(_parse, _RECORD)
    dealt = segments.repartition(F.col("origin")).sortWithinPartitions("origin", "number")
    return dealt.mapInArrow(_join_segments, _WHOLE)


def resolve_revisits(records: DataFrame, *more: str) -> DataFrame:
    """Revisits of ``records`` with the ``payload_bytes``, and the columns ``more`` as ``found_<name>``, of their responses.

    ``records`` is a table with ``record_id, warc_type, refers_to, payload_bytes,
    payload_digest``. A revisit whose response is missing, or has another
    digest than the revisit names, has nulls. A response that most records
    revisit is dealt over tasks.
    """
    again = records.where("warc_type = 'revisit'").drop("payload_bytes")
    named = again.groupBy("refers_to").agg(F.count("*").alias("many"))
    heavy = heavy_keys(named, "refers_to", "many", records.count())
    found = F.struct(F.col("payload_digest").alias("digest"), "payload_bytes", *more).alias("found")
    responses = records.where("warc_type = 'response'").select(F.col("record_id").alias("refers_to"), found)
    same = F.col("found.digest") == F.col("payload_digest")
    out = spread_join(again, responses, "refers_to", heavy, "record_id", "left")
    return out.select(*again.columns, *[F.when(same, F.col(f"found.{c}")).alias(c if c == "payload_bytes" else f"found_{c}") for c in ("payload_bytes", *more)])


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of what ``write_archives`` left below ``path``.

    A record that comes back broken fails the job.
    """
    sound = F.when(F.col("problem").isNull(), F.col("record_id")).otherwise(F.raise_error(F.concat(F.lit("broken record: "), F.col("problem"))).cast("string"))
    columns = [
        sound.alias("record_id"),
        F.col("warc_type"),
        F.col("headers")["warc-refers-to"].alias("refers_to"),
        F.col("headers")["page-id"].cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.col("payload_digest"),
    ]
    records = Scratch(spark).table(read_archives(spark, path).select(*columns))
    out = records.where("warc_type = 'response'").withColumn("first", F.lit(None).cast("long"))
    out = out.unionByName(resolve_revisits(records, "page_id").withColumnRenamed("found_page_id", "first"))
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("first").alias("refers_to"))


def op12_warc(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` written as archives and read back; nulls, ties, empty and repeated rows as in ``write_archives``."""
    path = f"{scratch_dir(spark)}/archives"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    out = archived_pages(spark, path)
    remove(spark, path)
    return out


OP12_SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (SELECT page_id, html, upper(sha1(html)) AS hex, min(page_id) OVER (PARTITION BY html) AS first_page FROM payloads),
fifths AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT) AS twenty FROM hashed)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       list_aggregate(list_transform(twenty, lambda v: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INTEGER + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM fifths
"""
