"""Media columns: what stored bytes are, whatever their declared type says.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass
over a blob. At each hit a validator walks the format's structure, confirms its
lengths and says where the file ends; only such files count. A valid file at the
start corrects the declared type, and further ones are carved.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import annotate, utf8

#: Format and magic bytes at the start of a file: fixed values.
MAGIC = {
    "audio/wav": b"RIFF",
    "image/png": b"\x89PNG\r\n\x1a\n",
    "image/gif": b"GIF8",
    "image/jpeg": b"\xff\xd8\xff",
    "image/bmp": b"BM",
}
UNKNOWN = "application/octet-stream"


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, magic in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def wav_chunks(blob: bytes, at: int) -> tuple[int, dict[bytes, tuple[int, int]]] | None:
    """End of a RIFF/WAVE file that starts at ``at``, and its chunks (start, length)."""
    if len(blob) < at + 12 or blob[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(blob[at + 4 : at + 8], "little")
    if end > len(blob):
        return None
    chunks, p = {}, at + 12
    while p + 8 <= end:
        size = int.from_bytes(blob[p + 4 : p + 8], "little")
        if p + 8 + size > end:
            return None
        chunks.setdefault(blob[p : p + 4], (p + 8, size))
        p += 8 + size + (size & 1)
    if p not in (end, end + 1) or chunks.get(b"fmt ", (0, 0))[1] < 16 or b"data" not in chunks:
        return None
    return end, chunks


def _wav(blob: bytes, at: int) -> int | None:
    got = wav_chunks(blob, at)
    return got[0] if got else None


def _png(blob: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(blob):
        size, name = int.from_bytes(blob[p : p + 4], "big"), blob[p + 4 : p + 8]
        end = p + 12 + size
        if end > len(blob) or first and (name, size) != (b"IHDR", 13):
            return None
        if zlib.crc32(blob[p + 4 : end - 4]) != int.from_bytes(blob[end - 4 : end], "big"):
            return None
        if name == b"IEND":
            return end
        p, first = end, False
    return None


def _gif(blob: bytes, at: int) -> int | None:
    if blob[at + 4 : at + 6] not in (b"7a", b"9a") or len(blob) < at + 13:
        return None
    flags = blob[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while p < len(blob):
        mark = blob[p]
        if mark == 0x3B:
            return p + 1
        if mark == 0x21:
            p += 2
        elif mark == 0x2C and p + 10 < len(blob):
            local = blob[p + 9]
            p += 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1
        else:
            return None
        while p < len(blob) and blob[p]:
            p += 1 + blob[p]
        p += 1
    return None


def _jpeg(blob: bytes, at: int) -> int | None:
    p, frame = at + 2, False
    while p + 4 <= len(blob) and blob[p] == 0xFF:
        mark = blob[p + 1]
        size = int.from_bytes(blob[p + 2 : p + 4], "big")
        if size < 2 or mark < 0xC0 or mark in (0xD8, 0xD9):
            return None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if mark != 0xDA:
            continue
        while True:  # entropy-coded data: up to the next marker that is no stuffing and no restart
            p = blob.find(b"\xff", p)
            if p < 0 or p + 1 >= len(blob):
                return None
            if blob[p + 1] == 0xD9:
                return p + 2 if frame else None
            if blob[p + 1] == 0 or 0xD0 <= blob[p + 1] <= 0xD7:
                p += 2
            else:
                break
    return None


def _bmp(blob: bytes, at: int) -> int | None:
    if len(blob) < at + 54:
        return None
    size, reserved, offset, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", blob, at + 2)
    if reserved or planes != 1 or header not in (40, 52, 56, 108, 124) or depth not in (1, 4, 8, 16, 24, 32):
        return None
    rows = abs(height) * ((width * depth + 31) // 32 * 4)
    compressed = struct.unpack_from("<I", blob, at + 30)[0]
    if width <= 0 or size < 14 + header or offset > size or not compressed and size < offset + rows:
        return None
    return at + size if at + size <= len(blob) else None


VALID = {"audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp}


def sniff(blob: bytes | None, declared: str | None = None) -> tuple[str, bool, list[tuple[str, int, int]]]:
    """(type, whether ``declared`` was wrong, files found as kind, start, end).

    Without a valid file at the start the type is unknown. Files may nest: what
    another holds is listed too. A null is no bytes.
    """
    blob = blob or b""
    files = []
    for last, (kind, size) in automaton().iter(blob.decode("latin-1")):
        at = last + 1 - size
        end = VALID[kind](blob, at)
        if end is not None:
            files.append((kind, at, end))
    files.sort(key=lambda f: (f[1], -f[2], f[0]))
    kind = files[0][0] if files and files[0][1] == 0 else UNKNOWN
    return kind, declared is not None and declared != kind, files


FILE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def sniff_column(df: DataFrame, blob: str, declared: str, keep: list[str] | None = None) -> DataFrame:
    """Add ``media_type``, ``corrected`` and ``files`` (array of kind, start, end) for a binary column.

    Null and empty blobs have an unknown type and no files. Columns named like
    the new ones are replaced.
    """
    fields = [T.StructField("media_type", T.StringType()), T.StructField("corrected", T.BooleanType()), T.StructField("files", T.ArrayType(FILE))]

    def make():
        def run(blobs, names):
            got = [sniff(b, d) for b, d in zip(blobs, names, strict=True)]
            return [g[0] for g in got], [g[1] for g in got], [[dict(zip(("kind", "start", "end"), f, strict=True)) for f in g[2]] for g in got]

        return run

    return annotate(df, [blob, declared], fields, make, keep, slice_rows=512)


UNIT = 192
DECLARED = ("audio/wav", "image/png")


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text's bytes, and those filled with blanks to a positive multiple of ``UNIT``."""
    raw = utf8(text)
    return len(raw), raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def wav_of(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as a mono WAV file of unsigned 8-bit samples."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    body = b"WAVE" + fmt + struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples_of(media: bytes) -> bytes:
    """The samples of a stored WAV file, found by its chunks."""
    got = wav_chunks(media, 0)
    if got is None:
        raise ValueError("the stored bytes are no valid WAV file")
    start, size = got[1][b"data"]
    return media[start : start + size]


def _encode():
    def run(texts):
        made = [payload_of(t) for t in texts]
        return [n for n, _ in made], [wav_of(p) for _, p in made], [DECLARED[n % 2] for n, _ in made]

    return run


def _digest():
    """Everything from the stored bytes and what sniffing said of them."""

    def run(media, kinds, files):
        out = []
        for blob, kind, found in zip(media, kinds, files, strict=True):
            if kind != "audio/wav":
                raise ValueError(f"stored media were found to be {kind}")
            data = samples_of(blob)
            s = np.frombuffer(data, np.uint8).astype(np.int64)
            centred = s - 128
            crossings = int(((centred[1:] < 0) != (centred[:-1] < 0)).sum())
            carved = ";".join(f"{f['kind']}@{f['start']}-{f['end']}" for f in found)
            feature = f"{carved}|sum={int(s.sum())}|energy={int((centred * centred).sum())}|peak={int(s.max())}|crossings={crossings}"
            out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
        return tuple(map(list, zip(*out, strict=True))) if out else ([],) * 6

    return run


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as a WAV file, sniffed, read back and described.

    Null and empty texts are payloads of blanks; equal texts have equal values;
    rows of repeated or null ids are kept each; an empty table gives none. What
    is declared of a file is ``DECLARED`` by the parity of the text's length, so
    that sniffing confirms one half and corrects the other.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored = annotate(
        docs,
        ["text"],
        [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("declared", T.StringType())],
        _encode,
        keep=["doc_id"],
        slice_rows=512,
    )
    sniffed = sniff_column(stored, "media", "declared")
    fields = [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
    out = annotate(sniffed, ["media", "media_type", "files"], fields, _digest, keep=["doc_id", "n_bytes", "media_type", "corrected"], slice_rows=512)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected")
