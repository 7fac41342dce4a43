"""Column functions that the queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t\n\f\r ]"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def signature_line(text) -> Column:
    """First line of a message, white space collapsed, absolute paths as ``<path>``."""
    line = F.regexp_replace(F.trim(F.split_part(col(text), F.lit("\n"), F.lit(1))), f"{SPACE}+", " ")
    return F.regexp_replace(line, r"(^|[\t\n\f\r ])/[^\t\n\f\r ]*[^\t\n\f\r .,;:]", "$1<path>")


def rebuilt_context(created, read, min_tokens: int, min_pct: int) -> Column:
    """Whether a call wrote its cache anew: much, and most of what it cached."""
    created, read = col(created), col(read)
    return (created >= min_tokens) & (created * 100 >= min_pct * (created + read))


def seconds_between(start, end) -> Column:
    """Second boundaries crossed from ``start`` to ``end``."""
    return F.unix_seconds(col(end)) - F.unix_seconds(col(start))


def millis_between(start, end) -> Column:
    return F.unix_millis(col(end)) - F.unix_millis(col(start))


def json_field(text, path: str) -> Column:
    """A field of JSON text; null for invalid text and for absent fields."""
    return F.when(F.try_parse_json(col(text)).isNotNull(), F.get_json_object(col(text), path))


def thread_key(session="session_id", source="source") -> Column:
    return F.concat(col(session), F.lit(":"), col(source))


def clipped(text, chars: int) -> Column:
    return F.substring(col(text), 1, chars)


def command_head(command, chars: int) -> tuple[Column, Column]:
    """(a shell command without assignments, ``cd`` and the program's folder; its first words)."""
    bare = F.regexp_replace(F.trim(col(command)), r"^([A-Za-z_][A-Za-z0-9_]*=[^\t\n\f\r ;]*[\t\n\f\r ;]+)+", "")
    bare = F.regexp_replace(bare, r"^([\t\n\f\r ]*cd[\t\n\f\r ]+[^&;|]+&&[\t\n\f\r ]*)+", "")
    bare = F.regexp_replace(bare, r"^[^\t\n\f\r ]*/", "")
    head = F.regexp_extract(bare, r"^([^\t\n\f\r ]+([\t\n\f\r ]+[a-z][a-z-]*){0,2})([\t\n\f\r ]|\z)", 1)
    return bare, clipped(head, chars)


def folder_tail(path, segments: int) -> Column:
    """The last ``segments`` names of a file's folder; empty without a folder."""
    folder = F.regexp_extract(col(path), r"^(.*)/[^/]*\z", 1)
    names = F.split(folder, "/")
    first = F.greatest(F.size(names) - segments + 1, F.lit(1))
    return F.array_join(F.slice(names, first, segments), "/")


def cut(text, chars: int) -> Column:
    """At most ``chars`` characters, the last an ellipsis where something was cut."""
    text = col(text)
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars - 1), F.lit("…"))).otherwise(text)


def iso_week(at) -> Column:
    at = col(at)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), at).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))
