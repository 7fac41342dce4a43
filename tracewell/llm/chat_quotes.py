"""Quotation linking: who answers whom, read from what messages quote.

A message's lines are read by their quote marks (``>``, nested by repetition).
Every maximal stretch of quoted lines of a level is a passage; normalised and
hashed it is looked up among the passages of earlier messages of the same
conversation, which are whole messages, their paragraphs, lines and sentences
without quotes. A trimmed passage that nothing equals is looked up by its lines
and sentences, and one cut elsewhere or wrapped anew by its runs of ``SHINGLE``
words. A message replies to the message of its outermost quotes (the latest that
fits; of those that share runs of words only, one that shares the most); without
a match there it answers nobody, whatever its inner quotes hold, and opens a thread. Conversations then read
thread by thread, so that each message follows what it answers, without quotes.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import Scratch, annotate, materialise

_MARK = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)(.*)", re.S)
#: A line that only announces a quotation, in the forms of common mail programs.
_INTRO = re.compile(r"(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$")

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Words of a run by which passages are found that are cut or wrapped otherwise.
SHINGLE = 4
#: How a passage is looked up: as it is, by its lines and sentences, by runs of words.
WHOLE, PART, RUN = 0, 1, 2


def normalise(passage: str) -> str:
    """Lower case, words only: what a quotation keeps when lines are wrapped anew."""
    return " ".join(re.findall(r"\w+", passage.lower()))


def key_of(passage: str) -> int | None:
    text = normalise(passage)
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63) if text else None


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(the message without quotes, quoted passages as level and text)."""
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    level = 0
    for line in (text or "").split("\n"):
        m = _MARK.match(line)
        depth = m[1].count(">") if m else 0
        if depth:
            if depth != level:
                quotes.append((depth, []))
            quotes[-1][1].append(m[2])
            if level == 0 and own and _INTRO.match(own[-1]):
                own.pop()
        else:
            own.append(line)
        level = depth
    passages = []
    for depth, lines in quotes:
        for part in re.split(r"\n\s*\n", "\n".join(lines)):
            if part.strip():
                passages.append((depth, part))
        whole = "\n".join(lines)
        if re.search(r"\n\s*\n", whole.strip()):
            passages.append((depth, whole))
    return "\n".join(own).strip(), passages


def passages_of(own: str) -> list[str]:
    """What others may quote of a message: the whole, and its paragraphs, lines and sentences."""
    parts = [own, *re.split(r"\n\s*\n", own), *own.split("\n"), *_SENTENCE.split(own)]
    return list(dict.fromkeys(p.strip() for p in parts if p.strip()))


def runs_of(text: str | None) -> list[int]:
    """Keys of the runs of ``SHINGLE`` words of a text."""
    w = normalise(text or "").split()
    return list(dict.fromkeys(key_of(" ".join(w[i : i + SHINGLE])) for i in range(len(w) - SHINGLE + 1)))


def asked_of(passages: list[tuple[int, str]]) -> list[dict]:
    """The keys by which quoted passages are looked up; ``passage`` is the key of the whole one."""
    out = []
    for level, text in passages:
        if (whole := key_of(text)) is None:
            continue
        parts = {k: PART for p in [*text.split("\n"), *_SENTENCE.split(text)] if (k := key_of(p)) is not None}
        for key, how in [*({**parts, whole: WHOLE}).items(), *((k, RUN) for k in runs_of(text))]:
            out.append({"level": level, "key": key, "passage": whole, "how": how})
    return out


QUOTE = T.ArrayType(
    T.StructType([T.StructField("level", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("passage", T.LongType()), T.StructField("how", T.IntegerType())])
)


def split_quotes(chats: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``reply_text``, ``quotes`` (level, key, passage, how) and ``quotable`` (keys of the message's own passages)."""
    fields = [T.StructField("reply_text", T.StringType()), T.StructField("quotes", QUOTE), T.StructField("quotable", T.ArrayType(T.LongType()))]

    def make():
        def run(texts):
            own, quotes, keys = [], [], []
            for t in texts:
                mine, found = parse(t)
                own.append(mine)
                quotes.append(asked_of(found))
                keys.append(list(dict.fromkeys(k for p in passages_of(mine) if (k := key_of(p)) is not None)))
            return own, quotes, keys

        return run

    return annotate(chats, [text], fields, make, keep)


def roots(edges: DataFrame, limit: int = 64) -> DataFrame:
    """(node, root, depth) for edges (conv, node, parent) of a forest, by pointer doubling.

    Nodes are turns with slots, parents have smaller turns, so a path of any length is done after
    as many rounds as its length has bits.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch.table(edges.select("conv_id", "node", F.col("parent").alias("at"), F.lit(1).cast("long").alias("depth")))
    for _ in range(limit):
        hop = now.select("conv_id", F.col("node").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        step = now.join(hop, ["conv_id", "at"], "left")
        step = step.select("conv_id", "node", F.coalesce("next", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        now, old = scratch.table(step), now
        scratch.drop(old)
        if now.where("moved").isEmpty():
            return now.select("conv_id", "node", F.col("at").alias("root"), "depth")
    raise RuntimeError("reply links do not end")


def link_quotations(chats: DataFrame) -> DataFrame:
    """One row for each message: its place, thread, parent and text without quotes.

    Returns ``conv_id, turn, role, reply_to, thread, depth, position, n_quotes,
    n_linked, text, slot, reply_slot, thread_slot``. Equal messages that share
    conversation and turn are one; different ones have slots, from 0 by (role,
    text), and the slots of ``reply_to`` and ``thread`` tell which is meant. Null
    conversations or turns have no place: ``unplaced`` has those. Null
    and empty texts quote nothing and keep their place with an empty text. Of
    several messages that hold a quoted passage the latest before the quoting
    one is meant. Extra columns are ignored.
    """
    base = typed(chats).where("conv_id is not null and turn is not null").distinct()
    slots = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    base = base.withColumn("slot", F.row_number().over(slots).cast("long") - 1)
    parsed = materialise(split_quotes(base, keep=["conv_id", "turn", "slot", "role"]))

    # Quotations meet the passages of their own conversation only; a passage that a
    # message holds twice counts once, so the join makes a row for each (quotation, holder).
    node = F.struct("turn", "slot").alias("node")
    quoting = parsed.where(F.size("quotes") > 0)
    asked = quoting.select("conv_id", node, F.explode("quotes").alias("q")).select("conv_id", "node", "q.*").distinct()
    rivals = parsed.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
    holders = rivals.select("conv_id", node, F.explode("quotable").alias("key"), F.lit(False).alias("run"))
    cut = annotate(rivals.select("conv_id", node, "reply_text"), ["reply_text"], [T.StructField("keys", T.ArrayType(T.LongType()))], lambda: lambda texts: ([runs_of(x) for x in texts],), ["conv_id", "node"])
    holders = holders.unionByName(cut.select("conv_id", "node", F.explode("keys").alias("key"), F.lit(True).alias("run")))
    asked = asked.withColumn("run", F.col("how") == RUN)
    wanted = asked.select("conv_id", "key", "run").distinct()
    holders = holders.join(wanted, ["conv_id", "key", "run"], "left_semi")
    latest = latest_before(asked, holders)
    # Runs of words are common by chance: those of a level vote for one message.
    votes = latest.groupBy("conv_id", "node", "level", "how", "source").agg(F.count_distinct("key").alias("n"))
    votes = votes.withColumn("n", F.when(F.col("how") == RUN, F.col("n")).otherwise(1))
    # Whom a message answers is told by its outermost quotes alone, linked or not.
    outermost = asked.groupBy("conv_id", "node").agg(F.min("level").alias("level"))
    votes = votes.join(outermost, ["conv_id", "node", "level"])
    best = votes.groupBy("conv_id", "node").agg(F.max(F.struct((-F.col("level")).alias("l"), (-F.col("how")).alias("h"), "n", "source"))["source"].alias("parent"))
    counted = latest.groupBy("conv_id", "node").agg(F.count_distinct("passage").alias("n_linked"))
    linked = materialise(counted.join(best, ["conv_id", "node"], "left"))
    placed = roots(linked.where("parent IS NOT NULL"))

    whole = parsed.withColumn("node", F.struct("turn", "slot")).join(linked, ["conv_id", "node"], "left").join(placed, ["conv_id", "node"], "left")
    whole = whole.select(
        "conv_id",
        "turn",
        "role",
        F.col("parent.turn").alias("reply_to"),
        F.coalesce("root.turn", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.size(F.filter("quotes", lambda q: q["how"] == WHOLE)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("reply_text").alias("text"),
        "slot",
        F.col("parent.slot").alias("reply_slot"),
        F.coalesce("root.slot", "slot").alias("thread_slot"),
    )
    return numbered(whole)


def typed(chats: DataFrame) -> DataFrame:
    blank = F.lit("")
    return chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))


def unplaced(chats: DataFrame) -> DataFrame:
    """The rows without a conversation or turn, in the columns of ``link_quotations``: unlinked, without position and slot."""
    rows = split_quotes(typed(chats).where("conv_id is null or turn is null"), keep=["conv_id", "turn", "role"])
    none = F.lit(None).cast("long")
    quoted = F.size(F.filter("quotes", lambda q: q["how"] == WHOLE)).cast("long")
    return rows.select(
        "conv_id", "turn", "role", none.alias("reply_to"), F.col("turn").alias("thread"), F.lit(0).cast("long").alias("depth"), none.alias("position"),
        quoted.alias("n_quotes"), F.lit(0).cast("long").alias("n_linked"), F.col("reply_text").alias("text"), none.alias("slot"), none.alias("reply_slot"), none.alias("thread_slot"),
    )


def latest_before(asked: DataFrame, holders: DataFrame) -> DataFrame:
    """For each asked (conv_id, node, key, run) the greatest ``source`` of a smaller turn.

    Both sides are laid on one line by turn and swept with a running maximum, so
    a passage that many messages quote and hold makes no pairs. The running
    maximum is taken in segments of turns first, then over segments, so that one
    busy passage is not one task.
    """
    keys = ["conv_id", "key", "run"]
    none = {f.name: F.lit(None).cast(f.dataType) for f in asked.schema if f.name not in keys}
    source = none["node"].alias("source")
    events = asked.select(*keys, F.col("node.turn").alias("at"), "node", "level", "passage", "how", source).unionByName(
        holders.select(*keys, F.col("node.turn").alias("at"), *[none[c].alias(c) for c in ("level", "passage", "how")], none["node"].alias("node"), F.col("node").alias("source"))
    )
    events = events.withColumn("segment", F.floor(F.col("at") / 256))
    carried = events.groupBy(*keys, "segment").agg(F.max("source").alias("last"))
    over = Window.partitionBy(*keys).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumn("carried", F.max("last").over(over)).drop("last")
    inner = Window.partitionBy(*keys, "segment").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    swept = events.withColumn("near", F.max("source").over(inner)).where("level is not null")
    swept = swept.join(carried, [*keys, "segment"])
    found = swept.withColumn("source", F.coalesce("near", "carried")).where("source is not null")
    return found.select("conv_id", "node", "level", "key", "passage", "how", "source")


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``position``, counted from 0 in each conversation by (thread, turn) and their slots.

    Rows are sorted over ranges of the whole order, so a conversation of any
    size spreads over tasks; a row's place is its place in its range plus the
    conversation's rows in earlier ranges.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "thread", "thread_slot", "turn", "slot"]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered = materialise(ordered.withColumn("__id", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("__part", F.shiftright("__id", 33))
    heads = ordered.groupBy("conv_id", "__part").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("conv_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    out = ordered.join(heads, ["conv_id", "__part"])
    out = out.withColumn("position", F.col("__id") - F.col("__first") + F.col("__before"))
    return out.select("conv_id", "turn", "role", "reply_to", "thread", "depth", "position", "n_quotes", "n_linked", "text", "slot", "reply_slot", "thread_slot")


def op1_chat_quotes(spark, sf_dir: str) -> DataFrame:
    """All ``conversations`` linked, rows without conversation or turn unplaced; odd rows as in ``link_quotations``."""
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return link_quotations(chats).unionByName(unplaced(chats))
