"""Near-duplicate classes by fast similarity sketching.

A document's set holds the 64-bit hashes of its distinct five-word shingles.
Sketching throws every element into one of ``T`` bins, round after round, a
round's values ranking behind those of the round before; from round ``T`` on,
round ``T + i`` throws all elements into bin ``i``. So each coordinate is filled
after ``2 T`` rounds at the latest, and two sets agree on a coordinate with the
probability of their Jaccard similarity, concentrated as for independent draws.
``BANDS`` bands of ``ROWS`` coordinates make the bucket keys; pairs that share a
bucket are compared on their full sets.

Rows never meet by the square of a group:

* equal texts collapse into one representative before any band is made;
* in a bucket, members are first compared with one star only, the member that
  meets most others over all its buckets and so stands in a group's middle;
* after connected components of those links, buckets of a star whose members lie
  in one component are finished; else members outside its main component are
  packed in blocks that meet the packed members of all buckets of that star.

A key that holds more than a thousandth of a join's rows (there can be no more
than a thousand of those) is dealt over ``SALTS`` tasks, and its row on the other
side repeated for each.

Pairs are compared on one byte for each coordinate first. At the similarity of
0.85 a pair misses all bands with probability 4e-5, and that comparison, six
standard deviations below, practically never.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import Scratch, annotate, utf8

SHINGLE = 5
BANDS, ROWS = 32, 8
BINS = BANDS * ROWS
PERCENT = 85
PACK, FACING = 64, 8
SALTS, HEAVY_SHARE = 64, 1000
#: Six standard deviations of a sketch's estimate at the similarity of 0.85.
SLACK = 6 * (0.85 * 0.15 / BINS) ** 0.5

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (multiply and fold, twice)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * _ODD)


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space."""
    return utf8(text).lower().split()


def shingle_set(tokens: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all ``n``-word shingles; of the whole if shorter."""
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in tokens), np.uint64, len(tokens))
    span = min(n, len(tokens))
    count = len(tokens) - span + 1
    acc = np.full(count, np.uint64(span), np.uint64)
    for k in range(span):
        acc = mix(acc * _ODD + h[k : k + count])
    return np.unique(acc)


def sketch(elements: np.ndarray) -> np.ndarray:
    """The ``BINS`` coordinates of a non-empty set, as described above."""
    out = np.full(BINS, _FULL, np.uint64)
    at, block = 0, max(1, 4096 // len(elements))
    while at < 2 * BINS:
        rounds = np.arange(at, min(at + block, 2 * BINS), dtype=np.uint64)
        h = mix(elements[None, :] ^ _SEEDS[at : at + len(rounds), None])
        bins = (h >> np.uint64(32)) % np.uint64(BINS)
        forced = rounds >= BINS
        if forced.any():
            bins[forced] = rounds[forced, None] - np.uint64(BINS)
        value = (rounds[:, None] << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(out, bins.ravel().astype(np.int64), value.ravel())
        if out.max() != _FULL:
            break
        at += len(rounds)
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates.reshape(BANDS, ROWS)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        acc = mix(acc * _ODD + rows[:, k])
    return acc.view(np.int64)


def signature(coordinates: np.ndarray) -> bytes:
    """One byte of each coordinate."""
    return (mix(coordinates) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def _profiles():
    def run(texts: list[str | None]):
        sizes, same, keys, bytes_, last = [], [], [], [], {}
        for text in texts:
            tokens = words(text)
            digest = xxhash.xxh3_128_digest(b" ".join(tokens))
            if digest not in last:
                s = shingle_set(tokens)
                if len(s):
                    coordinates = sketch(s)
                    last[digest] = len(s), band_keys(coordinates), signature(coordinates)
                else:
                    last[digest] = 0, np.empty(0, np.int64), None
            n, bands, code = last[digest]
            sizes.append(n)
            bytes_.append(code)
            same.append(digest if n else None)
            keys.append(bands)
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64), pa.int64())
        element = pa.field("element", pa.int64())
        return sizes, same, pa.ListArray.from_arrays(pa.array(offsets), flat, type=pa.list_(element)), bytes_

    return run


def _packed_sets():
    return lambda texts: ([shingle_set(words(t)).tobytes() for t in texts],)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets' Jaccard similarity is ``percent`` or more, exactly."""
    if len(x) > len(y):
        x, y = y, x
    found = y[np.minimum(np.searchsorted(y, x), len(y) - 1)]
    both = int((found == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(percent: int):
    """Pairs with packed sets in, linked pairs out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("set_a"), batch.column("set_b")
            keep = [
                similar(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64), percent)
                for i in range(batch.num_rows)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _alike(percent: int):
    """Pairs with signatures in, those whose estimate may reach ``percent`` out."""
    least = percent / 100 - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_codes(batch.column("sig_a")) == _codes(batch.column("sig_b"))).mean(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(same >= least))

    return run


def _between_packs(percent: int):
    """A pack of a group's minority and one of its members in, links between components out."""
    least = percent / 100 - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                main = batch.column("main")[i].as_py()
                xs, ys = batch.column("minority")[i].as_py(), batch.column("members")[i].as_py()
                codes = np.frombuffer(b"".join(x["sig"] for x in xs), np.uint8).reshape(-1, BINS)
                ids, n, part = (np.array([x[c] for x in xs]) for c in ("id", "n", "component"))
                sets = [np.frombuffer(x["set"], np.uint64) for x in xs]
                for y in ys:
                    take = (part != y["component"]) & (100 * np.minimum(n, y["n"]) >= percent * np.maximum(n, y["n"]))
                    if y["component"] != main:
                        take &= ids < y["id"]
                    if take.any():
                        take &= (codes == np.frombuffer(y["sig"], np.uint8)).mean(axis=1) >= least
                    other = np.frombuffer(y["set"], np.uint64)
                    for k in np.flatnonzero(take):
                        if similar(sets[k], other, percent):
                            a.append(max(int(ids[k]), y["id"]))
                            b.append(min(int(ids[k]), y["id"]))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def heavy_keys(counts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Keys of more than a thousandth of ``total`` rows: fewer than ``HEAVY_SHARE`` rows, whatever the input."""
    return counts.where(F.col(size) * HEAVY_SHARE > total).select(F.col(key).alias("__heavy"))


def spread_join(rows: DataFrame, table: DataFrame, key: str, heavy: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table`` (one row a key) on ``key``, heavy keys dealt over tasks by a hash of ``by``."""
    many = F.broadcast(heavy)
    dealt = rows.join(many, F.col(key) == F.col("__heavy"), "left")
    dealt = dealt.withColumn("__salt", F.when(F.col("__heavy").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))).drop("__heavy")
    salts = F.when(F.col("__heavy").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    copies = table.join(many, F.col(key) == F.col("__heavy"), "left").withColumn("__salt", F.explode(salts)).drop("__heavy")
    return dealt.join(copies.hint("merge"), [key, "__salt"], how).drop("__salt")


def linked(pairs: DataFrame, sets: DataFrame, heavy: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (id, star) whose full sets are similar enough, as (a, b)."""
    first = sets.select("id", F.col("set").alias("set_a"))
    second = sets.select(F.col("id").alias("star"), F.col("set").alias("set_b"))
    both = spread_join(pairs.select("id", "star").join(first, "id"), second, "star", heavy, "id")
    both = both.select(F.col("id").alias("a"), F.col("star").alias("b"), "set_a", "set_b")
    return both.mapInArrow(_verify(percent), "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable id: (id, component) for every linked id but the smallest ones themselves.

    Alternates the large-star and small-star steps of Kiveris et al.: edges are
    moved to the smallest neighbour until each points at its component's
    smallest id. A step is an aggregation and a join; hubs are dealt over tasks.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.table(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state, total = None, edges.count()
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many"))
        hubs = heavy_keys(least, "u", "many", total)
        least = least.select("u", F.least("u", "m").alias("m"))
        large = spread_join(both.where("v > u"), least, "u", hubs, "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.table(large.where("u <> v").distinct())
        small_least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many"))
        hubs = heavy_keys(small_least, "u", "many", total)
        small = (
            spread_join(large, small_least.drop("many"), "u", hubs, "v")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        edges, old = scratch.table(small), edges
        scratch.drop(old, large)
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        total = seen[0]
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, representative, component_id, kept`` for every row.

    Links hold where ``100 * |A & B| >= percent * |A | B|``. A component's id is
    its smallest document id, and that document is kept; ``representative`` is
    the smallest id of the same words. Null and empty texts and texts of white
    space only have an empty set: they link with nothing and are kept. Rows that
    repeat an id are one document, whatever their texts: all of its texts' links
    are its own, and its rows share one component. Rows without an id are linked
    like others, but are kept only where no id is in their component (which then
    has no ``component_id``). Texts are read whole; extra columns are ignored; an
    empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    odd = not source.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty()
    if not odd:
        return _classes(scratch, source, None, percent)
    # Rows are told apart by a number; those of one id are linked, and at the end numbers become ids again.
    rows = scratch.table(source.withColumn("row", F.monotonically_increasing_id()))
    first = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("row").alias("b"), F.count("*").alias("many"))
    total = rows.count()
    ids = rows.select("doc_id", F.col("row").alias("a"))
    same_id = spread_join(ids, first.drop("many"), "doc_id", heavy_keys(first, "doc_id", "many", total), "a").select("a", "b").where("a <> b")
    out = _classes(scratch, rows.select(F.col("row").alias("doc_id"), "text"), scratch.table(same_id), percent)
    out = scratch.table(out.withColumnRenamed("doc_id", "row").drop("kept").join(rows.select("row", "doc_id"), "row"))
    for column in ("representative", "component_id"):
        least = out.groupBy(column).agg(F.min("doc_id").alias("least"), F.count("*").alias("many"))
        heavy = heavy_keys(least, column, "many", total)
        out = spread_join(out, least.drop("many"), column, heavy, "row").drop(column).withColumnRenamed("least", column)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "representative", "component_id", kept.alias("kept"))


def _classes(scratch: Scratch, source: DataFrame, also: DataFrame | None, percent: int) -> DataFrame:
    """``near_duplicates`` where no id is null or repeated; ``also`` (a, b) are links between ids besides."""
    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("same", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sig", T.BinaryType()),
    ]
    profile = scratch.table(annotate(source, ["text"], fields, _profiles, keep=["doc_id"]))

    filled = profile.where("same is not null")
    first = scratch.table(filled.groupBy("same").agg(F.min("doc_id").alias("representative"), F.count("*").alias("copies")))
    total = filled.count()
    copied = heavy_keys(first, "same", "copies", total)
    people = spread_join(filled.select("doc_id", "n_shingles", "same"), first.select("same", "representative"), "same", copied, "doc_id").drop("same")
    people = scratch.table(people.unionByName(profile.where("same is null").select("doc_id", "n_shingles", F.col("doc_id").alias("representative"))))

    # One row per distinct text and band; buckets with a single member end here.
    unique = profile.join(first.select(F.col("representative").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    unique = scratch.table(unique.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "sig"))
    n_texts = unique.count()
    codes = unique.select("id", "sig")
    single = unique.select("id", "n", F.explode("bands").alias("key"))
    bucket = scratch.table(single.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"))
    crowded = heavy_keys(bucket, "key", "many", n_texts)
    seats = scratch.table(spread_join(single, bucket, "key", crowded, "id"))

    ids = seats.select("id").distinct()
    texts = source.join(ids.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left_semi")
    packed = annotate(texts, ["text"], [T.StructField("set", T.BinaryType())], _packed_sets, keep=["doc_id"])
    sets = scratch.table(packed.withColumnRenamed("doc_id", "id"))

    met = seats.groupBy("id").agg(F.sum("many").alias("met"))
    stars = seats.join(met.hint("merge"), "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("minus"), "n")).alias("s"))
    stars = stars.select("key", (-F.col("s.minus")).alias("star"), F.col("s.n").alias("n_star"))
    groups = scratch.table(spread_join(seats, stars, "key", crowded, "id").select("star", "id", "n", "n_star").distinct())
    met_by = groups.groupBy("star").agg(F.count("*").alias("many"))
    hubs = heavy_keys(met_by, "star", "many", n_texts)
    fits = f"100 * least(n, n_star) >= {int(percent)} * greatest(n, n_star)"
    tried = groups.where("id <> star").where(fits).select("id", "star").join(codes.select("id", F.col("sig").alias("sig_a")), "id")
    tried = spread_join(tried, codes.select(F.col("id").alias("star"), F.col("sig").alias("sig_b")), "star", hubs, "id")
    tried = tried.select(F.col("id").alias("a"), F.col("star").alias("b"), "sig_a", "sig_b").mapInArrow(_alike(percent), "a long, b long")
    tried = scratch.table(tried.select(F.col("a").alias("id"), F.col("b").alias("star")))
    links = linked(tried, sets, hubs, percent)
    if also is not None:
        node = people.select("doc_id", "representative")
        ends = also.join(node.withColumnsRenamed({"doc_id": "a", "representative": "x"}), "a").join(node.withColumnsRenamed({"doc_id": "b", "representative": "y"}), "b")
        links = links.unionByName(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    links = scratch.table(links)
    label = components(links)

    # Groups of one star whose members are in several components.
    placed = groups.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = placed.groupBy("star", "component").agg(F.count("*").alias("many"))
    sizes = sizes.groupBy("star").agg(F.max(F.struct("many", (-F.col("component")).alias("minus"))).alias("m"), F.sum("many").alias("all"), F.count("*").alias("parts"))
    spread = sizes.where("parts > 1").select("star", (-F.col("m.minus")).alias("main"), F.col("all"), (F.col("all") - F.col("m.many")).alias("fewer"))
    open_ = scratch.table(spread_join(placed.select("star", "id", "n", "component"), spread, "star", hubs, "id"))
    full = open_.join(codes, "id").join(sets, "id")
    member = F.struct("id", "n", "component", "sig", "set")

    def packs(rows: DataFrame, size: str, name: str, *more: str) -> DataFrame:
        slot = F.pmod(F.xxhash64("id"), F.ceil(F.col(size) / PACK))
        return rows.groupBy("star", slot.alias("slot")).agg(*[F.first(c).alias(c) for c in more], F.collect_list(member).alias(name))

    # The members' packs of a star are dealt over parts, each of which its minority's packs go to.
    minority = packs(full.where("component <> main"), "fewer", "minority", "all")
    parts = F.sequence(F.lit(0), F.ceil(F.ceil(F.col("all") / PACK) / FACING).cast("int") - 1)
    minority = minority.select("star", "minority", F.explode(parts).alias("part"))
    members = packs(full, "all", "members", "main", "all")
    members = members.withColumn("part", F.pmod("slot", F.ceil(F.ceil(F.col("all") / PACK) / FACING)).cast("int"))
    facing = members.join(minority, ["star", "part"]).select("main", "minority", "members")
    more = scratch.table(facing.mapInArrow(_between_packs(percent), "a long, b long"))
    label = scratch.table(components(links.union(more)))
    scratch.drop(profile, unique, bucket, seats, sets, groups, tried, links, open_, more)

    out = spread_join(people, label.select(F.col("id").alias("representative"), "component"), "representative", _copied(people, total), "doc_id", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        "representative",
        F.coalesce("component", "representative").alias("component_id"),
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _copied(people: DataFrame, total: int) -> DataFrame:
    counts = people.groupBy("representative").agg(F.count("*").alias("copies"))
    return heavy_keys(counts, "representative", "copies", total)


def op2_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all ``documents``; nulls, empty and repeated rows as in ``near_duplicates``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
    SELECT doc_id, array_to_string(w, ' ') AS whole, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM words),
members AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM members a JOIN members b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN sides e ON e.a = r.b),
lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, CASE WHEN whole = '' THEN doc_id ELSE min(doc_id) OVER (PARTITION BY whole) END AS representative, component_id, doc_id = component_id AS kept
FROM sets JOIN lowest USING (doc_id)
"""
