"""Hard negatives by vantage-point trees over norm-augmented vectors.

With one more component, the square root of what a row's norm lacks of the
largest one, all rows have one length, and a row's distance from an anchor
(whose own further component is 0) falls as their inner product rises: a window
of scores is an annulus of distances, and nearest first is best first.

Rows are dealt over cells of one tree of vantage points, fitted on a bounded
sample that the driver sees; a cell of more than ``TREE_ROWS`` rows is dealt
over several trees. Every tree is built where its rows are, from all of them.
A cell's distances from the vantage points above it bound, by the triangle
inequality, how near and how far its rows can be to an anchor.

A search goes in two rounds. First each query visits the cell it lies in, and
the score of its last wanted hit there, if there are as many, narrows its
annulus; then it visits the other cells that the annulus still meets. Within a
tree nodes are taken nearest first, until no node is nearer than the last of
the hits wanted. Scores are integers and exact; distances only choose where to
look, with a slack for their rounding. So recall is 1, whatever the sample.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import Scratch, annotate, hash_sample, ship

#: Of the registered query: components times SCALE, one row of so many ids an anchor, of so many with a changed label.
SCALE, ANCHORS, CHANGED, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Bounds of what one task and the driver hold: rows of a tree and of its leaves, cells, sampled rows.
TREE_ROWS, LEAF, CELLS, SAMPLE, SAMPLE_BYTES = 65_536, 256, 2048, 8192, 1 << 26
LEAST_TREE, TASK_QUERIES = 1024, 32_768
#: Scores below this are exact in double precision, whatever the order of a sum.
EXACT = 2**53


def packed(codes: list[int]) -> bytes:
    """Integers in the fewest bytes each that hold them all, behind one byte that tells how many."""
    v = np.array(codes, np.int64)
    most = max(int(v.max(initial=0)), -int(v.min(initial=0)))
    width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return bytes([width]) + v.astype(f"<i{width}").tobytes()


def matrix(codes: list[bytes], dim: int) -> np.ndarray:
    """Integer vectors as rows; a shorter one has zeros behind."""
    out = np.zeros((len(codes), dim), np.int64)
    for i, code in enumerate(codes):
        v = np.frombuffer(code, f"<i{code[0]}", offset=1)
        out[i, : len(v)] = v
    return out


class Space:
    """Distances between anchors and rows of norms up to ``top`` (the largest square)."""

    def __init__(self, top: int, dim: int):
        self.top, self.dim = top, dim
        self.kind = np.float64 if top < EXACT else np.int64
        self.slack = 1e-6 * top**0.5 + 1e-9

    def further(self, rows: np.ndarray) -> np.ndarray:
        """The further component of rows."""
        return np.sqrt(np.maximum(float(self.top) - np.square(rows.astype(np.float64)).sum(axis=1), 0))

    def between(self, rows: np.ndarray, more: np.ndarray, row: np.ndarray, own: float) -> np.ndarray:
        """Distances of rows from one row."""
        both = rows.astype(np.float64) @ row.astype(np.float64) + more * own
        return np.sqrt(np.maximum(2.0 * self.top - 2.0 * both, 0))

    def of_score(self, norm2: float, score: float) -> float:
        """The distance from an anchor at which rows have this score."""
        return max(self.top + norm2 - 2.0 * score, 0) ** 0.5


class Cells:
    """A tree of vantage points down to ``2 ** depth`` cells, fitted on a sample."""

    def __init__(self, space: Space, sample: np.ndarray, depth: int):
        self.space, self.depth = space, depth
        self.points = np.zeros((2**depth, space.dim), np.int64)
        self.cut = np.full(2**depth, np.inf)
        more = space.further(sample)
        groups = {1: np.arange(len(sample))}
        for node in range(1, 2**depth):
            at = groups.pop(node)
            if len(at):
                self.points[node] = sample[at[0]]
                d = space.between(sample[at], more[at], sample[at[0]], more[at[0]])
                self.cut[node] = np.median(d)
                groups[2 * node], groups[2 * node + 1] = at[d <= self.cut[node]], at[d > self.cut[node]]
            else:
                groups[2 * node] = groups[2 * node + 1] = at
        self.own = space.further(self.points)

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row, and its distances from the vantage points above it."""
        more, node = self.space.further(rows), np.ones(len(rows), np.int64)
        path = np.zeros((len(rows), self.depth))
        for level in range(self.depth):
            for k in np.unique(node):
                at = np.flatnonzero(node == k)
                d = self.space.between(rows[at], more[at], self.points[k], self.own[k])
                path[at, level] = d
                node[at] = 2 * k + (d > self.cut[k])
        return node - 2**self.depth, path

    def from_anchor(self, anchor: np.ndarray) -> np.ndarray:
        """Distances of an anchor from all vantage points."""
        a = anchor.astype(np.float64)
        return np.sqrt(np.maximum(self.space.top + a @ a - 2.0 * (self.points.astype(np.float64) @ a), 0))


class Tree:
    """A vantage-point tree over the rows of one task."""

    def __init__(self, space: Space, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.space, self.ids, self.labels = space, ids, labels
        self.rows = rows.astype(space.kind)
        self.more = space.further(rows)
        self.root = self._node(np.arange(len(ids)))

    def _node(self, at: np.ndarray) -> tuple:
        """(rows,) of a leaf, or (vantage point, (nearest, farthest, child) of both halves)."""
        if len(at) <= LEAF:
            return (at,)
        p = at[0]
        d = self.space.between(self.rows[at], self.more[at], self.rows[p], self.more[p])
        half = np.argpartition(d, len(at) // 2)
        sides = [half[: len(at) // 2], half[len(at) // 2 :]]
        return p, [(d[s].min(), d[s].max(), self._node(at[s])) for s in sides]

    def search(self, q: Query, scores: dict) -> list[tuple[int, int]]:
        """Up to ``q.k`` (score, id) of the query, best first. ``scores`` keeps those of leaves for queries of one vector."""
        inner, outer = q.inner - self.space.slack, q.outer + self.space.slack
        heap, count = [(0.0, 0, np.inf, self.root)], 0
        best: list[tuple[int, int]] = []
        while heap:
            near, _, far, node = heapq.heappop(heap)
            if near > outer:
                break
            if far < inner:
                continue
            if len(node) == 1:
                at = node[0]
                if id(at) not in scores:
                    scores[id(at)] = self.rows[at] @ q.vector
                s = scores[id(at)]
                least = q.low if len(best) < q.k else max(q.low, best[-1][0])
                fit = np.flatnonzero((s >= least) & (s <= q.high) & ((self.labels[at] == q.label) == q.same))
                if len(fit):
                    found = [(int(s[i]), int(self.ids[at[i]])) for i in fit if self.ids[at[i]] != q.anchor]
                    best = sorted([*best, *found], key=lambda x: (-x[0], x[1]))[: q.k]
                    if len(best) == q.k:
                        outer = min(outer, self.space.of_score(q.norm2, best[-1][0]) + self.space.slack)
                continue
            d = self.space.of_score(q.norm2, float(self.rows[node[0]] @ q.vector))
            for nearest, farthest, child in node[1]:
                lo = max(near, d - farthest, nearest - d)
                if lo <= outer:
                    count += 1
                    heapq.heappush(heap, (lo, count, min(far, d + farthest), child))
        return best


class Query:
    """The ``k`` best rows for an anchor with scores in ``[low, high]`` and the same, or another, label."""

    def __init__(self, space: Space, anchor: int, label: int, vector: np.ndarray, low: int, high: int, same: bool, k: int):
        self.anchor, self.label, self.same, self.k = anchor, label, same, k
        self.vector = vector.astype(space.kind)
        self.norm2 = float(np.square(vector.astype(np.float64)).sum())
        self.low, self.high = low, high
        self.inner, self.outer = space.of_score(self.norm2, high), space.of_score(self.norm2, low)


def codes_of(embedding: Column) -> Column:
    """Components times ``SCALE``, rounded down, as an array of long; null for a null, not finite or unrepresentable one."""
    scaled = F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE))
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(sound, scaled)


def vectors(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, label, code, norm2`` of the rows that take part.

    Left out are rows with a null label, id or vector, or a null or not finite
    component. Of rows that repeat an id the first by label and vector counts.
    """
    read = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("int").alias("label"), codes_of(F.col(f"`{vector_col}`")).alias("ints"))
    read = read.dropna()
    if not read.groupBy("vec_id").count().where("count > 1").isEmpty():
        read = read.groupBy("vec_id").agg(F.min(F.struct("label", "ints")).alias("r")).select("vec_id", "r.label", "r.ints")
    norm = F.aggregate("ints", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return read.withColumn("norm2", norm).withColumn("dim", F.size("ints"))


class Index:
    """Cells and trees over ``vectors``; ``anchors`` of any search are rows with ``vec_id, label, code``."""

    def __init__(self, scratch: Scratch, rows: DataFrame, tree_rows: int | None = None):
        self.scratch, spark = scratch, rows.sparkSession
        packs = [T.StructField("code", T.BinaryType())]
        coded = annotate(rows, ["ints"], packs, lambda: lambda ints: ([packed(v) for v in ints],), keep=["vec_id", "label", "norm2", "dim"])
        self.rows = scratch.table(coded)
        total, top, dim = self.rows.agg(F.count("*"), F.max("norm2"), F.max("dim")).first()
        self.total = total
        if not total:
            return
        if top >= 2.0**62:
            raise ValueError("components are so large that scores do not fit a long")
        # The largest square, not less than any; of large ones the sum in doubles is rounded.
        self.space = Space(int(top * (1 + 1e-12)) + 1, max(dim, 1))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        self.tree_rows = tree_rows or min(TREE_ROWS, max(LEAST_TREE, ceil(total / parts)))
        depth = min(ceil(log2(max(total / self.tree_rows, 1))), int(log2(CELLS)))
        size = min(SAMPLE, SAMPLE_BYTES // (8 * self.space.dim) + 1)
        sample = [r["code"] for r in hash_sample(self.rows.select("vec_id", "code"), size, "vec_id").orderBy("vec_id").collect()]
        self.cells = cells = Cells(self.space, matrix(sample, self.space.dim), depth)

        def placed():
            def run(codes):
                cell, path = cells.place(matrix(codes, cells.space.dim))
                return cell, path.tolist()

            return run

        fields = [T.StructField("cell", T.LongType()), T.StructField("path", T.ArrayType(T.DoubleType()))]
        self.placed = scratch.table(annotate(self.rows, ["code"], fields, placed))
        ends = [f(F.col("path")[i]).alias(f"{n}{i}") for i in range(depth) for n, f in (("lo", F.min), ("hi", F.max))]
        # One row a cell, of which there are no more than CELLS.
        held = self.placed.groupBy("cell").agg(F.count("*").alias("many"), *ends).collect()
        self.bounds = {r["cell"]: (ceil(r["many"] / self.tree_rows), [(r[f"lo{i}"], r[f"hi{i}"]) for i in range(depth)]) for r in held}
        trees = F.create_map(*[F.lit(x) for c, (n, _) in self.bounds.items() for x in (c, n)])
        slot = F.pmod(F.xxhash64("vec_id"), trees[F.col("cell")])
        self.members = self.placed.select(F.col("cell"), slot.cast("int").alias("slot"), "vec_id", "label", "code")

    def _route(self, queries: DataFrame, home: bool) -> DataFrame:
        """Each query once for every tree of the cells that its annulus meets: of its own cell, or of all others."""
        cells, space, bounds = self.cells, self.space, self.bounds
        names = queries.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = sorted(bounds)
            above = np.array([[(key + 2**cells.depth) >> (cells.depth - i) for i in range(cells.depth)] for key in keys], np.int64).reshape(len(keys), cells.depth)
            lo = np.array([[b[0] for b in bounds[key][1]] for key in keys]).reshape(above.shape)
            hi = np.array([[b[1] for b in bounds[key][1]] for key in keys]).reshape(above.shape)
            slots = [bounds[key][0] for key in keys]
            for whole in batches:
                for begin in range(0, whole.num_rows, 512):
                    batch = whole.slice(begin, 512)
                    rows = matrix(batch.column("code").to_pylist(), space.dim)
                    own = cells.place(rows)[0]
                    take, cell, slot = [], [], []
                    lows, highs = batch.column("low").to_pylist(), batch.column("high").to_pylist()
                    for i in range(len(rows)):
                        if home:
                            meets = [k for k, key in enumerate(keys) if key == own[i]]
                        else:
                            d = cells.from_anchor(rows[i])[above]
                            near = np.maximum(np.maximum(d - hi, lo - d), 0).max(axis=1, initial=0)
                            far = (d + hi).min(axis=1, initial=np.inf)
                            norm2 = float(np.square(rows[i].astype(np.float64)).sum())
                            inner, outer = space.of_score(norm2, highs[i]) - space.slack, space.of_score(norm2, lows[i]) + space.slack
                            meets = [k for k in np.flatnonzero((near <= outer) & (far >= inner)) if keys[k] != own[i]]
                        for k in meets:
                            take += [i] * slots[k]
                            cell += [keys[k]] * slots[k]
                            slot += range(slots[k])
                    chosen = batch.take(pa.array(take, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(slot, pa.int32()), *chosen.columns], names=["cell", "slot", *names])

        schema = T.StructType([T.StructField("cell", T.LongType()), T.StructField("slot", T.IntegerType()), *queries.schema.fields])
        return queries.mapInArrow(run, schema)

    def _visit(self, queries: DataFrame, home: bool, same: bool, k: int) -> DataFrame:
        """``anchor, rival, score, vec_id``: up to ``k`` hits of each query in each tree that it visits."""
        space = self.space
        # Many queries are dealt over parts, in each of which the trees that they visit are built.
        parts = ceil(queries.count() / TASK_QUERIES)
        part = F.pmod(F.xxhash64("anchor"), F.lit(max(parts, 1))).cast("int")
        routed = self.scratch.table(self._route(queries.withColumn("part", part), home))
        where = ["cell", "slot", "part"]
        asked = routed.select(*where, F.lit(1).alias("kind"), F.col("anchor").alias("vec_id"), "label", "code", "rival", "low", "high")
        none = F.lit(None).cast("long")
        built = self.members.join(routed.select(*where).distinct(), ["cell", "slot"])
        built = built.select(*where, F.lit(0).alias("kind"), "vec_id", "label", "code", none.alias("rival"), none.alias("low"), none.alias("high"))
        dealt = built.unionByName(asked).repartition(*where).sortWithinPartitions(*where, "kind", "vec_id", "rival")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, current, rows, last, scores = None, None, [], None, {}
            for batch in batches:
                out: list[tuple[int, int | None, int, int]] = []
                for r in batch.to_pylist():
                    if (r["cell"], r["slot"], r["part"]) != current:
                        current, tree, rows, last = (r["cell"], r["slot"], r["part"]), None, [], None
                    if r["kind"] == 0:
                        rows.append((r["vec_id"], r["label"], r["code"]))
                        continue
                    if tree is None:
                        ids, labels, codes = zip(*rows, strict=True)
                        tree, rows = Tree(space, np.array(ids, np.int64), np.array(labels, np.int64), matrix(codes, space.dim)), []
                    if last != r["vec_id"]:
                        last, scores, vector = r["vec_id"], {}, matrix([r["code"]], space.dim)[0]
                    q = Query(space, r["vec_id"], r["label"], vector, r["low"], r["high"], same, k)
                    out += [(r["vec_id"], r["rival"], s, found) for s, found in tree.search(q, scores)]
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "rival", "score", "vec_id"])

        return dealt.mapInArrow(run, "anchor long, rival long, score long, vec_id long")

    def best(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """``anchor, rival, rank, score, vec_id`` of the ``k`` best hits (all, if fewer) of each of ``queries``.

        A query is ``anchor`` and ``rival`` (two ids that name it), the anchor's
        ``label`` and ``code``, and a window of scores ``low`` to ``high``. Ties
        are ordered by ``vec_id``; a row never answers its own id.
        """
        order = Window.partitionBy("anchor", "rival").orderBy(F.desc("score"), "vec_id")
        home = self._visit(queries, True, same, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        home = self.scratch.table(home)
        # Where as many as wanted are at home, others must score as much as the last of them.
        least = home.where(F.col("rank") == k).select("anchor", "rival", F.col("score").alias("least"))
        narrowed = queries.join(least, ["anchor", "rival"], "left").withColumn("low", F.greatest("low", "least"))
        rest = self.scratch.table(self._visit(narrowed.select(*queries.columns), False, same, k))
        both = home.drop("rank").unionByName(rest).withColumn("rank", F.row_number().over(order))
        return both.where(F.col("rank") <= k).select("anchor", "rival", "rank", "score", "vec_id")


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, tree_rows: int | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows of ``vectors`` where ``anchors`` holds.

    The positives of an anchor are its ``positives`` best rows of the same
    label, and the negatives of a positive the ``negatives`` best rows of other
    labels that have from ``low`` to ``high`` hundredths of its score; all, if
    there are fewer. A positive of a negative score has none, one of the score 0
    those of 0. Equal scores are ordered by id. Shorter vectors count as if they
    had zeros behind. What takes part and how repeated ids count, see
    ``vectors``; an empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession)
    index = Index(scratch, rows, tree_rows)
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not index.total:
        return rows.sparkSession.createDataFrame([], names)
    chosen = index.rows.where(anchors).select(F.col("vec_id").alias("anchor"), "label", "code")
    any_score = [F.lit(x).cast("long").alias(n) for n, x in (("low", -(2**62)), ("high", 2**62))]
    near = index.best(chosen.select("anchor", F.col("anchor").alias("rival"), "label", "code", *any_score), True, positives)
    near = scratch.table(near.select("anchor", F.col("vec_id").alias("rival"), F.col("score").alias("p")))
    # In hundreds and rest, so that no product is larger than a score.
    hundreds, rest = "(p - pmod(p, 100L)) div 100", "pmod(p, 100L)"
    window = [F.expr(f"{low} * ({hundreds}) + ({low} * {rest} + 99) div 100").alias("low"), F.expr(f"{high} * ({hundreds}) + ({high} * {rest}) div 100").alias("high")]
    asked = near.join(chosen, "anchor").select("anchor", "rival", "label", "code", *window).where("low <= high")
    found = index.best(scratch.table(asked), False, negatives).join(near, ["anchor", "rival"])
    return found.select(
        F.col("anchor").alias("anchor_id"),
        F.col("rival").alias("positive_id"),
        "rank",
        F.col("vec_id").alias("negative_id"),
        F.col("p").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth id in all ``embeddings``; nulls, ties, empty and repeated rows as in ``hard_negatives`` and ``vectors``."""
    rows = vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    changed = F.when(F.col("vec_id") % CHANGED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", changed), F.col("vec_id") % ANCHORS == 0)


OP13_SQL = """
WITH sound AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
