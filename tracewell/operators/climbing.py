"""Climbing forests by pointer doubling: as many rounds as the logarithm of the depth.

Nodes are ``session_id``, an id and the id of a parent in the same session, null
at the top. Each round every node's pointer goes twice as far up. A parent that
is not among the nodes raises, and so does a cycle, whose pointers never end.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.lineage import cut


def checked(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """``edges`` at hand in a table, with ``up``; raises where a parent is missing."""
    held = cut(edges.withColumn("up", F.col(parent)))
    there = held.select("session_id", F.col(node).alias("up"))
    lost = held.where("up IS NOT NULL").join(there, ["session_id", "up"], "left_anti").select("session_id", node, "up").limit(1).collect()
    if lost:
        raise ValueError(f"{lost[0][1]} of session {lost[0][0]} has a parent {lost[0][2]} that is not there")
    return held


def doubled(held: DataFrame, node: str, step: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``held`` after rounds of ``step``, which is given the rows and how far their ``up`` now reaches, and returns them with ``up`` twice as far."""
    most, reach = ceil(log2(held.count() + 1)) + 1, 1
    while not held.where("up IS NOT NULL").isEmpty():
        if reach > 2**most:
            raise ValueError("parents form a cycle")
        held, reach = cut(step(held, reach)), 2 * reach
    return held.drop("up")


def above(held: DataFrame, node: str, *more: str) -> DataFrame:
    """What a row's pointer points at: its own ``up`` as ``further``, and columns ``more`` as ``up_<name>``."""
    return held.select("session_id", F.col(node).alias("up"), F.col("up").alias("further"), *[F.col(c).alias(f"up_{c}") for c in more])


def heights(edges: DataFrame, node: str = "run_id", parent: str = "parent_id") -> DataFrame:
    """Add ``height``: how far below a node its farthest descendant is."""

    def step(held: DataFrame, reach: int) -> DataFrame:
        raised = held.where("up IS NOT NULL").groupBy("session_id", F.col("up").alias(node)).agg((F.max("height") + reach).alias("over"))
        out = held.join(raised, ["session_id", node], "left").withColumn("height", F.greatest("height", F.coalesce("over", F.lit(0)))).drop("over")
        return out.join(above(held, node), ["session_id", "up"], "left").withColumn("up", F.col("further")).drop("further")

    return doubled(checked(edges, node, parent).withColumn("height", F.lit(0)), node, step)


def ancestry(edges: DataFrame, node: str = "run_id", parent: str = "parent_id") -> DataFrame:
    """(session, node, ancestor, distance) for every node and all above it."""
    held = checked(edges, node, parent).select("session_id", node, "up")
    pairs = [held.where("up IS NOT NULL").select("session_id", node, F.col("up").alias("ancestor"), F.lit(1).alias("distance"))]

    def step(rows: DataFrame, reach: int) -> DataFrame:
        beyond = pairs[-1].select("session_id", F.col(node).alias("up"), "ancestor", (F.col("distance") + reach).alias("distance"))
        pairs.append(cut(pairs[-1].unionByName(rows.join(beyond, ["session_id", "up"]).select("session_id", node, "ancestor", "distance"))))
        return rows.join(above(rows, node), ["session_id", "up"], "left").select("session_id", node, F.col("further").alias("up"))

    doubled(held, node, step)
    return pairs[-1]


def paths(edges: DataFrame, node: str = "item_id", parent: str = "parent_id") -> DataFrame:
    """Add ``path``: the ``step`` of all above a node and its own, from the top down, which sorts a session's nodes in preorder."""

    def step(held: DataFrame, reach: int) -> DataFrame:
        out = held.join(above(held, node, "path"), ["session_id", "up"], "left")
        return out.withColumns({"path": F.concat_ws("/", "up_path", "path"), "up": F.col("further")}).drop("up_path", "further")

    return doubled(checked(edges, node, parent).withColumn("path", F.col("step")), node, step)
