"""Exact quantiles of groups of any size, by ranks within ranges of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group's values are cut into.
RANGES = 64


def exact_quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """``group`` and a column for each of ``shares``: the quantile between the two neighbouring values.

    Equal values are counted first. Approximate quantiles cut a group's values
    into ranges; sums of the ranges' counts tell in which of them a wanted rank
    lies, and only there values are sorted. So a task holds one range of a
    group, a ``ranges``-th of its different values. Nulls, of values and of
    groups, take no part; a group without a value has no row.
    """
    counted = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("many"))
    edges = F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 1000)
    cuts = counted.groupBy(group).agg(edges.alias("edges"), F.sum("many").alias("all"))
    # Ranks from 0 on, two for each share.
    ends = [f(F.lit(q) * (F.col("all") - 1)).cast("long") for q in shares.values() for f in (F.floor, F.ceil)]
    cuts = cuts.withColumn("ranks", F.array_distinct(F.array(*ends)))
    placed = counted.join(cuts.select(group, "edges"), group).withColumn("range", F.size(F.filter("edges", lambda e: e < F.col(value)))).drop("edges")
    sums = placed.groupBy(group, "range").agg(F.sum("many").alias("held"))
    before = F.sum("held").over(Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(cuts.select(group, "ranks"), group)
    within = F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("held")))
    hit = sums.select(group, "range", "before", within.alias("ranks")).where(F.size("ranks") > 0)
    upto = F.sum("many").over(Window.partitionBy(group, "range").orderBy(value))
    sorted_ = placed.join(hit, [group, "range"]).withColumn("upto", F.col("before") + upto)
    own = F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("many")) & (r < F.col("upto")))
    found = sorted_.select(group, value, F.explode(own).alias("rank"))
    values = found.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("rank", value))).alias("at")).join(cuts.select(group, "all"), group)

    def quantile(q: float):
        place = F.lit(q) * (F.col("all") - 1)
        low, high = (F.element_at("at", f(place).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    return values.select(group, *[quantile(q).alias(name) for name, q in shares.items()])
