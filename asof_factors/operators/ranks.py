"""Exact ranks within groups of any size, without a task for each group.

Rows are dealt out by ranges of (group, order) and sorted there; a row's rank is
its place in its range plus the group's rows in the ranges before.  Only a row
for each group and range that it meets is summed up over ranges, so a group
that holds all rows is ranked by all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialised


def exact_ranks(rows: DataFrame, keys: list[str], order: list[str], rank: str = "rank", size: str = "group_size") -> DataFrame:
    """``rows`` with ``rank`` (1: first by ``order``) and the group's ``size``.
    Null keys are a group like others; nulls come first in an order."""
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # the id holds the number of the range and the place in it; written once, as
    # ranges may be drawn anew when they are computed again
    placed = materialised(dealt.withColumns({"__at": F.monotonically_increasing_id()}).withColumn("__range", F.shiftright("__at", 33)))
    met = placed.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    # a row for each group and range: groups plus ranges at most
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = met.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), size: F.sum("__n").over(Window.partitionBy(*keys))})
    offsets = offsets.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__range").alias("__r"), "__first", "__before", size)
    same = F.col("__range") == F.col("__r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = placed.join(F.broadcast(offsets), same)
    return out.select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias(rank), size)


def mean_ranks(rows: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """``rows`` with the rank of ``column`` as a double; equal values take the
    mean of their ranks."""
    ranked = exact_ranks(rows, keys, [column], "__rank", "__size")
    ties = ranked.groupBy(*keys, column).agg(((F.min("__rank") + F.max("__rank")) / 2.0).alias(out))
    return ranked.drop("__rank", "__size").join(ties, [*keys, column])
