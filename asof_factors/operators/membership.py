"""Membership episodes (ticker, start_date, end_date): start inclusive, end exclusive, null open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import many


def members_on(rows: DataFrame, membership: DataFrame, on: str = "as_of_date") -> DataFrame:
    """Rows whose ticker was a member on the row's date."""
    m = membership.select(F.col("ticker").alias("__t"), "start_date", "end_date")
    inside = (F.col("ticker") == F.col("__t")) & (F.col("start_date").isNull() | (F.col("start_date") <= F.col(on))) & (F.col("end_date").isNull() | (F.col("end_date") > F.col(on)))
    return rows.join(many(m), inside, "left_semi")


def episodes(membership: DataFrame) -> DataFrame:
    """``__episodes`` of each ticker, a row for each."""
    return membership.groupBy("ticker").agg(F.collect_list(F.struct("start_date", "end_date")).alias("__episodes"))


def member_on(day: Column) -> Column:
    """Whether one of the ``__episodes`` holds the day."""
    inside = lambda e: (e["start_date"].isNull() | (e["start_date"] <= day)) & (e["end_date"].isNull() | (e["end_date"] > day))
    return F.coalesce(F.exists("__episodes", inside), F.lit(False))


def removed_by_membership(panel: DataFrame, membership: DataFrame) -> DataFrame:
    """Per date: rows that the gate removes, and how many of them had a score."""
    m = membership.select(F.col("ticker").alias("__t"), "start_date", "end_date")
    inside = (F.col("ticker") == F.col("__t")) & (F.col("start_date").isNull() | (F.col("start_date") <= F.col("as_of_date"))) & (F.col("end_date").isNull() | (F.col("end_date") > F.col("as_of_date")))
    gone = panel.join(many(m), inside, "left_anti")
    return gone.groupBy("as_of_date").agg(F.count(F.lit(1)).alias("removed"), F.count("f_score").alias("with_score"))


def build_membership(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Current members start at their latest addition; each removal of a name
    that is not a member now ends an episode of unknown start.  ``changes``:
    date, added, removed."""
    added = changes.filter(F.col("added").isNotNull()).groupBy(F.col("added").alias("ticker")).agg(F.max("date").alias("start_date"))
    now = current.select("ticker").distinct().join(added, "ticker", "left").withColumn("end_date", F.lit(None).cast("date"))
    gone = changes.filter(F.col("removed").isNotNull()).select(F.col("removed").alias("ticker"), F.lit(None).cast("date").alias("start_date"), F.col("date").alias("end_date"))
    return now.unionByName(gone.join(current.select("ticker").distinct(), "ticker", "left_anti"))


def listing_membership(listings: DataFrame) -> DataFrame:
    """Members since their first annual filing."""
    return listings.select("ticker", F.col("first_filing").alias("start_date"), F.lit(None).cast("date").alias("end_date"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names in both universes, and in either alone."""
    x, y = a.select("ticker").distinct(), b.select("ticker").distinct()
    sides = x.withColumn("side", F.lit(1)).unionByName(y.withColumn("side", F.lit(2))).groupBy("ticker").agg(F.sum("side").alias("sides"))
    return sides.agg(F.count_if(F.col("sides") == 3).alias("both"), F.count_if(F.col("sides") == 1).alias("only_a"), F.count_if(F.col("sides") == 2).alias("only_b"))
