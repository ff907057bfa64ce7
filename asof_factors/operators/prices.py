"""Month-end prices in long form (ticker, month_end, close) and returns.

Returns never bridge a missing month: neighbours are looked up by calendar
month, not by row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import month_index


def month_ends(start: dt.date, end: dt.date) -> list[dt.date]:
    """Calendar month-ends from start to end."""
    out, y, m = [], start.year, start.month
    while True:
        y, m = (y, m + 1) if m < 12 else (y + 1, 1)
        last = dt.date(y, m, 1) - dt.timedelta(days=1)
        if last > end:
            return out
        out.append(last)


def strip_suffix(daily: DataFrame, suffix: str) -> DataFrame:
    """(symbol, date, close) with the vendor's market suffix taken off."""
    return daily.withColumn("ticker", F.regexp_replace("symbol", F.lit(suffix.replace(".", r"\.") + "$"), F.lit("")) if suffix else F.col("symbol")).drop("symbol")


def month_end_closes(daily: DataFrame) -> DataFrame:
    """Last close of each month; a close of exactly zero is missing."""
    d = daily.withColumn("close", F.nullif("close", F.lit(0.0))).filter(F.col("close").isNotNull())
    return d.groupBy("ticker", F.last_day("date").alias("month_end")).agg(F.max_by("close", "date").alias("close"))


def complete_grid(closes: DataFrame, tickers: DataFrame, months: list[dt.date]) -> DataFrame:
    """Every asked ticker in every month, with nulls where it has no price."""
    spine = tickers.select("ticker").distinct().select("ticker", F.explode(F.array(*[F.lit(m) for m in months])).alias("month_end"))
    return spine.join(closes, ["ticker", "month_end"], "left")


def priced_tickers(prices: DataFrame) -> DataFrame:
    return prices.filter(F.col("close").isNotNull()).select("ticker").distinct()


def _by_month(order: str = "m"):
    return Window.partitionBy("ticker").orderBy(order)


def monthly_returns(prices: DataFrame) -> DataFrame:
    """``ret`` since the month before; null if either close is missing."""
    w = _by_month()
    p = prices.withColumn("m", month_index(F.col("month_end")))
    before = F.when(F.lag("m").over(w) == F.col("m") - 1, F.lag("close").over(w))
    return p.withColumn("ret", F.col("close") / before - 1).drop("m")


def forward_returns(prices: DataFrame, ks: list[int]) -> DataFrame:
    """``fwd_<k>m``: compounded monthly returns over the next k months, null if
    any is missing."""
    r = monthly_returns(prices).withColumn("m", month_index(F.col("month_end")))
    out = {f"fwd_{k}m": _compounded(k) for k in ks}
    return r.withColumns(out).drop("m")


def _compounded(k: int) -> Column:
    w = _by_month().rangeBetween(1, k)
    return F.when(F.count("ret").over(w) == k, F.product(1 + F.col("ret")).over(w) - 1)


def forward_total_return(prices: DataFrame, months: int) -> DataFrame:
    """``fwd_<n>m``: close n months ahead over the close now."""
    p = prices.withColumn("m", month_index(F.col("month_end")))
    later = F.max("close").over(_by_month().rangeBetween(months, months))
    return p.withColumn(f"fwd_{months}m", later / F.col("close") - 1).drop("m")


def drawdowns(prices: DataFrame, fall: float = -0.7, recovery: float = 0.5) -> DataFrame:
    """Per name the worst fall from a running peak, and whether a name that
    fell below ``fall`` later regained ``recovery`` of that peak."""
    w = _by_month("month_end")
    p = prices.filter(F.col("close").isNotNull())
    p = p.withColumn("peak", F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("later_max", F.max("close").over(w.rowsBetween(1, Window.unboundedFollowing)))
    p = p.withColumn("drawdown", F.col("close") / F.col("peak") - 1)
    back = (F.col("drawdown") < fall) & (F.col("later_max") > recovery * F.col("peak"))
    return p.groupBy("ticker").agg(F.min("drawdown").alias("worst"), F.max(F.coalesce(back, F.lit(False))).alias("recovered"))


def liquid_universe(daily: DataFrame, min_days: int, top: int) -> DataFrame:
    """The ``top`` names by median daily traded value (close times volume)
    among those with ``min_days`` trading days."""
    value = daily.groupBy("ticker").agg(F.median(F.col("close") * F.col("volume")).alias("median_value"), F.count(F.lit(1)).alias("days"))
    return value.filter(F.col("days") >= min_days).orderBy(F.desc("median_value"), "ticker").limit(top)
