"""Statement scores on a snapshot: Piotroski F, Altman Z, Ohlson O."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import logistic, positive_log, safe_div
from ..plans.storage import few, materialised
from ..schema import MIN_SECTOR_SIZE, SCORES, SHARE_TOLERANCE

PRIOR = "_prior"


def _c(name: str, at: str) -> Column:
    return F.col(name + at)


def revenues(at: str = "") -> Column:
    return F.coalesce(_c("Revenues", at), _c("RevenueFromContractWithCustomerExcludingAssessedTax", at), _c("SalesRevenueNet", at))


def gross_profit(at: str = "") -> Column:
    cost = F.coalesce(_c("CostOfRevenue", at), _c("CostOfGoodsAndServicesSold", at))
    return F.coalesce(_c("GrossProfit", at), revenues(at) - cost)


def shares(at: str = "") -> Column:
    return F.coalesce(_c("EntityCommonStockSharesOutstanding", at), _c("CommonStockSharesOutstanding", at), _c("WeightedAverageNumberOfSharesOutstandingBasic", at))


def total_liabilities(at: str = "") -> Column:
    return F.coalesce(_c("Liabilities", at), _c("Assets", at) - _c("StockholdersEquity", at))


def piotroski_f() -> Column:
    """Nine tests, 0 to 9; null unless all nine can be computed."""
    now, then = "", PRIOR
    roa = lambda at: safe_div(_c("NetIncomeLoss", at), _c("Assets", at))
    debt = lambda at: safe_div(_c("LongTermDebtNoncurrent", at), _c("Assets", at))
    current = lambda at: safe_div(_c("AssetsCurrent", at), _c("LiabilitiesCurrent", at))
    margin = lambda at: safe_div(gross_profit(at), revenues(at))
    turnover = lambda at: safe_div(revenues(at), _c("Assets", at))
    cash = _c("NetCashProvidedByUsedInOperatingActivities", now)
    # no tagged debt in either year counts as no increase; in one year only, unknown
    no_debt = debt(now).isNull() & debt(then).isNull() & _c("Assets", now).isNotNull() & _c("Assets", then).isNotNull()
    tests = [
        roa(now) > 0,
        cash > 0,
        roa(now) > roa(then),
        cash > _c("NetIncomeLoss", now),
        F.when(no_debt, True).otherwise(debt(now) <= debt(then)),
        current(now) > current(then),
        shares(now) <= shares(then) * (1 + SHARE_TOLERANCE),
        margin(now) > margin(then),
        turnover(now) > turnover(then),
    ]
    return sum((t.cast("double") for t in tests[1:]), tests[0].cast("double"))


def altman_z(market_cap: Column) -> Column:
    assets = _c("Assets", "")
    ebit = F.coalesce(F.col("EBIT"), F.col("NetIncomeLoss") + F.coalesce(F.col("IncomeTaxExpenseBenefit"), F.lit(0.0)) + F.coalesce(F.col("InterestExpense"), F.lit(0.0)))
    return (
        1.2 * safe_div(F.col("AssetsCurrent") - F.col("LiabilitiesCurrent"), assets)
        + 1.4 * safe_div(F.col("RetainedEarningsAccumulatedDeficit"), assets)
        + 3.3 * safe_div(ebit, assets)
        + 0.6 * safe_div(market_cap, total_liabilities())
        + 1.0 * safe_div(revenues(), assets)
    )


def ohlson_o() -> Column:
    assets, debts, income, before = F.col("Assets"), total_liabilities(), F.col("NetIncomeLoss"), F.col("NetIncomeLoss" + PRIOR)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return (
        -1.32
        - 0.407 * positive_log(assets)
        + 6.03 * safe_div(debts, assets)
        - 1.43 * safe_div(F.col("AssetsCurrent") - F.col("LiabilitiesCurrent"), assets)
        + 0.0757 * safe_div(F.col("LiabilitiesCurrent"), F.col("AssetsCurrent"))
        - 1.72 * flag(debts > assets)
        - 2.37 * safe_div(income, assets)
        - 1.83 * safe_div(F.col("NetCashProvidedByUsedInOperatingActivities"), debts)
        + 0.285 * flag((income < 0) & (before < 0))
        - 0.521 * safe_div(income - before, F.abs(income) + F.abs(before))
    )


def score(wide: DataFrame, market_cap: str = "market_cap") -> DataFrame:
    """The snapshot's rows with f_score, z_score and o_score."""
    return wide.withColumns({"f_score": piotroski_f(), "z_score": altman_z(F.col(market_cap)), "o_score": ohlson_o()})


def sector_zscore(scores: DataFrame, min_size: int = MIN_SECTOR_SIZE) -> DataFrame:
    """``<score>_z`` of rows (as_of_date, ticker, sector, scores): standardised
    by population moments within the sector if it has ``min_size`` scores and
    spread, else within the date; O changes its sign.  The date's moments are
    aggregated and joined back, so no task holds a whole date."""
    whole = materialised(scores.groupBy("as_of_date").agg(*_moments("d")))
    # rows are dealt out by date and sector only where sectors are many
    part = few(scores.groupBy("as_of_date", "sector").agg(*_moments("s")).withColumnRenamed("sector", "__sector"))
    joined = scores.join(F.broadcast(whole), "as_of_date")  # a row for each date
    out = joined.join(part.withColumnRenamed("as_of_date", "__date"), (F.col("as_of_date") == F.col("__date")) & (F.col("sector") == F.col("__sector")), "left")
    z = {}
    for c in SCORES:
        own = (F.col(f"s_n_{c}") >= min_size) & (F.col(f"s_sd_{c}") > 0)
        mean, sd = [F.when(own, F.col(f"s_{m}_{c}")).otherwise(F.col(f"d_{m}_{c}")) for m in ("mean", "sd")]
        sign = -1.0 if c == "o_score" else 1.0
        z[f"{c}_z"] = F.when(sd > 0, sign * (F.col(c) - mean) / sd)
    return out.select(*[F.col(c) for c in scores.columns], *[v.alias(k) for k, v in z.items()])


def _moments(p: str) -> list[Column]:
    out = []
    for c in SCORES:
        out += [F.avg(c).alias(f"{p}_mean_{c}"), F.stddev_pop(c).alias(f"{p}_sd_{c}"), F.count(c).alias(f"{p}_n_{c}")]
    return out


def equal_weight() -> Column:
    """Mean of the three standardised scores; all three are required."""
    return (F.col("f_score_z") + F.col("z_score_z") + F.col("o_score_z")) / 3


def default_probability() -> Column:
    return logistic(F.col("o_score"))


# The textbook screens.
SCREENS = {
    "f_high": lambda: F.col("f_score") >= 8,
    "f_low": lambda: F.col("f_score") <= 2,
    "z_safe": lambda: F.col("z_score") > 2.99,
    "z_grey": lambda: (F.col("z_score") >= 1.81) & (F.col("z_score") <= 2.99),
    "z_distress": lambda: F.col("z_score") < 1.81,
    "o_safe": lambda: F.col("o_score") < 0,
    "o_risk": lambda: F.col("o_score") > 0,
}


def apply_screens(section: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that pass every named screen; a missing score fails."""
    from ..functions.expressions import all_true

    return section.filter(all_true([SCREENS[k]() for k in keys]))


def screen_counts(panel: DataFrame) -> DataFrame:
    """Names that pass each screen at each date, in one aggregation."""
    passed = F.array(*[F.struct(F.lit(k).alias("screen"), F.coalesce(c(), F.lit(False)).alias("passed")) for k, c in SCREENS.items()])
    each = panel.select("as_of_date", F.explode(passed).alias("x"))
    return each.groupBy("x.screen", "as_of_date").agg(F.count_if("x.passed").alias("names"))


def latest_section(panel: DataFrame) -> DataFrame:
    """The panel's last date with implied default probabilities, best first."""
    last = panel.agg(F.max("as_of_date").alias("as_of_date"))
    rows = panel.join(F.broadcast(last), "as_of_date", "left_semi")  # one row
    return rows.withColumn("p_default", F.round(default_probability(), 4)).orderBy(F.col("composite_score").desc_nulls_last(), "ticker")


def coverage(panel: DataFrame) -> DataFrame:
    """Names, fully scored names and missing scores per date."""
    full = F.col("f_score").isNotNull() & F.col("z_score").isNotNull() & F.col("o_score").isNotNull()
    return panel.groupBy("as_of_date").agg(F.count(F.lit(1)).alias("names"), F.count_if(full).alias("fully_scored"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in SCORES])


def tag_coverage(wide: DataFrame, tags: list[str]) -> DataFrame:
    """Share of snapshot rows that have each tag."""
    return wide.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).isNotNull().cast("double").alias("has")) for t in tags])).alias("x")).groupBy("x.tag").agg(F.avg("x.has").alias("coverage"))


def with_market_cap(wide: DataFrame, prices: DataFrame, dates: list[dt.date]) -> DataFrame:
    """``market_cap``: shares times the close of the last calendar month-end on
    or before the date (of ``dates``); that month's missing close is not filled
    from before."""
    from ..functions.expressions import month_index

    at = F.when(F.last_day("as_of_date") == F.col("as_of_date"), F.col("as_of_date")).otherwise(F.last_day(F.add_months("as_of_date", -1)))
    months = {12 * d.year + d.month - ((d + dt.timedelta(days=1)).month == d.month) for d in dates}
    prices = prices.filter(month_index(F.col("month_end")).isin(sorted(months)))
    close = prices.select(F.col("ticker").alias("__ticker"), month_index(F.col("month_end")).alias("__month"), F.col("close").alias("__close"))
    joined = wide.join(close, (F.col("ticker") == F.col("__ticker")) & (month_index(at) == F.col("__month")), "left")
    return joined.withColumn("market_cap", shares() * F.col("__close")).drop("__ticker", "__month", "__close")


