"""As-of operators over the bitemporal fact table.

Availability is the filing date, never the period end.  Many as-of dates are
answered in one plan: every fact is valid from its filing until the next
filing of the same (ticker, tag, period), so each date takes the facts whose
interval holds it.  Of facts that are dealt out by ticker, no window or
aggregation of a snapshot moves any again.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialised
from ..schema import ANNUAL_FORM_PREFIXES, ANNUAL_FORMS, FILING_TOLERANCE_DAYS, FLOW_TAGS, MIN_ANNUAL_DAYS, TAGS


def newest_first() -> list[Column]:
    """Total order of filings of one period: what is known last comes first."""
    return [F.desc("filed_date"), F.col("start_date").desc_nulls_last(), F.asc("unit"), F.desc("value")]


def oldest_first() -> list[Column]:
    return [F.asc("filed_date"), F.col("start_date").asc_nulls_first(), F.desc("unit"), F.asc("value")]


def annual_filter() -> Column:
    """Flow facts of a year's duration; instant facts of annual forms."""
    flow = F.col("tag").isin(FLOW_TAGS)
    year = F.col("start_date").isNotNull() & (F.datediff("fiscal_period_end", "start_date") >= MIN_ANNUAL_DAYS)
    form = reduce(lambda a, b: a | b, [F.col("form").like(f"{p}%") for p in ANNUAL_FORM_PREFIXES], F.col("form").isin(*ANNUAL_FORMS))
    return flow & year | ~flow & form


def restrict(facts: DataFrame, tickers: DataFrame | None = None, tags: list[str] | None = None) -> DataFrame:
    """Facts of some tickers (a table with ``ticker``, any case) and tags."""
    if tags is not None:
        facts = facts.filter(F.col("tag").isin(tags))
    if tickers is not None:
        facts = facts.join(tickers.select(F.upper("ticker").alias("ticker")).distinct(), "ticker", "left_semi")
    return facts


def flag_restatements(facts: DataFrame) -> DataFrame:
    """A fact is a restatement if its period was filed before."""
    first = F.min("filed_date").over(Window.partitionBy("cik", "tag", "fiscal_period_end"))
    return facts.withColumn("is_restatement", F.col("filed_date") > first)


def latest_filings(facts: DataFrame, as_of: dt.date) -> DataFrame:
    """The filing of each (ticker, tag, period) that was known last on a date."""
    w = Window.partitionBy("ticker", "tag", "fiscal_period_end").orderBy(*newest_first())
    known = facts.filter(F.col("filed_date") <= F.lit(as_of)).withColumn("rn", F.row_number().over(w))
    return known.filter("rn = 1").drop("rn")


def _ranked(facts: DataFrame, keys: list[str]) -> DataFrame:
    """``place``: of the filings of one key, later periods and then later
    filings have larger ones."""
    order = Window.partitionBy(*keys).orderBy(F.asc("fiscal_period_end"), *oldest_first())
    return facts.withColumn("place", F.row_number().over(order))


def _answered(requests: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Requests and filings of a key in one sequence by date; each request
    takes the filing of the largest place so far.  Nothing is joined, so the
    work is that of sorting both sides once."""
    known = _ranked(facts, keys).select(*keys, F.col("filed_date").alias("at"), F.lit(0).alias("asks"), F.struct("place", "value").alias("known"), F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"))
    asked = requests.select(*keys, F.col("as_of_date").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast(known.schema["known"].dataType).alias("known"), "request_id")
    # dealt out by ticker as facts are, so that the sequence moves none of these
    asked = asked.repartition(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ticker")
    so_far = Window.partitionBy(*keys).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = known.unionByName(asked).withColumn("last", F.max("known").over(so_far))
    return both.filter("asks = 1").select("request_id", "ticker", "tag", F.col("at").alias("as_of_date"), F.col("last.value").alias("value"))


def lookup(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Batch of as-of lookups: ``requests`` (request_id, ticker, tag,
    as_of_date and, optionally, fiscal_period_end to pin a period) with the
    ``value`` known on the date: latest period, then latest filing; null if
    nothing was known."""
    pin = ["fiscal_period_end"] if "fiscal_period_end" in requests.columns else []
    r = requests.select("request_id", F.upper("ticker").alias("ticker"), "tag", "as_of_date", *pin)
    f = facts.select("ticker", "tag", "fiscal_period_end", "filed_date", "start_date", "unit", "value")
    if not pin:
        return _answered(r, f, ["ticker", "tag"])
    r = materialised(r)
    free, kept = r.filter("fiscal_period_end IS NULL"), r.filter("fiscal_period_end IS NOT NULL")
    out = _answered(kept, f, ["ticker", "tag", "fiscal_period_end"])
    # all facts go through a sequence, so there is none without requests
    return out if free.isEmpty() else out.unionByName(_answered(free, f, ["ticker", "tag"]))


def _dates_before(day: Column, dates: list[dt.date]) -> Column:
    """How many of the sorted dates lie before a day: looked up by the day's
    distance from the first, so that no fact is compared with every date."""
    span = (dates[-1] - dates[0]).days + 1
    at, counts = 0, []
    for k in range(span + 1):
        while at < len(dates) and dates[at] < dates[0] + dt.timedelta(days=k):
            at += 1
        counts.append(at)
    table = F.split(F.lit(",".join(map(str, counts))), ",").cast("array<int>")
    return F.get(table, F.greatest(F.lit(0), F.least(F.lit(span), F.datediff(day, F.lit(dates[0])))))


def _held(facts: DataFrame, dates: list[dt.date], tags: list[str], periods: int = 2) -> tuple[DataFrame, Column]:
    """ticker, tag and its number in ``tags`` (``__tag``), fiscal_period_end,
    value and as_of_date of what each date takes, and the rank of the period.

    A filing is valid until the next one of its period, and no longer than
    until ``periods`` later periods are known, so that a date meets no more
    than ``periods`` filings of a ticker and tag."""
    annual = facts.filter(F.col("tag").isin(tags) & annual_filter())
    # later periods come first in both windows, so that one sort does for them
    number = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag")).cast("int")
    annual = annual.withColumns({"__tag": number, "__period": F.coalesce(-F.unix_date("fiscal_period_end").cast("long"), F.lit(1 << 40))})
    period = Window.partitionBy("ticker", "__tag", "__period")
    following = F.lead("filed_date").over(period.orderBy(*oldest_first()))
    later = Window.partitionBy("ticker", "__tag").orderBy("__period").rangeBetween(Window.unboundedPreceding, -1)
    dates = sorted(dates)
    calendar = F.array(*[F.lit(d) for d in dates])
    start = _dates_before(F.col("filed_date"), dates) if dates else F.lit(0)
    end = F.coalesce(_dates_before(F.col("until"), dates), F.lit(len(dates))) if dates else F.lit(0)
    held = F.slice(calendar, F.col("__start") + 1, F.greatest(F.col("__end") - F.col("__start"), F.lit(0)))
    valid = annual.withColumns({"next": following, "first_filed": F.min("filed_date").over(period)})
    # the k-th of the later periods to be known: at each of them the later of its own
    # first filing and the (k-1)-th known among those after it, the least of these
    for k in range(1, periods + 1):
        seen = F.when(F.col(f"known_{k - 1}").isNotNull(), F.greatest("first_filed", f"known_{k - 1}")) if k > 1 else F.col("first_filed")
        valid = valid.withColumn(f"known_{k}", F.min(seen).over(later))
    valid = valid.withColumn("until", F.least("next", f"known_{periods}"))
    before = [f"known_{k}" for k in range(1, periods)]
    valid = valid.withColumns({"__start": start, "__end": end}).filter("__start < __end")
    each = valid.select("ticker", "tag", "fiscal_period_end", "value", "__tag", *before, F.explode(held).alias("as_of_date"))
    # later periods that were known on the date, so that the unfolded rows are not sorted
    rank = sum(((F.coalesce(F.col(k) <= F.col("as_of_date"), F.lit(False))).cast("int") for k in before), F.lit(1))
    return each, rank


def snapshot_long(facts: DataFrame, dates: list[dt.date], tags: list[str] = TAGS, periods: int = 2) -> DataFrame:
    """as_of_date, ticker, tag, period_rank (1: latest annual period known),
    fiscal_period_end and value, for every date."""
    each, rank = _held(facts, dates, tags, periods)
    return each.select("ticker", "tag", "fiscal_period_end", "value", "as_of_date", rank.alias("period_rank"))


def snapshot(facts: DataFrame, dates: list[dt.date], tags: list[str] = TAGS) -> DataFrame:
    """One row per (as_of_date, ticker): each tag's latest annual value known,
    ``<tag>_prior`` its value one period earlier, and fiscal_period_end, the
    latest period of any tag."""
    each, rank = _held(facts, dates, tags)
    found = each.select("ticker", "fiscal_period_end", "value", "as_of_date", (2 * F.col("__tag") + rank).alias("__at"))
    pick = lambda k, rank: F.max(F.when(F.col("__at") == 2 * (k + 1) + rank, F.col("value")))
    columns = [pick(k, 1).alias(t) for k, t in enumerate(tags)] + [pick(k, 2).alias(f"{t}_prior") for k, t in enumerate(tags)]
    last = F.max(F.when(F.col("__at") % 2 == 1, F.col("fiscal_period_end"))).alias("fiscal_period_end")
    return found.groupBy("as_of_date", "ticker").agg(last, *columns)


def complete(wide: DataFrame, tickers: DataFrame, dates: list[dt.date]) -> DataFrame:
    """Every asked ticker at every date, with nulls where nothing was known."""
    spine = tickers.select(F.upper("ticker").alias("ticker")).distinct().select("ticker", F.explode(F.array(*[F.lit(d) for d in dates])).alias("as_of_date"))
    return spine.join(wide, ["as_of_date", "ticker"], "left")


def restated(facts: DataFrame) -> DataFrame:
    """Periods filed more than once with different values: the original, the
    final value and when each was filed."""
    order = F.struct("filed_date", "value")
    out = facts.groupBy("ticker", "tag", "fiscal_period_end").agg(
        F.count_distinct("value").alias("n_values"),
        F.min("filed_date").alias("first_filed"),
        F.max("filed_date").alias("last_filed"),
        F.min_by("value", order).alias("original_value"),
        F.max_by("value", order).alias("final_value"),
    )
    return out.filter("n_values > 1 AND first_filed < last_filed")


def first_filing_after(periods: DataFrame, filings: DataFrame, key: str, tolerance_days: int = FILING_TOLERANCE_DAYS) -> DataFrame:
    """``periods`` (key, period_end, ...) with ``filed_date``, the first filing
    strictly after the period's end; a later one than the tolerance is no
    match, and an earlier filing beyond it does not make way for another."""
    f, ends = filings.select(key, "filed_date"), periods.select(key, "period_end").distinct()
    first = ends.join(f, key).filter(F.col("filed_date") > F.col("period_end")).groupBy(key, "period_end").agg(F.min("filed_date").alias("filed_date"))
    return periods.join(first.filter(F.datediff("filed_date", "period_end") <= tolerance_days), [key, "period_end"])


def filing_lags(facts: DataFrame) -> DataFrame:
    """Days from period end to filing, by tag."""
    days = F.datediff("filed_date", "fiscal_period_end")
    return facts.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min(days).alias("min_days"), F.percentile(days, F.lit(0.5)).alias("median_days"), F.max(days).alias("max_days"))


def identity_gaps(wide: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Snapshot rows whose assets differ from liabilities plus equity."""
    gap = F.abs(F.col("Assets") - F.col("Liabilities") - F.col("StockholdersEquity")) / F.nullif(F.abs("Assets"), F.lit(0.0))
    return wide.select("as_of_date", "ticker", gap.alias("gap")).filter(F.col("gap") > tolerance)
