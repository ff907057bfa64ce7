"""End-to-end jobs: panel, backtest, screen run, validation, reports."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import composite, portfolios, seriesstats
from ..operators.asof import complete, snapshot
from ..operators.membership import episodes, member_on
from ..operators.prices import forward_returns, forward_total_return, priced_tickers
from ..operators.scores import equal_weight, score, sector_zscore, with_market_cap
from .storage import many, materialised
from ..schema import FEATURES, FORWARD_MONTHS, MIN_STATS_MONTHS, MIN_TRAIN_MONTHS, N_BUCKETS, ROLLING_WINDOW, SCORES, TAGS, Universe


def scores_panel(facts: DataFrame, prices: DataFrame, sectors: DataFrame, dates: list[dt.date], membership: DataFrame | None = None, tags: list[str] = TAGS) -> DataFrame:
    """One row per date and ticker that was ever priced: scores, scores
    standardised within sector, sector, next month's return and the next half
    year's return less the date's mean."""
    rows = scored_rows(facts, prices, sectors, dates, membership, tags)
    return standardised(rows if membership is None else rows.filter("__member"))


def twin_panels(facts: DataFrame, prices: DataFrame, sectors: DataFrame, dates: list[dt.date], membership: DataFrame) -> dict[str, DataFrame]:
    """The panel of all names and that of members, from one table of scores."""
    rows = scored_rows(facts, prices, sectors, dates, membership)
    return {"static": standardised(rows), "corrected": standardised(rows.filter("__member"))}


def scored_rows(facts: DataFrame, prices: DataFrame, sectors: DataFrame, dates: list[dt.date], membership: DataFrame | None = None, tags: list[str] = TAGS) -> DataFrame:
    """Scores, sector, returns ahead and, with ``membership``, whether the
    ticker was a member on the date: the one table on disk that a panel is
    made from.  Facts and prices that are dealt out by ticker stay where they
    are until it is written."""
    wide = complete(snapshot(facts, dates, tags), priced_tickers(prices), dates)
    scored = score(with_market_cap(wide, prices, dates)).select("as_of_date", "ticker", *SCORES)
    rows = scored.join(many(sectors), "ticker", "left")
    ahead = forward_total_return(forward_returns(prices, [1]), FORWARD_MONTHS)
    ahead = ahead.filter(F.col("month_end").isin(dates)).select("ticker", F.col("month_end").alias("as_of_date"), F.col("fwd_1m").alias("fwd_ret_1m"), F.col(f"fwd_{FORWARD_MONTHS}m").alias("__half"))
    rows = rows.join(many(ahead), ["as_of_date", "ticker"], "left")
    if membership is not None:
        rows = rows.join(many(episodes(membership)), "ticker", "left").withColumn("__member", member_on(F.col("as_of_date"))).drop("__episodes")
    return materialised(rows)


def standardised(rows: DataFrame) -> DataFrame:
    """The panel of scored rows; only a row for each date, and for each date
    and sector, is made beside them."""
    mean = materialised(rows.groupBy("as_of_date").agg(F.avg("__half").alias("__mean")))
    out = sector_zscore(rows).join(F.broadcast(mean), "as_of_date")  # a row for each date
    return out.withColumn("fwd_ret_demeaned", F.col("__half") - F.col("__mean")).select("as_of_date", "ticker", *SCORES, "sector", *FEATURES, "fwd_ret_1m", "fwd_ret_demeaned")


def backtest(panel: DataFrame, n: int = N_BUCKETS, refit_every: int = 12, least_months: int = MIN_TRAIN_MONTHS, digits: int | None = None) -> dict[str, DataFrame]:
    """Panel with composite scores (rounded to ``digits``, which settles ties
    that differ by the order of sums), buckets, bucket returns and coefficients."""
    blended, coefficients = composite.walk_forward(panel, refit_every, least_months)
    if digits is not None:
        blended = blended.withColumn("composite_score", F.round("composite_score", digits))
    bucketed = portfolios.form_buckets(blended, "composite_score", n)
    return {"panel": bucketed, "bucket_returns": portfolios.bucket_returns(bucketed), "coefficients": coefficients}


def screen_run(panel: DataFrame, n: int = N_BUCKETS) -> DataFrame:
    """Equal-weight composite and buckets: no model, no validation."""
    return portfolios.form_buckets(panel.withColumn("composite_score", equal_weight()), "composite_score", n)


def validation_series(bucketed: DataFrame, n: int = N_BUCKETS) -> DataFrame:
    """Spread series of the composite and of each score alone."""
    own = portfolios.spread(bucketed, n).select(F.lit("composite").alias("strategy"), "as_of_date", "spread")
    single = portfolios.single_score_spreads(bucketed, FEATURES, n).select("strategy", "as_of_date", "spread")
    both = own.unionByName(single).filter(F.col("spread").isNotNull())
    return both.select("strategy", F.col("as_of_date").alias("date"), F.col("spread").alias("ret"))


def validate(bucketed: DataFrame, n: int = N_BUCKETS, least: int = 24) -> DataFrame:
    return seriesstats.series_stats(validation_series(bucketed, n), ["strategy"], least=least)


def sink(tables: dict[str, DataFrame], universe: Universe, folder: str) -> None:
    """Results side by side: every table partitioned by universe and mode; a
    rerun replaces its own partition only."""
    for name, df in tables.items():
        marked = df.withColumns({"universe": F.lit(universe.name), "mode": F.lit(universe.mode)})
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("universe", "mode").parquet(f"{folder}/{name}")


def write_summary(summary: DataFrame, universe: Universe, folder: str) -> None:
    summary.withColumns({"universe": F.lit(universe.name), "mode": F.lit(universe.mode)}).write.mode("overwrite").option("header", True).csv(f"{folder}/summary/{universe.name}-{universe.mode}")


def replace_facts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after a load: the keys' old facts give way to the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def run(universe: Universe, facts: DataFrame, prices: DataFrame, sectors: DataFrame, dates: list[dt.date], membership: DataFrame | None = None, **model: int) -> dict[str, DataFrame]:
    """A universe's backtest; its corrected twin ranks members only."""
    gate = membership if universe.corrected else None
    panel = scores_panel(facts, prices, sectors, dates, gate)
    if not universe.backtestable:
        done = screen_run(panel, universe.n_buckets)
        return {"panel": done, "bucket_returns": portfolios.bucket_returns(done)}
    return backtest(panel, universe.n_buckets, **model)


def available_runs(spark: SparkSession, folder: str) -> DataFrame:
    """universe, mode, rows, dates and time of writing of the runs in a sink,
    found by their partitions."""
    p = spark.read.parquet(f"{folder}/panel").select("universe", "mode", "as_of_date", F.col("_metadata.file_modification_time").alias("written"))
    return p.groupBy("universe", "mode").agg(F.count(F.lit(1)).alias("n_rows"), F.min("as_of_date").alias("first_date"), F.max("as_of_date").alias("last_date"), F.max("written").alias("panel_at"))


def run_overview(spark: SparkSession, folder: str) -> DataFrame:
    """The composite's verdict of each run in a sink, and whether it is older
    than the run's panel."""
    s = spark.read.parquet(f"{folder}/summary").withColumn("run_at", F.col("_metadata.file_modification_time")).filter(F.col("strategy") == "composite")
    return available_runs(spark, folder).join(s, ["universe", "mode"]).withColumn("stale", F.col("run_at") < F.col("panel_at"))


def validation_job(bucketed: DataFrame, n: int = N_BUCKETS, window: int = ROLLING_WINDOW, least: int = MIN_STATS_MONTHS) -> dict[str, DataFrame]:
    """Summary and rolling hurdle table of all strategies, from one series
    table that is made once."""
    series = materialised(validation_series(bucketed, n))
    return {"summary": seriesstats.series_stats(series, ["strategy"], least=least), "rolling": seriesstats.rolling_hurdle(series, ["strategy"], window=window)}


def compare_runs(runs: dict[str, DataFrame], n: int = N_BUCKETS) -> DataFrame:
    """Compounded spreads of several bucketed panels, each from its first date."""
    long = [portfolios.spread(p, n).select(F.lit(k).alias("run"), F.col("as_of_date").alias("date"), F.col("spread").alias("ret")) for k, p in runs.items()]
    return seriesstats.compounded(reduce(DataFrame.unionByName, long), ["run"])


def twin_correlation(static: DataFrame, corrected: DataFrame) -> DataFrame:
    """Correlation and mean difference of two runs' spreads by strategy
    (strategy, date, ret)."""
    c = corrected.withColumnRenamed("ret", "ret_c")
    return static.join(c, ["strategy", "date"]).groupBy("strategy").agg(F.corr("ret", "ret_c").alias("corr"), F.avg(F.col("ret_c") - F.col("ret")).alias("mean_delta"), F.count(F.lit(1)).alias("n"))


def costs_input(bucketed: DataFrame, n: int = N_BUCKETS) -> DataFrame:
    """date, ret and traded (twice the turnover of both legs) of the spread."""
    legs = portfolios.turnover(bucketed, n).groupBy("as_of_date").agg(F.count("turnover").alias("k"), F.sum("turnover").alias("t"))
    # a date where a leg has no previous book pays nothing
    traded = F.when(F.col("k") == 2, 2 * F.col("t"))
    s = portfolios.spread(bucketed, n)
    return s.join(legs.select("as_of_date", traded.alias("traded")), "as_of_date", "left").select(F.col("as_of_date").alias("date"), F.col("spread").alias("ret"), "traded")


def leg_table(bucketed: DataFrame, n: int = N_BUCKETS, least: int = 24) -> DataFrame:
    """Statistics of the spread, of its legs against the market and of the
    raw series, whose Sharpe ratios are not tested."""
    legs = portfolios.leg_decomposition(bucketed, n).withColumnRenamed("as_of_date", "date").withColumn("run", F.lit("run"))
    long = legs.unpivot(["run", "date"], ["spread", "long_excess", "short_excess", "top", "market"], "leg", "ret")
    raw = F.col("leg").isin("top", "market")
    return seriesstats.series_stats(long, ["run", "leg"], least=least).withColumns({"psr_stat": F.when(~raw, F.col("psr_stat")), "survives_95": F.when(~raw, F.col("survives_95"))})


def report(bucketed: DataFrame, prices: DataFrame, n: int = N_BUCKETS, least: int = 24, horizons: tuple[int, ...] = (1, 3, 6, 12)) -> dict[str, DataFrame]:
    """The tables of a research report on one run."""
    key = lambda d: d.withColumn("run", F.lit("run"))
    legs = key(portfolios.leg_decomposition(bucketed, n)).withColumnRenamed("as_of_date", "date")
    s = legs.select("run", "date", F.col("spread").alias("ret"))
    costs = key(costs_input(bucketed, n))
    ahead = portfolios.horizon_spreads(bucketed, forward_returns(prices, list(horizons)), list(horizons), n)
    ahead = key(ahead).select("run", "horizon", F.col("as_of_date").alias("date"), F.col("spread").alias("ret"))
    return {
        "summary": validate(bucketed, n, least),
        "robustness": seriesstats.robustness(s, ["run"], drop_top=3, drop_bottom=3),
        "costs": seriesstats.cost_table(costs, ["run"], [0, 10, 25, 50]),
        "legs": leg_table(bucketed, n, least),
        "horizons": seriesstats.horizon_table(ahead, ["run"], least),
        "sectors": portfolios.sector_attribution(bucketed, n),
    }
