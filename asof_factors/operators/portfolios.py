"""Quantile buckets, their returns, and what the spread is made of.

A panel has as_of_date, ticker, sector, scores, decile and fwd_ret_1m.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialised
from .ranks import exact_ranks, mean_ranks
from ..schema import MIN_NAMES_PER_BUCKET, N_BUCKETS

#: Bins of a group's scores in which rows are counted before any is ordered.
BINS = 4096


def form_buckets(rows: DataFrame, score: str, n: int = N_BUCKETS, least: int = MIN_NAMES_PER_BUCKET, keys: tuple[str, ...] = ("as_of_date",), out: str = "decile") -> DataFrame:
    """``decile`` 1 to n by score, ties in ticker order, equal counts by the
    exact integer rule ceil((rank - 1) n / (m - 1)); null for a missing score
    and for sections of fewer than n * least scores."""
    cuts = _cuts(rows.filter(F.col(score).isNotNull()).select(*keys, F.col(score).alias("__score"), "ticker"), n, n * least, keys)
    if cuts is not None:
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
        s, t = F.col(score), F.col("ticker")
        above = [(s > F.col(f"__s{b}")) | (s == F.col(f"__s{b}")) & F.coalesce(t >= F.col(f"__t{b}"), F.col(f"__t{b}").isNull()) for b in range(2, n + 1)]
        bucket = sum((a.cast("int") for a in above), F.lit(1))
        found = rows.join(F.broadcast(cuts), same, "left")  # a row for each group
        return found.select(*rows.columns, F.when(s.isNotNull() & F.col("__cut"), bucket).alias(out))
    has = F.col(score).isNotNull()
    ranked = exact_ranks(rows.withColumn("__has", has), [*keys, "__has"], [score, "ticker"], "__rank", "__m")
    rank, m = F.col("__rank") - 1, F.col("__m")
    bucket = F.greatest(F.lit(1), F.ceil(rank * n / F.greatest(m - 1, F.lit(1)))).cast("int")
    return ranked.withColumn(out, F.when(F.col("__has") & (m >= n * least), bucket)).drop("__has", "__rank", "__m")


def _cuts(scores: DataFrame, n: int, least: int, keys: tuple[str, ...]) -> DataFrame | None:
    """The first row (score and ticker) of each bucket from the second on, for
    each group of ``least`` rows; none if such a row is there twice.

    Rows are counted in bins of equal width between a group's least and
    largest score, and only those in the bins where a bucket begins are
    ordered, so no table of ranked rows is written."""
    named = scores.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__score", "ticker")
    ks = [f"__k_{k}" for k in keys]
    at = lambda other: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in ks])
    under = lambda df, other, *more: df.select(*[F.col(k).alias(f"{other}{k}") for k in ks], *more)
    ends = materialised(named.groupBy(*ks).agg(F.count(F.lit(1)).alias("__m"), F.min("__score").alias("__low"), F.max("__score").alias("__high")).filter(F.col("__m") >= least))
    binned = named.join(F.broadcast(under(ends, "e", "__low", "__high")), at("e"))
    binned = binned.select(*ks, "__score", "ticker", F.coalesce(F.width_bucket(F.col("__score").cast("double"), F.col("__low").cast("double"), F.col("__high").cast("double"), F.lit(BINS)), F.lit(0)).alias("__bin"))
    counts = binned.groupBy(*ks, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*ks).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = F.array(*[F.struct(F.lit(b).alias("b"), (F.floor(F.lit(b - 1) * (F.col("__m") - 1) / F.lit(n)) + 2).alias("rank")) for b in range(2, n + 1)])
    wanted = counts.withColumn("__before", before).join(F.broadcast(under(ends, "e", F.explode(firsts).alias("w"))), at("e"))
    wanted = wanted.filter((F.col("__before") < F.col("w.rank")) & (F.col("w.rank") <= F.col("__before") + F.col("__n")))
    wanted = materialised(under(wanted, "w", F.col("__bin").alias("w__bin"), F.col("w.b").alias("__b"), (F.col("w.rank") - F.col("__before")).alias("__place")))
    few_bins = F.broadcast(wanted.select(*[f"w{k}" for k in ks], "w__bin").distinct())  # n for each group at most
    ranked = exact_ranks(binned.join(few_bins, at("w") & (F.col("__bin") == F.col("w__bin")), "left_semi"), [*ks, "__bin"], ["__score", "ticker"], "__rank", "__size")
    met = at("w") & (F.col("__bin") == F.col("w__bin")) & (F.col("__rank") <= F.col("__place")) & (F.col("__rank") >= F.col("__place") - 1)
    found = materialised(ranked.join(F.broadcast(wanted), met).select(*ks, "__b", "__score", "ticker", (F.col("__rank") == F.col("__place")).alias("__first")))
    if not found.groupBy(*ks, "__b", "__score", "ticker").count().filter("count > 1").isEmpty():
        return None
    pick = lambda c, b: F.max(F.when(F.col("__first") & (F.col("__b") == b), F.col(c)))
    own = [pick(c, b).alias(f"{p}{b}") for b in range(2, n + 1) for c, p in (("__score", "__s"), ("ticker", "__t"))]
    # without a second bucket there is nothing to find, and all rows are in the first
    out = under(ends, "e").join(found, at("e"), "left").groupBy(*[f"e{k}" for k in ks]).agg(*own)
    return materialised(out.select(*[F.col(f"e{k}").alias(k) for k in ks], *[F.col(f"{p}{b}") for b in range(2, n + 1) for p in ("__s", "__t")], F.lit(True).alias("__cut")))


def bucket_returns(panel: DataFrame, keys: tuple[str, ...] = ("as_of_date",)) -> DataFrame:
    """Mean forward return of each bucket, in long form."""
    return panel.filter(F.col("decile").isNotNull()).groupBy(*keys, "decile").agg(F.avg("fwd_ret_1m").alias("ret"))


def ranked(panel: DataFrame) -> DataFrame:
    return panel.filter(F.col("decile").isNotNull() & F.col("fwd_ret_1m").isNotNull())


def mean_in(decile: int) -> Column:
    return F.avg(F.when(F.col("decile") == decile, F.col("fwd_ret_1m")))


def spread(panel: DataFrame, n: int = N_BUCKETS, keys: tuple[str, ...] = ("as_of_date",)) -> DataFrame:
    """Top minus bottom bucket; null if either has no return."""
    return panel.filter(F.col("decile").isin(1, n)).groupBy(*keys).agg((mean_in(n) - mean_in(1)).alias("spread"))


def single_score_spreads(panel: DataFrame, scores: list[str], n: int = N_BUCKETS) -> DataFrame:
    """Spreads of buckets formed on each score alone: one job keyed by strategy."""
    long = panel.select("as_of_date", "ticker", "fwd_ret_1m", F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("score")) for s in scores])).alias("x")).select("as_of_date", "ticker", "fwd_ret_1m", "x.*")
    return spread(form_buckets(long, "score", n, keys=("strategy", "as_of_date")), n, ("strategy", "as_of_date"))


def exclude(panel: DataFrame, tickers: list[str] = (), sectors: list[str] = ()) -> DataFrame:
    """Rows without some names and sectors; buckets stay as they were."""
    drop = [t.strip().upper() for t in tickers if t and t.strip()]
    out = panel.filter(~F.upper("ticker").isin(drop)) if drop else panel
    return out.filter(F.col("sector").isNull() | ~F.col("sector").isin(list(sectors))) if sectors else out


def _legs(panel: DataFrame, n: int) -> DataFrame:
    """Members of the two end buckets with the leg's size at the date."""
    x = ranked(panel).filter(F.col("decile").isin(1, n))
    size = x.groupBy("as_of_date", "decile").agg(F.count(F.lit(1)).alias("size"))
    return x.join(F.broadcast(size), ["as_of_date", "decile"])  # two rows for each date


def contributions(panel: DataFrame, n: int = N_BUCKETS) -> DataFrame:
    """Each name's share of its date's spread: its return over its leg's size,
    with a minus in the bottom leg."""
    sign = F.when(F.col("decile") == n, 1.0).otherwise(-1.0)
    return _legs(panel, n).select("as_of_date", "ticker", "sector", "decile", "fwd_ret_1m", (sign * F.col("fwd_ret_1m") / F.col("size")).alias("contribution"))


def top_contributors(panel: DataFrame, k: int, n: int = N_BUCKETS) -> DataFrame:
    """The ``k`` largest contributions by size of each date, the largest first;
    those that agree in nine decimals by ticker."""
    order = Window.partitionBy("as_of_date").orderBy(F.round(F.abs("contribution"), 9).desc_nulls_last(), "ticker")
    return contributions(panel, n).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def company_history(bucketed: DataFrame, tickers: list[str]) -> DataFrame:
    """Scores, composite and bucket of some names at every date, in order."""
    x = bucketed.filter(F.col("ticker").isin([t.upper() for t in tickers]))
    return x.select("ticker", "as_of_date", "f_score", "z_score", "o_score", "composite_score", "decile").orderBy("ticker", "as_of_date")


def month_buckets(panel: DataFrame, n: int = N_BUCKETS) -> DataFrame:
    """Names, mean and median return of the end buckets at each date."""
    return ranked(panel).filter(F.col("decile").isin(1, n)).groupBy("as_of_date", "decile").agg(F.count(F.lit(1)).alias("names"), F.avg("fwd_ret_1m").alias("mean"), F.median("fwd_ret_1m").alias("median"))


def sector_attribution(panel: DataFrame, n: int = N_BUCKETS) -> DataFrame:
    """Each sector's contribution to the spread per year, and its mean number
    of names in either leg."""
    c = contributions(panel, n).withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    months = F.broadcast(c.agg(F.count_distinct("as_of_date").alias("months")))  # one row
    sums = c.groupBy("sector").agg(F.sum("contribution").alias("c"), F.count_if(F.col("decile") == n).alias("t"), F.count_if(F.col("decile") == 1).alias("b"))
    out = sums.join(months).select("sector", (F.col("c") / F.col("months") * 12).alias("ann_contribution"), (F.col("t") / F.col("months")).alias("avg_top_names"), (F.col("b") / F.col("months")).alias("avg_bottom_names"))
    return out.orderBy("ann_contribution")


def leg_decomposition(panel: DataFrame, n: int = N_BUCKETS) -> DataFrame:
    """Market (all ranked names), top, bottom and what each leg adds."""
    legs = ranked(panel).groupBy("as_of_date").agg(F.avg("fwd_ret_1m").alias("market"), mean_in(n).alias("top"), mean_in(1).alias("bottom"))
    legs = legs.filter(F.col("top").isNotNull() & F.col("bottom").isNotNull())
    return legs.withColumns({"long_excess": F.col("top") - F.col("market"), "short_excess": F.col("market") - F.col("bottom"), "spread": F.col("top") - F.col("bottom")})


def turnover(panel: DataFrame, n: int = N_BUCKETS) -> DataFrame:
    """One-way turnover of each end bucket (leg) against its previous date:
    half the summed change of equal weights; null at the first date."""
    legs = _legs(panel, n).select("as_of_date", "decile", "ticker", "size")
    dates = legs.select("decile", "as_of_date", "size").distinct()
    order = Window.partitionBy("decile").orderBy("as_of_date")
    dates = dates.withColumn("previous", F.lag("as_of_date").over(order)).withColumn("previous_size", F.lag("size").over(order))
    before = legs.select(F.col("decile").alias("d"), F.col("as_of_date").alias("p"), F.col("ticker").alias("t"))
    kept = legs.drop("size").join(F.broadcast(dates), ["decile", "as_of_date"]).join(before, (F.col("decile") == F.col("d")) & (F.col("previous") == F.col("p")) & (F.col("ticker") == F.col("t")))
    stay = kept.groupBy("decile", "as_of_date").agg(F.count(F.lit(1)).alias("stay"))
    both = dates.join(stay, ["decile", "as_of_date"], "left").withColumn("stay", F.coalesce("stay", F.lit(0)))
    # names that stay change from 1/previous to 1/size; the rest enter or leave whole
    change = F.col("stay") * F.abs(1 / F.col("size") - 1 / F.col("previous_size")) + (F.col("size") - F.col("stay")) / F.col("size") + (F.col("previous_size") - F.col("stay")) / F.col("previous_size")
    return both.select("as_of_date", "decile", F.when(F.col("previous").isNotNull(), change / 2).alias("turnover"))


def horizon_spreads(panel: DataFrame, forward: DataFrame, ks: list[int], n: int = N_BUCKETS) -> DataFrame:
    """Spreads of unchanged buckets held for k months: horizon, as_of_date,
    spread.  ``forward``: ticker, month_end and ``fwd_<k>m``."""
    f = forward.select(F.col("ticker").alias("__t"), F.col("month_end").alias("__m"), *[f"fwd_{k}m" for k in ks])
    x = panel.filter(F.col("decile").isin(1, n)).join(f, (F.col("ticker") == F.col("__t")) & (F.col("as_of_date") == F.col("__m")))
    long = x.select("as_of_date", "decile", F.explode(F.array(*[F.struct(F.lit(k).alias("horizon"), F.col(f"fwd_{k}m").alias("fwd_ret_1m")) for k in ks])).alias("h")).select("as_of_date", "decile", "h.*")
    return spread(long, n, ("horizon", "as_of_date")).filter(F.col("spread").isNotNull())


def sector_heatmap(panel: DataFrame, years: list[int]) -> DataFrame:
    """Mean composite by sector and year."""
    return panel.withColumn("__y", F.year("as_of_date")).groupBy("sector").pivot("__y", years).agg(F.avg("composite_score"))


def score_return_line(panel: DataFrame, score: str = "f_score") -> DataFrame:
    """Least squares of the forward return on a score over all rows."""
    return panel.agg(F.regr_slope("fwd_ret_1m", score).alias("slope"), F.regr_intercept("fwd_ret_1m", score).alias("intercept"), F.regr_count("fwd_ret_1m", score).alias("n"))


def display_sample(panel: DataFrame, rows: int) -> DataFrame:
    """A bounded, repeatable sample of rows for display."""
    return panel.orderBy(F.xxhash64("as_of_date", "ticker"), "as_of_date", "ticker").limit(rows)


def bucket_gradient(panel: DataFrame) -> DataFrame:
    """Mean annual return per bucket."""
    return bucket_returns(panel).groupBy("decile").agg((F.avg("ret") * 12).alias("ann_mean"), F.count("ret").alias("months"))


def gradient_correlation(panel: DataFrame) -> DataFrame:
    """Spearman correlation of bucket number and mean return."""
    g = bucket_gradient(panel)
    w = lambda c: Window.partitionBy(F.lit(1)).orderBy(c)  # noqa: E731  a row for each bucket
    r = g.select(F.rank().over(w("decile")).cast("double").alias("a"), F.rank().over(w("ann_mean")).cast("double").alias("b"))
    return r.agg(F.corr("a", "b").alias("spearman"))


def rank_stability(panel: DataFrame, score: str = "composite_score") -> DataFrame:
    """Spearman correlation of a score between a date and the one before."""
    dates = panel.select("as_of_date").distinct().withColumn("i", F.row_number().over(Window.orderBy("as_of_date")))  # a row for each date
    scored = panel.filter(F.col(score).isNotNull()).select("as_of_date", "ticker", score).join(F.broadcast(dates), "as_of_date")
    later = scored.select("ticker", (F.col("i") - 1).alias("i"), F.col("as_of_date"), F.col(score).alias("b"))
    pairs = scored.select("ticker", "i", F.col(score).alias("a")).join(later, ["ticker", "i"])
    both = mean_ranks(mean_ranks(pairs.select("as_of_date", "a", "b"), ["as_of_date"], "a", "ra"), ["as_of_date"], "b", "rb")
    return both.groupBy("as_of_date").agg(F.corr("ra", "rb").alias("spearman"), F.count(F.lit(1)).alias("names"))


def watchlist(panel: DataFrame, tickers: list[str]) -> DataFrame:
    """Latest row of some names with the bucket of twelve months before."""
    x = panel.filter(F.upper("ticker").isin([t.upper() for t in tickers]))
    last = x.groupBy("ticker").agg(F.max("as_of_date").alias("last"))
    old = F.max_by("decile", F.when(F.col("as_of_date") <= F.add_months("last", -12), F.col("as_of_date")))
    now = lambda c: F.max_by(c, "as_of_date").alias(c)
    return x.join(last, "ticker").groupBy("ticker").agg(F.max("as_of_date").alias("as_of_date"), now("composite_score"), now("decile"), old.alias("decile_12m_ago"))
