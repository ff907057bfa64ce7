"""Statistics of return series, keyed: thousands of series in one job.

A series is (keys, date, ret); missing returns are dropped.  A series has a
row for each month, so it is folded into one sorted array where neighbours in
time are needed.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import best_of_trials, newey_west_lag, norm_cdf, quantile, sharpe_spread
from ..schema import MIN_STATS_MONTHS, N_DSR_TRIALS, ROLLING_WINDOW


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _lagged(a: Column, b: Column, lag: Column) -> Column:
    """Sum of a[t] * b[t - lag]."""
    return F.aggregate(F.transform(a, lambda x, i: F.when(i >= lag, x * F.get(b, i - lag)).otherwise(0.0)), F.lit(0.0), lambda x, y: x + y)


def hac(a: Column, b: Column, lag: Column) -> Column:
    """Bartlett-weighted long-run cross product of two residual arrays, no
    small-sample correction."""
    both = lambda k: (_lagged(a, b, k) + _lagged(b, a, k)) * (1 - k / (lag + 1.0))
    tail = F.when(lag > 0, F.transform(F.sequence(F.lit(1), F.greatest(lag, F.lit(1))), both)).otherwise(F.array().cast("array<double>"))
    return _lagged(a, b, F.lit(0)) + _sum(tail)


def folded(series: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """keys and arrays of the values in date order; rows with a missing value
    are dropped."""
    rows = series.dropna(subset=list(values)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", *values))).alias("__rows"))
    return rows.select(*keys, *[F.col("__rows")[v].alias(v) for v in values])


def newey_west(series: DataFrame, keys: list[str], value: str = "ret", least_lag: str | int = 0) -> DataFrame:
    """keys, n, mean, nw_lag and nw_tstat of the mean.  ``least_lag``: a
    column of the keys or a number that the lag is at least."""
    a = folded(series, keys, value).withColumn("n", F.size(value))
    a = a.withColumn("mean", _sum(F.col(value)) / F.col("n"))
    least = F.lit(least_lag) if isinstance(least_lag, int) else F.col(least_lag)
    a = a.withColumn("nw_lag", F.greatest(newey_west_lag(F.col("n")), least.cast("int")))
    a = a.withColumn("__e", F.transform(value, lambda x: x - F.col("mean")))
    long_run = hac(F.col("__e"), F.col("__e"), F.col("nw_lag"))
    t = F.col("mean") / F.nullif(F.sqrt(long_run) / F.col("n"), F.lit(0.0))
    return a.select(*keys, "n", "mean", "nw_lag", t.alias("nw_tstat"))


def moments(series: DataFrame, keys: list[str], value: str = "ret") -> DataFrame:
    """keys, n, mean, sd, skew and (non-excess) kurtosis."""
    v = F.col(value)
    return series.filter(v.isNotNull()).groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.skewness(v).alias("skew"), (F.kurtosis(v) + 3).alias("kurt"))


def sharpe_columns(trials: int = N_DSR_TRIALS, variance: Column | None = None) -> dict[str, Column]:
    """sharpe, sr0 and psr_stat from the columns of ``moments``; null for
    series without spread."""
    ok = (F.col("n") >= 3) & (F.col("sd") > 0)
    sr = F.when(ok, F.col("mean") / F.nullif("sd", F.lit(0.0)))
    inside = sharpe_spread(sr, F.col("skew"), F.col("kurt"))
    trial_variance = variance if variance is not None else inside / (F.col("n") - 1)
    sr0 = F.sqrt(F.greatest(trial_variance, F.lit(1e-12))) * best_of_trials(trials)
    stat = (sr - sr0) * F.sqrt(F.col("n") - 1) / F.sqrt(F.greatest(inside, F.lit(1e-12)))
    return {"sharpe": sr, "sr0": sr0, "psr_stat": stat}


def deflated_sharpe(series: DataFrame, keys: list[str], value: str = "ret", trials: int = N_DSR_TRIALS, with_probability: bool = False) -> DataFrame:
    """Sharpe ratios deflated by the best of ``trials`` skill-less ones;
    survives_95 compares the statistic with the normal quantile, dsr and
    p_value (``with_probability``) need the distribution function."""
    m = moments(series, keys, value).withColumns(sharpe_columns(trials))
    m = m.withColumn("sharpe_annual", F.col("sharpe") * F.sqrt(F.lit(12.0))).withColumn("survives_95", F.coalesce(F.col("psr_stat") > quantile(0.95), F.lit(False)))
    if with_probability:
        m = m.withColumn("dsr", norm_cdf("psr_stat")).withColumn("p_value", 1 - F.col("dsr"))
    return m


def series_stats(series: DataFrame, keys: list[str], value: str = "ret", least: int = MIN_STATS_MONTHS) -> DataFrame:
    """months, ann_return, nw_tstat, psr_stat and survives_95 of each series;
    shorter ones than ``least`` have their number of months only."""
    t = newey_west(series, keys, value).select(*keys, F.col("nw_tstat"), F.col("nw_lag"))
    d = deflated_sharpe(series, keys, value)
    x = d.join(t, keys)
    enough = F.col("n") >= least
    return x.select(
        *keys,
        F.col("n").alias("months"),
        F.when(enough, F.pow(1 + F.col("mean"), 12.0) - 1).alias("ann_return"),
        *[F.when(enough, F.col(c)).alias(c) for c in ("nw_tstat", "nw_lag", "sharpe_annual", "skew", "kurt", "psr_stat")],
        (enough & F.col("survives_95")).alias("survives_95"),
    )


def rolling_hurdle(series: DataFrame, keys: list[str], value: str = "ret", window: int = ROLLING_WINDOW, trials: int = N_DSR_TRIALS) -> DataFrame:
    """Per date the annualised mean of the last ``window`` returns, its band of
    1.96 standard errors, and the spread that the window would need for its
    own deflated Sharpe to reach 95 %."""
    v = F.col(value)
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(1 - window, 0)
    full = F.count(v).over(w) == window
    s = series.select(*keys, "date", value)
    s = s.withColumns({"n": F.count(v).over(w), "mean": F.avg(v).over(w), "sd": F.stddev_samp(v).over(w), "skew": F.skewness(v).over(w), "kurt": F.kurtosis(v).over(w) + 3})
    s = s.withColumns(sharpe_columns(trials))
    need = F.col("sr0") + quantile(0.95) * F.sqrt(F.greatest(sharpe_spread(F.col("sharpe"), F.col("skew"), F.col("kurt")), F.lit(1e-12))) / F.sqrt(F.col("n") - 1)
    se = F.col("sd") / F.sqrt(F.lit(float(window))) * 12
    hurdle = need * F.col("sd") * 12
    mu = F.col("mean") * 12
    out = {"ann_spread": mu, "lo": mu - 1.96 * se, "hi": mu + 1.96 * se, "dsr_lo": -hurdle, "dsr_hi": hurdle}
    return s.select(*keys, "date", *[F.when(full, c).alias(k) for k, c in out.items()])


def compounded(series: DataFrame, keys: list[str], value: str = "ret", missing_as_zero: bool = False) -> DataFrame:
    """Cumulative compounded return of each series."""
    v = F.coalesce(value, F.lit(0.0)) if missing_as_zero else F.col(value)
    s = series if missing_as_zero else series.filter(v.isNotNull())
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return s.select(*keys, "date", (F.product(1 + v).over(w) - 1).alias("cum_ret"))


def half_samples(series: DataFrame, keys: list[str], value: str = "ret") -> DataFrame:
    """Compounded return of the whole series and of its halves (the first has
    n div 2 months)."""
    w = Window.partitionBy(*keys)
    s = series.filter(F.col(value).isNotNull()).withColumn("i", F.row_number().over(w.orderBy("date"))).withColumn("n", F.count(F.lit(1)).over(w))
    first = F.col("i") <= F.floor(F.col("n") / 2)
    grow = lambda c: F.product(c) - 1
    g = 1 + F.col(value)
    return s.groupBy(*keys).agg(grow(g).alias("total"), grow(F.when(first, g).otherwise(1.0)).alias("first_half"), grow(F.when(~first, g).otherwise(1.0)).alias("second_half"))


def calendar_years(series: DataFrame, keys: list[str], value: str = "ret") -> DataFrame:
    """Compounded return per calendar year."""
    return series.filter(F.col(value).isNotNull()).groupBy(*keys, F.year("date").alias("year")).agg((F.product(1 + F.col(value)) - 1).alias("year_ret"), F.count(F.lit(1)).alias("months"))


def hurdle_years(rolling: DataFrame, keys: list[str]) -> DataFrame:
    """Per year of a ``rolling_hurdle`` table: mean spread, windows that clear
    the hurdle either way, and the median hurdle."""
    r = rolling.filter(F.col("dsr_hi").isNotNull())
    return r.groupBy(*keys, F.year("date").alias("year")).agg(F.avg("ann_spread").alias("mean_spread"), F.count_if(F.col("ann_spread") > F.col("dsr_hi")).alias("above"), F.count_if(F.col("ann_spread") < F.col("dsr_lo")).alias("below"), F.median("dsr_hi").alias("median_hurdle"))


def robustness(series: DataFrame, keys: list[str], value: str = "ret", winsor_pct: float = 1.0, drop_top: int = 0, drop_bottom: int = 0, excluded: DataFrame | None = None) -> DataFrame:
    """``series_stats`` of each series as it is and with one thing changed:
    clipped to its percentiles, without its largest or smallest months, or
    replaced by ``excluded``.  Scenarios are a further key of one job."""
    v = F.col(value)
    s = series.filter(v.isNotNull())
    limits = s.groupBy(*keys).agg(F.percentile(v, F.array(F.lit(winsor_pct / 100), F.lit(1 - winsor_pct / 100))).alias("q"))
    rank = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(c, "date"))
    s = s.withColumns({"__hi": rank(F.desc(value)), "__lo": rank(F.asc(value))}).join(limits, keys)
    cases = [("baseline", v)]
    if winsor_pct > 0:
        cases.append(("winsorised", F.greatest(F.least(v, F.col("q")[1]), F.col("q")[0])))
    if drop_top:
        cases.append(("drop_top", F.when(F.col("__hi") > drop_top, v)))
    if drop_bottom:
        cases.append(("drop_bottom", F.when(F.col("__lo") > drop_bottom, v)))
    long = s.select(*keys, "date", F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), c.alias(value)) for k, c in cases])).alias("c")).select(*keys, "date", "c.*")
    if excluded is not None:
        long = long.unionByName(excluded.select(*keys, "date", F.lit("excluded").alias("scenario"), value))
    return series_stats(long, [*keys, "scenario"], value)


def market_exposure(legs: DataFrame, keys: list[str], value: str = "spread", market: str = "market") -> DataFrame:
    """Beta and correlation to the market, means in up and down months."""
    s, m = F.col(value), F.col(market)
    x = legs.filter(s.isNotNull() & m.isNotNull())
    return x.groupBy(*keys).agg((F.covar_samp(value, market) / F.nullif(F.var_samp(market), F.lit(0.0))).alias("beta"), F.corr(value, market).alias("corr"), F.count_if(m > 0).alias("up_months"), F.count_if(m <= 0).alias("down_months"), F.avg(F.when(m > 0, s)).alias("up_mean"), F.avg(F.when(m <= 0, s)).alias("down_mean"))


def beta_adjusted(legs: DataFrame, keys: list[str], value: str = "spread", market: str = "market", least: int = MIN_STATS_MONTHS) -> DataFrame:
    """Least squares of the spread on the market with Newey-West errors."""
    a = folded(legs, keys, value, market).withColumn("n", F.size(value)).filter(F.col("n") >= least)
    s, m, n = F.col(value), F.col(market), F.col("n")
    dot = lambda x, y: _lagged(x, y, F.lit(0))
    a = a.withColumns({"sm": _sum(m), "ss": _sum(s), "mm": dot(m, m), "ms": dot(m, s), "s2": dot(s, s), "nw_lag": newey_west_lag(n)})
    det = F.nullif(n * F.col("mm") - F.col("sm") * F.col("sm"), F.lit(0.0))
    a = a.withColumn("det", det).withColumn("beta", (n * F.col("ms") - F.col("sm") * F.col("ss")) / F.col("det"))
    a = a.withColumn("alpha", (F.col("ss") - F.col("beta") * F.col("sm")) / n)
    a = a.withColumn("e", F.zip_with(s, m, lambda x, y: x - F.col("alpha") - F.col("beta") * y))
    a = a.withColumn("g", F.zip_with("e", m, lambda x, y: x * y))
    lag = F.col("nw_lag")
    a = a.withColumns({"s11": hac(F.col("e"), F.col("e"), lag), "s12": hac(F.col("e"), F.col("g"), lag), "s22": hac(F.col("g"), F.col("g"), lag), "sse": dot(F.col("e"), F.col("e"))})
    # rows of the inverse of X'X
    i11, i12, i22 = F.col("mm") / F.col("det"), -F.col("sm") / F.col("det"), n / F.col("det")
    quad = lambda p, q: p * p * F.col("s11") + 2 * p * q * F.col("s12") + q * q * F.col("s22")
    total = F.col("s2") - F.col("ss") * F.col("ss") / n
    return a.select(
        *keys,
        n.alias("months"),
        F.col("alpha").alias("alpha_monthly"),
        (F.col("alpha") * 12).alias("alpha_ann"),
        (F.col("alpha") / F.nullif(F.sqrt(quad(i11, i12)), F.lit(0.0))).alias("alpha_t"),
        "beta",
        (F.col("beta") / F.nullif(F.sqrt(quad(i12, i22)), F.lit(0.0))).alias("beta_t"),
        (1 - F.col("sse") / F.nullif(total, F.lit(0.0))).alias("r2"),
        "nw_lag",
        (F.col("ss") / n * 12).alias("raw_ann"),
    )


def horizon_table(spreads: DataFrame, keys: list[str], least: int = MIN_STATS_MONTHS) -> DataFrame:
    """Per horizon (a key in months) the mean spread, its annual equivalent and
    a t-statistic whose lag covers the overlap of the holding periods."""
    s = spreads.withColumn("__least", F.col("horizon") - 1)
    t = newey_west(s, [*keys, "horizon", "__least"], "ret", "__least").filter(F.col("n") >= least)
    ann = F.when(F.col("mean") > -1, F.pow(1 + F.col("mean"), 12.0 / F.col("horizon")) - 1)
    return t.select(*keys, "horizon", F.col("n").alias("obs"), F.col("mean").alias("mean_spread"), ann.alias("annualized"), "nw_tstat", "nw_lag")


# ---- trading costs: series of (keys, date, ret, traded), traded = twice the sum of both legs' turnover


def net_of_costs(series: DataFrame, keys: list[str], costs_bps: list[float]) -> DataFrame:
    """The series at each one-way cost, a further key."""
    costs = F.explode(F.array(*[F.lit(float(c)) for c in costs_bps]))
    x = series.withColumn("cost_bps", costs)
    return x.select(*keys, "cost_bps", "date", (F.col("ret") - F.col("cost_bps") / 1e4 * F.coalesce("traded", F.lit(0.0))).alias("ret"))


def cost_table(series: DataFrame, keys: list[str], costs_bps: list[float]) -> DataFrame:
    return series_stats(net_of_costs(series, keys, costs_bps), [*keys, "cost_bps"])


def breakeven_cost(series: DataFrame, keys: list[str]) -> DataFrame:
    """One-way cost at which the mean net spread is zero; null if the gross
    mean or the traded volume is not positive."""
    m = series.filter(F.col("ret").isNotNull()).groupBy(*keys).agg(F.avg("ret").alias("s"), F.avg(F.coalesce("traded", F.lit(0.0))).alias("x"))
    return m.select(*keys, F.when((F.col("s") > 0) & (F.col("x") > 0), F.col("s") / F.col("x") * 1e4).alias("breakeven_bps"))


def dsr_fail_cost(series: DataFrame, keys: list[str], most: float = 1000.0, tolerance: float = 0.5, least: int = MIN_STATS_MONTHS) -> DataFrame:
    """Cost at which the net series' deflated Sharpe falls to 0.95: null if it
    fails gross, ``most`` if it survives there.  One aggregation gives the
    joint moments of return and trading; the bisection then runs on one row."""
    x = F.coalesce("traded", F.lit(0.0)) / 1e4
    s = series.filter(F.col("ret").isNotNull())
    sums = [F.sum(F.pow("ret", F.lit(float(i))) * F.pow(x, F.lit(float(j)))).alias(f"m{i}{j}") for i in range(5) for j in range(5 - i)]
    m = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)

    def survives(c: Column) -> Column:
        n = F.col("n")
        raw = [sum((F.lit(float(comb(k, j))) * F.pow(-c, F.lit(float(j))) * F.col(f"m{k - j}{j}") for j in range(1, k + 1)), F.col(f"m{k}0")) / n for k in range(1, 5)]
        a, b, d, e = raw
        var = b - a * a
        sd = F.sqrt(F.greatest(var, F.lit(0.0)) * n / (n - 1))
        skew = (d - 3 * a * b + 2 * a * a * a) / F.nullif(F.pow(var, 1.5), F.lit(0.0))
        kurt = (e - 4 * a * d + 6 * a * a * b - 3 * a * a * a * a) / F.nullif(var * var, F.lit(0.0))
        sr = a / F.nullif(sd, F.lit(0.0))
        inside = sharpe_spread(sr, skew, kurt)
        stat = (sr - F.sqrt(F.greatest(inside / (n - 1), F.lit(1e-12))) * best_of_trials(N_DSR_TRIALS)) * F.sqrt(n - 1) / F.sqrt(F.greatest(inside, F.lit(1e-12)))
        return F.coalesce(stat > quantile(0.95), F.lit(False)) & (n >= least)

    steps = 0
    while most / 2**steps > tolerance:
        steps += 1
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(most).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        ok = survives(mid)
        return F.struct(F.when(ok, mid).otherwise(acc["lo"]).alias("lo"), F.when(ok, acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: F.round(acc["hi"], 1))
    return m.select(*keys, F.when(~survives(F.lit(0.0)), None).when(survives(F.lit(most)), most).otherwise(found).alias("fail_bps"))


def block_bootstrap(series: DataFrame, keys: list[str], value: str = "ret", market: str | None = None, block: int = 6, reps: int = 1000, seed: int = 0) -> DataFrame:
    """Circular moving-block bootstrap: percentile intervals of the annual mean
    and Sharpe (and, with ``market``, of alpha from a beta fitted anew in each
    resample) and the share of resamples with a mean that is not positive.
    Block starts come from md5 of seed, resample and block."""
    draws = resamples(series, keys, value, market, block, reps, seed)
    stats = [F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")]
    if market:
        stats += [F.avg(market).alias("mm"), (F.covar_samp(value, market) / F.nullif(F.var_samp(market), F.lit(0.0))).alias("beta")]
    each = draws.groupBy(*keys, "rep").agg(*stats)
    each = each.withColumns({"ann_mean": F.col("mean") * 12, "ann_sharpe": F.col("mean") / F.nullif("sd", F.lit(0.0)) * F.sqrt(F.lit(12.0))})
    wanted = ["ann_mean", "ann_sharpe"]
    if market:
        each = each.withColumn("ann_alpha", (F.col("mean") - F.col("beta") * F.col("mm")) * 12)
        wanted.append("ann_alpha")
    ends = [F.percentile(c, F.lit(p)).alias(f"{c}_{n}") for c in wanted for n, p in (("lo", 0.025), ("hi", 0.975))]
    return each.groupBy(*keys).agg(*ends, F.avg((F.col("mean") <= 0).cast("double")).alias("p_value"))


def resamples(series: DataFrame, keys: list[str], value: str, market: str | None, block: int, reps: int, seed: int) -> DataFrame:
    """keys, rep and the resampled values."""
    values = [value, *([market] if market else [])]
    a = folded(series, keys, *values).withColumn("n", F.size(value)).filter(F.col("n") >= 2 * block)
    a = a.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    a = a.withColumn("b", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block) - 1).cast("int"))))
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "rep", "b").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("n")
    a = a.withColumn("start", start).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    a = a.filter(F.col("b") * block + F.col("k") < F.col("n"))
    at = ((F.col("start") + F.col("k")) % F.col("n")).cast("int")
    return a.select(*keys, "rep", *[F.get(v, at).alias(v) for v in values])
