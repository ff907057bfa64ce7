"""Queries over the driver's tables, each with its SQL where SQL can say it.

Keys are the survey's operator ids.  Results are rounded, so that sums in a
different order compare equal.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .operators import asof, composite, membership, portfolios, prices, scores, seriesstats
from .plans import backtest
from .plans.storage import land, shared_folder
from .schema import FEATURES, SCORES
from .sources import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Date columns of results, where not just as_of_date: both sides give ISO text.
DATES = {
    "e1_latest_filings": ["fiscal_period_end", "filed_date"],
    "e2_period_ranks": ["as_of_date", "fiscal_period_end"],
    "e3_restatement_flags": ["fiscal_period_end", "filed_date"],
    "i4_pit_snapshot": ["as_of_date", "fiscal_period_end"],
    "d16_restated": ["fiscal_period_end", "first_filed", "last_filed"],
    "c7_first_filing_after": ["period_end", "filed_date"],
    "g2_membership_unwinding": ["start_date", "end_date"],
    "d6_month_end_closes": ["month_end"],
    "e6_monthly_returns": ["month_end"],
    "e14_forward_returns": ["month_end"],
    "a18_complete_grid": ["month_end"],
    "j12_net_of_costs": ["date"],
    "e12_rolling_hurdle": ["date"],
    "e13_cumulative": ["date"],
    "j8_training_moments": ["refit_date"],
    "a1_company_facts": ["fiscal_period_end", "start_date", "filed_date"],
    "k5_bse_facts": ["fiscal_period_end", "start_date", "filed_date"],
    "k5_cvm_facts": ["fiscal_period_end", "start_date", "filed_date"],
    "a19_replaced_facts": ["fiscal_period_end", "filed_date"],
    "a22_registry_batch": [],
    "b4_restricted_facts": ["fiscal_period_end", "filed_date"],
    "b5_pinned_lookup": ["fiscal_period_end", "as_of_date"],
    "l1_stream_ingest": ["fiscal_period_end", "filed_date"],
}
UNDATED = {"k6_compare_runs", "n9_twin_correlation", "g3_listing_membership", "n7_filing_lags", "n6_tag_coverage", "b14_latest_section", "g6_universe_overlap", "n1_drawdowns", "f7_liquid_universe", "d8_sector_attribution", "d12_sector_heatmap", "d13_score_return_line", "j13_breakeven_cost", "n3_bucket_gradient"}


def query(name: str, sql: str | None = None):
    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"})

        QUERIES[name] = run
        series = name[0] == "j" or name in ("n4_calendar_years", "n5_hurdle_years", "d14_half_samples")
        dates = DATES.get(name, [] if series or name in UNDATED else ["as_of_date"])
        if sql and dates:
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}' for c in dates)}) FROM (\n{sql}\n)"
        elif sql:
            SQL[name] = sql
        return f

    return keep


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, under its own name; zero never negative."""
    name = c if isinstance(c, str) else None
    out = F.round(F.col(c) if name else c, digits) + F.lit(0.0)
    return out.alias(name) if name else out


def rounded(df: DataFrame) -> DataFrame:
    """All columns, doubles rounded."""
    return df.select(*[r(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rs(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0::double AS {n}" for n in names)


# ---- as-of operators

AS_OF = dt.date(2000, 6, 30)


@query(
    "c1_asof_lookup",
    O.sql(
        """, r AS (SELECT row_number() OVER (ORDER BY ticker, tag, d) AS request_id, ticker, tag, d AS as_of_date
     FROM (SELECT DISTINCT ticker, tag FROM facts), (VALUES (DATE '1998-06-30'), (DATE '2000-12-31')) t(d))
SELECT r.ticker, r.tag, r.as_of_date, round(v.value, 4) AS value FROM r LEFT JOIN
  (SELECT r.request_id, f.value, row_number() OVER (PARTITION BY r.request_id ORDER BY fiscal_period_end DESC, filed_date DESC) AS rn
   FROM r JOIN facts f ON f.ticker = r.ticker AND f.tag = r.tag AND f.filed_date <= r.as_of_date) v ON v.request_id = r.request_id AND rn = 1""",
        "facts",
    ).replace(")\n, r AS", "),\nr AS"),
)
def c1(spark, d):
    f = X.facts(spark, d)
    days = F.explode(F.array(F.lit(dt.date(1998, 6, 30)), F.lit(dt.date(2000, 12, 31))))
    asked = f.select("ticker", "tag").distinct().select("ticker", "tag", days.alias("as_of_date")).withColumn("request_id", F.xxhash64("ticker", "tag", "as_of_date"))
    return asof.lookup(asked, f).select("ticker", "tag", "as_of_date", r("value", 4).alias("value"))


@query("e1_latest_filings", O.sql("SELECT ticker, tag, fiscal_period_end, filed_date, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY ticker, tag, fiscal_period_end ORDER BY filed_date DESC) AS rn FROM facts WHERE filed_date <= DATE '2000-06-30') WHERE rn = 1", "facts"))
def e1(spark, d):
    return asof.latest_filings(X.facts(spark, d), AS_OF).select("ticker", "tag", "fiscal_period_end", "filed_date", r("value", 4).alias("value"))


@query("e2_period_ranks", O.sql("SELECT as_of_date, ticker, tag, fiscal_period_end, period_rank::int AS period_rank, round(value, 4) AS value FROM long", "long"))
def e2(spark, d):
    return asof.snapshot_long(X.facts(spark, d), X.DATES).select("as_of_date", "ticker", "tag", "fiscal_period_end", "period_rank", r("value", 4).alias("value"))


@query("e3_restatement_flags", O.sql("SELECT cik, ticker, tag, fiscal_period_end, filed_date, filed_date > min(filed_date) OVER (PARTITION BY cik, tag, fiscal_period_end) AS is_restatement FROM facts", "facts"))
def e3(spark, d):
    return X.facts(spark, d, flagged=True).select("cik", "ticker", "tag", "fiscal_period_end", "filed_date", "is_restatement")


@query("i4_pit_snapshot", O.sql("SELECT as_of_date, ticker, fiscal_period_end, " + ", ".join(f'round("{t}{a}", 4) AS "{t}{a}"' for t in O.HELD for a in ("", "_prior")) + " FROM wide", "wide"))
def i4(spark, d):
    return asof.snapshot(X.facts(spark, d), X.DATES, O.HELD).select("as_of_date", "ticker", "fiscal_period_end", *[r(f"{t}{a}", 4).alias(f"{t}{a}") for t in O.HELD for a in ("", "_prior")])


@query("d16_restated", O.sql("SELECT ticker, tag, fiscal_period_end, count(DISTINCT value) AS n_values, min(filed_date) AS first_filed, max(filed_date) AS last_filed, round(min_by(value, filed_date), 4) AS original_value, round(max_by(value, filed_date), 4) AS final_value FROM facts GROUP BY ALL HAVING count(DISTINCT value) > 1 AND min(filed_date) < max(filed_date)", "facts"))
def d16(spark, d):
    return rounded(asof.restated(X.facts(spark, d)))


@query("n7_filing_lags", O.sql("SELECT tag, count(*) AS n, min(filed_date - fiscal_period_end)::int AS min_days, median(filed_date - fiscal_period_end)::double AS median_days, max(filed_date - fiscal_period_end)::int AS max_days FROM facts GROUP BY tag", "facts"))
def n7(spark, d):
    return asof.filing_lags(X.facts(spark, d))


@query(
    "c7_first_filing_after",
    O.sql(
        """SELECT ticker, period_end, filed_date FROM (SELECT p.ticker, p.period_end, min(f.filed_date) AS filed_date
FROM (SELECT DISTINCT ticker, (fiscal_period_end - 150)::date AS period_end FROM facts) p
JOIN (SELECT DISTINCT ticker, filed_date FROM facts) f ON f.ticker = p.ticker AND f.filed_date > p.period_end GROUP BY p.ticker, p.period_end)
WHERE filed_date - period_end <= 180""",
        "facts",
    ),
)
def c7(spark, d):
    f = X.facts(spark, d)
    periods = f.select("ticker", F.date_sub("fiscal_period_end", 150).alias("period_end")).distinct()
    return asof.first_filing_after(periods, f.select("ticker", "filed_date").distinct(), "ticker").select("ticker", "period_end", "filed_date")


# ---- scores and panel


def _panel(spark, d, gated: bool = False) -> DataFrame:
    gate = X.membership(spark, d) if gated else None
    return backtest.scores_panel(X.facts(spark, d), X.prices(spark, d), X.sectors(spark, d), X.DATES, gate)


def _booked(panel: DataFrame) -> DataFrame:
    return portfolios.form_buckets(panel.withColumn("composite_score", F.round(scores.equal_weight(), 9)), "composite_score")


def _book(spark, d) -> DataFrame:
    return _booked(_panel(spark, d))


@query("i1_i3_scores", O.sql(f"SELECT as_of_date, ticker, f_score, {rs('z_score', 'o_score')} FROM scores", "scores"))
def i1(spark, d):
    return rounded(_panel(spark, d).select("as_of_date", "ticker", *SCORES))


@query("e9_sector_zscores", O.sql(f"SELECT as_of_date, ticker, sector, {rs(*FEATURES)} FROM zscored", "zscored"))
def e9(spark, d):
    return rounded(_panel(spark, d).select("as_of_date", "ticker", "sector", *FEATURES))


@query("i5_scores_panel", O.sql(f"SELECT as_of_date, ticker, sector, {rs(*FEATURES, 'fwd_ret_1m', 'fwd_ret_demeaned')} FROM panel", "panel"))
def i5(spark, d):
    return rounded(_panel(spark, d).select("as_of_date", "ticker", "sector", *FEATURES, "fwd_ret_1m", "fwd_ret_demeaned"))


@query("d15_coverage", O.sql("SELECT as_of_date, count(*) AS names, count(*) FILTER (f_score IS NOT NULL AND z_score IS NOT NULL AND o_score IS NOT NULL) AS fully_scored, " + ", ".join(f"count(*) FILTER ({s} IS NULL) AS missing_{s}" for s in SCORES) + " FROM scores GROUP BY as_of_date", "scores"))
def d15(spark, d):
    return scores.coverage(_panel(spark, d))


@query("n6_tag_coverage", O.sql(" UNION ALL ".join(f"SELECT '{t}' AS tag, round(avg((\"{t}\" IS NOT NULL)::int::double), 6) AS coverage FROM wide" for t in O.HELD), "wide"))
def n6(spark, d):
    return rounded(scores.tag_coverage(asof.snapshot(X.facts(spark, d), X.DATES), O.HELD))


@query("b8_screens", O.sql("SELECT screen, as_of_date, count(*) FILTER (ok) AS names FROM scores, LATERAL (VALUES ('f_high', f_score >= 8), ('f_low', f_score <= 2), ('z_safe', z_score > 2.99), ('z_grey', z_score >= 1.81 AND z_score <= 2.99), ('z_distress', z_score < 1.81), ('o_safe', o_score < 0), ('o_risk', o_score > 0)) t(screen, ok) GROUP BY screen, as_of_date", "scores"))
def b8(spark, d):
    return scores.screen_counts(_panel(spark, d))


@query("b8_screened_names", O.sql("SELECT as_of_date, ticker, f_score, round(z_score, 6) AS z_score FROM scores WHERE f_score >= 8 AND z_score > 2.99 AND o_score < 0", "scores"))
def b8_names(spark, d):
    return rounded(scores.apply_screens(_panel(spark, d), ["f_high", "z_safe", "o_safe"]).select("as_of_date", "ticker", "f_score", "z_score"))


@query("b4_restricted_facts", O.sql("SELECT ticker, tag, fiscal_period_end, filed_date, round(value, 4) AS value FROM facts WHERE tag IN ('Revenues', 'Assets') AND ticker IN (SELECT 'P' || p_partkey FROM part WHERE p_size < 10)", "facts"))
def b4(spark, d):
    names = X.table(spark, d, "part").filter("p_size < 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("ticker"))
    return asof.restrict(X.facts(spark, d), names, ["Revenues", "Assets"]).select("ticker", "tag", "fiscal_period_end", "filed_date", r("value", 4).alias("value"))


@query(
    "b5_pinned_lookup",
    O.sql(
        """SELECT p.ticker, p.tag, p.fiscal_period_end, p.as_of_date, round((SELECT max_by(value, filed_date) FROM facts f WHERE f.ticker = p.ticker AND f.tag = p.tag AND f.fiscal_period_end = p.fiscal_period_end AND f.filed_date <= p.as_of_date), 4) AS value
FROM (SELECT DISTINCT ticker, tag, fiscal_period_end, d AS as_of_date FROM facts, (VALUES (DATE '1998-06-30'), (DATE '2000-12-31')) t(d) WHERE tag = 'Revenues') p""",
        "facts",
    ),
)
def b5(spark, d):
    f = asof.restrict(X.facts(spark, d), tags=["Revenues"])
    days = F.explode(F.array(F.lit(dt.date(1998, 6, 30)), F.lit(dt.date(2000, 12, 31))))
    asked = f.select("ticker", "tag", "fiscal_period_end").distinct().select("*", days.alias("as_of_date"))
    asked = asked.withColumn("request_id", F.struct("fiscal_period_end", "ticker", "as_of_date"))
    return asof.lookup(asked, f).select("ticker", "tag", F.col("request_id.fiscal_period_end").alias("fiscal_period_end"), "as_of_date", r("value", 4).alias("value"))


@query("b14_latest_section", O.sql("SELECT ticker, sector, decile, round(composite_score, 6) AS composite_score, round(1 / (1 + exp(-o_score)), 4) AS p_default FROM book WHERE as_of_date = (SELECT max(as_of_date) FROM book)", "book"))
def b14(spark, d):
    return rounded(scores.latest_section(_book(spark, d)).select("ticker", "sector", "decile", "composite_score", "p_default"))


@query("c3_members", O.sql("SELECT as_of_date, ticker FROM spine s WHERE EXISTS (SELECT 1 FROM membership m WHERE m.ticker = s.ticker AND (start_date IS NULL OR start_date <= as_of_date) AND (end_date IS NULL OR end_date > as_of_date))", "spine", "membership"))
def c3(spark, d):
    spine = X.sectors(spark, d).select("ticker", F.explode(F.array(*[F.lit(x) for x in X.DATES])).alias("as_of_date"))
    return membership.members_on(spine, X.membership(spark, d)).select("as_of_date", "ticker")


@query("n8_gate_audit", O.sql("SELECT as_of_date, count(*) AS removed, count(f_score) AS with_score FROM panel s WHERE NOT EXISTS (SELECT 1 FROM membership m WHERE m.ticker = s.ticker AND (start_date IS NULL OR start_date <= as_of_date) AND (end_date IS NULL OR end_date > as_of_date)) GROUP BY as_of_date", "panel", "membership"))
def n8(spark, d):
    return membership.removed_by_membership(_panel(spark, d), X.membership(spark, d))


@query(
    "g2_membership_unwinding",
    """WITH cur AS (SELECT c_custkey AS k, c_name AS ticker FROM customer WHERE c_custkey % 3 <> 0),
ch AS (SELECT o_orderdate::date AS date, CASE WHEN o_orderkey % 2 = 0 THEN c_name END AS added, CASE WHEN o_orderkey % 2 = 1 THEN c_name END AS removed FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT ticker, (SELECT max(date) FROM ch WHERE added = ticker) AS start_date, NULL::date AS end_date FROM cur
UNION ALL SELECT removed, NULL, date FROM ch WHERE removed IS NOT NULL AND removed NOT IN (SELECT ticker FROM cur)""",
)
def g2(spark, d):
    c, o = X.table(spark, d, "customer"), X.table(spark, d, "orders")
    current = c.filter("c_custkey % 3 <> 0").select(F.col("c_name").alias("ticker"))
    j = o.join(c, F.col("c_custkey") == F.col("o_custkey"))
    even = F.col("o_orderkey") % 2 == 0
    changes = j.select(F.to_date("o_orderdate").alias("date"), F.when(even, F.col("c_name")).alias("added"), F.when(~even, F.col("c_name")).alias("removed"))
    return membership.build_membership(current, changes)


@query("g6_universe_overlap", "WITH a AS (SELECT DISTINCT l_partkey AS t FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS t FROM lineitem WHERE l_quantity > 45) SELECT (SELECT count(*) FROM a JOIN b USING (t)) AS both_, (SELECT count(*) FROM a WHERE t NOT IN (SELECT t FROM b)) AS only_a, (SELECT count(*) FROM b WHERE t NOT IN (SELECT t FROM a)) AS only_b".replace("both_", '"both"'))
def g6(spark, d):
    li = X.table(spark, d, "lineitem").withColumn("ticker", F.col("l_partkey"))
    return membership.overlap(li.filter("l_returnflag = 'R'"), li.filter("l_quantity > 45"))


# ---- prices

_DAILY = "daily AS (SELECT 'P' || l_partkey AS ticker, l_shipdate::date AS date, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_extendedprice / l_quantity END AS close, l_orderkey * 10 + l_linenumber AS k, l_quantity AS volume FROM lineitem)"


def _daily(spark, d) -> DataFrame:
    close = F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_extendedprice") / F.col("l_quantity"))
    return X.table(spark, d, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit(".KS")).alias("symbol"), F.to_date("l_shipdate").alias("date"), close.alias("close"), F.col("l_quantity").alias("volume"))


@query("d6_month_end_closes", f"WITH {_DAILY}, one AS (SELECT ticker, date, max(close) AS close FROM daily WHERE close <> 0 GROUP BY ticker, date) SELECT ticker, last_day(date) AS month_end, round(max_by(close, date), 9) AS close FROM one GROUP BY ticker, last_day(date)")
def d6(spark, d):
    daily = prices.strip_suffix(_daily(spark, d), ".KS")
    one = daily.filter("close <> 0").groupBy("ticker", "date").agg(F.max("close").alias("close"))
    return prices.month_end_closes(one).withColumn("close", F.round("close", 9))


@query("e6_monthly_returns", O.sql("SELECT ticker, month_end, round(ret, 6) AS ret FROM returns", "returns"))
def e6(spark, d):
    return rounded(prices.monthly_returns(X.prices(spark, d)).select("ticker", "month_end", "ret"))


@query(
    "e14_forward_returns",
    O.sql(
        "SELECT a.ticker, a.month_end, " + ", ".join(f"round(CASE WHEN count(b.ret) FILTER (b.mi <= a.mi + {k}) = {k} THEN product(1 + b.ret) FILTER (b.mi <= a.mi + {k}) - 1 END, 6) AS fwd_{k}m" for k in (1, 3, 6, 12)) + " FROM returns a LEFT JOIN returns b ON a.ticker = b.ticker AND b.mi > a.mi AND b.mi <= a.mi + 12 GROUP BY a.ticker, a.month_end, a.mi",
        "returns",
    ),
)
def e14(spark, d):
    ks = [1, 3, 6, 12]
    return rounded(prices.forward_returns(X.prices(spark, d), ks).select("ticker", "month_end", *[f"fwd_{k}m" for k in ks]))


@query("a18_complete_grid", O.sql("SELECT ticker, month_end, round(close, 4) AS close FROM prices", "prices"))
def a18(spark, d):
    p = X.prices(spark, d)
    months = prices.month_ends(dt.date(1995, 1, 1), dt.date(2001, 12, 31))
    return rounded(prices.complete_grid(p.filter(F.col("close").isNotNull()), X.sectors(spark, d), months))


@query(
    "n1_drawdowns",
    O.sql(
        """, q AS (SELECT ticker, close, max(close) OVER (PARTITION BY ticker ORDER BY mi) AS peak, max(close) OVER (PARTITION BY ticker ORDER BY mi ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM prices WHERE close IS NOT NULL)
SELECT ticker, round(min(close / peak - 1), 6) AS worst, bool_or(coalesce(close / peak - 1 < -0.1 AND later > 0.95 * peak, false)) AS recovered FROM q GROUP BY ticker""",
        "prices",
    ).replace(")\n, q AS", "),\nq AS"),
)
def n1(spark, d):
    return rounded(prices.drawdowns(X.prices(spark, d), -0.1, 0.95))


@query("f7_liquid_universe", f"WITH {_DAILY} SELECT ticker, round(median(close * volume), 4) AS median_value, count(*) AS days FROM daily GROUP BY ticker HAVING count(*) >= 20 ORDER BY median(close * volume) DESC, ticker LIMIT 100")
def f7(spark, d):
    return prices.liquid_universe(prices.strip_suffix(_daily(spark, d), ".KS"), 20, 100).select("ticker", r("median_value", 4).alias("median_value"), "days")


# ---- portfolios


@query("e10_buckets", O.sql("SELECT as_of_date, ticker, round(composite_score, 6) AS composite_score, decile FROM book", "book"))
def e10(spark, d):
    return rounded(_book(spark, d).select("as_of_date", "ticker", "composite_score", "decile"))


@query("d3_bucket_returns", O.sql("SELECT as_of_date, decile, round(avg(fwd_ret_1m), 6) AS ret FROM book WHERE decile IS NOT NULL GROUP BY ALL", "book"))
def d3(spark, d):
    return rounded(portfolios.bucket_returns(_book(spark, d)))


_SINGLE = """single AS (SELECT strategy, as_of_date, avg(fwd_ret_1m) FILTER (decile = 10) - avg(fwd_ret_1m) FILTER (decile = 1) AS spread FROM
  (SELECT *, """ + O.buckets("score", 10, "strategy, as_of_date") + """ AS decile FROM (SELECT as_of_date, ticker, fwd_ret_1m, strategy, round(score, 9) AS score FROM panel,
   LATERAL (VALUES """ + ", ".join(f"('{f}', {f})" for f in FEATURES) + """) t(strategy, score))) WHERE decile IN (1, 10) GROUP BY strategy, as_of_date)"""


def _rounded_features(p: DataFrame) -> DataFrame:
    return p.withColumns({f: F.round(f, 9) for f in FEATURES})


@query("d4_single_score_spreads", O.sql("SELECT strategy, as_of_date, round(spread, 6) AS spread FROM single", "panel").replace("\nSELECT strategy, as_of_date, round", ",\n" + _SINGLE + "\nSELECT strategy, as_of_date, round"))
def d4(spark, d):
    return rounded(portfolios.single_score_spreads(_rounded_features(_panel(spark, d)), FEATURES))


@query("d7_spread_excluding", O.sql("SELECT as_of_date, round(avg(fwd_ret_1m) FILTER (decile = 10) - avg(fwd_ret_1m) FILTER (decile = 1), 6) AS spread FROM book WHERE decile IN (1, 10) AND ticker NOT IN ('P1', 'P2', 'P3') AND sector <> 'Brand#11' GROUP BY as_of_date", "book"))
def d7(spark, d):
    return rounded(portfolios.spread(portfolios.exclude(_book(spark, d), ["p1 ", "P2", "P3"], ["Brand#11"])))


_CONTRIB = "c AS (SELECT *, CASE WHEN decile = 10 THEN 1 ELSE -1 END * fwd_ret_1m / count(*) OVER (PARTITION BY as_of_date, decile) AS contribution FROM ranked WHERE decile IN (1, 10))"


def _with(extra: str, final: str, *names: str) -> str:
    """A select over model tables and one more."""
    return O.sql("@@", *names).replace("\n@@", ",\n" + extra + "\n" + final)


@query("d8_sector_attribution", _with(_CONTRIB, "SELECT coalesce(sector, 'Unknown') AS sector, round(sum(contribution) / any_value(m) * 12, 6) AS ann_contribution, round(count(*) FILTER (decile = 10) / any_value(m)::double, 6) AS avg_top_names, round(count(*) FILTER (decile = 1) / any_value(m)::double, 6) AS avg_bottom_names FROM c, (SELECT count(DISTINCT as_of_date) AS m FROM c) GROUP BY 1", "ranked"))
def d8(spark, d):
    return rounded(portfolios.sector_attribution(_book(spark, d)))


@query("d9_month_explorer", O.sql("SELECT as_of_date, decile, count(*) AS names, round(avg(fwd_ret_1m), 6) AS mean, round(median(fwd_ret_1m), 6) AS median FROM ranked WHERE decile IN (1, 10) GROUP BY ALL", "ranked"))
def d9(spark, d):
    return rounded(portfolios.month_buckets(_book(spark, d)))


@query("d9_contributions", _with(_CONTRIB, "SELECT as_of_date, ticker, sector, decile, round(fwd_ret_1m, 6) AS fwd_ret_1m, round(contribution, 8) AS contribution FROM c", "ranked"))
def d9c(spark, d):
    c = portfolios.contributions(_book(spark, d))
    return c.select("as_of_date", "ticker", "sector", "decile", r("fwd_ret_1m"), F.round("contribution", 8).alias("contribution"))


@query("d10_legs", O.sql(f"SELECT as_of_date, {rs('market', 'top', 'bottom', 'long_excess', 'short_excess', 'spread')} FROM legs", "legs"))
def d10(spark, d):
    return rounded(portfolios.leg_decomposition(_book(spark, d)))


_HORIZON = "h AS (SELECT horizon, b.as_of_date, avg(f) FILTER (decile = 10) - avg(f) FILTER (decile = 1) AS spread FROM book b JOIN (SELECT a.ticker, a.month_end, horizon, CASE WHEN count(r.ret) = horizon THEN product(1 + r.ret) - 1 END AS f FROM returns a, (VALUES (1), (3), (6), (12)) t(horizon), returns r WHERE r.ticker = a.ticker AND r.mi > a.mi AND r.mi <= a.mi + horizon GROUP BY a.ticker, a.month_end, horizon) x ON x.ticker = b.ticker AND x.month_end = b.as_of_date WHERE decile IN (1, 10) AND f IS NOT NULL GROUP BY horizon, b.as_of_date)"


@query("d11_horizon_spreads", _with(_HORIZON, "SELECT horizon, as_of_date, round(spread, 6) AS spread FROM h WHERE spread IS NOT NULL", "book", "returns"))
def d11(spark, d):
    ks = [1, 3, 6, 12]
    return rounded(portfolios.horizon_spreads(_book(spark, d), prices.forward_returns(X.prices(spark, d), ks), ks))


@query("d12_sector_heatmap", O.sql("SELECT sector, " + ", ".join(f'round(avg(composite_score) FILTER (year(as_of_date) = {y}), 6) AS "{y}"' for y in range(1997, 2002)) + " FROM book GROUP BY sector", "book"))
def d12(spark, d):
    return rounded(portfolios.sector_heatmap(_book(spark, d), list(range(1997, 2002))))


@query("d13_score_return_line", O.sql("SELECT round(regr_slope(fwd_ret_1m, f_score), 8) AS slope, round(regr_intercept(fwd_ret_1m, f_score), 8) AS intercept, regr_count(fwd_ret_1m, f_score)::bigint AS n FROM panel", "panel"))
def d13(spark, d):
    return portfolios.score_return_line(_panel(spark, d)).select(F.round("slope", 8).alias("slope"), F.round("intercept", 8).alias("intercept"), "n")


_TURN = "w AS (SELECT decile, as_of_date, ticker, 1.0::double / count(*) OVER (PARTITION BY decile, as_of_date) AS w FROM ranked WHERE decile IN (1, 10)), dd AS (SELECT decile, as_of_date, lag(as_of_date) OVER (PARTITION BY decile ORDER BY as_of_date) AS p FROM (SELECT DISTINCT decile, as_of_date FROM w)), tt AS (SELECT decile, as_of_date, sum(abs(w)) / 2 AS turnover FROM (SELECT dd.decile, dd.as_of_date, ticker, sum(CASE WHEN w.as_of_date = dd.as_of_date THEN w ELSE -w END) AS w FROM dd JOIN w ON w.decile = dd.decile AND w.as_of_date IN (dd.as_of_date, dd.p) WHERE dd.p IS NOT NULL GROUP BY ALL) GROUP BY decile, as_of_date)"


@query("e15_turnover", _with(_TURN, "SELECT dd.as_of_date, dd.decile, round(turnover, 6) AS turnover FROM dd LEFT JOIN tt USING (decile, as_of_date)", "ranked"))
def e15(spark, d):
    return rounded(portfolios.turnover(_book(spark, d)))


_NET = "s AS (SELECT as_of_date AS date, spread AS ret, traded FROM (SELECT as_of_date, avg(fwd_ret_1m) FILTER (decile = 10) - avg(fwd_ret_1m) FILTER (decile = 1) AS spread FROM book WHERE decile IN (1, 10) GROUP BY as_of_date) LEFT JOIN (SELECT as_of_date, 2 * sum(turnover) AS traded FROM tt GROUP BY as_of_date HAVING count(*) = 2) USING (as_of_date))"


@query("j12_net_of_costs", _with(_TURN + ",\n" + _NET, "SELECT cost_bps, date, round(ret - cost_bps / 1e4 * coalesce(traded, 0), 8) AS ret FROM s, (VALUES (0.0::double), (10), (25), (50)) t(cost_bps)", "ranked", "book"))
def j12(spark, d):
    n = seriesstats.net_of_costs(backtest.costs_input(_book(spark, d)), [], [0, 10, 25, 50])
    return n.select("cost_bps", "date", F.round("ret", 8).alias("ret"))


@query("j13_breakeven_cost", _with(_TURN + ",\n" + _NET, "SELECT 'run' AS run, round(CASE WHEN avg(ret) > 0 AND avg(coalesce(traded, 0)) > 0 THEN avg(ret) / avg(coalesce(traded, 0)) * 1e4 END, 4) AS breakeven_bps FROM s WHERE ret IS NOT NULL", "ranked", "book"))
def j13(spark, d):
    return seriesstats.breakeven_cost(backtest.costs_input(_book(spark, d)).withColumn("run", F.lit("run")), ["run"]).select("run", F.round("breakeven_bps", 4).alias("breakeven_bps"))


@query("n2_rank_stability", _with("n AS (SELECT DISTINCT as_of_date, dense_rank() OVER (ORDER BY as_of_date) AS i FROM book), pr AS (SELECT y.as_of_date, x.composite_score AS a, y.composite_score AS b FROM book x JOIN n nx ON nx.as_of_date = x.as_of_date JOIN n ny ON ny.i = nx.i + 1 JOIN book y ON y.as_of_date = ny.as_of_date AND y.ticker = x.ticker WHERE x.composite_score IS NOT NULL AND y.composite_score IS NOT NULL), rk AS (SELECT as_of_date, rank() OVER (PARTITION BY as_of_date ORDER BY a) + (count(*) OVER (PARTITION BY as_of_date, a) - 1) / 2.0::double AS ra, rank() OVER (PARTITION BY as_of_date ORDER BY b) + (count(*) OVER (PARTITION BY as_of_date, b) - 1) / 2.0::double AS rb FROM pr)", "SELECT as_of_date, round(corr(ra, rb), 6) AS spearman, count(*) AS names FROM rk GROUP BY as_of_date", "book"))
def n2(spark, d):
    return rounded(portfolios.rank_stability(_book(spark, d)))


@query("n3_bucket_gradient", O.sql("SELECT decile, round(avg(ret) * 12, 6) AS ann_mean, count(ret) AS months FROM (SELECT as_of_date, decile, avg(fwd_ret_1m) AS ret FROM book WHERE decile IS NOT NULL GROUP BY ALL) GROUP BY decile", "book"))
def n3(spark, d):
    return rounded(portfolios.bucket_gradient(_book(spark, d)))


@query("b15_company_history", O.sql("SELECT ticker, as_of_date, f_score, round(z_score, 6) AS z_score, round(o_score, 6) AS o_score, round(composite_score, 6) AS composite_score, decile FROM book WHERE ticker IN ('P1', 'P7')", "book"))
def b15(spark, d):
    return rounded(portfolios.company_history(_book(spark, d), ["p1", "P7"]))


@query("f4_top_contributors", _with(_CONTRIB, "SELECT as_of_date, ticker, place, round(contribution, 8) AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date ORDER BY round(abs(contribution), 9) DESC, ticker)::int AS place FROM c) WHERE place <= 5", "ranked"))
def f4(spark, d):
    b = _book(spark, d)
    top = portfolios.top_contributors(b, 5)
    return top.select("as_of_date", "ticker", "place", F.round("contribution", 8).alias("contribution"))


@query("k2_screen_run", _with("sr AS (SELECT *, (round(f_score_z, 9) + round(z_score_z, 9) + round(o_score_z, 9)) / 3 AS score FROM panel)", "SELECT as_of_date, ticker, round(score, 6) AS composite_score, " + O.buckets("score", 5) + " AS decile FROM sr", "panel"))
def k2(spark, d):
    done = backtest.screen_run(_rounded_features(_panel(spark, d)), 5)
    return rounded(done.select("as_of_date", "ticker", "composite_score", "decile"))


_TWINS = """gz AS (SELECT s.* FROM sectored s WHERE EXISTS (SELECT 1 FROM membership m WHERE m.ticker = s.ticker AND (start_date IS NULL OR start_date <= as_of_date) AND (end_date IS NULL OR end_date > as_of_date))),
zz AS (SELECT *, """ + ", ".join(O._zs) + """ FROM gz WINDOW sec AS (PARTITION BY as_of_date, sector), al AS (PARTITION BY as_of_date)),
zc AS (SELECT zz.*, round((f_score_z + z_score_z + o_score_z) / 3, 9) AS composite_score, r1.ret AS fwd_ret_1m FROM zz LEFT JOIN returns r1 ON r1.ticker = zz.ticker AND r1.mi = year(as_of_date) * 12 + month(as_of_date) + 1),
cb AS (SELECT *, """ + O.buckets("composite_score") + """ AS decile FROM zc),
twins AS (SELECT run, as_of_date AS date, avg(fwd_ret_1m) FILTER (decile = 10) - avg(fwd_ret_1m) FILTER (decile = 1) AS ret FROM (SELECT 'static' AS run, as_of_date, decile, fwd_ret_1m FROM book UNION ALL SELECT 'corrected', as_of_date, decile, fwd_ret_1m FROM cb) WHERE decile IN (1, 10) GROUP BY run, as_of_date)"""


def _twins(spark, d) -> dict[str, DataFrame]:
    panels = backtest.twin_panels(X.facts(spark, d), X.prices(spark, d), X.sectors(spark, d), X.DATES, X.membership(spark, d))
    return {k: _booked(p) for k, p in panels.items()}


@query("k6_compare_runs", _with(_TWINS, "SELECT run, CAST(date AS VARCHAR) AS date, round(product(1 + ret) OVER (PARTITION BY run ORDER BY date) - 1, 6) AS cum_ret FROM twins WHERE ret IS NOT NULL", "book", "sectored", "membership", "returns"))
def k6(spark, d):
    return rounded(backtest.compare_runs(_twins(spark, d)))


@query("n9_twin_correlation", _with(_TWINS, "SELECT 'composite' AS strategy, round(corr(s.ret, c.ret), 6) AS corr, round(avg(c.ret - s.ret), 6) AS mean_delta, count(*) AS n FROM twins s JOIN twins c USING (date) WHERE s.run = 'static' AND c.run = 'corrected' AND s.ret IS NOT NULL AND c.ret IS NOT NULL", "book", "sectored", "membership", "returns"))
def n9(spark, d):
    series = {k: portfolios.spread(b).filter("spread IS NOT NULL").select(F.lit("composite").alias("strategy"), F.col("as_of_date").alias("date"), F.col("spread").alias("ret")) for k, b in _twins(spark, d).items()}
    return rounded(backtest.twin_correlation(series["static"], series["corrected"]))


_LEGS = "lg AS (SELECT leg, as_of_date AS date, ret FROM legs, LATERAL (VALUES ('spread', spread), ('long_excess', long_excess), ('short_excess', short_excess), ('top', top), ('market', market)) t(leg, ret))"


@query("j16_leg_table", _with(_LEGS, "SELECT leg, months, ann_return, nw_tstat, CASE WHEN leg NOT IN ('top', 'market') THEN psr_stat END AS psr_stat, CASE WHEN leg NOT IN ('top', 'market') THEN survives_95 END AS survives_95 FROM (@STATS)", "legs"))
def j16(spark, d):
    t = backtest.leg_table(_book(spark, d), least=12)
    return rounded(t.select("leg", "months", "ann_return", "nw_tstat", "psr_stat", "survives_95"))


@query("c20_watchlist", O.sql("SELECT ticker, max(as_of_date) AS as_of_date, round(max_by(composite_score, as_of_date), 6) AS composite_score, max_by(decile, as_of_date) AS decile, (SELECT max_by(decile, as_of_date) FROM book o WHERE o.ticker = b.ticker AND o.as_of_date <= DATE '2000-09-30') AS decile_12m_ago FROM (SELECT *, true AS k FROM book WHERE composite_score IS NOT NULL AND decile IS NOT NULL) b WHERE ticker IN ('P1', 'P7', 'P12') GROUP BY ticker", "book").replace("FROM book o WHERE o.ticker", "FROM book o WHERE o.composite_score IS NOT NULL AND o.decile IS NOT NULL AND o.ticker"))
def c20(spark, d):
    b = _book(spark, d).filter("composite_score IS NOT NULL AND decile IS NOT NULL")
    return rounded(portfolios.watchlist(b, ["p1", "P7", "P12"]))


# ---- series statistics, over one series for each brand


def _market(b: DataFrame) -> DataFrame:
    m = b.groupBy("date").agg(F.round(F.avg("ret"), 8).alias("market"))
    return b.join(m, "date")


@query("j2_newey_west", O.sql("SELECT series, n, round(mean, 8) AS mean, nw_lag, round(nw_tstat, 6) AS nw_tstat FROM (" + O.newey_west("brand", "series") + ")", "brand"))
def j2(spark, d):
    t = seriesstats.newey_west(X.brand_returns(spark, d), ["series"])
    return t.select("series", F.col("n").cast("long").alias("n"), F.round("mean", 8).alias("mean"), "nw_lag", r("nw_tstat"))


@query("j3_deflated_sharpe", O.sql(f"SELECT series, n, {rs('mean', 'sd', 'skew', 'kurt', 'sharpe', 'sr0', 'psr_stat')}, psr_stat > {O.CUT_95!r} AS survives_95 FROM (" + O.sharpe("brand", "series") + ")", "brand"))
def j3(spark, d):
    s = seriesstats.deflated_sharpe(X.brand_returns(spark, d), ["series"])
    return rounded(s.select("series", "n", "mean", "sd", "skew", "kurt", "sharpe", "sr0", "psr_stat", "survives_95"))


_ROLL = f"""m AS (SELECT series, date, n, mean, sd, m2, (m3 - 3 * mean * m2 + 2 * mean ** 3) / nullif((m2 - mean * mean) ** 1.5::double, 0) AS skew, (m4 - 4 * mean * m3 + 6 * mean * mean * m2 - 3 * mean ** 4) / nullif((m2 - mean * mean) ** 2, 0) AS kurt
FROM (SELECT series, date, count(ret) OVER w AS n, avg(ret) OVER w AS mean, stddev_samp(ret) OVER w AS sd, avg(ret ** 2) OVER w AS m2, avg(ret ** 3) OVER w AS m3, avg(ret ** 4) OVER w AS m4 FROM brand WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))),
x AS (SELECT *, 1 - skew * sr + (kurt - 1) / 4 * sr * sr AS inside FROM (SELECT *, mean / nullif(sd, 0) AS sr FROM m)),
roll AS (SELECT series, date, CASE WHEN n = 24 THEN mean * 12 END AS ann_spread, CASE WHEN n = 24 THEN mean * 12 - 1.96::double * sd / sqrt(24) * 12 END AS lo, CASE WHEN n = 24 THEN mean * 12 + 1.96::double * sd / sqrt(24) * 12 END AS hi,
 CASE WHEN n = 24 THEN (sqrt(inside / (n - 1)) * {O.best_of_trials(4)!r}::double + {O.CUT_95!r}::double * sqrt(inside) / sqrt(n - 1)) * sd * 12 END AS dsr_hi FROM x)"""


@query("e12_rolling_hurdle", _with(_ROLL, f"SELECT series, date, {rs('ann_spread', 'lo', 'hi')}, round(-dsr_hi, 6) AS dsr_lo, round(dsr_hi, 6) AS dsr_hi FROM roll", "brand"))
def e12(spark, d):
    return rounded(seriesstats.rolling_hurdle(X.brand_returns(spark, d), ["series"]))


@query("n5_hurdle_years", _with(_ROLL, "SELECT series, year(date)::int AS year, round(avg(ann_spread), 6) AS mean_spread, count(*) FILTER (ann_spread > dsr_hi) AS above, count(*) FILTER (ann_spread < -dsr_hi) AS below, round(median(dsr_hi), 6) AS median_hurdle FROM roll WHERE dsr_hi IS NOT NULL GROUP BY ALL", "brand"))
def n5(spark, d):
    return rounded(seriesstats.hurdle_years(seriesstats.rolling_hurdle(X.brand_returns(spark, d), ["series"]), ["series"]))


@query("e13_cumulative", O.sql("SELECT series, date, round(product(1 + ret) OVER (PARTITION BY series ORDER BY date) - 1, 6) AS cum_ret FROM brand", "brand"))
def e13(spark, d):
    return rounded(seriesstats.compounded(X.brand_returns(spark, d), ["series"]))


@query("d14_half_samples", _with("i AS (SELECT series, ret, row_number() OVER (PARTITION BY series ORDER BY date) AS i, count(*) OVER (PARTITION BY series) AS n FROM brand)", "SELECT series, round(product(1 + ret) - 1, 6) AS total, round(coalesce(product(1 + ret) FILTER (i <= n // 2), 1) - 1, 6) AS first_half, round(product(1 + ret) FILTER (i > n // 2) - 1, 6) AS second_half FROM i GROUP BY series", "brand"))
def d14(spark, d):
    return rounded(seriesstats.half_samples(X.brand_returns(spark, d), ["series"]))


@query("n4_calendar_years", O.sql("SELECT series, year(date)::int AS year, round(product(1 + ret) - 1, 6) AS year_ret, count(*) AS months FROM brand GROUP BY ALL", "brand"))
def n4(spark, d):
    return rounded(seriesstats.calendar_years(X.brand_returns(spark, d), ["series"]))


_ROBUST = """b0 AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ret DESC, date) AS hi, row_number() OVER (PARTITION BY series ORDER BY ret, date) AS lo FROM brand),
q AS (SELECT series, quantile_cont(ret, 0.01) AS q1, quantile_cont(ret, 0.99) AS q2 FROM brand GROUP BY series),
sc AS (SELECT series || '|baseline' AS k, date, ret FROM b0 UNION ALL SELECT series || '|winsorised', date, greatest(least(ret, q2), q1) FROM b0 JOIN q USING (series)
 UNION ALL SELECT series || '|drop_top', date, ret FROM b0 WHERE hi > 3 UNION ALL SELECT series || '|drop_bottom', date, ret FROM b0 WHERE lo > 3)"""


def _stats_sql(source: str, key: str) -> str:
    return f"SELECT {key}, d.n AS months, round(pow(1 + d.mean, 12) - 1, 6) AS ann_return, round(nw_tstat, 6) AS nw_tstat, round(psr_stat, 6) AS psr_stat, psr_stat > {O.CUT_95!r} AS survives_95 FROM ({O.sharpe(source, key)}) d JOIN ({O.newey_west(source, key)}) t USING ({key})"


SQL["j16_leg_table"] = SQL["j16_leg_table"].replace("@STATS", _stats_sql("lg", "leg"))


@query("j11_robustness", _with(_ROBUST, "SELECT split_part(k, '|', 1) AS series, split_part(k, '|', 2) AS scenario, * EXCLUDE (k) FROM (" + _stats_sql("sc", "k") + ")", "brand"))
def j11(spark, d):
    t = seriesstats.robustness(X.brand_returns(spark, d), ["series"], drop_top=3, drop_bottom=3)
    return rounded(t.select("series", "scenario", "months", "ann_return", "nw_tstat", "psr_stat", "survives_95"))


@query("j6_validation_summary", _with(_SINGLE + ",\nv AS (SELECT strategy, as_of_date AS date, spread AS ret FROM single WHERE spread IS NOT NULL UNION ALL SELECT 'composite', as_of_date, spread FROM (SELECT as_of_date, avg(fwd_ret_1m) FILTER (decile = 10) - avg(fwd_ret_1m) FILTER (decile = 1) AS spread FROM book GROUP BY as_of_date) WHERE spread IS NOT NULL)", _stats_sql("v", "strategy"), "panel", "book"))
def j6(spark, d):
    t = backtest.validate(_rounded_features(_book(spark, d)), least=12)
    return rounded(t.select("strategy", "months", "ann_return", "nw_tstat", "psr_stat", "survives_95"))


@query("j17_market_exposure", O.sql("SELECT series, round(covar_samp(ret, market) / var_samp(market), 6) AS beta, round(corr(ret, market), 6) AS corr, count(*) FILTER (market > 0) AS up_months, count(*) FILTER (market <= 0) AS down_months, round(avg(ret) FILTER (market > 0), 6) AS up_mean, round(avg(ret) FILTER (market <= 0), 6) AS down_mean FROM brand JOIN market USING (date) GROUP BY series", "brand", "market"))
def j17(spark, d):
    return rounded(seriesstats.market_exposure(_market(X.brand_returns(spark, d)), ["series"], "ret"))


_BETA = """o AS (SELECT series, date, ret, market, row_number() OVER (PARTITION BY series ORDER BY date) AS i, count(*) OVER p AS n, regr_slope(ret, market) OVER p AS beta, regr_intercept(ret, market) OVER p AS alpha, avg(market) OVER p AS mbar, var_pop(market) OVER p AS mvar
 FROM brand JOIN market USING (date) WINDOW p AS (PARTITION BY series)),
g AS (SELECT *, floor(4 * pow(n / 100.0::double, 2.0::double / 9))::int AS lag, ret - alpha - beta * market AS e, (ret - alpha - beta * market) * (mvar + mbar * mbar - mbar * market) / mvar AS ga, (ret - alpha - beta * market) * (market - mbar) / mvar AS gb FROM o),
v AS (SELECT a.series, any_value(a.n) AS n, any_value(a.lag) AS lag, any_value(a.alpha) AS alpha, any_value(a.beta) AS beta, sum(CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (a.i - b.i) / (a.lag + 1.0::double)) END * a.ga * b.ga) AS va, sum(CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (a.i - b.i) / (a.lag + 1.0::double)) END * a.gb * b.gb) AS vb
 FROM g a JOIN g b ON a.series = b.series AND b.i BETWEEN a.i - a.lag AND a.i GROUP BY a.series)"""


@query("j18_beta_adjusted", _with(_BETA, "SELECT v.series, n AS months, round(alpha, 8) AS alpha_monthly, round(alpha / (sqrt(va) / n), 6) AS alpha_t, round(beta, 6) AS beta, round(beta / (sqrt(vb) / n), 6) AS beta_t, round(r2, 6) AS r2, lag AS nw_lag FROM v JOIN (SELECT series, regr_r2(ret, market) AS r2 FROM o GROUP BY series) USING (series)", "brand", "market"))
def j18(spark, d):
    t = seriesstats.beta_adjusted(_market(X.brand_returns(spark, d)), ["series"], "ret")
    return t.select("series", F.col("months").cast("long").alias("months"), F.round("alpha_monthly", 8).alias("alpha_monthly"), r("alpha_t"), r("beta"), r("beta_t"), r("r2"), "nw_lag")


_BOOT = """bs AS (SELECT series, date, ret, market, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM brand JOIN market USING (date)),
nn AS (SELECT series, any_value(n) AS n FROM bs GROUP BY series),
dr AS (SELECT series, rep, (('0x' || substr(md5('0|' || rep || '|' || b), 1, 8))::bigint % n + k) % n AS at FROM nn, range(5000) r(rep), LATERAL (SELECT unnest(range(ceil(n / 6.0)::bigint)) AS b), range(6) t(k) WHERE b * 6 + k < n),
ev AS (SELECT series, rep, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(market) AS mm, covar_samp(ret, market) / var_samp(market) AS beta FROM dr JOIN bs USING (series) WHERE bs.i = dr.at GROUP BY series, rep)"""


@query("j20_block_bootstrap", _with(_BOOT, "SELECT series, " + ", ".join(f"round(quantile_cont({e}, {p}), 6) AS {n}_{s}" for n, e in (("ann_mean", "mean * 12"), ("ann_sharpe", "mean / sd * sqrt(12)"), ("ann_alpha", "(mean - beta * mm) * 12")) for s, p in (("lo", 0.025), ("hi", 0.975))) + ", round(avg((mean <= 0)::int::double), 6) AS p_value FROM ev GROUP BY series", "brand", "market"))
def j20(spark, d):
    return rounded(seriesstats.block_bootstrap(_market(X.brand_returns(spark, d)), ["series"], "ret", "market", reps=5000))


@query("j19_horizon_table", _with(_HORIZON + ",\nhs AS (SELECT horizon, as_of_date AS date, spread AS ret FROM h WHERE spread IS NOT NULL)", "SELECT horizon, n AS obs, round(mean, 6) AS mean_spread, round(CASE WHEN mean > -1 THEN pow(1 + mean, 12.0::double / horizon) - 1 END, 6) AS annualized, round(nw_tstat, 6) AS nw_tstat, nw_lag FROM (" + O.newey_west("hs", "horizon", "horizon - 1") + ") WHERE n >= 12", "book", "returns"))
def j19(spark, d):
    ks = [1, 3, 6, 12]
    s = portfolios.horizon_spreads(_book(spark, d), prices.forward_returns(X.prices(spark, d), ks), ks)
    t = seriesstats.horizon_table(s.select("horizon", F.col("as_of_date").alias("date"), F.col("spread").alias("ret")), [], 12)
    return rounded(t.select("horizon", F.col("obs").cast("long").alias("obs"), "mean_spread", "annualized", "nw_tstat", "nw_lag"))


@query("j15_dsr_fail_cost")
def j15(spark, d):
    s = X.brand_returns(spark, d).withColumn("ret", F.col("ret") + 0.01).withColumn("traded", F.lit(0.5))
    return seriesstats.dsr_fail_cost(s, ["series"])


# ---- composite


@query(
    "j8_training_moments",
    _with(
        "n AS (SELECT as_of_date, row_number() OVER (ORDER BY as_of_date) - 1 AS i FROM (SELECT DISTINCT as_of_date FROM panel)), rf AS (SELECT as_of_date AS refit_date, (as_of_date - INTERVAL 7 MONTH)::date AS cutoff FROM n WHERE i % 4 = 0), "
        "tr AS (SELECT refit_date, p.as_of_date, ticker, f_score_z, z_score_z, o_score_z, fwd_ret_demeaned AS y, row_number() OVER (PARTITION BY refit_date ORDER BY p.as_of_date, ticker) - 1 AS place, count(*) OVER (PARTITION BY refit_date) AS c FROM panel p JOIN rf ON p.as_of_date <= cutoff WHERE f_score_z IS NOT NULL AND z_score_z IS NOT NULL AND o_score_z IS NOT NULL AND fwd_ret_demeaned IS NOT NULL), "
        "ok AS (SELECT refit_date FROM tr GROUP BY refit_date HAVING count(DISTINCT as_of_date) >= 6)",
        "SELECT refit_date, greatest(0, floor((place - (c - 5 * (c // 6))) / (c // 6)::double)::int + 1) AS segment, count(*) AS n, round(sum(f_score_z), 4) AS s0, round(sum(y), 4) AS s3, round(sum(f_score_z * f_score_z), 4) AS s00, round(sum(z_score_z * y), 4) AS s13 FROM tr JOIN ok USING (refit_date) GROUP BY ALL",
        "panel",
    ),
)
def j8(spark, d):
    p = _panel(spark, d)
    m = composite.training_moments(p, composite.refit_calendar(p, 4), least_months=6)
    return m.select("refit_date", "segment", "n", *[F.round(c, 4).alias(c) for c in ("s0", "s3", "s00", "s13")])


@query("j9_walk_forward")
def j9(spark, d):
    return rounded(composite.walk_forward(_panel(spark, d), 4, 6)[0].select("as_of_date", "ticker", "composite_score"))


@query("k4_corrected_twin", _with("gz AS (SELECT s.* FROM sectored s WHERE EXISTS (SELECT 1 FROM membership m WHERE m.ticker = s.ticker AND (start_date IS NULL OR start_date <= as_of_date) AND (end_date IS NULL OR end_date > as_of_date))), zz AS (SELECT *, " + ", ".join(O._zs) + " FROM gz WINDOW sec AS (PARTITION BY as_of_date, sector), al AS (PARTITION BY as_of_date)), bb AS (SELECT *, " + O.buckets("composite_score") + " AS decile FROM (SELECT *, round((f_score_z + z_score_z + o_score_z) / 3, 9) AS composite_score FROM zz))", "SELECT as_of_date, ticker, round(composite_score, 6) AS composite_score, decile FROM bb", "sectored", "membership"))
def k4(spark, d):
    p = _panel(spark, d, gated=True).withColumn("composite_score", F.round(scores.equal_weight(), 9))
    return rounded(portfolios.form_buckets(p, "composite_score").select("as_of_date", "ticker", "composite_score", "decile"))


# ---- sources


@query("a1_company_facts", O.sql("SELECT cik, ticker, tag, fiscal_period_end, start_date, filed_date, round(value, 4) AS value, filed_date > min(filed_date) OVER (PARTITION BY cik, tag, fiscal_period_end) AS is_restatement FROM facts", "facts"))
def a1(spark, d):
    from .sources import filings as S

    nested = S.nest_facts(X.facts(spark, d)).select("cik", "ticker", F.from_json("json", S.COMPANY_FACTS).alias("facts"))
    f = S.company_facts(nested)
    return f.select("cik", "ticker", "tag", "fiscal_period_end", "start_date", "filed_date", r("value", 4).alias("value"), "is_restatement")


@query("a22_registry_batch", "SELECT 'P' || p_partkey AS ticker, lpad(p_partkey::varchar, 10, '0') AS cik FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 ORDER BY 1 LIMIT 50")
def a22(spark, d):
    """Every fourth name is unknown to the registry, every seventh held already."""
    from .sources import filings as S

    k = F.col("p_partkey")
    p = X.table(spark, d, "part").select(F.concat(F.lit("P"), k.cast("string")).alias("ticker"), k.alias("cik_str"))
    listed = S.ticker_cik_map(p.filter("cik_str % 4 <> 0"))
    log = p.filter("cik_str % 7 = 0").select(F.lpad(F.col("cik_str").cast("string"), 10, "0").alias("cik"), "ticker")
    return S.registry_batch(p.select(F.lower("ticker").alias("ticker")), listed, log, 50)


@query("a19_replaced_facts", O.sql("SELECT cik, tag, fiscal_period_end, filed_date, round(CASE WHEN cik LIKE '%7' THEN value * 2 ELSE value END, 4) AS value FROM facts", "facts"))
def a19(spark, d):
    f = X.facts(spark, d)
    new = f.filter(F.col("cik").like("%7")).withColumn("value", F.col("value") * 2)
    return backtest.replace_facts(f, new, ["cik"]).select("cik", "tag", "fiscal_period_end", "filed_date", r("value", 4).alias("value"))


_BSE = """, b AS (SELECT entity, fy, make_date(fy + 1, 3, 31) AS period_end, tag, st, value FROM yearly, LATERAL (VALUES ('Assets', 'bs', round(1.5::double * rev + 2000 * size, 4)), ('StockholdersEquity', 'bs', CASE WHEN entity % 4 <> 0 THEN round(0.6::double * rev, 4) ELSE round(0.5::double * rev, 4) END), ('CommonStockSharesOutstanding', 'bs', 1000 + n * size), ('Revenues', 'is', rev), ('NetCashProvidedByUsedInOperatingActivities', 'cf', round(rev - cogs, 4))) t(tag, st, value) WHERE v = 2),
fl AS (SELECT DISTINCT entity, make_date(fy + 1, 3, 31) + (entity % 8 * 30)::int AS filed FROM yearly WHERE v = 2),
fd AS (SELECT b.entity, b.fy, min(filed) AS filed_date FROM (SELECT DISTINCT entity, fy, period_end FROM b) b JOIN fl ON fl.entity = b.entity AND filed > period_end GROUP BY b.entity, b.fy, period_end HAVING min(filed) - period_end <= 180)
SELECT b.entity::varchar AS cik, 'P' || b.entity AS ticker, tag, period_end AS fiscal_period_end, CASE WHEN st <> 'bs' THEN make_date(b.fy, 4, 1) END AS start_date, filed_date, round(value, 4) AS value, CASE WHEN tag = 'CommonStockSharesOutstanding' THEN 'shares' ELSE 'INR' END AS unit FROM b JOIN fd ON fd.entity = b.entity AND fd.fy = b.fy"""


@query("k5_bse_facts", O.sql(_BSE, "yearly").replace(")\n, b AS", "),\nb AS"))
def k5_bse(spark, d):
    """Indian statements: labels, parent equity fallback, first filing within 180 days."""
    from .sources import filings as S

    f = S.bse_facts(*X.bse_landed(spark, d))
    return f.select("cik", "ticker", "tag", "fiscal_period_end", "start_date", "filed_date", r("value", 4).alias("value"), "unit")


_CVM = """, l AS (SELECT entity, fy, v, tag, flow, unit, CASE WHEN unit = 'BRL' AND entity % 2 = 1 THEN 1000.0::double ELSE 1 END * value AS value FROM yearly, LATERAL (VALUES ('Assets', false, 'BRL', round(1.5::double * rev + 2000 * size, 4)), ('StockholdersEquity', false, 'BRL', CASE WHEN entity % 5 <> 0 THEN round(0.5::double * rev, 4) END), ('Revenues', true, 'BRL', rev), ('CostOfRevenue', true, 'BRL', cogs), ('CommonStockSharesOutstanding', false, 'shares', 1000 + n * size - size)) t(tag, flow, unit, value) WHERE value IS NOT NULL AND (v = 1 OR entity % 9 <> 0)),
ff AS (SELECT *, CASE WHEN v = 1 THEN make_date(fy + 1, 3, 15) ELSE make_date(fy + 1, 9, 30) END AS filed_date FROM l)
SELECT lpad(entity::varchar, 14, '0') AS cik, 'P' || entity AS ticker, tag, make_date(fy, 12, 31) AS fiscal_period_end, CASE WHEN flow THEN make_date(fy, 1, 1) END AS start_date, filed_date, round(value, 4) AS value, unit, filed_date > min(filed_date) OVER (PARTITION BY entity, tag, fy) AS is_restatement FROM ff"""


@query("k5_cvm_facts", O.sql(_CVM, "yearly").replace(")\n, l AS", "),\nl AS"))
def k5_cvm(spark, d):
    """Brazilian statements: label checks, scale and sign, receipt dates, shares less treasury."""
    from .sources import filings as S

    f = S.cvm_facts(*X.cvm_landed(spark, d))
    return f.select("cik", "ticker", "tag", "fiscal_period_end", "start_date", "filed_date", r("value", 4).alias("value"), "unit", "is_restatement")


@query("l1_stream_ingest", O.sql("SELECT cik, ticker, tag, fiscal_period_end, filed_date, round(value, 4) AS value, filed_date > min(filed_date) OVER (PARTITION BY cik, tag, fiscal_period_end) AS is_restatement FROM facts", "facts"))
def l1(spark, d):
    """Facts landed by ticker, streamed in, with one year delivered twice."""
    import uuid

    from .streaming import ingest as L

    base = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    f = X.facts(spark, d)
    land(f, f"{base}/landed")
    land(f.filter(F.year("filed_date") == 1999), f"{base}/landed")
    L.ingest(spark, f"{base}/landed", f"{base}/table", f"{base}/checkpoint")
    return L.current_facts(spark, f"{base}/table").select("cik", "ticker", "tag", "fiscal_period_end", "filed_date", r("value", 4).alias("value"), "is_restatement")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of high F-score at one date, best first."""
    from .operators.scores import apply_screens, score
    from .schema import TAGS

    wide = asof.snapshot(X.facts(spark, sf_dir), [AS_OF], TAGS).withColumn("market_cap", F.lit(None).cast("double"))
    rows = score(wide).select("as_of_date", "ticker", *SCORES)
    return apply_screens(rows, ["f_high"]).orderBy(F.desc("f_score"), "ticker")

