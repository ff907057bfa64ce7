"""Queries of the fitted model, of runs on disk, and of the smaller table
operators.

The model's SQL does not descend: for every refit, fold and alpha it solves the
regression for each pattern of signs of the three coefficients in closed form
and takes the pattern that meets the optimality conditions.
"""

from __future__ import annotations

import datetime as dt
import uuid
from itertools import product

from pyspark.sql import functions as F

from . import oracle as O
from .operators import asof, composite, membership, portfolios, prices
from .plans import backtest
from .plans.storage import materialised, shared_folder
from .queries import DATES, QUERIES, SQL, UNDATED, _book, _panel, _stats_sql, _twins, _TWINS, _with, query, r, rounded, rs
from .schema import FEATURES, LASSO_ALPHAS, UNIVERSES
from .sources import filings as S
from .sources import fixtures as X

DATES |= {"j8_lasso_fits": ["refit_date"], "b6_zero_closes": ["month_end"], "g3_listing_members": ["start_date"], "a13_constituents": [], "a15_crosswalk": [], "c15_ticker_fallback": [], "c16_relabelled": [], "c18_sector_fallback": [], "g1_taxonomies": [], "n10_share_gaps": [], "k3_validation": ["last_date"], "d17_run_overview": ["first_date", "last_date"]}
UNDATED.add("n3_gradient_correlation")


# ---- the fitted model


def _patterns() -> str:
    """w0, w1, w2 and signs for each pattern of signs, by Cramer's rule."""
    g = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    rows = []
    for s in product((-1, 0, 1), repeat=3):
        on = [i for i in range(3) if s[i]]
        rest = {i: f"(b{i} - {s[i]} * alpha)" for i in on}
        w = ["0.0::double"] * 3
        if len(on) == 1:
            (i,) = on
            w[i] = f"{rest[i]} / {g(i, i)}"
        elif len(on) == 2:
            i, j = on
            det = f"({g(i, i)} * {g(j, j)} - {g(i, j)} * {g(i, j)})"
            w[i] = f"({rest[i]} * {g(j, j)} - {rest[j]} * {g(i, j)}) / {det}"
            w[j] = f"({rest[j]} * {g(i, i)} - {rest[i]} * {g(i, j)}) / {det}"
        elif on:

            def det3(col: int | None) -> str:
                m = [[rest[i] if j == col else g(i, j) for j in range(3)] for i in range(3)]
                return f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"

            w = [f"{det3(k)} / {det3(None)}" for k in range(3)]
        rows.append(f"({', '.join(w)}, {', '.join(map(str, s))})")
    return ",\n".join(rows)


_SUMS = ["s0", "s1", "s2", "s3", "s00", "s01", "s02", "s03", "s11", "s12", "s13", "s22", "s23", "s33"]
_X = ["f_score_z", "z_score_z", "o_score_z", "fwd_ret_demeaned"]
_GAP = lambda i: f"CASE WHEN sg{i} <> 0 THEN greatest(0, -sg{i} * w{i}) ELSE greatest(0, abs(b{i} - (" + " + ".join(f"g{min(i, j)}{max(i, j)} * w{j}" for j in range(3)) + ")) - alpha) END"
_FIT = (
    """dn AS (SELECT as_of_date, row_number() OVER (ORDER BY as_of_date) - 1 AS i FROM (SELECT DISTINCT as_of_date FROM panel)),
rf AS (SELECT as_of_date AS refit_date, (as_of_date - INTERVAL 7 MONTH)::date AS cutoff FROM dn WHERE i % 4 = 0),
tr AS (SELECT refit_date, p.*, row_number() OVER (PARTITION BY refit_date ORDER BY p.as_of_date, ticker) - 1 AS place, count(*) OVER (PARTITION BY refit_date) AS c FROM panel p JOIN rf ON p.as_of_date <= cutoff WHERE """
    + " AND ".join(f"{x} IS NOT NULL" for x in _X)
    + """),
ok AS (SELECT refit_date FROM tr GROUP BY refit_date HAVING count(DISTINCT as_of_date) >= 6),
seg AS MATERIALIZED (SELECT refit_date, greatest(0, floor((place - (c - 5 * (c // 6))) / (c // 6)::double)::int + 1) AS segment, count(*)::double AS n, """
    + ", ".join(f"sum({' * '.join(_X[int(k)] for k in s[1:])}) AS {s}" for s in _SUMS)
    + """ FROM tr JOIN ok USING (refit_date) GROUP BY ALL),
fold AS (SELECT refit_date, k, sum(n) AS n, """
    + ", ".join(f"sum({s}) AS {s}" for s in _SUMS)
    + """ FROM seg JOIN range(1, 7) t(k) ON segment < k GROUP BY ALL),
cov AS (SELECT refit_date, k, """
    + ", ".join(f"s{i} / n AS m{i}" for i in range(4))
    + ", "
    + ", ".join(f"s{i}{j} / n - s{i} / n * s{j} / n AS g{i}{j}" for i in range(3) for j in range(i, 3))
    + ", "
    + ", ".join(f"s{i}3 / n - s{i} / n * s3 / n AS b{i}" for i in range(3))
    + " FROM fold),\ncand AS (SELECT cov.*, alpha, w.* FROM cov, (VALUES "
    + ", ".join(f"({a!r}::double)" for a in LASSO_ALPHAS)
    + f") al(alpha), LATERAL (VALUES {_patterns()}) w(w0, w1, w2, sg0, sg1, sg2)),\n"
    + f"sol AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY refit_date, k, alpha ORDER BY greatest({_GAP(0)}, {_GAP(1)}, {_GAP(2)})) AS rn FROM cand) WHERE rn = 1),\n"
    + """err AS (SELECT sol.refit_date, alpha, avg((s33 - 2 * (w0 * s03 + w1 * s13 + w2 * s23) + w0 * w0 * s00 + w1 * w1 * s11 + w2 * w2 * s22 + 2 * (w0 * w1 * s01 + w0 * w2 * s02 + w1 * w2 * s12) - 2 * ic * s3 + 2 * ic * (w0 * s0 + w1 * s1 + w2 * s2) + n * ic * ic) / n) AS mse
 FROM (SELECT *, m3 - (w0 * m0 + w1 * m1 + w2 * m2) AS ic FROM sol) sol JOIN seg ON seg.refit_date = sol.refit_date AND seg.segment = sol.k GROUP BY ALL),
pick AS (SELECT refit_date, alpha FROM (SELECT *, row_number() OVER (PARTITION BY refit_date ORDER BY mse, alpha DESC) AS rn FROM err) WHERE rn = 1),
coef AS MATERIALIZED (SELECT sol.refit_date, sol.alpha, m3 - (w0 * m0 + w1 * m1 + w2 * m2) AS intercept, w0, w1, w2 FROM sol JOIN pick ON sol.refit_date = pick.refit_date AND sol.alpha = pick.alpha WHERE k = 6),
fitted AS (SELECT p.*, CASE WHEN abs(w0) + abs(w1) + abs(w2) > 0 THEN intercept + w0 * f_score_z + w1 * z_score_z + w2 * o_score_z ELSE (f_score_z + z_score_z + o_score_z) / 3 END AS fitted_score FROM panel p LEFT JOIN coef ON refit_date = (SELECT max(refit_date) FROM coef c2 WHERE c2.refit_date <= p.as_of_date))"""
)


@query("j8_lasso_fits", _with(_FIT, "SELECT refit_date, alpha, round(intercept, 6) + 0.0::double AS intercept, round(w0, 6) + 0.0::double AS f_score_z, round(w1, 6) + 0.0::double AS z_score_z, round(w2, 6) + 0.0::double AS o_score_z FROM coef", "panel"))
def j8_fits(spark, d):
    p = _panel(spark, d)
    found = composite.fit(composite.training_moments(p, composite.refit_calendar(p, 4), least_months=6))
    return found.select("refit_date", "alpha", r("intercept"), *[r(f) for f in FEATURES])


SQL["j9_walk_forward"] = "SELECT * REPLACE (CAST(CAST(as_of_date AS DATE) AS VARCHAR) AS as_of_date) FROM (\n" + _with(_FIT, "SELECT as_of_date, ticker, round(fitted_score, 6) + 0.0::double AS composite_score FROM fitted", "panel") + "\n)"


@query("k1_backtest", _with(_FIT + ",\nfb AS (SELECT *, " + O.buckets("composite_score") + " AS decile FROM (SELECT *, round(fitted_score, 9) AS composite_score FROM fitted))", "SELECT as_of_date, decile, round(avg(fwd_ret_1m), 6) + 0.0::double AS ret FROM fb WHERE decile IS NOT NULL GROUP BY ALL", "panel"))
def k1(spark, d):
    return rounded(backtest.backtest(_panel(spark, d), refit_every=4, least_months=6, digits=9)["bucket_returns"])


# ---- runs on disk


_OVERVIEW = _TWINS + ",\nbooks AS (SELECT 'static' AS run, as_of_date, decile FROM book UNION ALL SELECT 'corrected', as_of_date, decile FROM cb),\nts AS (SELECT run, date, ret FROM twins WHERE ret IS NOT NULL)"


@query(
    "d17_run_overview",
    _with(
        _OVERVIEW,
        "SELECT 'sp500' AS universe, run AS mode, b.n_rows, b.first_date, b.last_date, s.months, s.ann_return, s.nw_tstat, run = 'corrected' AS stale FROM (SELECT run, count(*) AS n_rows, min(as_of_date) AS first_date, max(as_of_date) AS last_date FROM books GROUP BY run) b JOIN (" + _stats_sql("ts", "run") + ") s USING (run)",
        "book",
        "sectored",
        "membership",
        "returns",
    ),
)
def d17(spark, d):
    """Two runs in a sink, found by their partitions; the corrected one's panel
    is written anew after its summary."""
    base = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    static, corrected = UNIVERSES["sp500"], UNIVERSES["sp500"].with_membership()
    books = _twins(spark, d)
    for universe, book in ((static, books["static"]), (corrected, books["corrected"])):
        backtest.sink({"panel": book, "summary": backtest.validate(book, least=12)}, universe, base)
    backtest.sink({"panel": books["corrected"]}, corrected, base)
    return rounded(backtest.run_overview(spark, base).select("universe", "mode", "n_rows", "first_date", "last_date", "months", "ann_return", "nw_tstat", "stale"))


_ROLL = """lv AS (SELECT run AS strategy, date, ret FROM ts),
lr AS (SELECT strategy, count(*) AS n, max(date) AS last_date FROM lv GROUP BY strategy),
lw AS (SELECT strategy, avg(ret) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY date DESC) AS k FROM lv) WHERE k <= 12 GROUP BY strategy HAVING count(*) = 12)"""


@query("k3_validation", _with(_OVERVIEW + ",\n" + _ROLL, "SELECT s.run AS strategy, s.months, s.ann_return, s.nw_tstat, s.psr_stat, last_date, round(lw.mean * 12, 6) AS last_mean FROM (" + _stats_sql("ts", "run") + ") s JOIN lr ON lr.strategy = s.run LEFT JOIN lw ON lw.strategy = s.run", "book", "sectored", "membership", "returns"))
def k3(spark, d):
    """Summary and the last point of the rolling table of two books in one job."""
    jobs = []
    for name, book in _twins(spark, d).items():
        done = backtest.validation_job(book, window=12, least=12)
        last = done["rolling"].filter("strategy = 'composite'").groupBy("strategy").agg(F.max("date").alias("last_date"), F.max_by("ann_spread", "date").alias("last_mean"))
        jobs.append(done["summary"].filter("strategy = 'composite'").join(last, "strategy").withColumn("strategy", F.lit(name)))
    return rounded(jobs[0].unionByName(jobs[1]).select("strategy", "months", "ann_return", "nw_tstat", "psr_stat", "last_date", "last_mean"))


# ---- smaller operators


@query("n3_gradient_correlation", _with("gr AS (SELECT decile, avg(ret) * 12 AS m FROM (SELECT as_of_date, decile, avg(fwd_ret_1m) AS ret FROM book WHERE decile IS NOT NULL GROUP BY ALL) GROUP BY decile)", "SELECT round(corr(a, b), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY decile) AS a, rank() OVER (ORDER BY m) AS b FROM gr)", "book"))
def n3_correlation(spark, d):
    return rounded(portfolios.gradient_correlation(_book(spark, d)))


@query("b6_zero_closes", O.sql(f"SELECT ticker, month_end, {rs('close')} FROM prices WHERE close IS NOT NULL", "prices"))
def b6(spark, d):
    """Padding before a listing is a close of zero, which counts as missing."""
    raw = X.prices(spark, d, raw=True).withColumnRenamed("month_end", "date")
    return rounded(prices.month_end_closes(raw))


@query("i7_identity_gaps", O.sql('SELECT w.as_of_date, w.ticker, round(0.02::double * (entity % 3), 6) AS gap FROM wide w JOIN (SELECT DISTINCT entity FROM yearly) y ON w.ticker = \'P\' || entity WHERE entity % 3 > 0 AND "Assets" <> 0 AND "Liabilities" IS NOT NULL', "wide", "yearly"))
def i7(spark, d):
    """Snapshots whose equity is off by 0, 2 or 4 per cent of assets."""
    wide = asof.snapshot(X.facts(spark, d), X.DATES, O.HELD)
    off = 0.02 * (F.substring("ticker", 2, 20).cast("long") % 3)
    return rounded(asof.identity_gaps(wide.withColumn("StockholdersEquity", F.col("Assets") * (1 + off) - F.col("Liabilities"))))


@query("n10_share_gaps", O.sql("SELECT lpad(entity::varchar, 8, '0') AS corp_code, fy::varchar AS bsns_year, '보통주' AS se FROM yearly WHERE v = 2 AND entity % 4 = 3", "yearly"))
def n10(spark, d):
    """Share classes whose issued less treasury shares are not those around."""
    base = f"{shared_folder(spark)}/dart-{uuid.uuid4().hex}"
    X.land_dart(spark, d, base)
    return S.share_consistency(spark.read.schema(S.DART_SHARES).json(f"{base}/shares")).select("corp_code", "bsns_year", "se")


@query("g1_taxonomies", O.sql("SELECT 'us-gaap' AS taxonomy, count(*) AS n FROM facts UNION ALL SELECT 'bse-in', count(*) FROM (" + SQL["k5_bse_facts"] + ")", "facts"))
def g1(spark, d):
    both = S.union_taxonomies([X.facts(spark, d), S.bse_facts(*X.bse_landed(spark, d))])
    return both.groupBy("taxonomy").agg(F.count(F.lit(1)).alias("n"))


@query("g3_listing_members", "SELECT 'P' || p_partkey AS ticker, DATE '1996-01-01' + (p_partkey % 900)::int AS start_date FROM part WHERE DATE '1996-01-01' + (p_partkey % 900)::int <= DATE '1997-03-31'")
def g3(spark, d):
    """Members on a date, by their first annual filing."""
    k = F.col("p_partkey")
    listed = X.table(spark, d, "part").select(F.concat(F.lit("P"), k.cast("string")).alias("ticker"), F.date_add(F.lit(dt.date(1996, 1, 1)), (k % 900).cast("int")).alias("first_filing"))
    gate = membership.listing_membership(listed)
    asked = listed.select("ticker", F.lit(dt.date(1997, 3, 31)).alias("as_of_date"))
    return membership.members_on(asked, gate).join(gate, "ticker").select("ticker", "start_date")


@query("a13_constituents", "SELECT DISTINCT 'P-' || (p_partkey % 1000) AS ticker FROM part")
def a13(spark, d):
    listed = X.table(spark, d, "part").select(F.concat(F.lit("p."), (F.col("p_partkey") % 1000).cast("string")).alias("ticker"))
    return S.constituents(listed)


@query("a15_crosswalk", "SELECT lpad(p_partkey::varchar, 8, '0') AS corp_code, CASE WHEN p_partkey % 5 = 0 THEN 'IN-UNCLASSIFIED' ELSE p_brand END AS sector FROM part")
def a15(spark, d):
    k = F.col("p_partkey")
    raw = X.table(spark, d, "part").select(k.alias("corp_code"), F.when(k % 5 != 0, F.col("p_brand")).alias("sector"))
    return S.crosswalk(raw, "corp_code", 8, "IN-UNCLASSIFIED")


@query("c15_ticker_fallback", "SELECT CASE p_partkey % 4 WHEN 0 THEN 'P-' ELSE 'P' END || CASE WHEN p_partkey % 4 = 2 THEN '-' ELSE '' END || p_partkey AS ticker, CASE WHEN p_partkey % 4 < 3 THEN lpad(p_partkey::varchar, 10, '0') END AS cik FROM part")
def c15(spark, d):
    """Asked with a dash that the list lacks, exactly, with another dash than
    the list's, and unknown."""
    k, kind = F.col("p_partkey"), F.col("p_partkey") % 4
    p = X.table(spark, d, "part")
    text = k.cast("string")
    listed = p.filter(kind < 3).select(F.when(kind == 2, F.concat(F.lit("P"), F.substring(text, 1, 1), F.lit("-"), F.substring(text, 2, 20))).otherwise(F.concat(F.lit("P"), text)).alias("ticker"), k.alias("cik_str"))
    asked = p.select(F.concat(F.when(kind == 0, "P-").when(kind == 2, "P-").otherwise("P"), text).alias("ticker"))
    return S.match_tickers(asked, S.ticker_cik_map(listed))


@query("c16_relabelled", O.sql("SELECT cik, CASE WHEN cik::bigint % 3 = 0 THEN 'N' || ticker ELSE ticker END AS ticker, count(*) AS n FROM facts GROUP BY ALL", "facts"))
def c16(spark, d):
    """Every third company is asked for under a new ticker; another third's
    logged ticker is still asked for."""
    f = X.facts(spark, d, by="cik")
    log = materialised(f.select("cik", "ticker").distinct())
    third = F.col("cik").cast("long") % 3
    asked = log.select(F.when(third < 2, F.when(third == 0, F.concat(F.lit("N"), "ticker")).otherwise(F.col("ticker"))).alias("ticker"), "cik").filter("ticker IS NOT NULL")
    return S.relabel(f, log, asked).groupBy("cik", "ticker").agg(F.count(F.lit(1)).alias("n"))


@query("c18_sector_fallback", "SELECT 'P' || p_partkey AS ticker, CASE WHEN p_partkey % 2 = 0 THEN p_brand WHEN p_partkey % 3 = 0 THEN p_type END AS sector FROM part")
def c18(spark, d):
    k = F.col("p_partkey")
    p = X.table(spark, d, "part").withColumn("ticker", F.concat(F.lit("P"), k.cast("string")))
    return S.sectors_with_fallback(p, p.filter(k % 2 == 0).select("ticker", F.col("p_brand").alias("sector")), p.filter(k % 3 == 0).select("ticker", F.col("p_type").alias("sector")))
