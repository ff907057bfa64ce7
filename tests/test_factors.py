"""Scores, buckets, the sparse regression and series statistics."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from asof_factors.functions import expressions as X
from asof_factors.operators import composite, portfolios, scores, seriesstats
from asof_factors.schema import FEATURES, TAGS

GOOD = dict(NetIncomeLoss=100, Assets=1000, NetCashProvidedByUsedInOperatingActivities=150, LongTermDebtNoncurrent=100, AssetsCurrent=500, LiabilitiesCurrent=200, CommonStockSharesOutstanding=100, Revenues=900, CostOfRevenue=500, Liabilities=400, RetainedEarningsAccumulatedDeficit=300)
BEFORE = dict(NetIncomeLoss=50, Assets=1000, NetCashProvidedByUsedInOperatingActivities=60, LongTermDebtNoncurrent=150, AssetsCurrent=400, LiabilitiesCurrent=220, CommonStockSharesOutstanding=100, Revenues=700, CostOfRevenue=450, Liabilities=450)


def wide(spark, rows):
    names = [f"{t}{a}" for t in TAGS for a in ("", "_prior")]
    data = [[t, float(cap)] + [float(v) if (v := (now if not a else then).get(tag)) is not None else None for tag in TAGS for a in ("", "_prior")] for t, cap, now, then in rows]
    return spark.createDataFrame(data, "ticker string, market_cap double, " + ", ".join(f"{n} double" for n in names))


def test_statement_scores(spark):
    rows = [("GOOD", 2000, GOOD, BEFORE), ("BAD", 10, BEFORE, GOOD), ("GAP", 10, {**GOOD, "NetCashProvidedByUsedInOperatingActivities": None}, BEFORE), ("EBIT", 2000, {**GOOD, "EBIT": 200}, BEFORE), ("DEBT", 1, {**GOOD, "LongTermDebtNoncurrent": None}, BEFORE)]
    got = {r.ticker: r for r in scores.score(wide(spark, rows)).collect()}
    assert got["GOOD"].f_score == 9 and got["GAP"].f_score is None and got["DEBT"].f_score is None
    z = 1.2 * 0.3 + 1.4 * 0.3 + 3.3 * 0.1 + 0.6 * 5 + 0.9
    assert got["GOOD"].z_score == pytest.approx(z) and got["EBIT"].z_score == pytest.approx(z + 0.33)
    o = -1.32 - 0.407 * math.log(1000) + 6.03 * 0.4 - 1.43 * 0.3 + 0.0757 * 0.4 - 2.37 * 0.1 - 1.83 * 150 / 400 - 0.521 * 50 / 150
    assert got["GOOD"].o_score == pytest.approx(o)
    assert [r.ticker for r in scores.apply_screens(scores.score(wide(spark, rows)), ["f_high"]).orderBy("ticker").collect()] == ["EBIT", "GOOD"]


def test_sector_zscore_falls_back(spark):
    rng = random.Random(1)
    rows = [(dt.date(2020, 1, 31), f"T{i}", "big" if i < 10 else ("small" if i < 12 else None), rng.random(), rng.random(), rng.random()) for i in range(13)]
    df = spark.createDataFrame(rows, "as_of_date date, ticker string, sector string, f_score double, z_score double, o_score double")
    got = {r.ticker: r for r in scores.sector_zscore(df).collect()}
    big = np.array([r[3] for r in rows[:10]])
    every = np.array([r[3] for r in rows])
    assert got["T0"].f_score_z == pytest.approx((big[0] - big.mean()) / big.std())
    assert got["T11"].f_score_z == pytest.approx((every[11] - every.mean()) / every.std())
    assert got["T12"].o_score_z == pytest.approx(-(rows[12][5] - np.mean([r[5] for r in rows])) / np.std([r[5] for r in rows]))


@pytest.mark.parametrize(("m", "n", "least", "sizes"), [(100, 10, 5, [10] * 10), (20, 5, 4, [4] * 5), (20, 5, 5, None), (60, 10, 7, None)])
def test_bucket_sizes(spark, m, n, least, sizes):
    df = spark.createDataFrame([(dt.date(2020, 1, 31), f"T{i:03}", float(i)) for i in range(m)] + [(dt.date(2020, 1, 31), "X", None)], "as_of_date date, ticker string, s double")
    got = portfolios.form_buckets(df, "s", n, least).groupBy("decile").count().orderBy("decile").collect()
    assert [r["count"] for r in got if r.decile] == (sizes or []) and any(r.decile is None for r in got)


def test_turnover_and_contributions(spark):
    a, b, c = dt.date(2020, 1, 31), dt.date(2020, 2, 29), dt.date(2020, 3, 31)
    book = [(a, t, 2, 0.1) for t in "ABCD"] + [(b, t, 2, 0.2) for t in "ABCE"] + [(c, t, 2, 0.1) for t in "WXYZ"] + [(d, t, 1, 0.05) for d in (a, b) for t in "PQ"] + [(c, t, 1, 0.0) for t in "RS"]
    df = spark.createDataFrame([(*r, "s") for r in book], "as_of_date date, ticker string, decile int, fwd_ret_1m double, sector string")
    got = {(r.as_of_date, r.decile): r.turnover for r in portfolios.turnover(df, 2).collect()}
    assert got == {(a, 2): None, (b, 2): 0.25, (c, 2): 1.0, (a, 1): None, (b, 1): 0.0, (c, 1): 1.0}
    total = {r.as_of_date: r.s for r in portfolios.contributions(df, 2).groupBy("as_of_date").agg(F.sum("contribution").alias("s")).collect()}
    spread = {r.as_of_date: r.spread for r in portfolios.spread(df, 2).collect()}
    assert total == pytest.approx(spread)


def test_series_statistics(spark):
    rng = np.random.default_rng(7)
    r = rng.normal(0.01, 0.03, 60)
    rows = [("a", dt.date(2015 + i // 12, i % 12 + 1, 1), float(x)) for i, x in enumerate(r)] + [("flat", dt.date(2015 + i // 12, i % 12 + 1, 1), 0.0) for i in range(30)] + [("short", dt.date(2015, i + 1, 1), 0.01 * i) for i in range(12)]
    df = spark.createDataFrame(rows, "series string, date date, ret double")
    got = {x.series: x for x in seriesstats.series_stats(df, ["series"]).collect()}
    e, lag = r - r.mean(), int(4 * (60 / 100) ** (2 / 9))
    long_run = sum((1 if k == 0 else 2 * (1 - k / (lag + 1))) * (e[k:] * e[: len(e) - k]).sum() for k in range(lag + 1))
    assert got["a"].nw_tstat == pytest.approx(r.mean() / (math.sqrt(long_run) / 60))
    assert got["a"].nw_lag == lag and got["short"].nw_tstat is None and got["flat"].psr_stat is None
    roll = seriesstats.rolling_hurdle(df.filter("series = 'a'"), ["series"]).filter("dsr_hi IS NOT NULL").collect()
    assert len(roll) == 37 and all(x.dsr_hi > 0 for x in roll)
    p = seriesstats.deflated_sharpe(df.filter("series = 'a'"), ["series"], with_probability=True).first()
    assert (p.dsr >= 0.95) == p.survives_95


def test_beta_and_bootstrap(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(0, 0.04, 120)
    s = 0.002 + 0.6 * m + rng.normal(0, 0.001, 120)
    df = spark.createDataFrame([("x", dt.date(2010 + i // 12, i % 12 + 1, 1), float(a), float(b)) for i, (a, b) in enumerate(zip(s, m))], "k string, date date, spread double, market double")
    b = seriesstats.beta_adjusted(df, ["k"]).first()
    assert b.beta == pytest.approx(0.6, abs=0.01) and b.alpha_ann == pytest.approx(0.024, abs=0.004) and b.r2 > 0.99
    boot = seriesstats.block_bootstrap(df, ["k"], "spread", "market", reps=100)
    assert boot.first() == boot.first() and boot.first().ann_alpha_lo < 0.024 < boot.first().ann_alpha_hi + 0.004


def test_cost_limits(spark):
    rng = np.random.default_rng(5)
    rows = [("x", dt.date(2010 + i // 12, i % 12 + 1, 1), float(v), 0.8) for i, v in enumerate(rng.normal(0.02, 0.02, 80))]
    df = spark.createDataFrame(rows, "k string, date date, ret double, traded double")
    net = seriesstats.net_of_costs(df, ["k"], [100.0]).orderBy("date").first()
    assert net.ret == pytest.approx(rows[0][2] - 0.008)
    fail = seriesstats.dsr_fail_cost(df, ["k"]).first().fail_bps
    ok = {c: seriesstats.cost_table(df, ["k"], [c]).first().survives_95 for c in (fail - 1, fail + 1)}
    assert ok == {fail - 1: True, fail + 1: False}


def test_lasso_recovers_and_blends(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(40):
        d = dt.date(2010 + k // 12, k % 12 + 1, 28)
        for i in range(30):
            f = rng.normal(size=3)
            rows.append((d, f"T{i:02}", *map(float, f), None if k >= 33 else float(0.02 * f[0] + rng.normal(0, 0.01))))
    df = spark.createDataFrame(rows, "as_of_date date, ticker string, " + ", ".join(f"{f} double" for f in FEATURES) + ", fwd_ret_demeaned double")
    blended, coefs = composite.walk_forward(df)
    c = coefs.collect()
    assert c and all(abs(x.f_score_z - 0.02) < 0.005 and abs(x.z_score_z) < 0.005 for x in c)
    first = blended.filter(F.col("as_of_date") == rows[0][0]).orderBy("ticker").first()
    assert first.composite_score == pytest.approx(sum(rows[0][2:5]) / 3)
    w = composite.lasso(np.eye(3), np.array([0.5, -0.2, 0.05]), 0.1)
    assert w == pytest.approx([0.4, -0.1, 0.0])


def test_text_expressions(spark):
    df = spark.createDataFrame([("1,234", "BRK.B", "ifrs-full_Equity", "Ação Média", "보 통 주"), ("-", "brk b", "dart_X", "x", "우선주")], "a string, b string, c string, d string, e string")
    r = df.select(X.number_text(F.col("a")), X.share_class_ticker(F.col("b")), X.account_id(F.col("c")), X.same_label(F.col("d"), F.lit("acao me")), X.common_share_label(F.col("e"))).collect()
    assert tuple(r[0]) == (1234.0, "BRK-B", "equity", True, True) and tuple(r[1]) == (None, "BRK-B", "x", False, False)
