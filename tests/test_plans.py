"""Plans over the derived tables: what is unfolded is neither taken for small nor moved again."""

import pytest

from asof_factors.operators import asof, membership, prices
from asof_factors.sources import filings
from asof_factors.sources import fixtures as X

SMOKE = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_prices_are_not_taken_for_small(spark):
    """84 rows of each part were estimated as one, and sent whole through the driver."""
    p = X.prices(spark, SMOKE)
    size = int(str(p._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size >= 8 * p.count()


@pytest.mark.parametrize(("name", "rows"), [("facts", "tag"), ("prices", "month_end")])
def test_unfolded_rows_stay(spark, name, rows):
    """Windows and groups by company meet rows where they were dealt out before they were unfolded."""
    df = X.facts(spark, SMOKE) if name == "facts" else X.prices(spark, SMOKE)
    used = asof.snapshot(df, X.DATES) if name == "facts" else prices.forward_total_return(prices.forward_returns(df, [1, 3]), 6)
    moved = [line for line in planned(used).splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not [line for line in moved if f"{rows}#" in line or "as_of_date#" in line]


def test_flagged_facts_stay(spark):
    moved = [line for line in planned(X.facts(spark, SMOKE, flagged=True)).splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not [line for line in moved if "tag#" in line]


def test_total_return_over_a_missing_month(spark):
    rows = [("P1", "2000-01-31", 10.0), ("P1", "2000-03-31", 12.0), ("P1", "2000-04-30", None)]
    p = spark.createDataFrame(rows, "ticker string, month_end string, close double").selectExpr("ticker", "CAST(month_end AS date) AS month_end", "close")
    got = {str(r.month_end): r.fwd_2m for r in prices.forward_total_return(p, 2).collect()}
    assert abs(got["2000-01-31"] - 0.2) < 1e-12 and got["2000-03-31"] is None and got["2000-04-30"] is None


def test_landed_tables_share_one_aggregation(spark):
    """Each of the regulator's tables summed up all lines anew."""
    assert not [df for df in X.cvm_landed(spark, SMOKE) if "lineitem" in planned(df)]


def test_company_tables_are_not_sent_through_the_driver(spark):
    """By the size of its files Spark took a row for each company for small and broadcast it."""
    spine = X.sectors(spark, SMOKE).crossJoin(spark.createDataFrame([(X.DATES[0],)], "as_of_date date"))
    gate = X.membership(spark, SMOKE)
    for df in (X.yearly(spark, SMOKE), X.brand_returns(spark, SMOKE), membership.members_on(spine.repartition(4), gate), membership.removed_by_membership(spine.selectExpr("*", "1 AS f_score"), gate)):
        assert "SortMergeJoin" in planned(df) and "BroadcastHashJoin" not in planned(df)


def test_unfolded_facts_are_not_sorted_again(spark):
    """The rank of a period came from a window over a row for each fact and date."""
    windows = [line for line in planned(asof.snapshot_long(X.facts(spark, SMOKE), X.DATES)).splitlines() if "Window [" in line]
    assert windows and not [line for line in windows if "as_of_date#" in line]


@pytest.mark.parametrize("pinned", [False, True])
def test_lookups_move_no_facts(spark, pinned):
    """Filings and requests in one sequence were dealt out anew, and facts went through one more without requests."""
    f = X.facts(spark, SMOKE)
    keys = ["ticker", "tag", *(["fiscal_period_end"] if pinned else [])]
    asked = f.select(*keys).distinct().selectExpr("*", "DATE'2000-12-31' AS as_of_date", "1L AS request_id")
    plan = planned(asof.lookup(asked, f))
    assert plan.count("Union") == 1 and plan.count("row_number()") == 1
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "tag#" in line]


def test_indian_tables_share_one_aggregation(spark):
    assert not [df for df in X.bse_landed(spark, SMOKE) if "lineitem" in planned(df)]


def test_relabelled_facts_stay(spark):
    """Facts dealt out by ticker were dealt out again by company."""
    f = X.facts(spark, SMOKE, by="cik")
    log = f.select("cik", "ticker").distinct()
    moved = [line for line in planned(filings.relabel(f, log, log)).splitlines() if "Exchange hashpartitioning(cik#" in line and "REPARTITION_BY_NUM" not in line]
    assert len(moved) <= 1  # the new tickers
