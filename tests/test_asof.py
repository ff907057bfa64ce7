"""As-of operators on hand-made filings."""

import datetime as dt
import random

from asof_factors.operators import asof, membership
from asof_factors.schema import FACTS, TAGS
from asof_factors.streaming import ingest

D = dt.date


def fact(value, filed, fpe=D(2020, 12, 31), tag="NetIncomeLoss", start=D(2020, 1, 1), form="10-K", ticker="ACME"):
    return ("0000000001", ticker, tag, fpe, start, filed, float(value), "USD", form, fpe.year, "FY", False, "us-gaap")


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), FACTS)


def test_restatement_is_seen_from_its_own_filing_date(spark):
    f = facts(spark, fact(100, D(2021, 2, 15)), fact(80, D(2021, 11, 30), form="10-K/A"))
    asked = spark.createDataFrame([(i, "acme", "NetIncomeLoss", d) for i, d in enumerate([D(2021, 1, 1), D(2021, 11, 29), D(2021, 12, 1)])], "request_id int, ticker string, tag string, as_of_date date")
    got = {r.as_of_date: r.value for r in asof.lookup(asked, f).collect()}
    assert got == {D(2021, 1, 1): None, D(2021, 11, 29): 100.0, D(2021, 12, 1): 80.0}
    wide = {r.as_of_date: r.NetIncomeLoss for r in asof.snapshot(f, [D(2021, 1, 1), D(2021, 11, 29), D(2021, 12, 1)]).collect()}
    assert wide == {D(2021, 11, 29): 100.0, D(2021, 12, 1): 80.0}
    flags = {r.filed_date: r.is_restatement for r in asof.flag_restatements(f).collect()}
    assert flags == {D(2021, 2, 15): False, D(2021, 11, 30): True}
    r = asof.restated(f).first()
    assert (r.original_value, r.final_value, r.n_values) == (100.0, 80.0, 2)


def test_quarters_and_short_flows_are_not_annual(spark):
    f = facts(
        spark,
        fact(5, D(2021, 5, 1), D(2021, 3, 31), start=D(2021, 1, 1)),
        fact(7, D(2021, 5, 1), D(2021, 3, 31), "Assets", None, "10-Q"),
        fact(9, D(2021, 2, 1), D(2020, 12, 31), "Assets", None, "DFP"),
        fact(8, D(2020, 2, 1), D(2019, 12, 31), "Assets", None),
    )
    r = asof.snapshot(f, [D(2021, 6, 30)]).first()
    assert (r.Assets, r.Assets_prior, r.NetIncomeLoss, r.fiscal_period_end) == (9.0, 8.0, None, D(2020, 12, 31))
    assert set(TAGS) <= set(r.asDict())


def test_ties_and_empty(spark):
    f = facts(spark, fact(1, D(2021, 2, 1), start=D(2020, 1, 1)), fact(2, D(2021, 2, 1), start=D(2020, 2, 1)))
    assert asof.snapshot(f, [D(2022, 1, 1)]).first().NetIncomeLoss == 2.0
    assert asof.latest_filings(f, D(2022, 1, 1)).first().value == 2.0
    assert asof.snapshot(f.limit(0), [D(2022, 1, 1)]).count() == 0


def test_first_filing_after_with_tolerance(spark):
    periods = spark.createDataFrame([("A", D(2024, 3, 31)), ("B", D(2024, 3, 31))], "k string, period_end date")
    filings = spark.createDataFrame([("A", D(2024, 4, 22)), ("A", D(2024, 3, 31)), ("A", D(2024, 7, 1)), ("B", D(2024, 12, 1))], "k string, filed_date date")
    assert [(r.k, r.filed_date) for r in asof.first_filing_after(periods, filings, "k").collect()] == [("A", D(2024, 4, 22))]


def test_membership_bounds(spark):
    m = spark.createDataFrame([("OLD", None, D(2015, 6, 1)), ("NEW", D(2018, 3, 1), None), ("EVER", None, None)], "ticker string, start_date date, end_date date")
    rows = spark.createDataFrame([(t, d) for t in ("OLD", "NEW", "EVER", "NONE") for d in (D(2015, 5, 31), D(2015, 6, 1), D(2018, 3, 1))], "ticker string, as_of_date date")
    got = sorted((r.ticker, r.as_of_date) for r in membership.members_on(rows, m).collect())
    assert got == [("EVER", D(2015, 5, 31)), ("EVER", D(2015, 6, 1)), ("EVER", D(2018, 3, 1)), ("NEW", D(2018, 3, 1)), ("OLD", D(2015, 5, 31))]


def test_stream_is_restartable(spark, tmp_path):
    landed, table, check = [str(tmp_path / x) for x in ("landed", "table", "check")]
    f = facts(spark, fact(100, D(2021, 2, 15)))
    f.write.mode("append").parquet(landed)
    ingest.ingest(spark, landed, table, check)
    f.unionByName(facts(spark, fact(80, D(2021, 11, 30)))).write.mode("append").parquet(landed)
    ingest.ingest(spark, landed, table, check)
    ingest.ingest(spark, landed, table, check)
    got = sorted((r.value, r.is_restatement) for r in ingest.current_facts(spark, table).collect())
    assert got == [(80.0, True), (100.0, False)]


def test_ties_have_one_order_in_every_operator(spark):
    day = D(2021, 2, 15)
    rows = [fact(5, day, start=D(2019, 12, 1)), fact(3, day), (*fact(9, day)[:7], "ZAR", *fact(9, day)[8:]), fact(2, day)]
    f = facts(spark, *rows)
    asked = spark.createDataFrame([(1, "ACME", "NetIncomeLoss", D(2021, 3, 1))], "request_id int, ticker string, tag string, as_of_date date")
    assert asof.lookup(asked, f).first().value == 3.0
    assert asof.latest_filings(f, D(2021, 3, 1)).first().value == 3.0
    assert asof.snapshot(f, [D(2021, 3, 1)]).first().NetIncomeLoss == 3.0


def test_pinned_lookups(spark):
    f = facts(spark, fact(1, D(2020, 2, 1), D(2019, 12, 31)), fact(2, D(2021, 2, 1)), fact(3, D(2021, 6, 1), D(2019, 12, 31)))
    schema = "request_id int, ticker string, tag string, as_of_date date, fiscal_period_end date"
    asked = [(1, "acme", "NetIncomeLoss", D(2021, 3, 1), D(2019, 12, 31)), (2, "ACME", "NetIncomeLoss", D(2021, 7, 1), D(2019, 12, 31)), (3, "ACME", "NetIncomeLoss", D(2021, 7, 1), None), (4, "ACME", "NetIncomeLoss", D(2020, 7, 1), D(2020, 12, 31))]
    assert {r.request_id: r.value for r in asof.lookup(spark.createDataFrame(asked, schema), f).collect()} == {1: 1.0, 2: 3.0, 3: 2.0, 4: None}


def test_snapshots_against_brute_force(spark):
    """Periods filed late, out of order and again."""
    rng = random.Random(3)
    rows = {(t, y, rng.randint(0, 2200)): float(k) for k, (t, y) in enumerate((t, rng.randint(2010, 2016)) for t in "abc" for _ in range(25))}
    filed = {k: D(2010, 6, 1) + dt.timedelta(days=k[2]) for k in rows}
    f = facts(spark, *[fact(v, filed[k], D(k[1], 12, 31), start=D(k[1], 1, 1), ticker=k[0].upper()) for k, v in rows.items()])
    dates = [D(2010 + m // 4, 3 * (m % 4) + 1, 15) for m in range(30)]
    want = {}
    for d in dates:
        for t in "abc":
            known = {}
            for k in sorted((k for k in rows if k[0] == t and filed[k] <= d), key=lambda k: filed[k]):
                known[k[1]] = rows[k]
            for rank, y in enumerate(sorted(known, reverse=True)[:2], 1):
                want[d, t.upper(), rank] = (y, known[y])
    got = {(r.as_of_date, r.ticker, r.period_rank): (r.fiscal_period_end.year, r.value) for r in asof.snapshot_long(f, dates).collect()}
    assert got == want
