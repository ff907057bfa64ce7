"""What plans leave on disk: little beside their inputs and results."""

import datetime as dt
import random

import pytest

from asof_factors.llm import common
from asof_factors.operators import asof, portfolios, prices, scores
from asof_factors.operators.ranks import exact_ranks
from asof_factors.plans import backtest, fact_table, storage
from asof_factors.schema import FACTS
from asof_factors.sources import fixtures as X
from pyspark.sql import functions as F

SMOKE = "/root/testdata/sf0.001"
DAY = dt.date(2020, 1, 31)


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_made_table_leaves_no_shuffle(spark):
    """Shuffles stayed until the driver happened to collect its garbage, and tables were rows of a checkpoint."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    held = lambda: [b for b in str(env.blockManager().diskBlockManager().getAllBlocks()).split(", ") if "shuffle" in b]
    before = held()
    made = storage.materialised(spark.range(1000).repartition(3, "id").groupBy(F.col("id") % 7).count())
    assert sorted(held()) == sorted(before) and made.count() == 7
    assert "FileScan parquet" in planned(made)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


@pytest.mark.parametrize("make", [common.cut, common.saved])
def test_steps_of_operators_leave_no_shuffle(spark, make):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    held = lambda: sorted(b for b in str(env.blockManager().diskBlockManager().getAllBlocks()).split(", ") if "shuffle" in b)
    before = held()
    made = make(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(2):
        assert made.count() == 7 and made.agg(F.sum("count")).first()[0] == 1000
    kept = [b for b in held() if b not in before]
    assert len(kept) <= 2 * 4 * 4  # of the four counts here, a task's data and index each


def test_the_wide_snapshot_stays(spark):
    """It was dealt out by date and ticker for each join, though all sides were dealt out by ticker."""
    p = X.prices(spark, SMOKE)
    with storage.making(spark):
        wide = asof.complete(asof.snapshot(X.facts(spark, SMOKE), X.DATES), prices.priced_tickers(p), X.DATES)
        plan = planned(scores.score(scores.with_market_cap(wide, p, X.DATES)).select("as_of_date", "ticker", *scores.SCORES))
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not [line for line in moved if "as_of_date#" in line or "month_index" in line or "__month" in line]
    assert len(moved) == 5  # lines, parts, prices twice, asked tickers


def test_twins_share_their_scores(spark, monkeypatch):
    """The corrected twin's scores were made from the lines once more."""
    made = []
    monkeypatch.setattr(backtest, "snapshot", lambda *a: made.append(1) or asof.snapshot(*a))
    args = X.facts(spark, SMOKE), X.prices(spark, SMOKE), X.sectors(spark, SMOKE), X.DATES
    twins = backtest.twin_panels(*args, X.membership(spark, SMOKE))
    assert made == [1]
    rows = lambda df: sorted((str(r.as_of_date), r.ticker, r.f_score_z is None, round(r.z_score_z or 0, 9)) for r in df.collect())
    assert rows(twins["corrected"]) == rows(backtest.scores_panel(*args, X.membership(spark, SMOKE)))
    assert rows(twins["static"]) == rows(backtest.scores_panel(*args))


def by_ranks(df, n, least):
    ranked = exact_ranks(df.filter("s IS NOT NULL"), ["as_of_date"], ["s", "ticker"], "rank", "m").collect()
    return sorted((str(r.as_of_date), r.ticker, max(1, -(-(r["rank"] - 1) * n // max(r.m - 1, 1)))) for r in ranked if r.m >= n * least)


@pytest.mark.parametrize("kind", ["even", "tied", "equal", "infinite", "twice"])
def test_buckets_without_ranking_all(spark, monkeypatch, kind):
    """All rows were ordered and written with their ranks; now those near a bucket's first row."""
    given = random.Random(7)
    value = {"even": given.random, "tied": lambda: float(given.randrange(4)), "equal": lambda: 1.0, "infinite": lambda: given.choice([float("inf"), 1.0, float("nan"), -0.0, 0.0]), "twice": given.random}[kind]
    rows = [(d, f"T{i}", value()) for d in (DAY, None, dt.date(2020, 2, 29)) for i in range(997)] + [(DAY, "X", None), (dt.date(2021, 1, 31), "few", 1.0)]
    rows += [rows[5]] * 500 if kind == "twice" else []
    df = spark.createDataFrame(rows, "as_of_date date, ticker string, s double").repartition(5)
    seen = []
    monkeypatch.setattr(portfolios, "exact_ranks", lambda r, *a: seen.append(r.count()) or exact_ranks(r, *a))
    out = portfolios.form_buckets(df, "s", 10, 5)
    got = sorted((str(r.as_of_date), r.ticker, r.decile) for r in out.collect() if r.decile)
    assert got == by_ranks(df, 10, 5) and out.count() == len(rows) and out.columns == [*df.columns, "decile"]
    assert kind != "even" or seen[0] < len(rows) / 5


def test_a_first_load_is_written_once(spark, monkeypatch, tmp_path):
    """A batch was copied, joined with an empty table, copied again and staged before it was written."""
    made = []
    monkeypatch.setattr(fact_table, "materialised", lambda df: made.append(1) or storage.materialised(df))
    f = X.facts(spark, SMOKE)
    fact_table.add_filings(f, f"{tmp_path}/a")
    fact_table.replace_companies(f, f"{tmp_path}/b")
    assert not made
    rows = [sorted((r.cik, r.tag, str(r.fiscal_period_end), str(r.filed_date), r.value) for r in fact_table.read_facts(spark, f"{tmp_path}/{k}").collect()) for k in "ab"]
    assert rows[0] == rows[1] and len(rows[0]) == f.count()
    assert not [p for p in tmp_path.glob("*/.staged*")]


def test_repeats_keep_the_rows_held(spark, tmp_path):
    """Repeats within a batch and of the table go, with nulls in a key as well; a fact's flags are those of all its filings."""
    day = lambda y, m: dt.date(y, m, 1)
    row = lambda filed, value, start=None: ("1", "A", "Assets", dt.date(2019, 12, 31), start, filed, value, "USD", "10-K", 2019, "FY", False, "us-gaap")
    put = lambda *rows: fact_table.add_filings(spark.createDataFrame(list(rows), FACTS), f"{tmp_path}/t")
    assert put(row(day(2020, 5), 1.0), row(day(2020, 5), 1.0), row(day(2020, 5), 1.0, day(2019, 1))) == 1
    assert put(row(day(2020, 5), 1.0)) == 0
    assert put(row(day(2020, 5), 1.0), row(day(2020, 3), None)) == 1
    got = sorted((str(r.filed_date), str(r.start_date), r.value, r.is_restatement) for r in fact_table.read_facts(spark, f"{tmp_path}/t").collect())
    assert got == [("2020-03-01", "None", None, False), ("2020-05-01", "2019-01-01", 1.0, True), ("2020-05-01", "None", 1.0, True)]


def test_landed_text_is_compressed(spark, tmp_path):
    X.land_company_json(X.facts(spark, SMOKE), f"{tmp_path}/json")
    X.land_dart(spark, SMOKE, f"{tmp_path}/dart")
    assert not [p for p in tmp_path.rglob("part-*") if p.suffix in (".txt", ".json")] and list(tmp_path.rglob("*.gz"))
