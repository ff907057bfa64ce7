"""The fact table on disk, streams, scans of landed files, exact ranks, runs."""

import datetime as dt
import glob
import os
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from asof_factors.operators import asof, composite
from asof_factors.operators.ranks import exact_ranks, mean_ranks
from asof_factors.plans import backtest, fact_table
from asof_factors.schema import FACTS, UNIVERSES
from asof_factors.sources import filings as S
from asof_factors.streaming import ingest

D = dt.date


def fact(cik, year, filed, value, tag="Assets"):
    return (cik, f"T{cik}", tag, D(year, 12, 31), None, filed, float(value), "USD", "10-K", year, "FY", False, "us-gaap")


def table(spark, *rows):
    return spark.createDataFrame(list(rows), FACTS)


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/*/*/*.parquet")}


def flags(spark, path):
    return {(r.cik, r.filed_date.year, r.value): r.is_restatement for r in fact_table.read_facts(spark, path).collect()}


def test_a_late_first_filing_turns_flags_and_leaves_other_partitions(spark, tmp_path):
    path = f"{tmp_path}/facts"
    assert fact_table.add_filings(table(spark, fact("1", 2019, D(2021, 5, 1), 5), fact("2", 2019, D(2020, 2, 1), 7), fact("2", 2018, D(2019, 2, 1), 6)), path) == 3
    before = files(path)
    assert set(flags(spark, path).values()) == {False}
    assert fact_table.add_filings(table(spark, fact("1", 2019, D(2020, 2, 1), 4)), path) == 1
    assert flags(spark, path) == {("1", 2021, 5.0): True, ("1", 2020, 4.0): False, ("2", 2020, 7.0): False, ("2", 2019, 6.0): False}
    after = files(path)
    assert len(set(before.items()) & set(after.items())) == len(before) - 1
    # what was delivered before is harmless
    assert fact_table.add_filings(table(spark, fact("1", 2019, D(2020, 2, 1), 4), fact("1", 2019, D(2020, 2, 1), 4)), path) == 0
    assert files(path) == after
    assert fact_table.add_filings(table(spark), path) == 0


def test_a_second_load_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/facts"
    fact_table.replace_companies(table(spark, fact("1", 2018, D(2019, 2, 1), 1), fact("1", 2019, D(2020, 2, 1), 2), fact("2", 2019, D(2020, 2, 1), 3)), path)
    new = table(spark, fact("1", 2019, D(2020, 2, 1), 9))
    for _ in range(2):
        fact_table.replace_companies(new, path)
        assert sorted((r.cik, r.fiscal_period_end.year, r.value) for r in fact_table.read_facts(spark, path).collect()) == [("1", 2019, 9.0), ("2", 2019, 3.0)]


def test_json_stream_starts_after_what_it_took(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    body = lambda val, filed: '{"cik": "1", "ticker": "a", "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2020-12-31", "val": %s, "filed": "%s", "form": "10-K", "fy": 2020, "fp": "FY"}]}}}}}\n' % (val, filed)
    (landed / "1.json").write_text(body(6, "2022-02-01"))
    run = lambda: ingest.ingest_company_json(spark, str(landed), f"{tmp_path}/t", f"{tmp_path}/c")
    run()
    (landed / "2.json").write_text(body(5, "2021-02-01") + body(6, "2022-02-01"))
    run()
    run()
    assert sorted((r.value, r.is_restatement) for r in ingest.current_facts(spark, f"{tmp_path}/t").collect()) == [(5.0, False), (6.0, True)]


def test_csv_scan_by_names(spark, tmp_path):
    head = "CNPJ_CIA;DT_REFER;VERSAO;DENOM_CIA;ESCALA_MOEDA;ORDEM_EXERC;{}DT_FIM_EXERC;CD_CONTA;DS_CONTA;VL_CONTA\n"
    row = "01;2020-12-31;1;X;MIL;ÚLTIMO;{}2020-12-31;{};{};{}\n"
    put = lambda name, text: (tmp_path / name).write_text(text, encoding="latin-1")
    put("dfp_cia_aberta_BPP_con_2020.csv", head.format("") + row.format("", "2.03", "Patrimônio Líquido", "5.5"))
    put("dfp_cia_aberta_DRE_con_2020.csv", head.format("DT_INI_EXERC;") + row.format("2020-01-01;", "3.01", "Receita de Venda", "2"))
    put("dfp_cia_aberta_2020.csv", "CNPJ_CIA;DT_REFER;VERSAO;CATEG;DT_RECEB\n01;2020-12-31;1;DFP;2021-03-01\n")
    put("dfp_cia_aberta_composicao_capital_2020.csv", "CNPJ_CIA;DT_REFER;VERSAO;QT_ACAO_TOTAL_CAP_INTEGR;QT_ACAO_TOTAL_TESOURO\n01;2020-12-31;1;100;10\n")
    folder = str(tmp_path)
    lines = S.scan_cvm_lines(spark, folder)
    assert sorted((r.statement, r.CNPJ_CIA, r.CD_CONTA, r.DS_CONTA, r.DT_INI_EXERC) for r in lines.collect()) == [("BPP", "01", "2.03", "Patrimônio Líquido", None), ("DRE", "01", "3.01", "Receita de Venda", "2020-01-01")]
    got = S.cvm_facts(lines, S.scan_cvm_index(spark, folder), S.scan_cvm_shares(spark, folder), spark.createDataFrame([("01", "A")], "CNPJ_CIA string, ticker string"))
    assert sorted((r.tag, r.value, r.filed_date) for r in got.collect()) == [("CommonStockSharesOutstanding", 90.0, D(2021, 3, 1)), ("Revenues", 2000.0, D(2021, 3, 1)), ("StockholdersEquity", 5500.0, D(2021, 3, 1))]


def test_ranks_of_one_large_group(spark):
    rng = random.Random(1)
    rows = [("a" if k % 10 else None, rng.randint(0, 40), k) for k in range(3000)]
    got = exact_ranks(spark.createDataFrame(rows, "g string, x int, k int").repartition(7), ["g"], ["x", "k"])
    want = {}
    for g in ("a", None):
        own = sorted((x, k) for h, x, k in rows if h == g)
        want |= {k: (i + 1, len(own)) for i, (_, k) in enumerate(own)}
    assert {r.k: (r["rank"], r.group_size) for r in got.collect()} == want
    mean = {r.k: r.m for r in mean_ranks(spark.createDataFrame(rows, "g string, x int, k int").filter("g = 'a'"), ["g"], "x", "m").collect()}
    frame = pd.DataFrame([r for r in rows if r[0] == "a"], columns=["g", "x", "k"])
    assert mean == dict(zip(frame.k, frame.x.rank(method="average")))
    assert exact_ranks(spark.createDataFrame([], "g string, x int"), ["g"], ["x"]).count() == 0


def test_validity_ends_when_later_periods_are_known(spark):
    rng = random.Random(3)
    rows, dates = [], [D(2001 + k // 4, 3 * (k % 4) + 1, 15) for k in range(32)]
    for cik in "12345":
        for year in range(2000, 2008):
            for _ in range(rng.randint(1, 3)):
                rows.append(fact(cik, year, D(year, 12, 31) + dt.timedelta(days=rng.randint(30, 1500)), rng.randint(1, 10**6)))
    for periods in (1, 2, 3):
        got = {(r.as_of_date, r.ticker, r.period_rank): (r.fiscal_period_end, r.value) for r in asof.snapshot_long(table(spark, *rows), dates, ["Assets"], periods).collect()}
        want = {}
        for d in dates:
            for cik in "12345":
                known = [x for x in rows if x[0] == cik and x[5] <= d]
                for k, end in enumerate(sorted({x[3] for x in known}, reverse=True)[:periods]):
                    best = max((x[5], -x[6]) for x in known if x[3] == end)
                    want[(d, f"T{cik}", k + 1)] = (end, max((x for x in known if x[3] == end), key=lambda x: (x[5], x[6]))[6]) if best else None
        assert got == want


def test_fits_meet_the_optimality_conditions():
    rng = np.random.default_rng(5)
    for alpha in (0.0001, 0.01, 0.1):
        x = rng.normal(size=(200, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
        y = 0.05 * x[:, 0] - 0.02 * x[:, 2] + rng.normal(size=200) * 0.1
        gram, moment = x.T @ x / 200, x.T @ y / 200
        w = composite.lasso(gram, moment, alpha)
        slope = moment - gram @ w
        assert np.all(np.abs(slope[w == 0]) <= alpha + 1e-9) and np.allclose(slope[w != 0], alpha * np.sign(w[w != 0]), atol=1e-9)


def test_runs_in_a_sink(spark, tmp_path):
    book = spark.createDataFrame([(D(2020, 1, 31), "A", 1), (D(2020, 2, 29), "A", 1)], "as_of_date date, ticker string, decile int")
    summary = spark.createDataFrame([("composite", 0.1), ("f_score_z", 0.2)], "strategy string, ann_return double")
    a, b = UNIVERSES["sp500"], UNIVERSES["kospi"].with_membership()
    for u in (a, b):
        backtest.sink({"panel": book, "summary": summary}, u, str(tmp_path))
    os.utime(glob.glob(f"{tmp_path}/panel/universe=kospi/mode=corrected/*.parquet")[0], (4e9, 4e9))
    got = {(r.universe, r.mode): (r.n_rows, r.ann_return, r.stale) for r in backtest.run_overview(spark, str(tmp_path)).collect()}
    assert got == {("sp500", "static"): (2, 0.1, False), ("kospi", "corrected"): (2, 0.1, True)}
    assert backtest.available_runs(spark, str(tmp_path)).filter(F.col("last_date") == D(2020, 2, 29)).count() == 2
