"""Filing adapters on rows shaped like the regulators' files."""

import datetime as dt

import pytest

from asof_factors.operators.prices import drawdowns, forward_returns, month_end_closes, monthly_returns, strip_suffix
from asof_factors.plans import backtest
from asof_factors.schema import UNIVERSES
from asof_factors.sources import filings as S

D = dt.date


def test_company_facts(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"cik": "1", "ticker": "acme", "facts": {"us-gaap": {"Assets": {"units": {"USD": ['
        '{"end": "2020-12-31", "val": 5, "filed": "2021-02-01", "form": "10-K", "fy": 2020, "fp": "FY"},'
        '{"end": "2020-12-31", "val": 5, "filed": "2021-02-01", "form": "10-K", "fy": 2021, "fp": "FY"},'
        '{"end": "2020-12-31", "val": 6, "filed": "2022-02-01", "form": "10-K", "fy": 2021, "fp": "FY"},'
        '{"end": null, "val": 6, "filed": "2022-02-01"}, {"end": "bad", "val": 6, "filed": "2022-02-01"}, {"end": "2020-12-31", "val": null, "filed": "2022-02-01"}]}},'
        '"Untracked": {"units": {"USD": [{"end": "2020-12-31", "val": 5, "filed": "2021-02-01"}]}}}}}\n'
    )
    got = S.company_facts(S.read_company_facts(spark, str(tmp_path))).orderBy("filed_date").collect()
    assert [(r.cik, r.ticker, r.value, r.is_restatement) for r in got] == [("0000000001", "ACME", 5.0, False), ("0000000001", "ACME", 6.0, True)]


def test_brazil(spark):
    cols = "statement string, CNPJ_CIA string, DT_REFER string, VERSAO int, ESCALA_MOEDA string, ORDEM_EXERC string, DT_INI_EXERC string, DT_FIM_EXERC string, CD_CONTA string, DS_CONTA string, VL_CONTA double"
    line = lambda st, code, label, v, ini=None, ver=1, scale="MIL": (st, "1", "2023-12-31", ver, scale, "ÚLTIMO", ini, "2023-12-31", code, label, v)
    lines = spark.createDataFrame([line("BPA", "1", "Ativo Total", 10.0), line("BPA", "1.01", "Caixa e Equivalentes", 3.0), line("DRE", "3.02", "Custo dos Bens e/ou Serviços", -4.0, "2023-01-01", scale="UNIDADE"), line("BPA", "1", "ATIVO TOTAL", 11.0, ver=2), line("BPP", "2.03", "Patrimônio Líquido", 5.0, ver=9)], cols)
    index = spark.createDataFrame([("1", "2023-12-31", 1, "2024-03-01"), ("1", "2023-12-31", 2, "2024-04-15")], "CNPJ_CIA string, DT_REFER string, VERSAO int, DT_RECEB string")
    shares = spark.createDataFrame([("1", "2023-12-31", 1, 100, 10)], "CNPJ_CIA string, DT_REFER string, VERSAO int, QT_ACAO_TOTAL_CAP_INTEGR long, QT_ACAO_TOTAL_TESOURO long")
    got = S.cvm_facts(lines, index, shares, spark.createDataFrame([("1", "BANK3")], "CNPJ_CIA string, ticker string")).collect()
    assert sorted((r.tag, r.value, r.filed_date, r.is_restatement, r.start_date) for r in got) == [
        ("Assets", 10000.0, D(2024, 3, 1), False, None),
        ("Assets", 11000.0, D(2024, 4, 15), True, None),
        ("CommonStockSharesOutstanding", 90.0, D(2024, 3, 1), False, None),
        ("CostOfRevenue", 4.0, D(2024, 3, 1), False, D(2023, 1, 1)),
    ]


def test_korea(spark):
    row = lambda a, x, y=None, z=None, sj="BS", no="R1": ("C", "2023", no, sj, a, x, y, z)
    st = spark.createDataFrame(
        [row("ifrs-full_Assets", "1,000", "900", "-"), row("ifrs-full_EquityAttributableToOwnersOfParent", "380"), row("ifrs-full_Equity", "400"), row("ifrs-full_Equity", "7", sj="SCE"), row("ifrs_ProfitLoss", "50", sj="CIS"), row("dart_NoncurrentPortionOfNoncurrentBondsIssued", "30"), row("NoncurrentPortionOfNoncurrentLoansReceived", "20"), row("ifrs-full_CurrentAssets", "5", no="20240401000001"), row("ifrs-full_Liabilities", "5", no="19990101000001")],
        "corp_code string, bsns_year string, rcept_no string, sj_div string, account_id string, thstrm_amount string, frmtrm_amount string, bfefrmtrm_amount string",
    )
    index = S.annual_index(spark.createDataFrame([("C", "R1", "20240315", "사업보고서 (2023.12)"), ("C", "R9", "20240315", "분기보고서")], "corp_code string, rcept_no string, rcept_dt string, report_nm string"))
    sh = lambda rows: spark.createDataFrame([("C", "2023", "R1", se, n, "2023-12-31") for se, n in rows], "corp_code string, bsns_year string, rcept_no string, se string, distb_stock_co string, stlm_dt string")
    tick = spark.createDataFrame([("C", "005930")], "corp_code string, ticker string")
    got = S.dart_facts(st, index, sh([("보통 주", "90"), ("우선주", "10"), ("합계", "100")]), tick).collect()
    assert sorted((r.tag, r.fiscal_period_end.year, r.value) for r in got) == [("Assets", 2022, 900.0), ("Assets", 2023, 1000.0), ("AssetsCurrent", 2023, 5.0), ("CommonStockSharesOutstanding", 2023, 90.0), ("LongTermDebtNoncurrent", 2023, 50.0), ("NetIncomeLoss", 2023, 50.0), ("StockholdersEquity", 2023, 400.0)]
    assert {r.filed_date for r in got if r.tag == "AssetsCurrent"} == {D(2024, 4, 1)} and {r.start_date for r in got if r.tag == "NetIncomeLoss"} == {D(2023, 1, 1)}
    count = lambda rows: [r.value for r in S.dart_facts(st, index, sh(rows), tick).collect() if r.unit == "shares"]
    assert count([("합계", "100"), ("우선주", "-")]) == [100.0] and count([("합계", "100"), ("우선주", "10")]) == []
    assert count([("의결권 있는 주식", "70"), ("보통주", "80")]) == [80.0]
    fs = spark.createDataFrame([("C", "2023", "OFS", 1), ("C", "2023", "CFS", 2), ("E", "2023", "OFS", 3)], "corp_code string, bsns_year string, fs_div string, v int")
    assert sorted(r.v for r in S.consolidated_first(fs).collect()) == [2, 3]


def test_india(spark):
    wide = spark.createDataFrame([(1, "bs", "Stockholders Equity", 7.0, None), (1, "bs", "Total Assets", 9.0, 8.0), (2, "bs", "Stockholders Equity", 1.0, None), (2, "bs", "Total Equity Gross Minority Interest", 2.0, None), (2, "is", "Net Income", 3.0, None)], "scrip_code int, statement string, label string, `2024-03-31` double, `2023-03-31` double")
    rows = S.long_statement(wide, ["2024-03-31", "2023-03-31"])
    ann = spark.createDataFrame([(1, "2024-04-22T10:00:00", None), (1, None, "2024-07-01T00:00:00"), (2, "bad", "2024-05-02T00:00:00"), (2, "bad", None)], "scrip_code int, News_submission_dt string, DissemDT string")
    f = S.result_filings(ann)
    got = S.bse_facts(rows, f, spark.createDataFrame([(1, "AA"), (2, "BB")], "scrip_code int, ticker string")).collect()
    assert sorted((r.ticker, r.tag, r.value, r.filed_date, r.start_date) for r in got if r.start_date is None) == [("AA", "Assets", 9.0, D(2024, 4, 22), None), ("AA", "StockholdersEquity", 7.0, D(2024, 4, 22), None), ("BB", "StockholdersEquity", 2.0, D(2024, 5, 2), None)]
    assert [(r.tag, r.start_date) for r in got if r.start_date] == [("NetIncomeLoss", D(2023, 4, 1))]


def test_universes(spark, tmp_path):
    (tmp_path / "h.csv").write_text('Fund,x\nAs of,"Jan 1"\n\nTicker,Name,Sector,Asset Class,Market Value,Weight (%)\nBRK B,"Berk, Inc",Fin,Equity,"1,000",1.5\nAAPL,Apple,IT,Equity,9,"7.0"\n-,Cash,x,Equity,1,1\nUSD,Cash,x,Cash,1,1\nAAPL,Apple,IT,Equity,9,6\n')
    assert [(r.ticker, r.weight) for r in S.parse_holdings(spark, str(tmp_path / "h.csv")).collect()] == [("AAPL", 7.0), ("BRK-B", 1.5)]
    listed = spark.createDataFrame([("BRK-B", "1"), ("BFA", "2"), ("C-D", "3")], "ticker string, cik string")
    asked = spark.createDataFrame([("brk-b",), ("BF-A",), ("CD",), ("ZZ",)], "ticker string")
    assert {r.ticker: r.cik for r in S.match_tickers(asked, listed).collect()} == {"BRK-B": "1", "BF-A": "2", "CD": "3", "ZZ": None}
    log = spark.createDataFrame([("1", "BRKB"), ("2", "LEN")], "cik string, ticker string")
    facts = spark.createDataFrame([("1", "BRKB", 1), ("2", "LEN", 2), ("3", "X", 3)], "cik string, ticker string, v int")
    want = spark.createDataFrame([("BRK-B", "1"), ("LEN", "2"), ("LEN-B", "2")], "ticker string, cik string")
    assert sorted(r.ticker for r in S.relabel(facts, log, want).collect()) == ["BRK-B", "LEN", "X"]
    raw = spark.createDataFrame([("June 1, 2020", "nan", "old.a"), ("2019-01-02", "New", None), ("bad", "X", "Y")], "date string, added string, removed string")
    assert [(r.date, r.added, r.removed) for r in S.change_events(raw).collect()] == [(D(2019, 1, 2), "NEW", None), (D(2020, 6, 1), None, "OLD-A")]
    (tmp_path / "c.xml").write_text("<result><list><corp_code>126380</corp_code><corp_name>S</corp_name><stock_code>005930</stock_code></list><list><corp_code>00000001</corp_code><corp_name>T</corp_name><stock_code> </stock_code></list></result>")
    assert sorted((r.corp_code, r.stock_code) for r in S.read_corp_codes(spark, str(tmp_path / "c.xml")).collect()) == [("00000001", None), ("00126380", "005930")]


def test_prices(spark):
    daily = spark.createDataFrame([("A.KS", D(2020, 1, 30), 10.0), ("A.KS", D(2020, 1, 31), 0.0), ("A.KS", D(2020, 2, 28), 11.0), ("A.KS", D(2020, 4, 30), 12.0)], "symbol string, date date, close double")
    m = month_end_closes(strip_suffix(daily, ".KS"))
    got = {r.month_end: r.ret for r in monthly_returns(m).collect()}
    assert got == {D(2020, 1, 31): None, D(2020, 2, 29): pytest.approx(0.1), D(2020, 4, 30): None}
    f = {r.month_end: (r.fwd_1m, r.fwd_3m) for r in forward_returns(m, [1, 3]).collect()}
    assert f[D(2020, 1, 31)] == (pytest.approx(0.1), None)
    p = spark.createDataFrame([("A", D(2020, k, 28), c) for k, c in enumerate([10.0, 2.0, 6.0], 1)], "ticker string, month_end date, close double")
    assert tuple(drawdowns(p).first())[1:] == (pytest.approx(-0.8), True)


def test_sink_keeps_twins(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "v int")
    u = UNIVERSES["sp500"]
    for uni in (u, u.with_membership(), u):
        backtest.sink({"panel": df}, uni, str(tmp_path))
    got = spark.read.parquet(str(tmp_path / "panel"))
    assert sorted((r.universe, r.mode) for r in got.collect()) == [("sp500", "corrected"), ("sp500", "static")]
    new = backtest.replace_facts(spark.createDataFrame([("1", 1), ("2", 2)], "cik string, v int"), spark.createDataFrame([("2", 9)], "cik string, v int"), ["cik"])
    assert sorted(tuple(r) for r in new.collect()) == [("1", 1), ("2", 9)]
    with pytest.raises(ValueError):
        UNIVERSES["india"].with_membership()
