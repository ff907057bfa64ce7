"""The model's tables derived from the order tables: parts are the entities,
their yearly sales the filings.  Spark derives all of it, so work grows with
the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import flag_restatements
from ..plans.storage import making, many, materialised
from ..schema import FACT_COLUMNS

#: Quarter ends, fixed values.
DATES = [d for y in range(1997, 2002) for d in (dt.date(y, 3, 31), dt.date(y, 6, 30), dt.date(y, 9, 30), dt.date(y, 12, 31)) if d <= dt.date(2001, 9, 30)]
MONTHS = 84
#: Landed text repeats its keys in every row.
LANDED = {"compression": "gzip"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key before they are unfolded: what comes of them
    stays where it is for all windows and groups of that key.  The number of
    parts is given, as Spark would take so few rows for one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: What companies are known by.
NAMES = {"entity": lambda k: k, "ticker": lambda k: F.concat(F.lit("P"), k.cast("string")), "cik": lambda k: F.lpad(k.cast("string"), 10, "0")}


def yearly(spark: SparkSession, sf_dir: str, by: str = "entity") -> DataFrame:
    """Sales sums by part, year and filing version (1: without a third of the
    orders; 2: complete), from one aggregation of the lines.  Lines are dealt
    out once, by ``by`` (one of NAMES), and all that comes of them stays."""
    key = F.col("l_partkey")
    own = [NAMES[by](key).alias(by)] if by != "entity" else []
    li = table(spark, sf_dir, "lineitem").select(*own, key.alias("entity"), F.year("l_shipdate").alias("fy"), (F.col("l_orderkey") % 3 != 0).alias("early"), "l_extendedprice", "l_discount", "l_tax", "l_quantity", (F.col("l_returnflag") == "R").alias("returned"))
    li = dealt(li, by)
    price = F.col("l_extendedprice")
    sums = {
        "rev": price,
        "cogs": price * (0.40 + 4 * F.col("l_discount")),
        "tax": price * 2 * F.col("l_tax"),
        "qty": F.col("l_quantity"),
        "ret": F.when(F.col("returned"), price).otherwise(0.0),
        "n": F.lit(1.0),
    }
    early = F.col("early")
    aggs = [F.sum(c).alias(f"{k}2") for k, c in sums.items()] + [F.sum(F.when(early, c)).alias(f"{k}1") for k, c in sums.items()]
    names = [by] if by == "entity" else [by, "entity"]
    grouped = li.groupBy(*names, "fy").agg(*aggs)
    versions = F.array(*[F.struct(F.lit(v).alias("v"), *[F.round(F.col(f"{k}{v}"), 4).alias(k) for k in sums]) for v in (1, 2)])
    each = grouped.select(*names, "fy", F.explode(versions).alias("x")).select(*names, "fy", "x.*").filter(F.col("n").isNotNull())
    size = table(spark, sf_dir, "part").select(NAMES[by](F.col("p_partkey")).alias(by), F.col("p_size").cast("double").alias("size"))
    return each.join(many(dealt(size, by)), by)


def statement(y: DataFrame) -> dict[str, object]:
    """Tag values of a yearly row."""
    c = F.col
    return {
        "Revenues": c("rev"),
        "CostOfRevenue": F.when(c("entity") % 13 != 0, c("cogs")),
        "NetIncomeLoss": c("rev") - c("cogs") - c("tax") - 0.3 * c("ret") - 9000,
        "NetCashProvidedByUsedInOperatingActivities": c("rev") - c("cogs") - c("tax") - 20 * c("qty"),
        "Assets": 1.5 * c("rev") + 2000 * c("size"),
        "AssetsCurrent": 0.6 * c("rev") + 500 * c("size"),
        "LiabilitiesCurrent": 0.5 * c("cogs") + 100 * c("qty"),
        "Liabilities": 0.5 * c("cogs") + 100 * c("qty") + 1500 * c("size"),
        "LongTermDebtNoncurrent": F.when(c("entity") % 11 != 0, 700 * c("size") + 0.1 * c("ret")),
        "RetainedEarningsAccumulatedDeficit": 0.4 * (c("rev") - c("cogs")) - 8000,
        "CommonStockSharesOutstanding": 1000 + c("n") * c("size"),
        "IncomeTaxExpenseBenefit": c("tax"),
    }


FLOWS = {"Revenues", "CostOfRevenue", "NetIncomeLoss", "NetCashProvidedByUsedInOperatingActivities", "IncomeTaxExpenseBenefit"}


def facts(spark: SparkSession, sf_dir: str, flagged: bool = False, by: str = "ticker") -> DataFrame:
    """Facts dealt out by ticker or, flagged or if asked for, by cik."""
    by = "cik" if flagged else by
    y = yearly(spark, sf_dir, by)
    tags = F.array(*[F.struct(F.lit(t).alias("tag"), F.round(v, 4).alias("value"), F.lit(t in FLOWS).alias("flow")) for t, v in statement(y).items()])
    y = y.withColumns({k: NAMES[k](F.col("entity")) for k in ("cik", "ticker") if k != by})
    x = y.select("cik", "ticker", "fy", "v", F.explode(tags).alias("t")).filter(F.col("t.value").isNotNull())
    out = x.select(
        "cik",
        "ticker",
        F.col("t.tag").alias("tag"),
        F.make_date("fy", F.lit(12), F.lit(31)).alias("fiscal_period_end"),
        F.when(F.col("t.flow"), F.make_date("fy", F.lit(1), F.lit(1))).alias("start_date"),
        F.when(F.col("v") == 1, F.make_date(F.col("fy") + 1, F.lit(2), F.lit(15))).otherwise(F.make_date(F.col("fy") + 1, F.lit(11), F.lit(30))).alias("filed_date"),
        F.col("t.value").alias("value"),
        F.lit("USD").alias("unit"),
        F.lit("10-K").alias("form"),
        F.col("fy").cast("int").alias("fy"),
        F.lit("FY").alias("fp"),
        F.lit(False).alias("is_restatement"),
        F.lit("us-gaap").alias("taxonomy"),
    ).select(*FACT_COLUMNS)
    return flag_restatements(out) if flagged else out


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"), F.col("p_brand").alias("sector"))


def prices(spark: SparkSession, sf_dir: str, raw: bool = False) -> DataFrame:
    """Month-end closes; the padding before a listing (zero) is missing unless ``raw``."""
    k = F.col("p_partkey")
    p = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.concat(F.lit("P"), k.cast("string")).alias("ticker")), "ticker")
    # a cross join, not an explode: Spark takes an exploded table for as small as
    # the one before, and sends it whole through the driver
    p = p.crossJoin(F.broadcast(spark.range(MONTHS).select(F.col("id").cast("int").alias("m"))))
    close = F.round(F.col("p_retailprice") * (1 + ((k * 31 + F.col("m") * 17) % 41 - 20) / 200.0), 4)
    padded = F.when((k % 10 == 0) & (F.col("m") < 12 + k % 24), 0.0).otherwise(close)
    month = F.last_day(F.add_months(F.lit(dt.date(1995, 1, 1)), F.col("m")))
    return p.select("ticker", month.alias("month_end"), (padded if raw else F.nullif(padded, F.lit(0.0))).alias("close"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    first = F.lit(dt.date(1995, 7, 1))
    start = F.when(k % 3 != 0, F.date_add(first, (k % 1500).cast("int")))
    end = F.when(k % 5 == 0, F.date_add(F.coalesce(start, first), 1200))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P"), k.cast("string")).alias("ticker"), start.alias("start_date"), end.alias("end_date"))


def brand_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly equal-weight return of each brand: series, date, ret."""
    from ..operators.prices import monthly_returns

    r = monthly_returns(prices(spark, sf_dir)).filter(F.col("ret").isNotNull())
    mean = F.round(F.avg("ret"), 8).alias("ret")
    return r.join(many(sectors(spark, sf_dir)), "ticker").groupBy(F.col("sector").alias("series"), F.col("month_end").alias("date")).agg(mean)


def _unpivoted(y: DataFrame, keep: list[str], rows: list[tuple]) -> DataFrame:
    """A row for each of (statement, label or code, text, value) of a yearly row."""
    each = F.array(*[F.struct(F.lit(a).alias("statement"), F.lit(b).alias("code"), F.lit(c).alias("label"), v.alias("value")) for a, b, c, v in rows])
    return y.select(*keep, F.explode(each).alias("x")).select(*keep, "x.*").filter(F.col("value").isNotNull())


def bse_landed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Indian statement rows, filing dates and tickers: every fourth company
    has the parent's equity only; a filing comes 0 to 7 months after the period."""
    c = F.col
    y = yearly(spark, sf_dir).filter("v = 2").withColumns({"scrip_code": c("entity"), "period_end": F.make_date(c("fy") + 1, F.lit(3), F.lit(31))})
    y = dealt(materialised(y), "scrip_code")  # three tables come from it
    rows = _unpivoted(
        y,
        ["scrip_code", "period_end"],
        [
            ("bs", "", "Total Assets", F.round(1.5 * c("rev") + 2000 * c("size"), 4)),
            ("bs", "", "Stockholders Equity", F.round(0.5 * c("rev"), 4)),
            ("bs", "", "Total Equity Gross Minority Interest", F.when(c("entity") % 4 != 0, F.round(0.6 * c("rev"), 4))),
            ("bs", "", "Ordinary Shares Number", 1000 + c("n") * c("size")),
            ("is", "", "Total Revenue", c("rev")),
            ("is", "", "A label of no tag", c("rev")),
            ("cf", "", "Operating Cash Flow", F.round(c("rev") - c("cogs"), 4)),
        ],
    ).drop("code")
    filings = y.select("scrip_code", F.date_add("period_end", (c("entity") % 8 * 30).cast("int")).alias("filed_date")).distinct()
    tickers = y.select("scrip_code", F.concat(F.lit("P"), c("entity").cast("string")).alias("ticker")).distinct()
    return rows, filings, tickers


def cvm_landed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Brazilian statement lines of two versions, filing index, share counts
    and tickers: every fifth company labels its equity wrongly, and every
    ninth has no receipt date for its second version."""
    c = F.col
    y = yearly(spark, sf_dir).withColumns({"CNPJ_CIA": F.lpad(c("entity").cast("string"), 14, "0"), "DT_REFER": F.concat(c("fy").cast("string"), F.lit("-12-31")), "VERSAO": c("v")})
    y = materialised(y)  # four tables, and up to five files, come from it
    key = ["CNPJ_CIA", "DT_REFER", "VERSAO"]
    equity = F.round(0.5 * c("rev"), 4)
    rows = [
        ("BPA", "1", "Ativo Total", F.round(1.5 * c("rev") + 2000 * c("size"), 4)),
        ("BPP", "2.03", "Patrim\u00f4nio L\u00edquido", F.when(c("entity") % 5 != 0, equity)),
        ("BPP", "2.03", "Outras contas", F.when(c("entity") % 5 == 0, equity)),
        ("DRE", "3.01", "Receita de Venda de Bens e/ou Servi\u00e7os", c("rev")),
        ("DRE", "3.02", "Custo dos Bens e/ou Servi\u00e7os Vendidos", -c("cogs")),
        ("DRE", "9.99", "Receita de Venda", c("rev")),
    ]
    lines = _unpivoted(y, [*key, "entity", "fy"], rows).select(
        "statement",
        *key,
        F.when(c("entity") % 2 == 1, "MIL").otherwise("UNIDADE").alias("ESCALA_MOEDA"),
        F.when(c("statement") == "DRE", F.concat(c("fy").cast("string"), F.lit("-01-01"))).alias("DT_INI_EXERC"),
        c("DT_REFER").alias("DT_FIM_EXERC"),
        c("code").alias("CD_CONTA"),
        c("label").alias("DS_CONTA"),
        c("value").alias("VL_CONTA"),
    )
    received = F.when(c("v") == 1, F.concat((c("fy") + 1).cast("string"), F.lit("-03-15"))).when(c("entity") % 9 != 0, F.concat((c("fy") + 1).cast("string"), F.lit("-09-30")))
    index = y.select(*key, received.alias("DT_RECEB")).filter(c("DT_RECEB").isNotNull())
    shares = y.select(*key, (1000 + c("n") * c("size")).alias("QT_ACAO_TOTAL_CAP_INTEGR"), c("size").alias("QT_ACAO_TOTAL_TESOURO"))
    tickers = y.select("CNPJ_CIA", F.concat(F.lit("P"), c("entity").cast("string")).alias("ticker")).distinct()
    return lines, index, shares, tickers


def land_company_json(facts: DataFrame, folder: str) -> None:
    """Company-facts files: one JSON object a company and line."""
    from .filings import nest_facts

    n = nest_facts(facts)
    line = F.concat(F.lit('{"cik": "'), "cik", F.lit('", "ticker": "'), "ticker", F.lit('", "facts": '), "json", F.lit("}"))
    with making(facts.sparkSession):
        n.select(line.alias("value")).write.mode("append").options(**LANDED).text(folder)


def land_cvm(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Brazilian files as the regulator names them, one for each statement
    and a year in the name; returns the tickers."""
    from .filings import CVM_CSV

    lines, index, shares, tickers = cvm_landed(spark, sf_dir)
    options = {k: v for k, v in CVM_CSV.items() if k != "enforceSchema"} | LANDED
    order = lines.withColumn("ORDEM_EXERC", F.lit("\u00daLTIMO"))
    for code in ("BPA", "BPP", "DRE"):
        # balance sheets have no column for a period's start
        without = ["statement"] if code == "DRE" else ["statement", "DT_INI_EXERC"]
        order.filter(F.col("statement") == code).drop(*without).write.options(**options).csv(f"{folder}/dfp_cia_aberta_{code}_con_2001.csv")
    index.write.options(**options).csv(f"{folder}/dfp_cia_aberta_2001.csv")
    shares.write.options(**options).csv(f"{folder}/dfp_cia_aberta_composicao_capital_2001.csv")
    return tickers


def land_dart(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Korean files: statement rows, filings and share classes as JSON, the
    registry as XML.  Companies differ in id prefixes, statements (income or
    comprehensive income), equity rows, consolidation, share classes, and in whether
    the index or the receipt number itself gives the receipt date."""
    c, e = F.col, F.col("entity")
    y = yearly(spark, sf_dir).filter("v = 2").withColumns({"corp_code": F.lpad(e.cast("string"), 8, "0"), "bsns_year": c("fy").cast("string")})
    day = F.when(e % 12 == 0, F.lit("19900315")).otherwise(F.concat((c("fy") + 1).cast("string"), F.lit("0315")))
    y = materialised(y.withColumn("rcept_no", F.concat(day, F.lpad(e.cast("string"), 6, "0"))))  # six tables come from it
    full, income = F.when(e % 2 == 0, "ifrs-full_").otherwise("ifrs_"), F.when(e % 4 == 0, "CIS").otherwise("IS")
    cash = F.when(e % 7 == 0, "CashFlowsFromUsedInOperatingActivitiesBeforeIncomeTaxesAndOtherItemsAffectingConciliation").otherwise("CashFlowsFromUsedInOperatingActivities")
    rows = [
        (F.lit("BS"), F.concat(full, F.lit("Assets")), 1.5 * c("rev") + 2000 * c("size")),
        (F.lit("BS"), F.concat(full, F.lit("EquityAttributableToOwnersOfParent")), 0.4 * c("rev")),
        (F.lit("BS"), F.concat(full, F.lit("Equity")), F.when(e % 3 != 0, 0.5 * c("rev"))),
        (F.lit("SCE"), F.concat(full, F.lit("Equity")), F.lit(7.0)),
        (income, F.concat(full, F.lit("Revenue")), c("rev")),
        (income, F.concat(full, F.lit("ProfitLoss")), c("rev") - c("cogs")),
        (F.lit("BS"), F.lit("dart_NoncurrentPortionOfNoncurrentBondsIssued"), 0.1 * c("cogs")),
        (F.lit("BS"), F.lit("NoncurrentPortionOfNoncurrentLoansReceived"), F.when(e % 5 != 0, 0.2 * c("cogs"))),
        (F.lit("CF"), F.concat(full, cash), 0.3 * c("rev")),
    ]
    each = F.array(*[F.struct(a.alias("sj_div"), b.alias("account_id"), F.floor(v).alias("v")) for a, b, v in rows])
    x = y.select("entity", "corp_code", "bsns_year", "rcept_no", F.explode(each).alias("x")).select("entity", "corp_code", "bsns_year", "rcept_no", "x.*").filter(c("v").isNotNull())
    text = lambda v: F.format_number(v, 0)
    before = F.when(e % 2 == 1, text(c("v") - 200)).otherwise("-")
    x = x.select("entity", "corp_code", "bsns_year", "rcept_no", "sj_div", "account_id", "v", text(c("v") - 100).alias("frmtrm_amount"), before.alias("bfefrmtrm_amount"))
    one = x.withColumns({"fs_div": F.when(e % 10 == 0, "OFS").otherwise("CFS"), "thstrm_amount": text(c("v"))})
    two = x.filter(e % 9 == 0).filter(e % 10 != 0).withColumns({"fs_div": F.lit("OFS"), "thstrm_amount": text(2 * c("v"))})
    one.unionByName(two).drop("entity", "v").write.options(**LANDED).json(f"{folder}/statements")
    annual = y.filter(e % 6 != 0).select("corp_code", "rcept_no", F.concat((c("fy") + 1).cast("string"), F.lit("0320")).alias("rcept_dt"), F.concat(F.lit("사업보고서 ("), "bsns_year", F.lit(".12)")).alias("report_nm"))
    other = y.select("corp_code", "rcept_no", F.lit("19910101").alias("rcept_dt"), F.lit("분기보고서").alias("report_nm"))
    annual.unionByName(other).write.options(**LANDED).json(f"{folder}/filings")
    n = 1000 + c("n") * c("size")
    k = e % 4
    classes = F.array(
        F.struct(F.when(k == 0, "보통 주").when(k == 3, "의결권 있는 주식").alias("se"), n.alias("v")),
        F.struct(F.when(k == 3, "보통주").alias("se"), (n + 5).alias("v")),
        F.struct(F.lit("우선주").alias("se"), F.when(k != 1, F.lit(10.0)).alias("v")),
        F.struct(F.lit("합계").alias("se"), (n + 20).alias("v")),
        F.struct(F.lit("비고").alias("se"), F.lit(None).cast("double").alias("v")),
    )
    s = y.select("corp_code", "bsns_year", "rcept_no", F.explode(classes).alias("s")).filter("s.se IS NOT NULL")
    count = F.coalesce(text(c("s.v")), F.lit("-"))
    s.select("corp_code", "bsns_year", "rcept_no", "s.se", text(c("s.v") + F.when(c("s.se") == "보통주", 4).otherwise(3)).alias("istc_totqy"), F.lit("3").alias("tesstk_co"), count.alias("distb_stock_co"), F.concat("bsns_year", F.lit("-12-31")).alias("stlm_dt")).write.options(**LANDED).json(f"{folder}/shares")
    names = y.select(e.cast("string").alias("corp_code"), F.concat(F.lit("Company "), e.cast("string")).alias("corp_name"), F.concat(F.lit("P"), e.cast("string")).alias("stock_code")).distinct()
    names.write.format("xml").option("rootTag", "result").option("rowTag", "list").save(f"{folder}/registry")
