"""The model in plain SQL, for checks by another engine.

``sql(final, *names)`` puts the named tables and all that they need in front
of a final select.  The forms differ from the Spark plans on purpose: row
numbers per date instead of validity intervals, self joins instead of arrays.
"""

from __future__ import annotations

from .functions.expressions import best_of_trials, quantile
from .schema import FLOW_TAGS
from .sources.fixtures import DATES, MONTHS

HELD = ["Revenues", "CostOfRevenue", "NetIncomeLoss", "NetCashProvidedByUsedInOperatingActivities", "Assets", "AssetsCurrent", "LiabilitiesCurrent", "Liabilities", "LongTermDebtNoncurrent", "RetainedEarningsAccumulatedDeficit", "CommonStockSharesOutstanding", "IncomeTaxExpenseBenefit"]
CASH = "NetCashProvidedByUsedInOperatingActivities"

TABLES: dict[str, tuple[tuple[str, ...], str]] = {}


def _table(name: str, needs: tuple[str, ...], body: str) -> None:
    TABLES[name] = (needs, body)


def sql(final: str, *names: str) -> str:
    order: list[str] = []

    def need(n: str) -> None:
        for m in TABLES[n][0]:
            need(m)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n][1]})" for n in order) + "\n" + final


_table("dates", (), "SELECT * FROM (VALUES " + ", ".join(f"(DATE '{d}')" for d in DATES) + ") t(as_of_date)")
_table(
    "yearly",
    (),
    """SELECT entity, fy, v, round(sum(price), 4) AS rev, round(sum(price * (0.40 + 4 * disc)), 4) AS cogs, round(sum(price * 2 * tax), 4) AS tax,
       round(sum(qty), 4) AS qty, round(sum(CASE WHEN flag = 'R' THEN price ELSE 0 END), 4) AS ret, count(*)::double AS n, any_value(p_size)::double AS size
FROM (SELECT l_partkey AS entity, year(l_shipdate) AS fy, l_orderkey AS o, l_extendedprice AS price, l_discount AS disc, l_tax AS tax, l_quantity AS qty, l_returnflag AS flag, p_size
      FROM lineitem JOIN part ON l_partkey = p_partkey), (VALUES (1), (2)) t(v)
WHERE v = 2 OR o % 3 <> 0 GROUP BY entity, fy, v""",
)
_VALUES = {
    "Revenues": "rev",
    "CostOfRevenue": "CASE WHEN entity % 13 <> 0 THEN cogs END",
    "NetIncomeLoss": "rev - cogs - tax - 0.3::double * ret - 9000",
    CASH: "rev - cogs - tax - 20 * qty",
    "Assets": "1.5::double * rev + 2000 * size",
    "AssetsCurrent": "0.6::double * rev + 500 * size",
    "LiabilitiesCurrent": "0.5::double * cogs + 100 * qty",
    "Liabilities": "0.5::double * cogs + 100 * qty + 1500 * size",
    "LongTermDebtNoncurrent": "CASE WHEN entity % 11 <> 0 THEN 700 * size + 0.1::double * ret END",
    "RetainedEarningsAccumulatedDeficit": "0.4::double * (rev - cogs) - 8000",
    "CommonStockSharesOutstanding": "1000 + n * size",
    "IncomeTaxExpenseBenefit": "tax",
}
_table(
    "facts",
    ("yearly",),
    """SELECT lpad(entity::varchar, 10, '0') AS cik, 'P' || entity AS ticker, tag, make_date(fy, 12, 31) AS fiscal_period_end,
       CASE WHEN tag IN (""" + ", ".join(f"'{t}'" for t in FLOW_TAGS) + """) THEN make_date(fy, 1, 1) END AS start_date,
       CASE WHEN v = 1 THEN make_date(fy + 1, 2, 15) ELSE make_date(fy + 1, 11, 30) END AS filed_date, round(value, 4) AS value, fy::int AS fy
FROM yearly, LATERAL (VALUES """ + ", ".join(f"('{t}', {v})" for t, v in _VALUES.items()) + ") t(tag, value) WHERE value IS NOT NULL",
)
_table(
    "known",
    ("facts", "dates"),
    """SELECT as_of_date, ticker, tag, fiscal_period_end, filed_date, value,
       dense_rank() OVER (PARTITION BY as_of_date, ticker, tag ORDER BY fiscal_period_end DESC) AS period_rank
FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date, ticker, tag, fiscal_period_end ORDER BY filed_date DESC, start_date DESC NULLS LAST, value DESC) AS rn
      FROM facts JOIN dates ON filed_date <= as_of_date)
WHERE rn = 1""",
)
_table("long", ("known",), "SELECT * FROM known WHERE period_rank <= 2")
_picks = ", ".join([f"max(CASE WHEN tag = '{t}' AND period_rank = 1 THEN value END) AS \"{t}\", max(CASE WHEN tag = '{t}' AND period_rank = 2 THEN value END) AS \"{t}_prior\"" for t in HELD])
_table("wide", ("long",), f"SELECT as_of_date, ticker, max(CASE WHEN period_rank = 1 THEN fiscal_period_end END) AS fiscal_period_end, {_picks} FROM long GROUP BY as_of_date, ticker")
_table(
    "prices_raw",
    (),
    f"""SELECT 'P' || p_partkey AS ticker, last_day((DATE '1995-01-01' + to_months(m::int))::date) AS month_end, (12 * 1995 + 1 + m)::int AS mi,
       CASE WHEN p_partkey % 10 = 0 AND m < 12 + p_partkey % 24 THEN 0.0::double ELSE round(p_retailprice * (1 + ((p_partkey * 31 + m * 17) % 41 - 20) / 200.0::double), 4) END AS close
FROM part, range({MONTHS}) t(m)""",
)
_table("prices", ("prices_raw",), "SELECT ticker, month_end, mi, nullif(close, 0) AS close FROM prices_raw")
_table(
    "returns",
    ("prices",),
    """SELECT a.ticker, a.month_end, a.mi, a.close, a.close / b.close - 1 AS ret
FROM prices a LEFT JOIN prices b ON a.ticker = b.ticker AND b.mi = a.mi - 1""",
)
_table("sectors", (), "SELECT 'P' || p_partkey AS ticker, p_brand AS sector FROM part")
_table(
    "membership",
    (),
    """SELECT ticker, start_date, CASE WHEN k % 5 = 0 THEN coalesce(start_date, DATE '1995-07-01') + 1200 END AS end_date
FROM (SELECT p_partkey AS k, 'P' || p_partkey AS ticker, CASE WHEN p_partkey % 3 <> 0 THEN DATE '1995-07-01' + (p_partkey % 1500)::int END AS start_date FROM part)""",
)


def _div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def _q(t: str, at: str = "") -> str:
    return f'"{t}{at}"'


def _roa(at: str) -> str:
    return _div(_q("NetIncomeLoss", at), _q("Assets", at))


def _debt(at: str) -> str:
    return _div(_q("LongTermDebtNoncurrent", at), _q("Assets", at))


def _cur(at: str) -> str:
    return _div(_q("AssetsCurrent", at), _q("LiabilitiesCurrent", at))


def _gm(at: str) -> str:
    return _div(f"{_q('Revenues', at)} - {_q('CostOfRevenue', at)}", _q("Revenues", at))


def _turn(at: str) -> str:
    return _div(_q("Revenues", at), _q("Assets", at))


P = "_prior"
_TESTS = [
    f"{_roa('')} > 0",
    f"{_q(CASH)} > 0",
    f"{_roa('')} > {_roa(P)}",
    f"{_q(CASH)} > {_q('NetIncomeLoss')}",
    f"CASE WHEN {_debt('')} IS NULL AND {_debt(P)} IS NULL AND {_q('Assets')} IS NOT NULL AND {_q('Assets', P)} IS NOT NULL THEN true ELSE {_debt('')} <= {_debt(P)} END",
    f"{_cur('')} > {_cur(P)}",
    f"{_q('CommonStockSharesOutstanding')} <= {_q('CommonStockSharesOutstanding', P)} * 1.02::double",
    f"{_gm('')} > {_gm(P)}",
    f"{_turn('')} > {_turn(P)}",
]
F_SQL = " + ".join(f"({t})::int::double" for t in _TESTS)
Z_SQL = (
    f"1.2::double * {_div(_q('AssetsCurrent') + ' - ' + _q('LiabilitiesCurrent'), _q('Assets'))} + 1.4::double * {_div(_q('RetainedEarningsAccumulatedDeficit'), _q('Assets'))}"
    f" + 3.3::double * {_div(_q('NetIncomeLoss') + ' + coalesce(' + _q('IncomeTaxExpenseBenefit') + ', 0)', _q('Assets'))} + 0.6::double * {_div('market_cap', _q('Liabilities'))} + {_turn('')}"
)
O_SQL = (
    f"-1.32::double - 0.407::double * ln(CASE WHEN {_q('Assets')} > 0 THEN {_q('Assets')} END) + 6.03::double * {_div(_q('Liabilities'), _q('Assets'))}"
    f" - 1.43::double * {_div(_q('AssetsCurrent') + ' - ' + _q('LiabilitiesCurrent'), _q('Assets'))} + 0.0757::double * {_div(_q('LiabilitiesCurrent'), _q('AssetsCurrent'))}"
    f" - 1.72::double * coalesce({_q('Liabilities')} > {_q('Assets')}, false)::int - 2.37::double * {_roa('')} - 1.83::double * {_div(_q(CASH), _q('Liabilities'))}"
    f" + 0.285::double * coalesce({_q('NetIncomeLoss')} < 0 AND {_q('NetIncomeLoss', P)} < 0, false)::int"
    f" - 0.521::double * {_div(_q('NetIncomeLoss') + ' - ' + _q('NetIncomeLoss', P), 'abs(' + _q('NetIncomeLoss') + ') + abs(' + _q('NetIncomeLoss', P) + ')')}"
)
_table("spine", ("prices", "dates"), "SELECT as_of_date, ticker FROM dates, (SELECT DISTINCT ticker FROM prices WHERE close IS NOT NULL)")
_table(
    "capped",
    ("spine", "wide", "prices"),
    """SELECT s.as_of_date, s.ticker, w.* EXCLUDE (as_of_date, ticker), w."CommonStockSharesOutstanding" * p.close AS market_cap
FROM spine s LEFT JOIN wide w USING (as_of_date, ticker) LEFT JOIN prices p ON p.ticker = s.ticker
 AND p.mi = CASE WHEN last_day(s.as_of_date) = s.as_of_date THEN year(s.as_of_date) * 12 + month(s.as_of_date) ELSE year(s.as_of_date) * 12 + month(s.as_of_date) - 1 END""",
)
_table("scores", ("capped",), f"SELECT as_of_date, ticker, {F_SQL} AS f_score, {Z_SQL} AS z_score, {O_SQL} AS o_score FROM capped")
_table("sectored", ("scores", "sectors"), "SELECT s.*, sector FROM scores s LEFT JOIN sectors USING (ticker)")
_zs = []
for _s in ("f_score", "z_score", "o_score"):
    _sign = "-1" if _s == "o_score" else "1"
    _own = f"sector IS NOT NULL AND count({_s}) OVER sec >= 5 AND stddev_pop({_s}) OVER sec > 0"
    _zs.append(f"CASE WHEN {_own} THEN {_sign} * ({_s} - avg({_s}) OVER sec) / stddev_pop({_s}) OVER sec WHEN stddev_pop({_s}) OVER al > 0 THEN {_sign} * ({_s} - avg({_s}) OVER al) / stddev_pop({_s}) OVER al END AS {_s}_z")
_table("zscored", ("sectored",), "SELECT *, " + ", ".join(_zs) + " FROM sectored WINDOW sec AS (PARTITION BY as_of_date, sector), al AS (PARTITION BY as_of_date)")
_table(
    "panel",
    ("zscored", "returns"),
    """SELECT z.*, r1.ret AS fwd_ret_1m, h.close / r0.close - 1 - avg(h.close / r0.close - 1) OVER (PARTITION BY z.as_of_date) AS fwd_ret_demeaned
FROM zscored z LEFT JOIN returns r0 ON r0.ticker = z.ticker AND r0.month_end = z.as_of_date
LEFT JOIN returns r1 ON r1.ticker = z.ticker AND r1.mi = r0.mi + 1 LEFT JOIN returns h ON h.ticker = z.ticker AND h.mi = r0.mi + 6""",
)


def buckets(score: str, n: int = 10, keys: str = "as_of_date") -> str:
    """Bucket by the integer rule over rows that have the score."""
    r = f"(row_number() OVER (PARTITION BY {keys}, {score} IS NULL ORDER BY {score}, ticker) - 1)"
    m = f"count(*) OVER (PARTITION BY {keys}, {score} IS NULL)"
    return f"CASE WHEN {score} IS NOT NULL AND {m} >= {n * 5} THEN greatest(1, ({r} * {n} + greatest({m} - 1, 1) - 1) // greatest({m} - 1, 1))::int END"


_table("composed", ("panel",), "SELECT *, (f_score_z + z_score_z + o_score_z) / 3 AS composite_raw FROM panel")
_table("blended", ("composed",), "SELECT * EXCLUDE (composite_raw), round(composite_raw, 9) AS composite_score FROM composed")
_table("book", ("blended",), f"SELECT *, {buckets('composite_score')} AS decile FROM blended")
_table("ranked", ("book",), "SELECT * FROM book WHERE decile IS NOT NULL AND fwd_ret_1m IS NOT NULL")
_table(
    "legs",
    ("ranked",),
    """SELECT *, top - market AS long_excess, market - bottom AS short_excess, top - bottom AS spread
FROM (SELECT as_of_date, avg(fwd_ret_1m) AS market, avg(fwd_ret_1m) FILTER (decile = 10) AS top, avg(fwd_ret_1m) FILTER (decile = 1) AS bottom FROM ranked GROUP BY as_of_date)
WHERE top IS NOT NULL AND bottom IS NOT NULL""",
)
_table("brand", ("returns", "sectors"), "SELECT sector AS series, month_end AS date, round(avg(ret), 8) AS ret FROM returns JOIN sectors USING (ticker) WHERE ret IS NOT NULL GROUP BY sector, month_end")
_table("market", ("brand",), "SELECT date, round(avg(ret), 8) AS market FROM brand GROUP BY date")


def newey_west(source: str, key: str, least: str = "0") -> str:
    """n, mean, nw_lag and nw_tstat by self join on the distance of rows."""
    return f"""SELECT {key}, n, mean, nw_lag, mean / nullif(sqrt(sum(CASE WHEN d = 0 THEN g ELSE 2 * (1 - d / (nw_lag + 1.0::double)) * g END)) / n, 0) AS nw_tstat
FROM (SELECT a.{key}, any_value(a.n) AS n, any_value(a.mean) AS mean, any_value(a.nw_lag) AS nw_lag, a.i - b.i AS d, sum(a.e * b.e) AS g
      FROM (SELECT *, greatest(floor(4 * pow(n / 100.0::double, 2.0::double / 9))::int, {least}) AS nw_lag, ret - mean AS e FROM (
              SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date) AS i, count(*) OVER (PARTITION BY {key}) AS n, avg(ret) OVER (PARTITION BY {key}) AS mean FROM {source} WHERE ret IS NOT NULL)) a
      JOIN (SELECT *, ret - mean AS e FROM (SELECT {key}, ret, row_number() OVER (PARTITION BY {key} ORDER BY date) AS i, avg(ret) OVER (PARTITION BY {key}) AS mean FROM {source} WHERE ret IS NOT NULL)) b
        ON a.{key} = b.{key} AND b.i BETWEEN a.i - a.nw_lag AND a.i
      GROUP BY a.{key}, a.i - b.i) GROUP BY {key}, n, mean, nw_lag"""


def sharpe(source: str, key: str, over: str = "") -> str:
    """n, mean, sd, skew, kurt, sharpe, sr0, psr_stat from raw moments."""
    return f"""SELECT *, (sharpe - sr0) * sqrt(n - 1) / sqrt(greatest(inside, 1e-12)) AS psr_stat FROM (
  SELECT *, sqrt(greatest(inside / (n - 1), 1e-12)) * {best_of_trials(4)!r}::double AS sr0 FROM (
    SELECT *, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe AS inside FROM (
      SELECT *, mean / nullif(sd, 0) AS sharpe FROM (
        SELECT {key}, n, mean, sd, (m3 - 3 * mean * m2 + 2 * mean ** 3) / nullif((m2 - mean * mean) ** 1.5::double, 0) AS skew,
               (m4 - 4 * mean * m3 + 6 * mean * mean * m2 - 3 * mean ** 4) / nullif((m2 - mean * mean) ** 2, 0) AS kurt
        FROM (SELECT {key}, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(ret ** 2) AS m2, avg(ret ** 3) AS m3, avg(ret ** 4) AS m4 FROM {source} WHERE ret IS NOT NULL GROUP BY {key})))))"""


CUT_95 = quantile(0.95)
