"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark code.

`PANEL`, `FINANCE` and the like are common table expressions; `_sql` joins them to a query and rounds.
"""

from __future__ import annotations


def _whole(c: str) -> str:
    return f"CAST(round({c} * 100) AS BIGINT)"


_E, _D, _X, _N = _whole("l_extendedprice"), _whole("l_discount"), _whole("l_tax"), "CAST(l_quantity AS BIGINT)"
SUMS = ", ".join(f"CAST(sum({term}) AS DOUBLE) / {unit} AS {name}" for name, term, unit in (("e", _E, "100e0"), ("d", f"{_E} * {_D}", "10000e0"), ("x", f"{_E} * {_X}", "10000e0"), ("n", _N, "1e0"), ("nd", f"{_N} * {_D}", "100e0"), ("nx", f"{_N} * {_X}", "100e0"), ("sd", _D, "100e0")))


def panel(unit: str = "week") -> str:
    return f"""px0 AS (SELECT l_suppkey AS code, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS time, min(l_extendedprice / l_quantity) AS open, count(*) AS k, {SUMS} FROM lineitem GROUP BY 1, 2),
    px AS (SELECT code, time, e / n AS close, open, e AS market_cap, e - d AS cap, n AS turnover_ratio, round(e / nullif(x, 0), 6) AS pb_ratio, round(e / nullif(d, 0), 6) AS pe_ratio,
        e / nullif(round(nd - nx, 6), 0) AS pcf_ratio, round(100 * sd / k, 6) AS dv_ratio FROM px0),
    cal AS (SELECT time, row_number() OVER (ORDER BY time) AS t FROM (SELECT DISTINCT time FROM px)),
    p0 AS (SELECT px.*, cal.t, lag(close) OVER (PARTITION BY code ORDER BY cal.t) AS pre_close FROM px JOIN cal USING (time)),
    p AS (SELECT *, close / pre_close - 1 AS ret FROM p0),
    ind AS (SELECT s_suppkey AS code, n_name AS industry, r_name AS L1 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    grid AS (SELECT code, cal.t, cal.time FROM (SELECT code, min(t) AS f FROM p GROUP BY code) JOIN cal ON cal.t >= f),
    d AS (SELECT grid.code, grid.t, grid.time, p.close, p.pre_close, p.ret, p.turnover_ratio / 100 AS x, p.turnover_ratio AS whole FROM grid LEFT JOIN p ON p.code = grid.code AND p.t = grid.t),
    mkt AS (SELECT time, avg(ret) AS m FROM p GROUP BY time)"""


FINANCE = f"""q AS (SELECT l_suppkey AS code, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q, {SUMS} FROM lineitem GROUP BY 1, 2),
    f0 AS (SELECT code, year(q) * 4 + quarter(q) AS k, last_day(q + INTERVAL 2 MONTH) AS statDate,
        sum(e) OVER y AS operating_revenue, sum(e + x) OVER y AS total_operating_revenue, sum(e - d) OVER y AS operating_cost, sum(e - d + x) OVER y AS total_operating_cost, sum(d) OVER y AS compr_inc_attr_p,
        CASE WHEN (year(q) * 4 + quarter(q)) % 5 <> 0 THEN sum(x) OVER y END AS oth_compr_income, CASE WHEN quarter(q) IN (2, 4) THEN sum(d) OVER y END AS net_profit,
        sum(n) OVER y AS net_operate_cash_flow, sum(-x) OVER y AS net_invest_cash_flow, sum(n * 2) OVER y AS fix_intan_other_asset_acqui_cash, sum(x * 0.06) OVER y AS fixed_assets_depreciation,
        sum(x * 0.03) OVER y AS intangible_assets_amortization, sum(x * 0.01) OVER y AS defferred_expense_amortization, n AS cash_equivalent_increase,
        sum(e) OVER a AS total_assets, sum((e - d) * 0.6) OVER a AS total_liability, sum(x) OVER a AS total_non_current_liability, CASE WHEN (year(q) * 4 + quarter(q)) % 7 <> 0 THEN sum(x * 0.25) OVER a END AS non_current_liability_in_one_year,
        sum(d * 0.5) OVER a AS shortterm_loan, CASE WHEN code % 2 <> 0 THEN sum(d * 0.1) OVER a END AS longterm_account_payable, sum(x * 0.2) OVER a AS specific_account_payable, CASE WHEN code % 3 = 0 THEN sum(n * 20) OVER a END AS oth_eqt_tools_p_shr,
        sum(n) OVER a AS cash_and_equivalents_at_end, sum(n * 3) OVER a AS paidin_capital
        FROM q WINDOW y AS (PARTITION BY code, year(q) ORDER BY q), a AS (PARTITION BY code ORDER BY q)),
    f1 AS (SELECT *, statDate + CAST(20 + (7 * code + 11 * k) % 90 AS INT) AS pubDate FROM f0 WHERE (code * 31 + k) % 97 <> 0),
    filings AS (SELECT * FROM f1 UNION ALL SELECT * REPLACE (pubDate + 5 AS pubDate, operating_revenue * 1.01 AS operating_revenue) FROM f1 WHERE (code + k) % 13 = 0),
    fin0 AS (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY code, statDate ORDER BY pubDate DESC) = 1),
    fin AS (SELECT *, coalesce(compr_inc_attr_p, 0) - coalesce(oth_compr_income, 0) AS np_parent_company_owners, make_date(CAST(year(statDate) + (month(statDate) = 12)::INT AS INT), CASE month(statDate) WHEN 6 THEN 9 WHEN 9 THEN 11 ELSE 5 END, 1) AS due FROM fin0)"""


def _trailing() -> str:
    """CTE `tt`: fin with `<c>_ttm`."""
    yearly = ("operating_revenue", "total_operating_revenue", "total_operating_cost", "np_parent_company_owners", "operating_cost")
    values = [f"CASE WHEN quarter(statDate) = 1 THEN {c} ELSE {c} - lag({c}) OVER o END AS _{c}" for c in yearly] + ["cash_equivalent_increase AS _cash_equivalent_increase"]
    sums = [f"CASE WHEN count(_{c}) OVER o4 = 4 THEN sum(_{c}) OVER o4 END AS {c}_ttm" for c in (*yearly, "cash_equivalent_increase")]
    return f"""t0 AS (SELECT *, {', '.join(values)} FROM fin WINDOW o AS (PARTITION BY code ORDER BY statDate)),
    h0 AS (SELECT code, statDate, CASE WHEN month(statDate) = 6 THEN net_profit ELSE net_profit - lag(net_profit) OVER o END AS hp FROM fin WHERE month(statDate) IN (6, 12) WINDOW o AS (PARTITION BY code ORDER BY statDate)),
    h1 AS (SELECT code, statDate, CASE WHEN count(hp) OVER o = 2 THEN sum(hp) OVER o END AS net_profit_ttm FROM h0 WINDOW o AS (PARTITION BY code ORDER BY statDate ROWS 1 PRECEDING)),
    tt AS (SELECT t0.*, net_profit_ttm, {', '.join(sums)} FROM t0 LEFT JOIN h1 ON h1.code = t0.code AND h1.statDate = t0.statDate WINDOW o4 AS (PARTITION BY t0.code ORDER BY t0.statDate ROWS 3 PRECEDING))"""


TTM = _trailing()


def asof(source: str, date: str, columns: list[str], order: str, name: str = "al") -> str:
    """CTE `name`: (code, time, columns) of `source` carried forward over the trading days."""
    last = ", ".join(f"arg_max({c}, {order}) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in columns)
    fill = ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY g.code ORDER BY g.t ROWS UNBOUNDED PRECEDING) AS {c}" for c in columns)
    return f"""{name}0 AS (SELECT code, cal.time, cal.t, {last} FROM (SELECT * FROM {source} WHERE {date} <= (SELECT max(time) FROM cal)) s ASOF JOIN cal ON s.{date} <= cal.time GROUP BY ALL),
    {name} AS (SELECT g.code, g.time, g.t, {fill} FROM (SELECT code, cal.t, cal.time FROM (SELECT code, min(t) AS f FROM {name}0 GROUP BY code) JOIN cal ON cal.t >= f) g LEFT JOIN {name}0 z ON z.code = g.code AND z.t = g.t)"""


#: Added before rounding, as in the queries: exact halves, which engines round either way, all go up.
NUDGE = "3e-10"


class Sql(str):
    """A query, and the same without rounding, to be read by another."""

    exact: str


def _sql(parts: list[str], keys: str, values: list[str], source: str) -> Sql:
    names = [k.strip() for k in keys.split(",") if k.strip()]
    head = "WITH " + ",\n    ".join(parts) + "\n" if parts else ""
    out = Sql(head + f"SELECT {', '.join([*names, *[f'round(({v.rsplit(" AS ", 1)[0]}) + {NUDGE}, 6) + 0 AS {v.rsplit(" AS ", 1)[-1]}' for v in values]])} {source}")
    out.exact = head + f"SELECT {', '.join([*names, *values])} {source}"
    return out


def over(n: int, by: str = "code") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY t RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def norm(window: int, half_life: float) -> float:
    return sum(0.5 ** ((a + 1) / half_life) for a in range(window))


def beta(source: str, window: int, half_life: float, least: float) -> str:
    """CTE `fit`: regression of ret on m in `source` (code, time, t, ret, m)."""
    w = f"pow(2.0, t / {half_life}.0)"
    o = "w"
    return f"""b0 AS (SELECT *, CASE WHEN ret IS NOT NULL AND m IS NOT NULL THEN {w} END AS g, CASE WHEN m IS NOT NULL THEN ret END AS yy, CASE WHEN ret IS NOT NULL THEN m END AS xx FROM {source}),
    b1 AS (SELECT *, count(g) OVER {o} AS n, sum(g) OVER {o} AS sw, sum(g * m) OVER {o} AS sx, sum(g * ret) OVER {o} AS sy, sum(g * m * m) OVER {o} AS sxx, sum(g * m * ret) OVER {o} AS sxy,
        avg(yy) OVER {o} AS my, avg(xx) OVER {o} AS mx, avg(yy * yy) OVER {o} AS myy, avg(xx * xx) OVER {o} AS mxx, avg(xx * yy) OVER {o} AS mxy FROM b0
        WINDOW {o} AS (PARTITION BY code ORDER BY t RANGE BETWEEN {window - 1} PRECEDING AND CURRENT ROW)),
    b2 AS (SELECT *, CASE WHEN n >= {least} AND t >= {window} AND mxx - mx * mx > 0 THEN (sw * sxy - sx * sy) / nullif(sw * sxx - sx * sx, 0) END AS beta FROM b1),
    fit AS (SELECT *, (sy - beta * sx) / sw AS alpha, CASE WHEN beta IS NOT NULL THEN sqrt(greatest(myy - my * my + beta * beta * (mxx - mx * mx) - 2 * beta * (mxy - mx * my), 0)) END AS sigma FROM b2)"""


def strength(window: int, half_life: float, denominator: int) -> str:
    """CTE `rs`: weighted sums of log returns."""
    o = over(window)
    return f"""rs AS (SELECT code, time, t, CASE WHEN ({window} - count(ret) {o}) / {denominator}.0 <= 0.1 AND t >= {window}
        THEN coalesce(sum(ln(1 + ret) * pow(2.0, t / {half_life}.0)) {o}, 0) / pow(2.0, (t + 1) / {half_life}.0) / {norm(window, half_life)!r} END AS rs FROM d)"""


def zscore(source: str, columns: list[str], eps: str = "1e-6", by: str = "time") -> list[str]:
    return [f"({c} - avg({c}) OVER (PARTITION BY {by})) / nullif(stddev_samp({c}) OVER (PARTITION BY {by}) + {eps}, 0) AS {c}" for c in columns]


def mad(source: str, column: str, k: float, by: str = "time", name: str = "md") -> str:
    """CTE `name`: source with `column` clipped to k median deviations."""
    return f"""{name}0 AS (SELECT *, median({column}) OVER (PARTITION BY {by}) AS _mid FROM {source}), {name}1 AS (SELECT *, median(abs({column} - _mid)) OVER (PARTITION BY {by}) AS _gap FROM {name}0),
    {name} AS (SELECT * EXCLUDE (_mid, _gap) REPLACE (CASE WHEN {column} IS NOT NULL THEN greatest(least({column}, _mid + {k} * _gap), _mid - {k} * _gap) END AS {column}) FROM {name}1)"""


def forecast(value: str, ahead: int = 0, shift: int = 0) -> str:
    """CTE `fc`: (code, time, t, mean, std) of the forecasts for the year `ahead` years on."""
    rep = f"rep AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS time, year(l_shipdate) + {shift} AS year, l_extendedprice * (1 - l_discount) AS np, l_discount AS rd, l_tax AS roe FROM lineitem)"
    return f"""{rep},
    ends AS (SELECT year(time) AS own, max(t) AS e FROM cal GROUP BY 1), starts AS (SELECT own, time AS first FROM ends JOIN cal ON cal.t = greatest(e - 1094, 1)),
    rows0 AS (SELECT code, rep.time, own, {value} AS v FROM rep JOIN starts ON own = year - {ahead} WHERE time >= first AND year(time) <= own),
    days AS (SELECT code, own, time, count(*) AS n, count(v) AS k, sum(CAST(round(v * 1e8) AS HUGEINT)) AS s, sum(CAST(round(v * v * 1e8) AS HUGEINT)) AS ss FROM rows0 GROUP BY ALL),
    so AS (SELECT code, own, time, sum(n) OVER o AS n, sum(k) OVER o AS k, CAST(sum(s) OVER o AS DOUBLE) AS s, CAST(sum(ss) OVER o AS DOUBLE) / 1e8 AS ss FROM days WINDOW o AS (PARTITION BY code, own ORDER BY time ROWS UNBOUNDED PRECEDING)),
    known AS (SELECT code * 10000 + own AS code, time AS day, s / (k * 1e8) AS mean, sqrt(greatest(ss / k - (s / (k * 1e8)) * (s / (k * 1e8)), 0)) AS std FROM so WHERE n >= 5),
    {asof("known", "day", ["mean", "std"], "day", "fa")},
    fc AS (SELECT code // 10000 AS code, time, t, mean, std FROM fa WHERE year(time) = code % 10000)"""


DATES = """SELECT time FROM (SELECT make_date(CAST(y AS INT), m, 1) AS time FROM (SELECT unnest(range(year(min(time)) - 1, year(max(time)) + 1)) AS y FROM cal), (VALUES (5), (9)) v(m))
    WHERE time < (SELECT max(time) FROM cal) AND time >= (SELECT max(make_date(CAST(y AS INT), m, 1)) FROM (SELECT unnest(range(year(min(time)) - 1, year(min(time)) + 1)) AS y, min(time) AS f FROM cal), (VALUES (5), (9)) v(m) WHERE make_date(CAST(y AS INT), m, 1) <= f)"""


def slopes(source: str, columns: list[str], periods: int, more_than: int, name: str) -> str:
    """CTE `name`: minus the trend over the mean at each rebalancing date."""
    dates = f"({DATES})"
    num = ", ".join(f"count({c}) OVER (PARTITION BY code, r.time ORDER BY s.statDate ROWS UNBOUNDED PRECEDING) AS _{c}" for c in columns)
    agg = ", ".join(f"CASE WHEN count({c}) > {more_than} THEN -regr_slope({c}, CASE WHEN {c} IS NOT NULL THEN _{c} END) / nullif(avg({c}), 0) END AS {c}" for c in columns)
    return f"""{name}r AS (SELECT time, statDate FROM (SELECT DISTINCT statDate FROM {source}) JOIN {dates} ON statDate < time QUALIFY row_number() OVER (PARTITION BY time ORDER BY statDate DESC) <= {periods}),
    {name}n AS (SELECT s.code, r.time, {", ".join(columns)}, {num} FROM {source} s JOIN {name}r r ON r.statDate = s.statDate), {name} AS (SELECT code, time, {agg} FROM {name}n GROUP BY code, time)"""


PW, PM = panel("week"), panel("month")
D0, D1 = "DATE '1997-03-05'", "DATE '2001-06-15'"
Q: dict[str, str] = {}

# calendar
Q["calendar_ordinals"] = f"WITH {PW} SELECT time, t FROM cal"
Q["window_resolve"] = f"""WITH {PW}, e AS (SELECT max(t) FILTER (time <= {D1}) AS e, min(t) FILTER (time >= {D0}) AS s, max(t) FILTER (time <= DATE '1995-02-01') AS f FROM cal)
    SELECT (SELECT time FROM cal WHERE t = e - 29) AS start, {D1} AS "end" FROM e UNION ALL SELECT {D0}, (SELECT time FROM cal WHERE t = s + 9) FROM e UNION ALL SELECT (SELECT time FROM cal WHERE t = f - 29), DATE '1995-02-01' FROM e"""
Q["trading_days"] = f"WITH {PW} SELECT time, t FROM cal WHERE time BETWEEN {D0} AND {D1}"
Q["trade_day_shift"] = f"WITH {PW} SELECT a.time, a.t, coalesce(b.time, a.time + 5) AS shifted FROM cal a LEFT JOIN cal b ON b.t = a.t + 5"
Q["period_ends"] = f"WITH {FINANCE} SELECT statDate FROM fin UNION SELECT last_day(CAST(x AS DATE) + INTERVAL 2 MONTH) FROM range(DATE '1994-04-01', DATE '2002-01-02', INTERVAL 3 MONTH) r(x)"
Q["disclosure_deadline"] = f"WITH {FINANCE} SELECT DISTINCT statDate, due AS deadline FROM fin"
Q["on_time_filings"] = f"WITH {FINANCE} SELECT code, statDate, due AS pubDate FROM fin WHERE pubDate < due"
Q["rebalance_dates"] = f"WITH {PW} {DATES}"

# selection, completeness, alignment
Q["select_panel"] = _sql([PW], "code, time", ["close"], f"FROM p JOIN ind USING (code) WHERE L1 <> 'ASIA' AND time BETWEEN {D0} AND {D1}")
Q["dedupe_last"] = _sql([FINANCE], "code, statDate, pubDate", ["operating_revenue"], "FROM fin")
Q["completeness_filter"] = f"WITH {FINANCE} SELECT code FROM fin WHERE statDate BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY code HAVING count(*) = 12"
Q["asof_align"] = _sql([PW, FINANCE, asof("fin", "pubDate", ["total_assets", "net_profit"], "statDate")], "code, time", ["total_assets", "net_profit"], "FROM al")
Q["backfill_calendar"] = f"""WITH {PW}, b AS (SELECT code, t, CASE WHEN turnover_ratio > 100 THEN 'high' ELSE 'low' END AS band FROM p), g AS (SELECT code, time, t FROM (SELECT DISTINCT code FROM b), cal)
    SELECT code, time, coalesce(first_value(band IGNORE NULLS) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'other') AS band FROM g LEFT JOIN b USING (code, t)"""
Q["statement_join"] = _sql([FINANCE], "code, statDate", ["net_profit", "total_assets", "fix_intan_other_asset_acqui_cash", "np_parent_company_owners"], "FROM fin")
Q["select_statements"] = _sql([FINANCE], "code, statDate, pubDate", ["total_assets"], f"FROM fin WHERE statDate IN (SELECT DISTINCT statDate FROM fin WHERE statDate <= {D1} ORDER BY 1 DESC LIMIT 9)")
Q["select_reports"] = f"SELECT l_suppkey AS code, year(l_shipdate)::INT AS year, count(*) AS n, round(max(l_extendedprice * (1 - l_discount)), 6) + 0 AS np FROM lineitem WHERE year(l_shipdate) IN (1998, 1999) AND l_shipdate BETWEEN {D0} AND {D1} GROUP BY ALL"
Q["code_prefix"] = _sql([PW], "code, time", ["close"], "FROM p WHERE left(code::VARCHAR, 1) IN ('1', '3', '6')")
Q["listed_before"] = "SELECT l_suppkey AS code FROM lineitem GROUP BY 1 HAVING min(l_shipdate) <= DATE '1995-01-20'"
INDP = "ip AS (SELECT p.code, p.time, n_name AS industry, r_name AS L1 FROM p JOIN supplier ON s_suppkey = p.code JOIN nation ON n_nationkey = (s_nationkey + year(p.time)) % 25 JOIN region ON n_regionkey = r_regionkey)"
MONTH = "mn AS (SELECT time, min(time) OVER (PARTITION BY date_trunc('month', time)) AS mon FROM cal)"
Q["industry_month_start"] = _sql([PW, INDP, MONTH], "p.code, p.time, industry, L1", ["close"], "FROM p JOIN mn ON mn.time = p.time JOIN ip ON ip.code = p.code AND ip.time = mon")
Q["industry_map"] = f"WITH {PW} SELECT code, industry, CASE WHEN industry LIKE 'A%' THEN 'other' ELSE L1 END AS L1 FROM ind"
Q["fill_limited"] = _sql([PW, "z AS (SELECT code, time, t, last_value(close IGNORE NULLS) OVER o AS c, last_value(CASE WHEN close IS NOT NULL THEN t END IGNORE NULLS) OVER o AS seen FROM d WINDOW o AS (PARTITION BY code ORDER BY t ROWS UNBOUNDED PRECEDING))"], "code, time", ["CASE WHEN t - seen <= 2 THEN c END AS close"], "FROM z")

# cross-section
WINS = "{c} AS (SELECT {keys}, {clips} FROM {src} JOIN (SELECT time, {qs} FROM {src} GROUP BY time) USING (time))"


def winsorized(source: str, columns: list[str], name: str, keys: str = "code, time") -> str:
    qs = ", ".join(f"quantile_cont({c}, [0.05, 0.95]) AS q_{c}" for c in columns)
    clips = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, q_{c}[2]), q_{c}[1]) END AS {c}" for c in columns)
    return WINS.format(c=name, keys=keys, clips=clips, qs=qs, src=source)


def filled(source: str, columns: list[str], name: str) -> str:
    return f"{name} AS (SELECT * REPLACE ({', '.join(f'coalesce({c}, median({c}) OVER (PARTITION BY time)) AS {c}' for c in columns)}) FROM {source})"


Q["winsorize_quantile"] = _sql([PW, winsorized("p", ["ret", "market_cap"], "w")], "code, time", ["ret", "market_cap"], "FROM w")
Q["median_fill"] = _sql([PW, "s AS (SELECT code, time, ret FROM p)", filled("s", ["ret"], "f")], "code, time", ["ret"], "FROM f")
Q["zscore"] = _sql([PW], "code, time", zscore("p", ["close", "turnover_ratio"]), "FROM p")


def cleaned(source: str, columns: list[str], clip: tuple[float, float]) -> list[str]:
    """CTEs up to `cl`: source (code, time, columns) on the rows of p, filled, winsorized, median-filled, standardized."""
    last = ", ".join(f"last_value(s.{c} IGNORE NULLS) OVER (PARTITION BY p.code ORDER BY p.t ROWS UNBOUNDED PRECEDING) AS {c}" for c in columns)
    qs = ", ".join(f"quantile_cont({c}, [{clip[0]}, {clip[1]}]) AS q_{c}" for c in columns)
    clips = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, q_{c}[2]), q_{c}[1]) END AS {c}" for c in columns)
    return [f"c0 AS (SELECT p.code, p.time, {last} FROM p LEFT JOIN {source} s ON s.code = p.code AND s.time = p.time)", WINS.format(c="c1", keys="code, time", clips=clips, qs=qs, src="c0"), filled("c1", columns, "c2"), f"cl AS (SELECT code, time, {', '.join(zscore('c2', columns))} FROM c2)"]


Q["clean_panel"] = _sql([PW, *cleaned("p", ["ret", "dv_ratio"], (0.05, 0.95))], "code, time", ["ret", "dv_ratio"], "FROM cl")
Q["mad_winsorize"] = _sql([PW, mad("p", "turnover_ratio", 2.0)], "code, time", ["turnover_ratio"], "FROM md")
Q["mad_standardize"] = _sql([PW, "s AS (SELECT code, time, ret, turnover_ratio FROM p)", filled("s", ["ret", "turnover_ratio"], "f"), mad("f", "ret", 2.0), mad("md", "turnover_ratio", 2.0, name="me")], "code, time", zscore("me", ["ret", "turnover_ratio"], "0"), "FROM me")
SIZE = f"""s0 AS (SELECT code, time, ln(cap + 1) AS l, sqrt(cap) AS w FROM p), s1 AS (SELECT time, sum(w * l) / sum(w) AS mx, sum(w * l * l * l) / sum(w) AS my FROM s0 GROUP BY time),
    s2 AS (SELECT time, mx, my, CASE WHEN min(l) < max(l) THEN sum(w * (l - mx) * (l * l * l - my)) / sum(w * (l - mx) * (l - mx)) END AS b FROM s0 JOIN s1 USING (time) GROUP BY ALL), s3 AS (SELECT code, time, l, l * l * l - my - b * (l - mx) AS residual FROM s0 JOIN s2 USING (time)), {mad("s3", "residual", 5.0)}"""
Q["size_lncap"] = _sql([PW], "code, time", ["ln(cap + 1) AS LNCAP"], "FROM p")
Q["size_midcap"] = _sql([PW, SIZE], "code, time", ["(residual - avg(residual) OVER (PARTITION BY time)) / nullif(stddev_pop(residual) OVER (PARTITION BY time), 0) AS MIDCAP"], "FROM md")
Q["group_relative"] = _sql([PW], "code, time", ["sum(CASE WHEN ret IS NOT NULL THEN sqrt(cap) * ret END) OVER (PARTITION BY time, L1) / sum(CASE WHEN ret IS NOT NULL THEN sqrt(cap) END) OVER (PARTITION BY time, L1) - ret AS relative"], "FROM p JOIN ind USING (code)")
Q["industry_dummies"] = f"WITH {PW} SELECT code, (L1 = 'AFRICA')::DOUBLE AS africa, (L1 = 'AMERICA')::DOUBLE AS america, (L1 = 'ASIA')::DOUBLE AS asia, (L1 = 'EUROPE')::DOUBLE AS europe, 1.0::DOUBLE AS country FROM ind"
Q["cap_shares"] = _sql([PW, "s AS (SELECT time, L1, sum(market_cap) AS c FROM p JOIN ind USING (code) GROUP BY ALL)"], "time, L1", ["c / sum(c) OVER (PARTITION BY time) AS share"], "FROM s")


def mean_of(*columns: str) -> str:
    return "(" + " + ".join(f"coalesce({c}, 0)" for c in columns) + ") / nullif(" + " + ".join(f"({c} IS NOT NULL)::INT" for c in columns) + ", 0)"


Q["style_composite"] = _sql([PM, f"s AS (SELECT code, time, {mean_of('close', 'market_cap')} AS worth, {mean_of('turnover_ratio', 'dv_ratio', 'ret')} AS trade FROM p)"], "code, time", zscore("s", ["worth", "trade"]), "FROM s")

# rolling descriptors
RM = "rm AS (SELECT p.*, m FROM p JOIN mkt USING (time))"
for _name, _col, _out in (("rolling_beta", "beta", "BETA"), ("hist_sigma", "sigma", "Hist_sigma")):
    Q[_name] = _sql([PW, RM, beta("rm", 52, 13, 13)], "code, time", [f"{_col} AS {_out}"], "FROM fit WHERE ret IS NOT NULL AND beta IS NOT NULL")
_L = repr(0.5 ** (1 / 10))
Q["daily_std"] = _sql([PW, f"e0 AS (SELECT *, var_samp(ret) OVER (PARTITION BY code) AS seed, sum((ret IS NULL)::INT) OVER (PARTITION BY code ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM d), e1 AS (SELECT *, count(ret) OVER o AS n FROM e0 WINDOW o AS (PARTITION BY code, run ORDER BY t ROWS UNBOUNDED PRECEDING)), e2 AS (SELECT *, sum(ret * ret * pow({_L}, -n)) OVER (PARTITION BY code, run ORDER BY t ROWS UNBOUNDED PRECEDING) AS tail FROM e1)"], "code, time", [f"sqrt(pow({_L}, n) * (seed + (1 - {_L}) * tail)) AS Daily_std"], "FROM e2 WHERE ret IS NOT NULL AND seed IS NOT NULL")
_pts = ", ".join(f"{x} AS p{k}" for k, x in enumerate(["lag(pc, 51) OVER o", *[f"lag(c, {4 * k}) OVER o" for k in range(12, 0, -1)], "c"]))
_pad = [f"coalesce({', '.join(f'p{j}' for j in range(k, -1, -1))}, NULL)" for k in range(14)]
_rest = ", ".join(f"CASE WHEN {a} IS NOT NULL THEN {b} END" for a, b in zip(_pad, _pad[1:], strict=False))
Q["cumulative_range"] = _sql([PW, """h0 AS (SELECT code, time, t, close, pre_close, last_value(close IGNORE NULLS) OVER o AS lc, last_value(CASE WHEN close IS NOT NULL THEN t END IGNORE NULLS) OVER o AS ct, last_value(pre_close IGNORE NULLS) OVER o AS lp, last_value(CASE WHEN pre_close IS NOT NULL THEN t END IGNORE NULLS) OVER o AS pt FROM d WINDOW o AS (PARTITION BY code ORDER BY t ROWS UNBOUNDED PRECEDING)),
    h1 AS (SELECT code, time, t, CASE WHEN t - ct <= 2 THEN lc END AS c, CASE WHEN t - pt <= 2 THEN lp END AS pc FROM h0)""", f"h2 AS (SELECT code, time, t, {_pts} FROM h1 WINDOW o AS (PARTITION BY code ORDER BY t)), h3 AS (SELECT code, time, t, [{_rest}] AS z FROM h2)"], "code, time", ["ln(list_max(z)) - ln(list_min(z)) AS Cumulative_range"], "FROM h3 WHERE t >= 52 AND list_max(z) IS NOT NULL")
_m = [f"lag(m, {3 * k}) OVER o" if k else "m" for k in range(12)]
TURN = f"u0 AS (SELECT code, time, t, CASE WHEN count(whole) {over(3)} = 3 THEN sum(whole) {over(3)} END AS m FROM d), u1 AS (SELECT code, time, t, ln(m / 100) AS Monthly_share_turnover, CASE WHEN t >= 36 THEN ln({mean_of(*_m[:3])} / 100) END AS Quarterly_share_turnover, CASE WHEN t >= 36 THEN ln({mean_of(*_m)} / 100) END AS Annual_share_turnover FROM u0 WINDOW o AS (PARTITION BY code ORDER BY t))"
for _name in ("Monthly", "Quarterly", "Annual"):
    Q[f"turnover_{_name.lower()}"] = _sql([PW, TURN], "code, time", [f"{_name}_share_turnover"], f"FROM u1 WHERE {_name}_share_turnover IS NOT NULL")
Q["traded_value_ratio"] = _sql([PW, f"v AS (SELECT code, time, t, sum(x * pow(2.0, t / 13.0)) {over(52)} / pow(2.0, (t + 1) / 13.0) * 52 / {norm(52, 13)!r} * 52 / nullif(count(x) {over(52)}, 0) AS a FROM d)"], "code, time", ["a AS Annualized_traded_value_ratio"], "FROM v WHERE t >= 52 AND a IS NOT NULL")
_w = [0.5 ** ((a + 1) / 3) / norm(6, 3) for a in range(6)]
Q["short_term_reversal"] = _sql([PM, f"s0 AS (SELECT code, time, t, CASE WHEN count(ret) {over(6)} = 6 THEN ln(1 + avg(ret) {over(6)}) END AS g FROM d), s1 AS (SELECT code, time, {' + '.join(f'lag(g, {i}) OVER o * {w!r}' for i, w in enumerate(_w))} AS v FROM s0 WINDOW o AS (PARTITION BY code ORDER BY t))"], "code, time", ["v AS Short_Term_reversal"], "FROM s1 WHERE v IS NOT NULL")
Q["seasonality"] = _sql([PW, f"""k0 AS (SELECT code, t, close, last_value(close IGNORE NULLS) {over(5)} AS l FROM d), k1 AS (SELECT code, t, lead(l, 4) OVER (PARTITION BY code ORDER BY t) / close - 1 AS r FROM k0),
    bk AS (SELECT time, time - 365 * i::INT AS day FROM cal, range(1, 4) v(i) WHERE time - 365 * i::INT >= (SELECT min(time) FROM cal)), bs AS (SELECT bk.time, cal.t AS f FROM bk ASOF JOIN cal ON bk.day <= cal.time),
    se AS (SELECT code, time, avg(r) AS v FROM bs JOIN k1 ON k1.t = f GROUP BY ALL)"""], "code, time", ["v AS Seasonality"], "FROM se WHERE v IS NOT NULL")
Q["industry_momentum"] = _sql([PW, strength(26, 13, 52), "j AS (SELECT rs.code, rs.time, rs, L1, sqrt(cap) AS w FROM rs JOIN p ON p.code = rs.code AND p.time = rs.time JOIN ind ON ind.code = rs.code WHERE rs IS NOT NULL)"], "code, time", ["sum(w * rs) OVER (PARTITION BY time, L1) / sum(w) OVER (PARTITION BY time, L1) - rs AS Industry_Momentum"], "FROM j")
Q["industry_momentum_varying"] = _sql([PW, INDP, strength(26, 13, 52), "mn AS (SELECT time, min(time) OVER (PARTITION BY date_trunc('month', time)) AS mon FROM (SELECT DISTINCT rs.time FROM rs JOIN p ON p.code = rs.code AND p.time = rs.time WHERE rs IS NOT NULL))", "j AS (SELECT rs.code, rs.time, rs, L1, sqrt(cap) AS w FROM rs JOIN p ON p.code = rs.code AND p.time = rs.time JOIN mn ON mn.time = rs.time JOIN ip ON ip.code = rs.code AND ip.time = mon WHERE rs IS NOT NULL)"], "code, time", ["sum(w * rs) OVER (PARTITION BY time, L1) / sum(w) OVER (PARTITION BY time, L1) - rs AS Industry_Momentum"], "FROM j")
for _name, _out, _win, _h, _sign in (("relative_strength", "Relative_strength", 12, 6, ""), ("longterm_strength", "Longterm_Relative_strength", 36, 12, "-")):
    Q[_name] = _sql([PM, strength(_win, _h, _win), f"m AS (SELECT code, time, CASE WHEN count(rs) {over(3)} = 3 THEN avg(rs) {over(3)} END AS v FROM rs)"], "code, time", [f"{_sign}v AS {_out}"], "FROM m WHERE v IS NOT NULL")
for _name, _out, _win, _h, _sign in (("hist_alpha", "Hist_alpha", 12, 6, ""), ("longterm_alpha", "Longterm_Alpha", 36, 12, "-")):
    Q[_name] = _sql([PM, "dm AS (SELECT d.*, m FROM d JOIN mkt USING (time))", beta("dm", _win, _h, _h), f"m2 AS (SELECT code, time, CASE WHEN count(alpha) {over(3)} = 3 THEN avg(alpha) {over(3)} END AS v FROM fit)"], "code, time", [f"{_sign}v AS {_out}"], "FROM m2 WHERE v IS NOT NULL")
Q["panel_rolling_apply"] = _sql([PM, "g2 AS (SELECT code, time, t FROM (SELECT DISTINCT code FROM p), cal), g3 AS (SELECT g2.code, g2.time, g2.t, turnover_ratio AS v FROM g2 LEFT JOIN p USING (code, t)), g4 AS (SELECT *, CASE WHEN count(v) OVER o = 4 THEN 4 * stddev_pop(v) OVER o / avg(v) OVER o END AS r FROM g3 WINDOW o AS (PARTITION BY code ORDER BY t ROWS 3 PRECEDING)), g5 AS (SELECT code, time, last_value(r IGNORE NULLS) OVER (PARTITION BY code ORDER BY t ROWS UNBOUNDED PRECEDING) AS r FROM g4)"], "code, time", ["r AS turnover_ratio"], "FROM g5 WHERE r IS NOT NULL")

# statements and forecasts
ON = lambda where="true", source="fin": f"ot AS (SELECT * EXCLUDE (pubDate) RENAME (due AS pubDate) FROM {source} WHERE pubDate < due AND {where})"
Q["ttm"] = _sql([FINANCE, TTM], "code, statDate", ["operating_revenue_ttm", "net_profit_ttm", "total_operating_cost_ttm", "np_parent_company_owners_ttm", "cash_equivalent_increase_ttm"], "FROM tt")
Q["pcf_ratio"] = _sql([PW, FINANCE, TTM], "code, time", ["close * paidin_capital / nullif(cash_equivalent_increase_ttm, 0) AS pcf"], "FROM tt JOIN p USING (code) WHERE time > statDate AND time <= statDate + 7")
Q["leverage"] = _sql([PW, FINANCE, ON("month(statDate) IN (6, 12)"), "o2 AS (SELECT *, coalesce(total_non_current_liability, 0) AS LD, coalesce(oth_eqt_tools_p_shr, 0) AS PE FROM ot)", asof("o2", "pubDate", ["LD", "PE", "total_assets", "total_liability"], "statDate"), "j AS (SELECT al.code, al.time, LD, PE, total_assets, total_liability, market_cap, pb_ratio FROM al JOIN p ON p.code = al.code AND p.time = al.time)"], "code, time", ["(market_cap + (PE + LD)) / market_cap AS Market_Leverage", "(market_cap / pb_ratio + (PE + LD)) / market_cap AS Book_Leverage", "total_liability / nullif(total_assets, 0) AS Debt_to_asset_ratio"], "FROM j")
_V = {"vs": "operating_revenue_ttm", "ve": "net_profit_ttm", "vc": "cash_equivalent_increase_ttm"}
_names = {"vs": "Variation_in_Sales", "ve": "Variation_in_Earning", "vc": "Variation_in_Cashflow"}
_var = ", ".join(f"CASE WHEN count({c}) OVER o = 6 THEN 4 * stddev_pop({c}) OVER o / nullif(avg({c}) OVER o, 0) END AS {n}" for n, c in _V.items())
_fillp = ", ".join(f"coalesce({n}, median({n}) OVER (PARTITION BY pubDate)) AS {n}" for n in _V)
Q["earnings_variability"] = _sql([PW, FINANCE, TTM, ON("month(statDate) IN (6, 12)", "tt"), f"v0 AS (SELECT code, statDate, pubDate, {_var} FROM ot WINDOW o AS (PARTITION BY code ORDER BY statDate ROWS 5 PRECEDING)), v1 AS (SELECT * FROM v0 WHERE vs IS NOT NULL OR ve IS NOT NULL OR vc IS NOT NULL), v2 AS (SELECT * REPLACE ({_fillp}) FROM v1)", mad("v2", "vs", 5.0, "pubDate", "ma"), mad("ma", "ve", 5.0, "pubDate", "mb"), mad("mb", "vc", 5.0, "pubDate", "mc"), f"v3 AS (SELECT code, statDate, pubDate, {', '.join(zscore('mc', list(_V), '0', 'pubDate'))} FROM mc)", asof("v3", "pubDate", list(_V), "statDate")], "code, time", [f"{n} AS {o}" for n, o in _names.items()], "FROM al")
_half = ", ".join(f"CASE WHEN c2 = 2 AND r2 = 2 THEN {c} - lag({c}) OVER y ELSE {c} END AS {n}" for n, c in (("D1", "fixed_assets_depreciation"), ("D2", "intangible_assets_amortization"), ("D3", "defferred_expense_amortization"), ("CFO", "net_operate_cash_flow"), ("CFI", "net_invest_cash_flow"), ("NI", "net_profit")))
Q["accruals"] = _sql([PW, FINANCE, ON("quarter(statDate) IN (2, 4)"), f"""a0 AS (SELECT *, count(*) OVER (PARTITION BY code, year(statDate)) AS c2, row_number() OVER (PARTITION BY code, year(statDate) ORDER BY statDate) AS r2 FROM ot), a1 AS (SELECT *, {_half} FROM a0 WINDOW y AS (PARTITION BY code, year(statDate) ORDER BY statDate)),
    a2 AS (SELECT *, coalesce(D1, 0) + coalesce(D2, 0) + coalesce(D3, 0) AS DA, (total_assets - cash_and_equivalents_at_end) - (total_liability - (coalesce(non_current_liability_in_one_year, 0) + total_non_current_liability + shortterm_loan)) AS noa FROM a1),
    a3 AS (SELECT code, statDate, pubDate, -((noa - lag(noa) OVER (PARTITION BY code ORDER BY statDate)) - DA) / nullif(total_assets, 0) AS ab, -(NI - (CFO + CFI) + DA) / nullif(total_assets, 0) AS acf FROM a2)""", asof("a3", "pubDate", ["ab", "acf"], "statDate")], "code, time", ["ab AS ABS", "acf AS ACF"], "FROM al")
Q["profitability"] = _sql([PW, FINANCE, TTM, ON(source="tt"), "b0 AS (SELECT code, pubDate, avg(total_operating_revenue_ttm / nullif(total_assets, 0)) AS ATO, avg((total_operating_revenue_ttm - total_operating_cost_ttm) / nullif(total_assets, 0)) AS GP, avg((total_operating_revenue_ttm - total_operating_cost_ttm) / nullif(total_operating_revenue_ttm, 0)) AS GPM, avg(np_parent_company_owners_ttm / nullif(total_assets, 0)) AS ROA FROM ot GROUP BY ALL)", asof("b0", "pubDate", ["ATO", "GP", "GPM", "ROA"], "pubDate")], "code, time", ["ATO", "GP", "GPM", "ROA"], "FROM al")
Q["investment_quality"] = _sql([PW, FINANCE, ON(), slopes("ot", ["total_assets", "paidin_capital"], 21, 6, "sa"), "dec AS (SELECT *, fix_intan_other_asset_acqui_cash AS capex FROM ot WHERE month(statDate) = 12)", slopes("dec", ["capex"], 5, 2, "sb"), "both_of AS (SELECT code, time AS pubDate, coalesce(total_assets, 0) AS ta, coalesce(paidin_capital, 0) AS pc, coalesce(capex, 0) AS ce FROM sa FULL JOIN sb USING (code, time))", asof("both_of", "pubDate", ["ta", "pc", "ce"], "pubDate")], "code, time", ["ta AS Total_Assets_Growth_Rate", "pc AS Issuance_growth", "ce AS Capital_expenditure_growth"], "FROM al")
Q["growth_slopes"] = _sql([PW, FINANCE, TTM, ON(source="tt"), slopes("ot", ["np_parent_company_owners_ttm", "operating_revenue_ttm"], 21, 8, "sa"), "s2 AS (SELECT code, time AS pubDate, np_parent_company_owners_ttm AS eg, operating_revenue_ttm AS og FROM sa)", asof("s2", "pubDate", ["eg", "og"], "pubDate")], "code, time", ["eg AS Earning_Growth_Rate", "og AS OP_Growth_Rate"], "FROM al")
Q["enterprise_multiple"] = _sql([PW, FINANCE, TTM, ON(source="tt"), "o2 AS (SELECT *, operating_revenue_ttm - operating_cost_ttm AS eb FROM ot)", asof("o2", "pubDate", ["eb"], "statDate")], "p.code, p.time", ["eb / nullif(market_cap, 0) AS Enterprise_multiple"], "FROM al JOIN p ON p.code = al.code AND p.time = al.time")
Q["value_ratios"] = _sql([PW], "code, time", ["1 / pb_ratio AS Book_to_price", "1 / pe_ratio AS Earning_to_price", "1 / nullif(pcf_ratio, 0) AS Cash_earning_to_price"], "FROM p")
Q["dividend"] = _sql([PW], "code, time", ["dv_ratio AS Dividend_to_Price"], "FROM p")
Q["forecast_dividend"] = _sql([PW, forecast("rd")], "code, time", ["mean AS Forecast_Dividend_to_Price"], "FROM fc")
for _stat in ("mean", "std"):
    Q[f"forecast_ep_{_stat}"] = _sql([PW, forecast("np")], "p.code, p.time", [f"{_stat} / nullif(market_cap, 0) AS forecast_EP_{_stat}"], "FROM fc JOIN p ON p.code = fc.code AND p.time = fc.time")
Q["forecast_roe"] = _sql([PW, forecast("roe", 2, 2)], "code, time", ["mean AS roe_mean"], "FROM fc")


def changes(source: str, name: str) -> str:
    """CTE `name`: decayed 13-step changes of v in source (code, t, v)."""
    return f"""{name}a AS (SELECT g.code, g.time, g.t, last_value(v IGNORE NULLS) OVER (PARTITION BY g.code ORDER BY g.t ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT code, cal.t, cal.time FROM (SELECT code, min(t) AS f FROM {source} GROUP BY code) JOIN cal ON cal.t >= f) g LEFT JOIN {source} s ON s.code = g.code AND s.t = g.t),
    {name}b AS (SELECT *, k / nullif(lag(k, 13) OVER (PARTITION BY code ORDER BY t), 0) - 1 AS c FROM {name}a),
    {name} AS (SELECT code, time, t, coalesce(c, 0) + coalesce(lag(c, 13) OVER o, 0) / 2 + coalesce(lag(c, 26) OVER o, 0) / 3 + coalesce(lag(c, 39) OVER o, 0) / 4 AS v FROM {name}b WINDOW o AS (PARTITION BY code ORDER BY t)
        QUALIFY t >= (SELECT min(t) FROM {name}b WHERE c IS NOT NULL))"""


Q["sentiment_change"] = _sql([PW, forecast("np"), "ep AS (SELECT fc.code, fc.t, mean / nullif(market_cap, 0) AS v FROM fc JOIN p ON p.code = fc.code AND p.t = fc.t)", "es AS (SELECT code, t, mean AS v FROM fc)", changes("ep", "ca"), changes("es", "cb"), "j AS (SELECT code, time, ca.v AS a, cb.v AS b FROM ca FULL JOIN cb USING (code, time))"], "code, time", ["a AS Pred_EP_chg", "b AS Pred_EPS_chg"], "FROM j")

# evaluation
FWD = "fw AS (SELECT code, time, t, lead(close, {n}) OVER o / lead(open, 1) OVER o - 1 AS forward FROM p WINDOW o AS (PARTITION BY code ORDER BY t))"
Q["forward_return"] = _sql([PW, FWD.format(n=4)], "code, time", ["forward"], "FROM fw WHERE forward IS NOT NULL")
Q["forward_return_window"] = _sql([PW, f"pp AS (SELECT * FROM p WHERE time >= {D0} AND t <= (SELECT max(t) + 4 FROM cal WHERE time <= {D1}))", FWD.format(n=4).replace("FROM p ", "FROM pp ")], "code, time", ["forward"], "FROM fw WHERE forward IS NOT NULL")
LAB = "lb AS (SELECT *, lead(close, 3) OVER (PARTITION BY code ORDER BY t) AS close_future, lead(close, 3) OVER (PARTITION BY code ORDER BY t) / close - 1 AS return_ratio FROM p)"
Q["labels"] = _sql([PW, LAB], "code, time", ["close_future", "return_ratio"], ", (return_ratio > 0)::INT AS class_label FROM lb WHERE return_ratio IS NOT NULL")
LONG = FWD.format(n=2) + ", lo AS (UNPIVOT (SELECT p.time, p.turnover_ratio, p.dv_ratio, p.ret, forward FROM p JOIN fw ON fw.code = p.code AND fw.time = p.time WHERE forward IS NOT NULL) ON turnover_ratio, dv_ratio, ret INTO NAME factor VALUE value)"
CORR = "covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
RANKS = "rk AS (SELECT time, factor, rank() OVER (PARTITION BY time, factor ORDER BY value) + (count(*) OVER (PARTITION BY time, factor, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY time, factor ORDER BY forward) + (count(*) OVER (PARTITION BY time, factor, forward) - 1) / 2.0 AS b FROM {src})"
Q["ic_pearson"] = _sql([PW, LONG], "time, factor", [CORR.format(a="value", b="forward") + " AS ic"], "FROM lo GROUP BY time, factor")
Q["ic_spearman"] = _sql([PW, LONG, RANKS.format(src="lo")], "time, factor", [CORR.format(a="a", b="b") + " AS ic"], "FROM rk GROUP BY time, factor")
Q["ic_kendall"] = _sql([PW, LONG, "nr AS (SELECT *, row_number() OVER () AS i FROM lo)", "kd AS (SELECT time, factor, sum(sign(x.value - y.value) * sign(x.forward - y.forward)) AS s, sum((x.value <> y.value)::INT) AS a, sum((x.forward <> y.forward)::INT) AS b FROM nr x JOIN nr y USING (time, factor) WHERE x.i < y.i GROUP BY ALL)", "al AS (SELECT DISTINCT time, factor FROM lo)"], "time, factor", ["s / nullif(sqrt(a::DOUBLE * b::DOUBLE), 0) AS ic"], "FROM al LEFT JOIN kd USING (time, factor)")
Q["icir"] = _sql([PW, RM, beta("rm", 52, 13, 13), "bs AS (SELECT code, time, beta AS BETA, sigma AS Hist_sigma FROM fit WHERE ret IS NOT NULL AND beta IS NOT NULL)", *cleaned("bs", ["BETA", "Hist_sigma"], (0.01, 0.99)), FWD.format(n=2), "lo AS (UNPIVOT (SELECT cl.time, BETA, Hist_sigma, forward FROM cl JOIN fw ON fw.code = cl.code AND fw.time = cl.time WHERE forward IS NOT NULL) ON BETA, Hist_sigma INTO NAME factor VALUE value)", RANKS.format(src="lo"), f"ic AS (SELECT time, factor, {CORR.format(a='a', b='b')} AS ic FROM rk GROUP BY ALL)"], "factor", ["avg(ic) AS mean", "stddev_samp(ic) AS std", "min(ic) AS min", "max(ic) AS max", "avg(ic) / nullif(stddev_samp(ic), 0) AS icir"], ", count(ic) AS n FROM ic GROUP BY factor")
_f = ("turnover_ratio", "dv_ratio", "ret")
_wt = ", ".join(f"max(w) FILTER (factor = '{c}') AS w_{c}" for c in _f)
Q["ic_weighted_composite"] = _sql([PM, LONG, f"ic AS (SELECT time, factor, {CORR.format(a='value', b='forward')} AS ic FROM lo GROUP BY ALL)", "i2 AS (SELECT time, factor, CASE WHEN count(ic) OVER o >= 6 THEN sum(CASE WHEN ic IS NOT NULL THEN pow(2.0, t / 12.0) * ic END) OVER o / nullif(sum(CASE WHEN ic IS NOT NULL THEN pow(2.0, t / 12.0) END) OVER o, 0) END AS w FROM ic JOIN cal USING (time) WINDOW o AS (PARTITION BY factor ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))", f"wt AS (SELECT time, {_wt} FROM i2 GROUP BY time)"], "code, time", ["(" + " + ".join(f"coalesce(w_{c} * {c}, 0)" for c in _f) + ") / nullif(" + " + ".join(f"coalesce(CASE WHEN {c} IS NOT NULL THEN abs(w_{c}) END, 0)" for c in _f) + ", 0) AS composite"], "FROM p JOIN wt USING (time)")
Q["cumulative_returns"] = _sql([PW, "s AS (SELECT code AS factor, time, t, ret FROM p WHERE ret IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code ORDER BY t DESC) <= 30), s2 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY factor ORDER BY t) = 1 THEN 0 ELSE ret END AS r FROM s)"], "factor, time, t", ["ret", "product(1 + r) OVER o - 1 AS cum_return", "sum(ret) OVER o AS cum_sum"], "FROM s2 WINDOW o AS (PARTITION BY factor ORDER BY t ROWS UNBOUNDED PRECEDING)")

# training
_wf = lambda train, step, emb, base: f"SELECT ((a.t - 1) // {step} + {base})::INT AS window_id, a.time AS start, b.time AS \"end\", c.time AS test FROM cal a JOIN cal b ON b.t = a.t + {train} JOIN cal c ON c.t = a.t + {train} + {emb} WHERE (a.t - 1) % {step} = 0"
Q["walk_forward_windows"] = f"WITH {PW} {_wf(40, 5, 1, 0)} UNION ALL {_wf(100, 50, 5, 1000)}"
WIN = f"""sp AS ({_wf(40, 20, 5, 0)}), wr AS (SELECT lb.*, window_id, time - DATE '1970-01-01' AS day FROM lb JOIN sp ON lb.time BETWEEN sp.start AND sp."end" WHERE return_ratio IS NOT NULL), ws AS (SELECT *, (return_ratio > 0)::INT AS y, day < quantile_cont(day, 0.8) OVER (PARTITION BY window_id) AS is_train FROM wr)"""
Q["time_split"] = f"WITH {PM}, {LAB}, {WIN} SELECT window_id, is_train, count(*) AS n, min(time) AS first, max(time) AS last FROM ws GROUP BY ALL"
_dm = ["turnover_ratio", "dv_ratio", "L1_AFRICA", "L1_AMERICA", "country"]
Q["training_table"] = _sql([PM, LAB, "ds AS (SELECT p.code, p.time, turnover_ratio, dv_ratio, coalesce((L1 = 'AFRICA')::DOUBLE, 0) AS L1_AFRICA, coalesce((L1 = 'AMERICA')::DOUBLE, 0) AS L1_AMERICA, 1.0::DOUBLE AS country FROM p LEFT JOIN ind USING (code))", f"dz AS (SELECT code, time, {', '.join(zscore('ds', _dm))} FROM ds)", "jl AS (SELECT dz.*, lb.close, lb.close_future, lb.return_ratio, CASE WHEN lb.return_ratio IS NOT NULL THEN (lb.return_ratio > 0)::INT END AS class_label FROM dz LEFT JOIN (SELECT * FROM lb WHERE return_ratio IS NOT NULL) lb ON lb.code = dz.code AND lb.time = dz.time)"], "code, time, class_label", [*_dm, "close", "close_future", "return_ratio"], "FROM jl")
Q["training_table_varying"] = _sql([PM, INDP, LAB, "ds AS (SELECT p.code, p.time, turnover_ratio, dv_ratio, coalesce((L1 = 'AFRICA')::DOUBLE, 0) AS L1_AFRICA, coalesce((L1 = 'AMERICA')::DOUBLE, 0) AS L1_AMERICA, 1.0::DOUBLE AS country FROM p LEFT JOIN ip ON ip.code = p.code AND ip.time = p.time)", f"dz AS (SELECT code, time, {', '.join(zscore('ds', _dm))} FROM ds)", "jl AS (SELECT dz.*, lb.close, lb.close_future, lb.return_ratio, CASE WHEN lb.return_ratio IS NOT NULL THEN (lb.return_ratio > 0)::INT END AS class_label FROM dz LEFT JOIN (SELECT * FROM lb WHERE return_ratio IS NOT NULL) lb ON lb.code = dz.code AND lb.time = dz.time)"], "code, time, class_label", [*_dm, "close", "close_future", "return_ratio"], "FROM jl")
Q["regression_metrics"] = _sql([PM, LAB, WIN, "g AS (SELECT window_id, return_ratio AS y0, return_ratio - dv_ratio / 100 AS e FROM ws WHERE dv_ratio IS NOT NULL)"], "window_id", ["sqrt(avg(e * e)) AS rmse", "1 - avg(e * e) / nullif(var_pop(y0), 0) AS r2"], ", count(*) AS n FROM g GROUP BY window_id")


def class_sql(parts: list[str], source: str, label: str, score: str, by: str) -> str:
    return _sql([*parts, f"cr AS (SELECT {by}, {label} AS y, {score} AS s, rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS r FROM {source} WHERE {label} IS NOT NULL AND {score} IS NOT NULL)", f"ca AS (SELECT {by}, count(*) AS n, count(*) FILTER ((y = 1) = (s >= 0.5)) AS ok, count(*) FILTER (y = 1 AND s >= 0.5) AS tp, count(*) FILTER (s >= 0.5) AS said, count(*) FILTER (y = 1) AS pos, sum(r) FILTER (y = 1) AS rs FROM cr GROUP BY {by})"], f"{by}, n", ["ok / n AS accuracy", "2.0 * tp / nullif(said + pos, 0) AS f1", "(rs - pos * (pos + 1) / 2.0) / nullif(pos * (n - pos), 0) AS auc"], "FROM ca")


Q["class_metrics"] = class_sql([PM, LAB, WIN], "ws", "y", "(dv_ratio / 10)", "window_id")
Q["label_metrics"] = class_sql(["dl AS (SELECT lang, quality, n_chars / 1000.0::DOUBLE AS sc FROM documents JOIN labels USING (doc_id))"], "dl", "quality", "sc", "lang")
Q["portfolio_rank"] = _sql([PW], "code, time", ["turnover_ratio AS score"], ", row_number() OVER (PARTITION BY time ORDER BY turnover_ratio DESC, code) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY time ORDER BY turnover_ratio DESC, code) <= 10")
Q["event_panel"] = _sql(["ev AS (SELECT user_id AS code, CAST(ts AS DATE) AS time, 1 + avg(value) AS close FROM events GROUP BY ALL)"], "code, time", zscore("ev", ["close"]), "FROM ev")
Q["descriptor_panel"] = _sql([PM, SIZE, "z1 AS (SELECT code, time, l AS LNCAP, (residual - avg(residual) OVER (PARTITION BY time)) / nullif(stddev_pop(residual) OVER (PARTITION BY time), 0) AS MIDCAP FROM md)", RM, beta("rm", 12, 6, 6), "z2 AS (SELECT code, time, beta AS BETA, sigma AS Hist_sigma FROM fit WHERE ret IS NOT NULL AND beta IS NOT NULL)", f"e0 AS (SELECT *, var_samp(ret) OVER (PARTITION BY code) AS seed, sum((ret IS NULL)::INT) OVER (PARTITION BY code ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM d), e1 AS (SELECT *, count(ret) OVER o AS n FROM e0 WINDOW o AS (PARTITION BY code, run ORDER BY t ROWS UNBOUNDED PRECEDING)), e2 AS (SELECT *, sum(ret * ret * pow({0.5 ** (1 / 6)!r}, -n)) OVER (PARTITION BY code, run ORDER BY t ROWS UNBOUNDED PRECEDING) AS tail FROM e1), z3 AS (SELECT code, time, sqrt(pow({0.5 ** (1 / 6)!r}, n) * (seed + (1 - {0.5 ** (1 / 6)!r}) * tail)) AS Daily_std FROM e2 WHERE ret IS NOT NULL AND seed IS NOT NULL)", "z4 AS (SELECT code, time, 1 / pb_ratio AS Book_to_price, 1 / pe_ratio AS Earning_to_price, dv_ratio AS Dividend_to_Price FROM p)", "zz AS (SELECT * FROM z4 LEFT JOIN z1 USING (code, time) LEFT JOIN z2 USING (code, time) LEFT JOIN z3 USING (code, time))"], "code, time", ["LNCAP", "MIDCAP", "BETA", "Hist_sigma", "Daily_std", "Book_to_price", "Earning_to_price", "Dividend_to_Price"], "FROM zz")

# workload A whole: the descriptors' own queries, not rounded, on the weekly price rows
def weekly_momentum(source: str, window: int, half_life: int, mean: int, sign: str, name: str) -> Sql:
    """Mean of the last strengths (`rs`) or intercepts (`alpha`)."""
    if source == "rs":
        parts = [PW, strength(window, half_life, window).replace("<= 0.1", "<= 0.3")]
    else:
        parts = [PW, "dm AS (SELECT d.*, m FROM d JOIN mkt USING (time))", beta("dm", window, half_life, half_life)]
    table = "rs" if source == "rs" else "fit"
    parts.append(f"m9 AS (SELECT code, time, CASE WHEN count({source}) {over(mean)} = {mean} THEN avg({source}) {over(mean)} END AS v FROM {table})")
    return _sql(parts, "code, time", [f"{sign}v AS {name}"], "FROM m9 WHERE v IS NOT NULL")


REVERSAL = _sql([PW, f"s0 AS (SELECT code, time, t, CASE WHEN count(ret) {over(6)} = 6 THEN ln(1 + avg(ret) {over(6)}) END AS g FROM d), s1 AS (SELECT code, time, {' + '.join(f'lag(g, {i}) OVER o * {w!r}' for i, w in enumerate(_w))} AS v FROM s0 WINDOW o AS (PARTITION BY code ORDER BY t))"], "code, time", ["v AS Short_Term_reversal"], "FROM s1 WHERE v IS NOT NULL")
PARTS: list[tuple[str, list[str]]] = [
    (Q["size_lncap"].exact, ["LNCAP"]), (Q["size_midcap"].exact, ["MIDCAP"]),
    (Q["rolling_beta"].exact, ["BETA"]), (Q["hist_sigma"].exact, ["Hist_sigma"]), (Q["daily_std"].exact, ["Daily_std"]), (Q["cumulative_range"].exact, ["Cumulative_range"]),
    (Q["turnover_monthly"].exact, ["Monthly_share_turnover"]), (Q["turnover_quarterly"].exact, ["Quarterly_share_turnover"]), (Q["turnover_annual"].exact, ["Annual_share_turnover"]), (Q["traded_value_ratio"].exact, ["Annualized_traded_value_ratio"]),
    (REVERSAL.exact, ["Short_Term_reversal"]), (Q["seasonality"].exact, ["Seasonality"]), (Q["industry_momentum_varying"].exact, ["Industry_Momentum"]),
    (weekly_momentum("rs", 26, 13, 3, "", "Relative_strength").exact, ["Relative_strength"]), (weekly_momentum("alpha", 26, 13, 3, "", "Hist_alpha").exact, ["Hist_alpha"]),
    (Q["leverage"].exact, ["Market_Leverage", "Book_Leverage", "Debt_to_asset_ratio"]), (Q["earnings_variability"].exact, ["Variation_in_Sales", "Variation_in_Earning", "Variation_in_Cashflow"]),
    (Q["forecast_ep_std"].exact, ["forecast_EP_std"]), (Q["accruals"].exact, ["ABS", "ACF"]), (Q["profitability"].exact, ["ATO", "GP", "GPM", "ROA"]),
    (Q["investment_quality"].exact, ["Total_Assets_Growth_Rate", "Issuance_growth", "Capital_expenditure_growth"]), (Q["value_ratios"].exact, ["Book_to_price", "Earning_to_price", "Cash_earning_to_price"]),
    (Q["forecast_ep_mean"].exact, ["forecast_EP_mean"]), (Q["enterprise_multiple"].exact, ["Enterprise_multiple"]),
    (weekly_momentum("rs", 104, 52, 3, "-", "Longterm_Relative_strength").exact, ["Longterm_Relative_strength"]), (weekly_momentum("alpha", 104, 52, 3, "-", "Longterm_Alpha").exact, ["Longterm_Alpha"]),
    (Q["growth_slopes"].exact, ["Earning_Growth_Rate", "OP_Growth_Rate"]), (Q["forecast_roe"].exact, ["roe_mean"]), (Q["sentiment_change"].exact, ["Pred_EP_chg", "Pred_EPS_chg"]),
    (Q["dividend"].exact, ["Dividend_to_Price"]), (Q["forecast_dividend"].exact, ["Forecast_Dividend_to_Price"]),
]
ALL = [c for _, columns in PARTS for c in columns]
GROUPS = {
    "Size": ALL[:2], "Volatility": ALL[2:6], "Liquidity": ALL[6:10], "Momentum": ALL[10:15], "Quality": ALL[15:31], "Growth": ["Earning_Growth_Rate", "OP_Growth_Rate", "roe_mean"], "Sentiment": ["Pred_EP_chg", "Pred_EPS_chg"],
    "Value": ["Book_to_price", "Earning_to_price", "Cash_earning_to_price", "forecast_EP_mean", "Enterprise_multiple", "Longterm_Relative_strength", "Longterm_Alpha"], "Dividend": ["Dividend_to_Price", "Forecast_Dividend_to_Price"],
}
RAW = [PW, *[f"x{k} AS MATERIALIZED ({text})" for k, (text, _) in enumerate(PARTS)], f"raw AS (SELECT p.code, p.time, {', '.join(ALL)} FROM p {' '.join(f'LEFT JOIN x{k} ON x{k}.code = p.code AND x{k}.time = p.time' for k in range(len(PARTS)))})"]
Q["all_descriptors"] = _sql(RAW, "code, time", ALL, "FROM raw")
CLEAN = [*RAW, *cleaned("raw", ALL, (0.01, 0.99))]
Q["all_styles"] = _sql([*CLEAN, f"sy AS (SELECT code, time, {', '.join(f'{mean_of(*c)} AS {n}' for n, c in GROUPS.items())} FROM cl)"], "code, time", zscore("sy", list(GROUPS)), "FROM sy")
ALL_IC = [*CLEAN, FWD.format(n=5), f"lo AS (UNPIVOT (SELECT cl.time, {', '.join(ALL)}, forward FROM cl JOIN fw ON fw.code = cl.code AND fw.time = cl.time WHERE forward IS NOT NULL) ON {', '.join(ALL)} INTO NAME factor VALUE value)", RANKS.format(src="lo"), f"ic AS (SELECT time, factor, {CORR.format(a='a', b='b')} AS ic FROM rk GROUP BY ALL)"]
Q["all_factor_ic"] = _sql(ALL_IC, "time, factor", ["ic"], "FROM ic")
Q["all_icir"] = _sql(ALL_IC, "factor", ["avg(ic) AS mean", "stddev_samp(ic) AS std", "min(ic) AS min", "max(ic) AS max", "avg(ic) / nullif(stddev_samp(ic), 0) AS icir"], ", count(ic) AS n FROM ic GROUP BY factor")


def index_of(unit: str) -> str:
    """CTE `ix`: returns of the index."""
    return f"""ix0 AS (SELECT CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS time, {SUMS} FROM lineitem GROUP BY 1), ix1 AS (SELECT time, round(e / n, 4) AS close FROM ix0),
    ix AS (SELECT time, close / lag(close) OVER (ORDER BY time) - 1 AS m FROM ix1)"""


Q["beta_on_index"] = _sql([PW, index_of("week"), "ri AS (SELECT p.*, m FROM p JOIN ix USING (time))", beta("ri", 52, 13, 13)], "code, time", ["beta AS BETA", "sigma AS Hist_sigma"], "FROM fit WHERE ret IS NOT NULL AND beta IS NOT NULL")
Q["alpha_on_index"] = _sql([PM, index_of("month"), "di AS (SELECT d.*, m FROM d JOIN ix USING (time))", beta("di", 12, 6, 6), f"m9 AS (SELECT code, time, CASE WHEN count(alpha) {over(3)} = 3 THEN avg(alpha) {over(3)} END AS v FROM fit)"], "code, time", ["v AS Hist_alpha"], "FROM m9 WHERE v IS NOT NULL")


def returns_sql(parts: list[str], source: str, styles: list[str], industries: str) -> Sql:
    """Pure factor returns of `styles` in `source` (code, time): per date the normal equations of the regression with the
    last industry's factor put in terms of the others, solved by elimination, a column a step."""
    n = len(styles)
    return _sql(
        [
            *parts,
            f"own AS (SELECT p.code, p.time, p.t, p.cap, j.L1 FROM p JOIN {industries})",
            "caps AS (SELECT time, list(L1 ORDER BY L1) AS names, list(c ORDER BY L1) AS caps FROM (SELECT time, L1, coalesce(sum(cap), 0) AS c FROM own GROUP BY ALL) GROUP BY time)",
            f"ex AS (SELECT own.*, [{', '.join(f's.{c}' for c in styles)}] AS f, coalesce(nx.ret, 0) AS r0, coalesce(ln(1 + nx.ret), 0) AS r1 FROM own JOIN {source} s ON s.code = own.code AND s.time = own.time LEFT JOIN p nx ON nx.code = own.code AND nx.t = own.t + 1 WHERE {' AND '.join(f's.{c} IS NOT NULL' for c in styles)})",
            "zr AS (SELECT ex.time, sqrt(coalesce(cap, 0)) AS v, r0, r1, list_concat([1.0::DOUBLE], list_transform(range(1, len(names)), lambda i: CASE WHEN names[i] = L1 THEN 1.0 WHEN names[len(names)] = L1 AND caps[len(names)] <> 0 THEN -caps[i] / caps[len(names)] ELSE 0.0 END), f) AS z FROM ex JOIN caps USING (time))",
            "gr AS (SELECT time, i, j, sum(v * z[i] * CASE WHEN j <= len(z) THEN z[j] WHEN j = len(z) + 1 THEN r0 ELSE r1 END) AS g FROM (SELECT *, unnest(range(1, len(z) + 3)) AS j FROM (SELECT *, unnest(range(1, len(z) + 1)) AS i FROM zr)) GROUP BY ALL)",
            "mx AS (SELECT time, list(g ORDER BY i) AS m FROM (SELECT time, i, list(g ORDER BY j) AS g FROM gr GROUP BY ALL) GROUP BY time)",
            "el AS (SELECT time, 1 AS k, m FROM mx UNION ALL SELECT time, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / m[k][k]) ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END) FROM el WHERE k <= len(m))",
            f"so AS (SELECT el.time, names, caps, list_transform(m, lambda r: r[len(m) + 1]) AS a, list_transform(m, lambda r: r[len(m) + 2]) AS b FROM el JOIN caps USING (time) WHERE k = len(m) + 1)",
            "la AS (SELECT *, len(names) AS q, CASE WHEN caps[len(names)] <> 0 THEN coalesce(list_sum(list_transform(range(1, len(names)), lambda i: -caps[i] / caps[len(names)] * a[i + 1])), 0) ELSE 0 END AS xa, CASE WHEN caps[len(names)] <> 0 THEN coalesce(list_sum(list_transform(range(1, len(names)), lambda i: -caps[i] / caps[len(names)] * b[i + 1])), 0) ELSE 0 END AS xb FROM so)",
            f"fr AS (SELECT time, unnest(list_concat(['country'], names, [{', '.join(repr(c) for c in styles)}])) AS factor, unnest(list_concat(a[1:q], [xa], a[q + 1:q + {n}])) AS simple, unnest(list_concat(b[1:q], [xb], b[q + 1:q + {n}])) AS log FROM la)",
        ],
        "time, factor",
        ["simple", "log"],
        "FROM fr",
    )


_two = ["turnover_ratio", "dv_ratio"]
_recursive = lambda text: Sql(text.replace("WITH ", "WITH RECURSIVE ", 1))
Q["pure_factor_returns"] = _recursive(returns_sql([PM, f"sz AS (SELECT code, time, {', '.join(zscore('p', _two))} FROM p)"], "sz", _two, "ind j ON j.code = p.code"))
Q["style_returns"] = _recursive(returns_sql([*CLEAN, f"sy AS (SELECT code, time, {', '.join(f'{mean_of(*c)} AS {n}' for n, c in GROUPS.items())} FROM cl)", f"sz AS MATERIALIZED (SELECT code, time, {', '.join(zscore('sy', list(GROUPS)))} FROM sy)", INDP], "sz", list(GROUPS), "ip j ON j.code = p.code AND j.time = p.time"))

ORACLE_SQL = Q
