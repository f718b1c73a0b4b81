"""Canonical table schemas and the vendor's column names."""

from pyspark.sql import types as T


def _table(**columns: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DateType(), "f": T.DoubleType(), "i": T.IntegerType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in columns.items()])


PRICE = _table(code="s", time="d", open="f", close="f", pre_close="f")
VALUATION = _table(code="s", time="d", close="f", turnover_ratio="f", pe_ratio="f", pb_ratio="f", pcf_ratio="f", dv_ratio="f", paidin_capital="f", market_cap="f", circulating_market_cap="f")
INDUSTRY = _table(code="s", time="d", industry="s", L1="s")
REPORT = _table(code="s", time="d", quarter="s", np="f", eps="f", rd="f", roe="f")
CALENDAR = _table(time="d", t="i")
LISTING = _table(code="s", list_date="d")
_FILED = {"code": "s", "pubDate": "d", "statDate": "d"}
INCOME = _table(**_FILED, total_operating_revenue="f", operating_revenue="f", total_operating_cost="f", operating_cost="f", oth_compr_income="f", compr_inc_attr_p="f")
BALANCE = _table(**_FILED, paidin_capital="f", shortterm_loan="f", total_assets="f", non_current_liability_in_one_year="f", longterm_account_payable="f", specific_account_payable="f", total_non_current_liability="f", total_liability="f", oth_eqt_tools_p_shr="f")
CASHFLOW = _table(**_FILED, net_profit="f", net_operate_cash_flow="f", net_invest_cash_flow="f", fix_intan_other_asset_acqui_cash="f", cash_equivalent_increase="f", cash_and_equivalents_at_end="f", fixed_assets_depreciation="f", intangible_assets_amortization="f", defferred_expense_amortization="f")

# Vendor column name -> canonical name.
RENAMES = {
    "ts_code": "code",
    "trade_date": "time",
    "report_date": "time",
    "ann_date": "pubDate",
    "end_date": "statDate",
    "turnover_rate": "turnover_ratio",
    "pe": "pe_ratio",
    "pb": "pb_ratio",
    "total_share": "paidin_capital",
    "total_mv": "market_cap",
    "circ_mv": "circulating_market_cap",
    "total_revenue": "total_operating_revenue",
    "revenue": "operating_revenue",
    "total_cogs": "total_operating_cost",
    "oper_cost": "operating_cost",
    "st_borr": "shortterm_loan",
    "non_cur_liab_due_1y": "non_current_liability_in_one_year",
    "lt_payable": "longterm_account_payable",
    "specific_payables": "specific_account_payable",
    "total_ncl": "total_non_current_liability",
    "total_liab": "total_liability",
    "n_cashflow_act": "net_operate_cash_flow",
    "n_cashflow_inv_act": "net_invest_cash_flow",
    "c_pay_acq_const_fiolta": "fix_intan_other_asset_acqui_cash",
    "n_incr_cash_cash_equ": "cash_equivalent_increase",
    "c_cash_equ_end_period": "cash_and_equivalents_at_end",
    "depr_fa_coga_dpba": "fixed_assets_depreciation",
    "amort_intang_assets": "intangible_assets_amortization",
    "lt_amort_deferred_exp": "defferred_expense_amortization",
}
