"""Fundamental flags, ratios, scores and fair values from quarterly statements.

statements: a row per series and quarter (`period`), with sector, revenue, gross_profit,
net_income, cash_flow (operating), free_cash_flow, assets, equity, debt, current_assets,
current_liabilities, shares, dividends. Sums over the last four quarters are "trailing".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.series import keys, of_series, ratio

YEAR = 4
# Weights of the score, bounds and rates of the valuation.
WEIGHTS = {"valuation": 0.30, "profitability": 0.25, "health": 0.20, "growth": 0.15, "quality": 0.10}
MOST_GROWTH, TERMINAL_GROWTH, RISK_FREE, PREMIUM, DCF_YEARS, DIVIDEND_YEARS = 0.15, 0.03, 0.065, 0.085, 5, 5
FLAGS = ("f_income", "f_cash_flow", "f_return", "f_accruals", "f_leverage", "f_liquidity", "f_shares", "f_margin", "f_turnover")


def _quarters() -> Window:
    return of_series().orderBy("period")


def trailing(statements: DataFrame) -> DataFrame:
    """statements with ttm_{revenue, gross_profit, net_income, cash_flow, free_cash_flow, dividends} of four quarters, null before there are four."""
    frame = _quarters().rowsBetween(1 - YEAR, 0)
    sums = ("revenue", "gross_profit", "net_income", "cash_flow", "free_cash_flow", "dividends")
    return statements.withColumns({f"ttm_{c}": F.when(F.count(c).over(frame) == YEAR, F.sum(c).over(frame)) for c in sums})


def piotroski(rows: DataFrame) -> DataFrame:
    """trailing() rows with the nine flags (0 or 1; 0 where a number is missing) and their sum f_score.

    Against the same quarter a year before: income and cash flow above 0, return on assets up,
    cash flow above income, debt to assets down, current ratio up, no new shares, gross margin up,
    asset turnover up.
    """
    w = _quarters()
    made = {"_roa": ratio(F.col("ttm_net_income"), F.col("assets")), "_leverage": ratio(F.col("debt"), F.col("assets")), "_current": ratio(F.col("current_assets"), F.col("current_liabilities")), "_margin": ratio(F.col("ttm_gross_profit"), F.col("ttm_revenue")), "_turnover": ratio(F.col("ttm_revenue"), F.col("assets"))}
    rows = rows.withColumns(made)
    before = lambda c: F.lag(c, YEAR).over(w)
    flags = {
        "f_income": F.col("ttm_net_income") > 0, "f_cash_flow": F.col("ttm_cash_flow") > 0, "f_return": F.col("_roa") > before("_roa"), "f_accruals": F.col("ttm_cash_flow") > F.col("ttm_net_income"),
        "f_leverage": F.col("_leverage") < before("_leverage"), "f_liquidity": F.col("_current") > before("_current"), "f_shares": F.col("shares") <= before("shares"),
        "f_margin": F.col("_margin") > before("_margin"), "f_turnover": F.col("_turnover") > before("_turnover"),
    }
    rows = rows.withColumns({n: F.coalesce(x, F.lit(False)).cast("int") for n, x in flags.items()})
    return rows.withColumn("f_score", sum((F.col(f) for f in FLAGS[1:]), F.col(FLAGS[0]))).drop(*made)


def ratios(rows: DataFrame) -> DataFrame:
    """trailing() rows that have a `price`, with eps, bvps, per, pbv, roe, net_margin, der, current_ratio, dividend_yield, payout, growth (of trailing revenue over a year) and steady (of the last 12 quarters those with income); null where a divisor is 0, per and pbv also where it is negative."""
    w = _quarters()
    positive = lambda x: F.when(x > 0, x)
    rows = rows.withColumns({"eps": ratio(F.col("ttm_net_income"), F.col("shares")), "bvps": ratio(F.col("equity"), F.col("shares")), "_paid": ratio(F.col("ttm_dividends"), F.col("shares"))})
    return rows.withColumns({
        "per": ratio(F.col("price"), positive(F.col("eps"))), "pbv": ratio(F.col("price"), positive(F.col("bvps"))), "roe": ratio(F.col("ttm_net_income"), F.col("equity")), "net_margin": ratio(F.col("ttm_net_income"), F.col("ttm_revenue")),
        "der": ratio(F.col("debt"), F.col("equity")), "current_ratio": ratio(F.col("current_assets"), F.col("current_liabilities")), "dividend_yield": ratio(F.col("_paid"), F.col("price")), "payout": ratio(F.col("ttm_dividends"), F.col("ttm_net_income")),
        "growth": ratio(F.col("ttm_revenue"), F.lag("ttm_revenue", YEAR).over(w)) - 1, "steady": F.sum((F.col("net_income") > 0).cast("int")).over(w.rowsBetween(-11, 0)),
    }).drop("_paid")


def _percentile(x: str, ascending: bool = True) -> Column:
    """100 times the rank within sector and period, of those that have the ratio; null for the others, 50 for one alone."""
    known = F.col(x).isNotNull()
    peers = Window.partitionBy("sector", "period", known)
    rank = F.percent_rank().over(peers.orderBy(F.col(x) if ascending else F.col(x).desc()))
    return F.when(known, F.when(F.count("*").over(peers) == 1, 50.0).otherwise(100.0 * rank))


def fundamental_score(rows: DataFrame) -> DataFrame:
    """ratios() and piotroski() rows with five parts (0 to 100) and fundamental_score, their weighted mean; a part without any ratio counts as 0.

    Ratios are judged within sector and quarter: valuation by low per and pbv, profitability by
    roe and net_margin, health by low der and current_ratio, growth by growth; quality is the mean
    of f_score in ninths and of steady in twelfths.
    """
    judged = {"valuation": (("per", False), ("pbv", False)), "profitability": (("roe", True), ("net_margin", True)), "health": (("der", False), ("current_ratio", True)), "growth": (("growth", True),)}
    names = {(c, up): f"_p_{c}" for pairs in judged.values() for c, up in pairs}
    rows = rows.withColumns({n: _percentile(c, up) for (c, up), n in names.items()})
    total = F.lit(0.0)
    for part, pairs in judged.items():
        own = [F.col(names[p]) for p in pairs]
        there = sum((x.isNotNull().cast("int") for x in own[1:]), own[0].isNotNull().cast("int"))
        summed = sum((F.coalesce(x, F.lit(0.0)) for x in own[1:]), F.coalesce(own[0], F.lit(0.0)))
        rows = rows.withColumn(f"{part}_score", F.coalesce(ratio(summed, there), F.lit(0.0)))
    rows = rows.withColumn("quality_score", 50.0 * F.col("f_score") / 9 + 50.0 * F.coalesce(F.col("steady"), F.lit(0)) / 12)
    for part, weight in WEIGHTS.items():
        total = total + weight * F.col(f"{part}_score")
    return rows.withColumn("fundamental_score", total).drop(*names.values())


def _quantile(sorted_: Column, share: float) -> Column:
    """Linear interpolation between the elements of a sorted array; null for an empty one."""
    at = (F.size(sorted_) - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    a, b = F.try_element_at(sorted_, low + 1), F.try_element_at(sorted_, F.least(low + 2, F.size(sorted_)))
    return F.when(F.size(sorted_) > 0, a + (b - a) * (at - low))


def fair_value(rows: DataFrame) -> DataFrame:
    """ratios() rows with the value per share by each method, fair_low and fair_high (the quartiles of those present), and margin_of_safety in percent.

    value_per, value_pbv: earnings and book times the sector's median ratio of the quarter.
    value_dcf: free cash flow grown for five years by its yearly growth (0 to 15 %), then at 3 %
    for ever, discounted at the risk-free rate plus premium. value_ddm: dividends likewise for
    ever at 3 %, if each of the last 20 quarters paid some. A method without positive input is absent.
    """
    w, peers = _quarters(), Window.partitionBy("sector", "period")
    rate = RISK_FREE + PREMIUM
    cash = F.col("ttm_free_cash_flow")
    grown = F.greatest(F.lit(0.0), F.least(F.lit(MOST_GROWTH), F.coalesce(ratio(cash, F.lag("ttm_free_cash_flow", YEAR).over(w)) - 1, F.lit(0.0))))
    paying = F.sum((F.col("dividends") > 0).cast("int")).over(w.rowsBetween(1 - YEAR * DIVIDEND_YEARS, 0))
    rows = rows.withColumns({"_per": F.median("per").over(peers), "_pbv": F.median("pbv").over(peers), "_g": grown, "_paying": paying})
    flow = F.lit(0.0)
    for year in range(1, DCF_YEARS + 1):
        flow = flow + F.pow((1 + F.col("_g")) / (1 + rate), F.lit(float(year)))
    ending = F.pow((1 + F.col("_g")) / (1 + rate), F.lit(float(DCF_YEARS))) * (1 + TERMINAL_GROWTH) / (rate - TERMINAL_GROWTH)
    positive = lambda x: F.when(x > 0, x)
    rows = rows.withColumns({
        "value_per": positive(F.col("eps") * F.col("_per")), "value_pbv": positive(F.col("bvps") * F.col("_pbv")), "value_dcf": positive(ratio(cash * (flow + ending), F.col("shares"))),
        "value_ddm": F.when(F.col("_paying") == YEAR * DIVIDEND_YEARS, positive(ratio(F.col("ttm_dividends"), F.col("shares")) * (1 + TERMINAL_GROWTH) / (rate - TERMINAL_GROWTH))),
    })
    values = F.array_sort(F.filter(F.array("value_per", "value_pbv", "value_dcf", "value_ddm"), lambda x: x.isNotNull()))
    rows = rows.withColumn("_values", values).withColumns({"fair_low": _quantile(F.col("_values"), 0.25), "fair_high": _quantile(F.col("_values"), 0.75), "methods": F.size("_values")})
    return rows.withColumn("margin_of_safety", 100 * ratio(F.col("fair_low") - F.col("price"), F.col("fair_low"))).drop("_per", "_pbv", "_g", "_paying", "_values")


def assess(statements: DataFrame) -> DataFrame:
    """Everything of this module, per series and quarter: flags, ratios, score, fair value. `statements` has price, the price at the quarter's end."""
    rows = fair_value(fundamental_score(ratios(piotroski(trailing(statements)))))
    told = ("eps", "bvps", "per", "pbv", "roe", "net_margin", "der", "current_ratio", "dividend_yield", "payout", "growth")
    parts = [f"{p}_score" for p in WEIGHTS]
    return rows.select(*keys(), "sector", "period", *FLAGS, "f_score", *told, *parts, "fundamental_score", "value_per", "value_pbv", "value_dcf", "value_ddm", "methods", "fair_low", "fair_high", "margin_of_safety")
