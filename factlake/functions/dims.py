"""Dimension rows: names, aliases, scopes, thresholds. Data, not code; extend by adding rows."""

from __future__ import annotations

# Accounts as printed (English and Korean spellings) to their canonical names.
SYNONYMS = {
    "Net sales": "revenue",
    "Sales": "revenue",
    "매출액": "revenue",
    "수익(매출액)": "revenue",
    "영업수익": "revenue",
    "Cost of sales": "cost",
    "매출원가": "cost",
    "Operating profit": "operating_profit",
    "영업이익": "operating_profit",
    "영업이익(손실)": "operating_profit",
    "Net profit": "net_profit",
    "당기순이익": "net_profit",
    "당기순이익(손실)": "net_profit",
    "Quantity sold": "quantity",
    "Total assets": "assets",
    "자산총계": "assets",
    "Total liabilities": "liabilities",
    "부채총계": "liabilities",
    "Total equity": "equity",
    "자본총계": "equity",
    "Current assets": "current_assets",
    "유동자산": "current_assets",
    "Current liabilities": "current_liabilities",
    "유동부채": "current_liabilities",
}
#: Which statement an account stands on; balance-sheet accounts are instants without a variant.
STATEMENTS = {
    "revenue": "IS",
    "cost": "IS",
    "operating_profit": "IS",
    "net_profit": "IS",
    "quantity": "IS",
    "assets": "BS",
    "liabilities": "BS",
    "equity": "BS",
    "current_assets": "BS",
    "current_liabilities": "BS",
}
#: Other accounts to try, in order, when one is missing for a scope.
ALIASES = {"revenue": ("sales", "operating_revenue"), "net_profit": ("net_income", "profit_of_period"), "operating_profit": ("operating_income",)}
#: Scopes to try, in order, when none is asked for; and the order of a time series.
SCOPES = ("FY", "3Q", "HY")
SERIES_ORDER = {"1Q": 0, "HY": 1, "2Q": 1, "3Q": 2, "4Q": 3, "FY": 4}
SCOPE_ALIASES = {"FQ": "1Q", "SQ": "2Q", "TQ": "3Q"}

PROFILE = ("revenue", "operating_profit", "net_profit", "assets", "liabilities", "equity", "current_assets", "quantity")
YEARLY = ("revenue", "cost", "operating_profit", "net_profit", "assets", "liabilities", "equity")
COMPARED = ("revenue", "operating_profit", "net_profit", "assets", "equity")

#: Ratio: numerator, denominator, percent?, higher is better?, thresholds for excellent .. warning.
RATIOS = {
    "current": ("current_assets", "current_liabilities", False, True, (2.0, 1.5, 1.0, 0.5)),
    "debt": ("liabilities", "equity", False, False, (1.0, 2.0, 4.0, 8.0)),
    "equity": ("equity", "assets", True, True, (50.0, 35.0, 25.0, 15.0)),
    "operating_margin": ("operating_profit", "revenue", True, True, (20.0, 10.0, 5.0, 1.0)),
    "net_margin": ("net_profit", "revenue", True, True, (15.0, 7.0, 3.0, 0.0)),
    "roa": ("net_profit", "assets", True, True, (10.0, 5.0, 2.0, 0.0)),
    "roe": ("net_profit", "equity", True, True, (15.0, 10.0, 5.0, 0.0)),
}
GRADES = ("excellent", "good", "fair", "warning", "danger")
PROFITABILITY = ("operating_margin", "net_margin", "roa", "roe")
STABILITY = ("current", "debt", "equity")

#: Units as printed, tested in this order, with what one is worth.
UNITS = (("백만", 1_000_000), ("million", 1_000_000), ("천", 1_000), ("thousand", 1_000), ("억", 100_000_000))
