"""Names and codes of markets: aliases to codes, codes to display names, interval codes of vendors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The aliases and codes that catalogs use.
EXCHANGE_CODES = {
    "上交所": "SSE", "上海证券交易所": "SSE", "深交所": "SZSE", "深圳证券交易所": "SZSE", "北交所": "BSE", "北京证券交易所": "BSE",
    "纳斯达克": "NASDAQ", "纽交所": "NYSE", "NYSE": "N", "AMEX": "A", "NYSE American": "A", "NYSE Arca": "P", "NYSE ARCA": "P",
    "BATS": "Z", "IEX": "V", "NYSE MKT": "M",
}
EXCHANGE_NAMES = {
    "SSE": "上交所", "SZSE": "深交所", "BSE": "北交所", "NASDAQ": "NASDAQ", "NYSE": "NYSE", "N": "NYSE", "A": "AMEX", "P": "NYSE Arca",
    "Z": "BATS", "V": "IEX", "M": "NYSE MKT",
}
MARKET_CODES = {
    "主板": "MAIN", "科创板": "STAR", "创业板": "CHINEXT", "北交所": "BSE", "b股": "B", "b股市场": "B", "纳斯达克全球精选": "Q", "全球精选": "Q",
    "纳斯达克全球市场": "G", "全球市场": "G", "纳斯达克资本市场": "S", "资本市场": "S", "consumer cyclical": "Consumer Discretionary",
    "consumer defensive": "Consumer Staples", "healthcare": "Health Care", "financial services": "Financials",
    "technology": "Information Technology", "energy": "Energy", "materials": "Materials", "industrials": "Industrials",
    "consumer discretionary": "Consumer Discretionary", "consumer staples": "Consumer Staples", "health care": "Health Care",
    "financials": "Financials", "information technology": "Information Technology", "communication services": "Communication Services",
    "utilities": "Utilities", "real estate": "Real Estate",
}
MARKET_NAMES = {
    "MAIN": "主板", "STAR": "科创板", "CHINEXT": "创业板", "BSE": "北交所", "B": "B股", "Q": "纳斯达克全球精选", "G": "纳斯达克全球市场",
    "S": "纳斯达克资本市场",
}
FUND_CODES = {
    "ETF": "ETF", "LOF": "LOF", "REIT": "REIT", "REITS": "REIT", "QDII": "QDII", "货币": "MONEY", "货币基金": "MONEY", "债券": "BOND",
    "债券基金": "BOND", "联接": "ETF_LINK", "联结": "ETF_LINK", "ETF联接": "ETF_LINK", "ETF联结": "ETF_LINK", "分级": "GRADED", "基金": "FUND",
}
FUND_NAMES = {
    "ETF": "ETF", "LOF": "LOF", "REIT": "REITs", "QDII": "QDII", "MONEY": "货币基金", "BOND": "债券基金", "ETF_LINK": "ETF联接",
    "GRADED": "分级基金", "FUND": "基金",
}
ETF_PREFIXES = [
    "sh.510", "sh.511", "sh.512", "sh.513", "sh.515", "sh.516", "sh.517", "sh.518", "sh.560", "sh.561", "sh.562", "sh.563", "sh.588", "sz.159",
]
INTERVAL_CODES = {
    "chart": {"1m": "1m", "2m": "2m", "5m": "5m", "15m": "15m", "30m": "30m", "60m": "60m", "90m": "90m", "1h": "60m", "1d": "1d", "5d": "5d", "1wk": "1wk", "1mo": "1mo"},
    "baostock": {"1d": "d", "1w": "w", "1wk": "w", "1mo": "m", "1min": "1", "1m": "1", "5m": "5", "15m": "15", "30m": "30", "60m": "60", "1h": "60"},
    "akshare": {"1d": "d", "1wk": "w", "1mo": "m", "5m": "5", "15m": "15", "30m": "30", "60m": "60"},
    "dukascopy": {"1m": "M1", "5m": "M5", "15m": "M15", "30m": "M30", "1h": "H1", "4h": "H4", "1d": "D1"},
    "mt4": {"1m": "M1", "5m": "M5", "15m": "M15", "30m": "M30", "1h": "H1", "1d": "D1"},
}
ADJUST_CODES = {"front": "2", "forward": "2", "back": "1", "backward": "1", "none": "3", "raw": "3"}


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a small fixed table, null for keys that it lacks."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def exchange_code(value: Column) -> Column:
    """An exchange's alias as its code; other values in upper case; null stays null."""
    v = F.trim(value)
    return F.coalesce(lookup(EXCHANGE_CODES, v), F.upper(v))


def market_code(value: Column) -> Column:
    v = F.trim(value)
    return F.coalesce(lookup(MARKET_CODES, F.lower(v)), F.upper(v))


def fund_code(value: Column) -> Column:
    v = F.trim(value)
    return F.coalesce(lookup(FUND_CODES, v), lookup(FUND_CODES, F.upper(v)), F.upper(v))


def exchange_name(code: Column) -> Column:
    """The display name of a code; null where there is none."""
    return lookup(EXCHANGE_NAMES, F.upper(code))


def market_name(code: Column) -> Column:
    return lookup(MARKET_NAMES, F.upper(code))


def fund_name(code: Column) -> Column:
    return lookup(FUND_NAMES, F.upper(code))


def is_etf_code(code: Column) -> Column:
    """Whether a prefixed A-share code is an exchange-traded fund by its number."""
    c = F.lower(F.trim(code))
    found = F.lit(False)
    for p in ETF_PREFIXES:
        found = found | c.startswith(p)
    return found


def vendor_interval(vendor: str, interval: Column) -> Column:
    """A vendor's code of an interval; null where the vendor has none, but the chart API takes unknown ones as they are."""
    i = F.lower(F.trim(interval))
    found = lookup(INTERVAL_CODES[vendor], i)
    return F.coalesce(found, i) if vendor == "chart" else found


def vendor_adjust(adjust: Column, default: str = "back") -> Column:
    """The vendor code of a price adjustment; auto and unknown ones take the default."""
    a = F.lower(F.trim(F.coalesce(adjust, F.lit(""))))
    fallback = ADJUST_CODES.get(default, ADJUST_CODES["back"])
    return F.coalesce(lookup(ADJUST_CODES, a), F.lit(fallback))
