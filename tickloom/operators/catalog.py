"""Instrument catalogs: classification, filters, comparison."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import names


def prefixed_code(number: Column) -> Column:
    """Bare A-share number to a code with its exchange: 5, 6, 9 Shanghai; 0 to 3 Shenzhen; 4, 8 Beijing; else null."""
    c = F.trim(number)
    prefix = F.when(c.rlike("^[569]"), "sh.").when(c.rlike("^[0-3]"), "sz.").when(c.rlike("^[48]"), "bj.")
    return F.when(c.rlike("^[0-9]+$"), F.concat(prefix, c))


def exchange_and_market(code: Column) -> Column:
    """Struct (exchange, market) of a prefixed A-share code; nulls for other codes."""
    c = F.lower(F.trim(code))
    number = F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, r"^[^.]*\.", "")).otherwise(c)
    side = F.when(F.contains(c, F.lit(".")), F.substring_index(c, ".", 1))
    exchange = F.when(side == "sh", "SSE").when(side == "sz", "SZSE").when(side == "bj", "BSE")
    special = {"sh": (("688", "STAR"), ("900", "B")), "sz": (("300", "CHINEXT"), ("200", "B"))}
    market = F.when(side == "bj", "BSE")
    for name, rules in special.items():
        for start, code_ in rules:
            market = market.when((side == name) & number.startswith(start), code_)
        market = market.when(side == name, "MAIN")
    return F.struct(exchange.alias("exchange"), market.alias("market"))


def fund_class(code: Column, name: Column) -> Column:
    """Struct (is_etf, is_fund, fund_category) from code and name, by the first rule that fits."""
    n = F.trim(F.coalesce(name, F.lit("")))
    up = F.upper(n)
    number = F.regexp_replace(F.lower(F.trim(F.coalesce(code, F.lit("")))), r"^[^.]*\.", "")

    def has(text: Column, *parts: str) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])

    def kind(category: str, etf: bool = False) -> Column:
        return F.struct(F.lit(etf).alias("is_etf"), F.lit(True).alias("is_fund"), F.lit(category).alias("fund_category"))

    out = F.when(has(n, "联接") | has(up, "ETF_LINK"), kind("ETF_LINK"))
    for word in ("REIT", "LOF", "QDII"):
        out = out.when(has(up, word), kind(word))
    out = out.when(has(up, "ETF") | number.rlike("^(51|15)"), kind("ETF", True))
    fund = has(n, "基金", "货币", "债券", "债基")
    out = out.when(fund & has(n, "货币"), kind("MONEY")).when(fund & has(n, "债"), kind("BOND")).when(fund, kind("FUND"))
    none = F.struct(
        F.lit(None).cast("boolean").alias("is_etf"), F.lit(None).cast("boolean").alias("is_fund"), F.lit(None).cast("string").alias("fund_category")
    )
    return out.otherwise(none)


@dataclass
class CatalogFilter:
    """What to keep of a catalog; empty lists and None mean no condition."""

    include_symbols: list[str] = field(default_factory=list)
    exclude_symbols: list[str] = field(default_factory=list)
    include_exchanges: list[str] = field(default_factory=list)
    exclude_exchanges: list[str] = field(default_factory=list)
    include_markets: list[str] = field(default_factory=list)
    exclude_markets: list[str] = field(default_factory=list)
    include_funds: list[str] = field(default_factory=list)
    exclude_funds: list[str] = field(default_factory=list)
    include_prefixes: list[str] = field(default_factory=list)
    exclude_prefixes: list[str] = field(default_factory=list)
    include_regex: list[str] = field(default_factory=list)
    exclude_regex: list[str] = field(default_factory=list)
    include_name_regex: list[str] = field(default_factory=list)
    exclude_name_regex: list[str] = field(default_factory=list)
    only_etf: bool | None = None
    only_fund: bool | None = None

    def merged(self, other: CatalogFilter) -> CatalogFilter:
        """Lists are joined, flags of ``other`` win where they are set."""
        out = CatalogFilter()
        for f in fields(self):
            a, b = getattr(self, f.name), getattr(other, f.name)
            setattr(out, f.name, [*a, *b] if isinstance(a, list) else (a if b is None else b))
        return out


def _valid(patterns: list[str]) -> list[str]:
    """Patterns that compile in the engine that runs them, Java's; others are ignored."""
    pattern = SparkSession.active()._jvm.java.util.regex.Pattern
    out = []
    for p in patterns:
        try:
            pattern.compile("(?i)" + p)
        except IllegalArgumentException:
            continue
        out.append("(?i)" + p)
    return out


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def filter_condition(spec: CatalogFilter) -> Column:
    """The filter as one condition, which Spark can push into the scan."""
    yes = F.lit(True)
    no = F.lit(False)
    symbol = F.upper("symbol")
    if spec.include_symbols:
        yes = yes & F.coalesce(symbol.isin([x.upper() for x in spec.include_symbols]), no)
    if spec.exclude_symbols:
        yes = yes & ~F.coalesce(symbol.isin([x.upper() for x in spec.exclude_symbols]), no)
    for name, code, shown, keep, drop in (
        ("exchange", names.exchange_code, names.exchange_name, spec.include_exchanges, spec.exclude_exchanges),
        ("market_category", names.market_code, names.market_name, spec.include_markets, spec.exclude_markets),
        ("fund_category", names.fund_code, names.fund_name, spec.include_funds, spec.exclude_funds),
    ):
        for values, wanted in ((keep, True), (drop, False)):
            if values:
                asked = [code(F.lit(v)) for v in values]  # folded by the optimizer
                hit = F.coalesce(code(F.col(name)).isin(*asked), no) | F.coalesce(shown(F.col(name)).isin(*asked), no)
                yes = yes & (hit if wanted else ~hit)
    if spec.include_prefixes:
        yes = yes & _any([symbol.startswith(p.upper()) for p in spec.include_prefixes])
    if spec.exclude_prefixes:
        yes = yes & ~_any([symbol.startswith(p.upper()) for p in spec.exclude_prefixes])
    name = F.coalesce("name", F.lit(""))
    for column, keep, drop in ((F.col("symbol"), spec.include_regex, spec.exclude_regex), (name, spec.include_name_regex, spec.exclude_name_regex)):
        if found := _valid(keep):
            yes = yes & _any([column.rlike(p) for p in found])
        if found := _valid(drop):
            yes = yes & ~_any([column.rlike(p) for p in found])
    etf, fund = F.coalesce("is_etf", F.lit(False)), F.coalesce("is_fund", F.lit(False))
    if spec.only_etf and spec.only_fund:
        return yes & (etf | fund)
    for flag, value in ((etf, spec.only_etf), (fund, spec.only_fund)):
        if value is not None:
            yes = yes & (flag if value else ~flag)
    return yes


def catalog_filter(catalog: DataFrame, spec: CatalogFilter) -> DataFrame:
    return catalog.where(filter_condition(spec))


def first_rows(catalog: DataFrame, limit: int | None, order: str) -> tuple[DataFrame, DataFrame]:
    """(the first ``limit`` rows in the order of a column, the number of all rows as one row); below 0 counts as 0."""
    total = catalog.agg(F.count("*").alias("total"))
    return (catalog if limit is None else catalog.orderBy(order).limit(max(0, limit))), total


def group_members(groups: DataFrame) -> DataFrame:
    """(symbol, categories) of instrument groups (category, symbols): each symbol once, with its categories in order."""
    pairs = groups.select("category", F.explode("symbols").alias("symbol"))
    return pairs.groupBy("symbol").agg(F.sort_array(F.collect_set("category")).alias("categories"))


def group_counts(groups: DataFrame) -> DataFrame:
    """(category, symbols): distinct symbols of each category, and of all under the category null."""
    pairs = groups.select("category", F.explode("symbols").alias("symbol"))
    return pairs.rollup("category").agg(F.count_distinct("symbol").alias("symbols"))


def facets(catalog: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n): the distinct non-null values of each column, with their rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = catalog.select(F.explode(pairs).alias("p")).select("p.facet", "p.value").where("value is not null")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


def facets_shown(catalog: DataFrame) -> DataFrame:
    """(facet, value, shown, n): the values of exchange, market and fund category with their display names."""
    f = facets(catalog, ["exchange", "market_category", "fund_category"])
    v = F.col("value")
    shown = F.when(F.col("facet") == "exchange", names.exchange_name(v)).when(F.col("facet") == "market_category", names.market_name(v))
    return f.withColumn("shown", F.coalesce(shown.otherwise(names.fund_name(v)), v))


def counts(catalog: DataFrame, by: list[str]) -> DataFrame:
    """Rows in all, exchange-traded funds, and the others."""
    etf = F.count_if(F.coalesce("is_etf", F.lit(False)))
    return catalog.groupBy(*by).agg(F.count("*").alias("total"), etf.alias("etfs"), (F.count("*") - etf).alias("others"))


def safe_symbol(symbol: Column) -> Column:
    """Whether a symbol may be part of a path: at most 128 allowed characters and no two dots in a row."""
    s = F.trim(symbol)
    return F.coalesce(s.rlike(r"^[A-Za-z0-9._+=#@$%&^-]{1,128}$") & ~F.contains(s, F.lit("..")), F.lit(False))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(symbol, status): symbols added to and removed from a catalog."""
    o, n = old.select("symbol").distinct(), new.select("symbol").distinct()
    added = n.join(o, "symbol", "left_anti").withColumn("status", F.lit("added"))
    return added.unionByName(o.join(n, "symbol", "left_anti").withColumn("status", F.lit("removed")))
