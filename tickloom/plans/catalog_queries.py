"""Queries of catalogs and feeds, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import names
from tickloom.operators import catalog, feeds
from tickloom.plans import views
from tickloom.plans.queries import SQL_CATALOG, query


def _case(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


ALIASES = ["上交所", "NYSE Arca", "nasdaq", " 北交所 "]
MARKETS = ["科创板", "Healthcare", "energy", "odd"]
FUNDS = ["货币", "etf", "分级", "reits"]
SQL_LISTED = f"""{SQL_CATALOG}, listed AS (SELECT catalog.*, {_case(dict(enumerate(ALIASES)), "k % 5")} AS exchange_text, {_case(dict(enumerate(MARKETS)), "k % 6")} AS market_text,
  {_case(dict(enumerate(FUNDS)), "k % 7")} AS fund_text, k FROM (SELECT *, CAST(substr(symbol, 2) AS BIGINT) AS k FROM catalog) AS catalog)"""


def listed(spark: SparkSession, d: str) -> DataFrame:
    """The catalog with exchange, market and fund given by aliases."""
    k = F.substring("symbol", 2, 20).cast("long")

    def pick(values: list[str], n: int) -> F.Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))

    return views.catalog(spark, d).withColumns({"k": k, "exchange": pick(ALIASES, 5), "market_category": pick(MARKETS, 6), "fund_category": pick(FUNDS, 7)})


@query(
    f"""WITH {SQL_LISTED} SELECT symbol, {_case({"上交所": "SSE", "NYSE Arca": "P", "nasdaq": "NASDAQ", " 北交所 ": "BSE"}, "exchange_text")} AS exchange,
  {_case({"科创板": "STAR", "Healthcare": "Health Care", "energy": "Energy", "odd": "ODD"}, "market_text")} AS market,
  {_case({"货币": "MONEY", "etf": "ETF", "分级": "GRADED", "reits": "REIT"}, "fund_text")} AS fund,
  {_case({"上交所": "上交所", "NYSE Arca": "NYSE Arca", "nasdaq": "NASDAQ", " 北交所 ": "北交所"}, "exchange_text")} AS exchange_name,
  {_case({"科创板": "科创板"}, "market_text")} AS market_name, {_case({"货币": "货币基金", "etf": "ETF", "分级": "分级基金", "reits": "REITs"}, "fund_text")} AS fund_name FROM listed"""
)
def catalog_codes(spark: SparkSession, d: str) -> DataFrame:
    e, m, f = names.exchange_code(F.col("exchange")), names.market_code(F.col("market_category")), names.fund_code(F.col("fund_category"))
    return listed(spark, d).select(
        "symbol", e.alias("exchange"), m.alias("market"), f.alias("fund"),
        names.exchange_name(e).alias("exchange_name"), names.market_name(m).alias("market_name"), names.fund_name(f).alias("fund_name"),
    )


@query(
    f"""WITH {SQL_LISTED} SELECT symbol FROM listed WHERE exchange_text IN ('上交所', 'NYSE Arca', 'nasdaq') AND (market_text IS NULL OR market_text <> 'Healthcare')
  AND fund_text IN ('货币', 'reits')"""
)
def catalog_filter_aliases(spark: SparkSession, d: str) -> DataFrame:
    spec = catalog.CatalogFilter(include_exchanges=["上海证券交易所", "p", "纳斯达克"], exclude_markets=["health care"], include_funds=["货币基金", "REIT"])
    return catalog.catalog_filter(listed(spark, d), spec).select("symbol")


@query(
    f"""WITH {SQL_LISTED} SELECT market_text AS market_category, count(*) AS total, count_if(coalesce(is_etf, false))::BIGINT AS etfs,
  count_if(NOT coalesce(is_etf, false))::BIGINT AS others FROM listed GROUP BY 1"""
)
def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.counts(listed(spark, d), ["market_category"])


@query(
    f"""WITH {SQL_LISTED}, a AS (SELECT * FROM listed WHERE k % 2 = 0), b AS (SELECT * FROM listed WHERE k % 2 = 1 OR k % 3 = 0)
SELECT symbol, name FROM a UNION ALL SELECT symbol, name FROM b WHERE is_etf AND symbol NOT IN (SELECT symbol FROM a)"""
)
def supplement_catalog(spark: SparkSession, d: str) -> DataFrame:
    rows = listed(spark, d)
    return feeds.supplement(rows.where("k % 2 = 0"), rows.where("k % 2 = 1 or k % 3 = 0")).select("symbol", "name")


@query(
    f"""WITH {SQL_LISTED}, u AS (SELECT 'S' || (k // 3) AS symbol, name, k AS seq, 0 AS n FROM listed WHERE k % 2 = 0 UNION ALL
SELECT 'S' || (k // 5), name, k, 1 FROM listed) SELECT symbol, name, seq FROM u QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n, seq) = 1"""
)
def union_listings(spark: SparkSession, d: str) -> DataFrame:
    def numbered(n: int) -> DataFrame:
        return listed(spark, d).select(F.concat(F.lit("S"), F.floor(F.col("k") / n).cast("string")).alias("symbol"), "name", F.col("k").alias("seq"))

    return feeds.union_first(numbered(3).where("seq % 2 = 0"), numbered(5))


@query(
    """WITH f AS (SELECT l_orderkey AS request, l_linenumber % 3 AS priority, l_linenumber AS line FROM lineitem)
SELECT * FROM f QUALIFY priority = min(priority) OVER (PARTITION BY request)"""
)
def first_available_feed(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = views.table(spark, d, "lineitem")
    return feeds.first_available(rows.select(F.col("l_orderkey").alias("request"), (n % 3).alias("priority"), n.alias("line")), ["request"])


@query(
    """SELECT c_custkey AS request, CASE WHEN c_mktsegment = 'BUILDING' THEN 'ticks' WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'charts' END AS feed FROM customer"""
)
def route_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "customer").select(F.col("c_custkey").alias("request"), F.col("c_mktsegment").alias("asset_type"))
    return feeds.route(rows, {"building": "ticks"}, "charts", ["building", "machinery", "furniture"], strict=False).select("request", "feed")


SQL_FACET_CODES = """c AS (SELECT CASE p_size % 5 WHEN 0 THEN 'SSE' WHEN 1 THEN 'N' WHEN 2 THEN 'Z' WHEN 3 THEN 'ELSE' END AS exchange,
  CASE p_partkey % 4 WHEN 0 THEN 'MAIN' WHEN 1 THEN 'Q' WHEN 2 THEN p_brand END AS market_category, CASE p_partkey % 3 WHEN 0 THEN 'BOND' WHEN 1 THEN 'ETF' END AS fund_category FROM part)"""


@query(
    f"""WITH {SQL_FACET_CODES}, v AS (SELECT 'exchange' AS facet, exchange AS value FROM c UNION ALL SELECT 'market_category', market_category FROM c UNION ALL SELECT 'fund_category', fund_category FROM c)
SELECT facet, value, CASE facet || ':' || value WHEN 'exchange:SSE' THEN '上交所' WHEN 'exchange:N' THEN 'NYSE' WHEN 'exchange:Z' THEN 'BATS' WHEN 'market_category:MAIN' THEN '主板'
  WHEN 'market_category:Q' THEN '纳斯达克全球精选' WHEN 'fund_category:BOND' THEN '债券基金' ELSE value END AS shown, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY facet, value"""
)
def facets_shown(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.col("p_size"), F.col("p_partkey")
    c = views.table(spark, d, "part").select(
        F.when(s % 5 == 0, "SSE").when(s % 5 == 1, "N").when(s % 5 == 2, "Z").when(s % 5 == 3, "ELSE").alias("exchange"),
        F.when(k % 4 == 0, "MAIN").when(k % 4 == 1, "Q").when(k % 4 == 2, F.col("p_brand")).alias("market_category"),
        F.when(k % 3 == 0, "BOND").when(k % 3 == 1, "ETF").alias("fund_category"),
    )
    return catalog.facets_shown(c)
