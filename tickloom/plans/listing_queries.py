"""Queries of payloads, listings and loose inputs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import shape
from tickloom.plans import views
from tickloom.plans.queries import SQL_CATALOG, SQL_TICKS, query
from tickloom.sources import listings


@query(
    """SELECT o_custkey AS request, o_orderdate + INTERVAL 8 HOUR AS datetime, o_totalprice AS open, o_totalprice + 1 AS high, o_totalprice - 1 AS low,
  o_totalprice AS close, CAST(o_orderkey AS DOUBLE) AS volume, CASE WHEN o_custkey % 2 = 0 THEN o_totalprice / 2 END AS adjusted_close FROM orders WHERE o_orderkey % 5 <> 0"""
)
def chart_bars(spark: SparkSession, d: str) -> DataFrame:
    """orders folded into chart payloads of a customer, at most a thousand orders each, and read back as bars."""
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    rows = views.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("request"), F.floor(k / 1000).alias("page"))
    rows = rows.agg(F.collect_list(F.struct(at.alias("t"), p.alias("p"), F.when(k % 5 != 0, p).alias("c"), k.cast("double").alias("v"))).alias("r"))
    quote = F.struct(
        F.col("r.p").alias("open"), F.transform("r.p", lambda x: x + 1).alias("high"), F.transform("r.p", lambda x: x - 1).alias("low"),
        F.col("r.c").alias("close"), F.col("r.v").alias("volume"),
    )
    halves = F.array(F.struct(F.transform("r.p", lambda x: x / 2).alias("adjclose")))
    adjusted = F.when(F.col("request") % 2 == 0, halves).alias("adjclose")
    result = F.struct(F.col("r.t").alias("timestamp"), F.struct(F.array(quote).alias("quote"), adjusted).alias("indicators"))
    payload = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"})
    return listings.chart_bars(rows.select("request", payload.alias("json")), "json", ["request"])


@query("""SELECT 'P' || p_partkey AS symbol, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS name, p_brand AS exchange FROM part WHERE p_partkey % 7 <> 0""")
def screener_catalog(spark: SparkSession, d: str) -> DataFrame:
    """part folded into screener payloads of a brand, at most two hundred parts each, and read back."""
    k = F.col("p_partkey")
    quote = F.struct(
        F.when(k % 7 != 0, F.concat(F.lit("P"), k)).otherwise(" ").alias("symbol"), F.when(k % 2 == 0, F.col("p_name")).otherwise(" ").alias("shortName"),
        F.col("p_type").alias("longName"), F.col("p_brand").alias("exchange"),
    )
    rows = views.table(spark, d, "part").groupBy("p_brand", F.floor(k / 200)).agg(F.collect_list(quote).alias("quotes"))
    result = F.struct(F.array(F.struct("quotes")).alias("result"))
    return listings.screener_catalog(rows.select(F.to_json(F.struct(result.alias("finance"))).alias("json")), "json")


@query(
    f"""WITH {SQL_CATALOG} SELECT symbol, name, exchange, asset_type, market_category, CASE is_etf WHEN true THEN 'Y' WHEN false THEN 'N' ELSE '' END AS is_etf,
  CASE is_fund WHEN true THEN 'Y' WHEN false THEN 'N' ELSE '' END AS is_fund, '' AS fund_category FROM catalog"""
)
def catalog_text(spark: SparkSession, d: str) -> DataFrame:
    rows = views.catalog(spark, d).withColumn("fund_category", F.lit(None).cast("string"))
    return listings.catalog_text(listings.catalog_rows(listings.catalog_text(rows)))


@query(
    """SELECT 'P' || p_partkey AS symbol, p_name AS name, CASE WHEN p_size % 3 <> 0 THEN 'NASDAQ' END AS exchange, CASE WHEN p_size % 3 <> 0 THEN 'Q' END AS market_category,
  CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS is_etf FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 9 <> 0"""
)
def listing_rows(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = views.table(spark, d, "part").select(
        F.when(k % 5 == 0, " ").when(k % 9 == 0, "File Creation Time: 1").otherwise(F.concat(F.lit(" P"), k)).alias("Symbol"),
        F.col("p_name").alias("Security Name"),
        F.when(s % 3 != 0, "Q").otherwise("").alias("Market Category"),
        F.when(s % 4 == 0, "Y").when(s % 4 == 1, "N").when(s % 4 == 2, "?").otherwise("").alias("ETF"),
    )
    return listings.listing_rows(rows, "Symbol")


@query(
    """SELECT l_suppkey AS symbol, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_shipdate END AS datetime, l_extendedprice AS open, CAST(NULL AS DOUBLE) AS high,
  CAST(NULL AS DOUBLE) AS low, l_extendedprice AS close, CAST(l_quantity AS DOUBLE) AS volume FROM lineitem"""
)
def vendor_bars(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("l_orderkey"), F.col("l_shipdate")
    when = F.when(k % 3 == 0, "none").when(k % 3 == 1, F.date_format(t, "yyyyMMddHHmmss")).otherwise(F.date_format(t, "yyyy-MM-dd"))
    rows = views.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), when.alias("日期"), F.col("l_extendedprice").cast("string").alias("开盘"),
        F.col("l_extendedprice").cast("string").alias("收盘"), F.col("l_quantity").alias("成交量"),
    )
    return listings.vendor_bars(rows, ["symbol"])


@query(
    """SELECT l_orderkey, l_linenumber, l_shipdate AS datetime, (l_extendedprice + l_extendedprice * (1 - l_discount)) / 2 AS price,
  CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END + l_quantity AS volume FROM lineitem WHERE l_orderkey % 4 <> 0"""
)
def normalize_ticks(spark: SparkSession, d: str) -> DataFrame:
    k, p, q = F.col("l_orderkey"), F.col("l_extendedprice"), F.col("l_quantity")
    rows = views.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(k % 4 != 0, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).otherwise("bad").alias("Time"),
        p.alias("ASK"), (p * (1 - F.col("l_discount"))).alias("bid"), F.when(F.col("l_linenumber") % 2 == 0, q).alias("ask_volume"), q.alias("Bid_Volume"),
    )
    return shape.normalize_ticks(rows, ["l_orderkey", "l_linenumber"])


@query(f"WITH {SQL_TICKS} SELECT seq, date_trunc('second', datetime) AS datetime FROM ticks")
def epoch_times(spark: SparkSession, d: str) -> DataFrame:
    rows = views.ticks(spark, d).select("seq", F.unix_seconds(F.col("datetime").cast("timestamp")).alias("datetime"))
    return shape.epoch_time(rows, "datetime")
