"""The driver's tables seen as market data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.timefn import NTZ


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ticks: the event type is the symbol."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast(NTZ).alias("datetime"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").try_cast("double").alias("volume"),
        F.col("event_id").alias("seq"),
    )


def daily_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as ticks with many equal times; every seventh has no volume."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").cast(NTZ).alias("datetime"),
        F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 100).cast("double").alias("volume"),
        F.col("o_orderkey").alias("seq"),
    )


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as daily bars with every kind of fault, set by remainders of the keys."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    p = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.col("l_shipdate").cast(NTZ).alias("datetime"),
        p.alias("open"),
        F.when(k % 11 == 0, p - 5).otherwise(p + 1).alias("high"),
        (p - 1).alias("low"),
        F.when(k % 13 == 0, None).otherwise(p).alias("close"),
        F.when(k % 17 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("volume"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as an instrument catalog with tri-state flags."""
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey")).alias("symbol"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("exchange"),
        F.lit("stock").alias("asset_type"),
        F.col("p_type").alias("market_category"),
        F.when(s % 3 == 0, True).when(s % 3 == 1, False).alias("is_etf"),
        F.when(s % 4 == 0, True).when(s % 4 == 1, False).alias("is_fund"),
    )


def window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as raw rows of hour windows at two intervals, with bad times, bad ranges and infinite volumes set by the event id."""
    k, v = F.col("event_id"), F.col("value")
    hour = F.date_trunc("HOUR", "ts").cast(NTZ)
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.when(k % 5 == 0, "5m").otherwise("1m").alias("interval"),
        hour.alias("start"),
        (hour + F.make_dt_interval(F.lit(0), F.lit(1))).alias("end"),
        k.alias("pos"),
        F.when(k % 97 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("datetime"),
        v.alias("open"),
        F.when(k % 89 == 0, v - 5).otherwise(v + 1).alias("high"),
        (v - 1).alias("low"),
        F.when(k % 3 != 0, v).alias("close"),
        F.when(k % 101 == 0, "Infinity").when(k % 7 != 0, "1").alias("volume"),
    )
