"""Choosing between feeds, and joining listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.store import keep_first


def first_available(rows: DataFrame, key: list[str], priority: str = "priority") -> DataFrame:
    """Per request all rows of the first feed that has any; a request's rows are never mixed from several feeds."""
    best = rows.groupBy(*key).agg(F.min(priority).alias(priority))
    return rows.join(best, [*key, priority], "left_semi")


def route(requests: DataFrame, feeds: dict[str, str], default: str, allowed: list[str], strict: bool = True) -> DataFrame:
    """Each request's feed by its asset type, or the default; an unknown type is an error, or null if not ``strict``."""
    a = F.lower(F.trim("asset_type"))
    feed: Column = F.lit(default)
    for name, target in feeds.items():
        feed = F.when(a == name.lower(), target).otherwise(feed)
    unknown = F.raise_error(F.concat(F.lit("unknown asset type: "), F.coalesce(a, F.lit("null")))) if strict else F.lit(None).cast("string")
    return requests.withColumn("feed", F.when(a.isin([x.lower() for x in allowed]), feed).otherwise(unknown))


def supplement(stocks: DataFrame, others: DataFrame) -> DataFrame:
    """The first listing, and of the second the funds that it lacks; if the first is empty, all of the second."""
    empty = stocks.limit(1).agg((F.count("*") == 0).alias("_empty"))  # one row
    more = others.join(stocks.select("symbol"), "symbol", "left_anti").join(F.broadcast(empty), how="inner")
    more = more.where(F.col("_empty") | F.coalesce("is_etf", F.lit(False))).drop("_empty")
    return stocks.unionByName(more)


def union_first(first: DataFrame, second: DataFrame, order: str = "seq") -> DataFrame:
    """Two listings as one; of rows with equal symbols the first stays, the first listing before the second."""
    both = first.withColumn("_list", F.lit(0)).unionByName(second.withColumn("_list", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, ["symbol"], ["_list", order]).drop("_list")
