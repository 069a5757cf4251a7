"""Ticks to bars: one-minute bars, rollups, trading-session days, and grids.

Every function works on all symbols at once. First and last go by (datetime, seq), so equal times have a defined order,
and the aggregates combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import timefn
from tickloom.functions.numeric import close_to

OHLCV = ["open", "high", "low", "close", "volume"]


def _tick_aggregates() -> list[Column]:
    at = F.struct("datetime", "seq")
    return [
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"),
    ]


def _bar_aggregates() -> list[Column]:
    def when_there(name: str) -> Column:  # a null key is left out by min_by and max_by
        return F.when(F.col(name).isNotNull(), F.col("datetime"))

    return [
        F.min_by("open", when_there("open")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", when_there("close")).alias("close"),
        F.sum("volume").alias("volume"),
    ]


def bars_from_ticks(ticks: DataFrame, minutes: int = 1) -> DataFrame:
    """(symbol, datetime, open, high, low, close, volume) straight from ticks, without empty slots."""
    slot = timefn.minute_floor(F.col("datetime"), minutes)
    rows = ticks.where(F.col("datetime").isNotNull() & F.col("price").isNotNull())
    return rows.groupBy("symbol", slot.alias("slot")).agg(*_tick_aggregates()).withColumnRenamed("slot", "datetime")


def on_grid(bars: DataFrame, bounds: DataFrame, minutes: int) -> DataFrame:
    """The bars on every slot of ``bounds(symbol, start, end)``; slots without a bar are null."""
    slots = timefn.grid(bounds, "start", "end", minutes * 60).select("symbol", "datetime")
    return slots.join(bars, ["symbol", "datetime"], "left").select("symbol", "datetime", *OHLCV)


def tick_bounds(ticks: DataFrame) -> DataFrame:
    """(symbol, start, end) from the minute of the first tick to the end of the last tick's minute."""
    first, last = timefn.minute_floor(F.min("datetime")), timefn.minute_floor(F.max("datetime"))
    return ticks.groupBy("symbol").agg(first.alias("start"), (last + timefn.seconds(60)).alias("end"))


def bars_1m(ticks: DataFrame, bounds: DataFrame) -> DataFrame:
    """One-minute bars on the full grid of ``bounds``; minutes without ticks are null, and so is their volume."""
    return on_grid(bars_from_ticks(ticks), bounds, 1)


def rollup(bars: DataFrame, minutes: int) -> DataFrame:
    """Bars of a finer grid to bars of ``minutes``; null bars are skipped, slots of null bars only stay null."""
    slot = timefn.minute_floor(F.col("datetime"), minutes)
    return bars.groupBy("symbol", slot.alias("slot")).agg(*_bar_aggregates()).withColumnRenamed("slot", "datetime")


def bars_daily(bars: DataFrame, zone: str = "America/New_York", close_hour: int = 17, drop_empty: bool = False) -> DataFrame:
    """Session bars labelled by their close in UTC; sessions of null bars stay unless ``drop_empty``."""
    rows = bars.where(F.col("datetime").isNotNull())
    key = timefn.session_close(F.col("datetime"), zone, close_hour)
    out = rows.groupBy("symbol", key.alias("session")).agg(*_bar_aggregates()).withColumnRenamed("session", "datetime")
    return out.where(F.col("close").isNotNull()) if drop_empty else out


def reconcile(expected: DataFrame, given: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Per symbol: bars in both, and for each column how many differ by more than the tolerance (null equals null)."""
    a, b = expected.alias("a"), given.alias("b")
    both = a.join(b, (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.datetime") == F.col("b.datetime")))
    differ = [F.count_if(~close_to(F.col(f"a.{c}"), F.col(f"b.{c}"), tolerance)).alias(f"{c}_mismatch") for c in OHLCV]
    out = both.groupBy(F.col("a.symbol").alias("symbol")).agg(F.count("*").alias("overlap"), *differ)
    total = sum((F.col(f"{c}_mismatch") for c in OHLCV[1:]), F.col("open_mismatch"))
    return out.withColumn("ok", total == 0)


def reconcile_ticks(ticks: DataFrame, minutes: int, given_volume: str = "volume", tolerance: float = 1e-9) -> DataFrame:
    """Like ``reconcile`` of bars rolled up from one-minute bars with bars straight from the ticks, from one scan.

    Ticks are brought to minutes once, with what both sides need; each slot then gets both bars from its minutes, and
    nothing is joined. ``given_volume`` names the volumes of the direct side.
    """
    at = F.struct("datetime", "seq")
    rows = ticks.where(F.col("datetime").isNotNull() & F.col("price").isNotNull())
    own = _tick_aggregates()
    m = rows.groupBy("symbol", timefn.minute_floor(F.col("datetime")).alias("minute")).agg(
        *own, F.sum(given_volume).alias("given"), F.min(at).alias("first"), F.max(at).alias("last")
    )
    direct = {"open": F.min_by("open", "first"), "high": F.max("high"), "low": F.min("low"), "close": F.max_by("close", "last"), "volume": F.sum("given")}
    rolled = _bar_aggregates()
    both = m.withColumnRenamed("minute", "datetime").groupBy("symbol", timefn.minute_floor(F.col("datetime"), minutes).alias("slot")).agg(
        F.struct(*rolled).alias("a"), *[v.alias(f"b_{c}") for c, v in direct.items()]
    )
    differ = [F.count_if(~close_to(F.col(f"a.{c}"), F.col(f"b_{c}"), tolerance)).alias(f"{c}_mismatch") for c in OHLCV]
    out = both.groupBy("symbol").agg(F.count("*").alias("overlap"), *differ)
    return out.withColumn("ok", sum((F.col(f"{c}_mismatch") for c in OHLCV[1:]), F.col("open_mismatch")) == 0)
