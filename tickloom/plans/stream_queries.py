"""Queries that run the stream operators over landed copies of the given tables, with the SQL of what must come out.

Each stream is run twice: first over the ticks of the first half of the time, then over all others, among them every
fiftieth tick of the first half, which comes late. The first run leaves a watermark one hour before its last tick; late
ticks behind it are dropped. What is emitted ends at the watermark of the second run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.plans import views
from tickloom.plans.queries import SESSION, SLOT5, SQL_TICKS, query
from tickloom.sources import files
from tickloom.sources.shared import scratch
from tickloom.streaming import bars

TICKS = "symbol string, ts timestamp, seq long, price double, volume double"


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    t = views.ticks(spark, d)
    return t.select("symbol", F.col("datetime").cast("timestamp").alias("ts"), "seq", "price", "volume")


def _parts(ticks: DataFrame) -> list[DataFrame]:
    """The ticks of the first half of the time without every fiftieth, and the others."""
    middle = ticks.agg(F.floor((F.unix_seconds(F.min("ts")) + F.unix_seconds(F.max("ts"))) / 2).alias("_middle"))
    t = ticks.join(F.broadcast(middle), how="cross")  # one row
    early = (F.unix_seconds("ts") < F.col("_middle")) & (F.col("seq") % 50 != 0)
    return [t.where(early).drop("_middle"), t.where(~early).drop("_middle")]


def _emitted(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows that the stream has appended to its sink after both runs."""
    root = scratch(spark, "stream")
    for k, part in enumerate(_parts(_ticks(spark, d))):
        part.write.parquet(f"{root}/in/{k}")
        stream = build(spark.readStream.schema(TICKS).option("recursiveFileLookup", True).parquet(f"{root}/in"))
        writer = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


SQL_PARTS = f"""{SQL_TICKS}, mid AS (SELECT floor((floor(epoch(min(datetime))) + floor(epoch(max(datetime)))) / 2) AS middle FROM ticks),
p AS (SELECT t.*, floor(epoch(datetime)) < middle AND seq % 50 <> 0 AS early FROM ticks t, mid)"""


def bars_sql(slot: str, end: str, label: str) -> str:
    """Bars of the ticks by ``slot``, without late ticks, of which ``end`` has been passed; ``label`` is the event time."""
    return f"""WITH {SQL_PARTS}, l AS (SELECT *, {slot} AS slot, {label} AS label FROM p),
wm AS (SELECT date_trunc('milliseconds', max(label) FILTER (WHERE early)) - INTERVAL 1 HOUR AS first, date_trunc('milliseconds', max(label)) - INTERVAL 1 HOUR AS last FROM l),
kept AS (SELECT l.*, last FROM l, wm WHERE early OR {end} > first)
SELECT symbol, slot AS datetime, arg_min(price, (datetime, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (datetime, seq)) AS close, sum(volume) AS volume
FROM kept WHERE {end} <= last GROUP BY symbol, slot"""


@query(bars_sql(SLOT5, "slot + INTERVAL 5 MINUTE", "datetime"))
def stream_bars_5m(spark: SparkSession, d: str) -> DataFrame:
    out = _emitted(spark, d, lambda t: bars.stream_bars(t, 5))
    return out.withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


@query(bars_sql(f"CAST({SESSION} AS TIMESTAMP)", "slot", f"CAST({SESSION} AS TIMESTAMP)"))
def stream_bars_daily(spark: SparkSession, d: str) -> DataFrame:
    out = _emitted(spark, d, bars.stream_daily)
    return out.withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


@query(
    f"""WITH {SQL_PARTS}, wm AS (SELECT date_trunc('milliseconds', max(datetime) FILTER (WHERE early)) - INTERVAL 1 HOUR AS first FROM p)
SELECT DISTINCT symbol, date_trunc('minute', datetime) AS datetime FROM p, wm WHERE early OR date_trunc('minute', datetime) > first"""
)
def stream_distinct_ticks(spark: SparkSession, d: str) -> DataFrame:
    """The minutes with ticks, each once: ticks of a symbol and minute are repeats of the first."""

    def build(t: DataFrame) -> DataFrame:
        return bars.stream_dedup(t.withColumn("ts", F.date_trunc("MINUTE", "ts")))

    return _emitted(spark, d, build).select("symbol", F.col("ts").cast("timestamp_ntz").alias("datetime"))


LANDED = "asset_type string, interval string, symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, seq long"


@query(
    f"""WITH {SQL_TICKS} SELECT 'ticks' AS asset_type, '1s' AS interval, symbol, date_trunc('second', datetime) AS datetime, price AS close, volume, seq FROM ticks
QUALIFY row_number() OVER (PARTITION BY symbol, date_trunc('second', datetime) ORDER BY seq DESC) = 1"""
)
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """events landed in three parts, one of them twice, each taken into the bar store by a run of the stream."""
    root = scratch(spark, "ingest")
    t = views.ticks(spark, d)
    price = [F.col("price").alias(c) for c in ("open", "high", "low", "close")]
    rows = t.select(F.lit("ticks").alias("asset_type"), F.lit("1s").alias("interval"), "symbol", F.date_trunc("SECOND", "datetime").cast("timestamp_ntz").alias("datetime"), *price, "volume", "seq")
    third = F.pmod(F.xxhash64("symbol", "datetime"), F.lit(3))
    for k, part in enumerate((0, 1, 0, 2)):
        rows.where(third == part).write.parquet(f"{root}/landing/{k}")
        bars.ingest(spark, f"{root}/landing", LANDED, f"{root}/store", f"{root}/checkpoint").awaitTermination()
    return files.read_store(spark, f"{root}/store").select("asset_type", "interval", "symbol", "datetime", "close", "volume", "seq")
