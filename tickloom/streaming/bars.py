"""Streams of ticks: de-duplication, tumbling bars, and incremental upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.timefn import NTZ, session_close
from tickloom.operators.store import coverage
from tickloom.sources.files import exists, read_store, write_bars


def stream_dedup(ticks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first tick of each (symbol, ts) seen within the delay; ts is a TIMESTAMP."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"])


def stream_bars(ticks: DataFrame, minutes: int, delay: str = "1 hour") -> DataFrame:
    """Bars of ``minutes`` over a tick stream (symbol, ts TIMESTAMP, seq, price, volume), emitted when the watermark
    has passed their end; later ticks are dropped."""
    at = F.struct("ts", "seq")
    slot = F.window("ts", f"{minutes} minutes")
    bars = ticks.withWatermark("ts", delay).groupBy(slot, "symbol").agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"),
    )
    return bars.select("symbol", F.col("window.start").alias("datetime"), "open", "high", "low", "close", "volume")


def stream_daily(ticks: DataFrame, delay: str = "1 hour", zone: str = "America/New_York", close_hour: int = 17) -> DataFrame:
    """Session bars over a tick stream, labelled by their close; the Spark session's time zone must be UTC.

    The watermark is on the label, so a session is emitted when a later session's ticks have moved it past the label.
    """
    at = F.struct("ts", "seq")
    label = session_close(F.col("ts").cast(NTZ), zone, close_hour).cast("timestamp")
    bars = ticks.withColumn("datetime", label).withWatermark("datetime", delay).groupBy("symbol", "datetime")
    return bars.agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"),
    ).select("symbol", "datetime", "open", "high", "low", "close", "volume")


def stream_upsert(
    landing: DataFrame, path: str, checkpoint: str, seq: str | None = "seq", resume: bool = False, done: DataFrame | None = None
) -> StreamingQuery:
    """Merge each batch of new bars into the bar table at path; only the folders that a batch touches are written anew.

    With ``resume``, bars up to the last stored one of their series are left out, as stored already. ``done``
    (symbol, interval, start, end) names windows that are complete; bars inside them are left out. A batch that is run
    again after a failure gives the same table.
    """
    key = ["asset_type", "interval", "symbol"]

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if done is not None:
            w = done.select("symbol", "interval", F.col("start").alias("_start"), F.col("end").alias("_end")).distinct()
            inside = (F.col("datetime") >= F.col("_start")) & (F.col("datetime") < F.col("_end"))
            same = [batch[c] == w[c] for c in ("symbol", "interval")]
            batch = batch.join(w, [*same, inside], "left_anti")
        if resume and exists(spark, path):
            last = coverage(read_store(spark, path), key).select(*key, "stored_max")
            batch = batch.join(last, key, "left").where("stored_max is null or datetime > stored_max").drop("stored_max")
        write_bars(batch, path, seq)

    return landing.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(spark: SparkSession, landing: str, schema: str, path: str, checkpoint: str, seq: str | None = "seq", **options) -> StreamingQuery:
    """Upserts the Parquet files that have come into a landing folder since the last call with this checkpoint, then ends.

    A file is taken once; a file with rows that came before changes nothing. Options are those of ``stream_upsert``.
    """
    files = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(landing)
    return stream_upsert(files, path, checkpoint, seq, **options)
