"""Reading bar files, window CSVs, listings and page text; writing bars and exports."""

from __future__ import annotations

import json
import lzma
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tickloom.functions import timefn
from tickloom.functions.numeric import half_even_long

WINDOW_NAME = r"^(.+)_([0-9]+[a-z]+)_([0-9]{8})_([0-9]{8})\.csv$"
BARS = ["open", "high", "low", "close", "volume"]
BAR_SCHEMA = "datetime string, open double, high double, low double, close double, volume double"
STORED_BARS = "datetime timestamp_ntz, open double, high double, low double, close double, volume double"
#: Records of a binary tick file: milliseconds after the hour, ask, bid, ask volume, bid volume. Fixed values.
TICK = np.dtype([("ms", ">i4"), ("ask", ">i4"), ("bid", ">i4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")])
TICK_NAME = r"^(.+)_(\d{4}-\d{2}-\d{2})_(\d{2})$"
#: Buckets that symbols of one asset type, interval and period are stored in, unless the store says otherwise.
BUCKETS = 64
PLACE = ["asset_type", "interval", "period", "bucket"]
PERIODS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}
#: The folder in which a store says how it is laid out, and touched folders that are sent to every task at most.
ABOUT, FEW_PLACES = "_about", 10_000


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark names it, with its scheme, also where it is given without one; a local one begins with file:/."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()


@contextmanager
def few_listings(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark lists the folders of a scan in a few tasks for each core; else each folder is a task, up to 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    old = spark.conf.get(name)
    spark.conf.set(name, str(min(int(old), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def scan_bars(spark: SparkSession, root: str, interval: str | None = None, asset_type: str = "*", symbol: str = "*") -> DataFrame:
    """Parquet bars below root/asset_type/symbol/interval_start_end.parquet, with these keys from the path.

    Only the folders and files of the asked asset type, symbol and interval are listed, once. A missing root, or one
    without such files, gives no rows.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if interval:
        reader = reader.option("pathGlobFilter", f"{interval}_*.parquet")
    try:
        with few_listings(spark):
            rows = reader.parquet(f"{root}/{asset_type}/{symbol}")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], f"{STORED_BARS}, asset_type string, symbol string, interval string")
    parts = F.split(plain("_metadata.file_path"), "/")
    name = F.element_at(parts, -1)
    return rows.select(
        "*",
        F.element_at(parts, -3).alias("asset_type"),
        F.element_at(parts, -2).alias("symbol"),
        F.when(F.contains(name, F.lit("_")), F.substring_index(name, "_", 1)).alias("interval"),
    )


def scan_tick_binary(spark: SparkSession, root: str, point: float) -> DataFrame:
    """(symbol, datetime, price, volume, seq) of LZMA tick files named SYMBOL_YYYY-MM-DD_HH, one hour each.

    The price is the middle of ask and bid in units of ``point``; the volume the sum of both sides in millionths, null where
    both are 0. Ticks outside the file's hour are left out; files that are empty or cannot be read give no rows.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for symbol, hour, content in batch.itertuples(index=False):
                try:
                    raw = lzma.decompress(content)
                    t = np.frombuffer(raw[: len(raw) // TICK.itemsize * TICK.itemsize], TICK)
                except lzma.LZMAError:
                    continue
                ask, bid = (np.round(t[c].astype(float) * 1e6) for c in ("ask_volume", "bid_volume"))
                out = pd.DataFrame({"symbol": symbol, "hour": hour, "ms": t["ms"].astype(np.int64), "price": (t["ask"].astype(float) + t["bid"]) / 2 / point})
                yield out.assign(volume=np.where((ask == 0) & (bid == 0), np.nan, ask + bid), seq=np.arange(len(t)))

    name = F.element_at(F.split("path", "/"), -1)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = found.where(name.rlike(TICK_NAME) & (F.col("length") > 0))
    hour = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(name, TICK_NAME, 2), F.regexp_extract(name, TICK_NAME, 3)), F.lit("yyyy-MM-dd HH")).cast("timestamp_ntz")
    rows = found.select(F.regexp_extract(name, TICK_NAME, 1).alias("symbol"), hour.alias("hour"), "content").where("hour is not null")
    ticks = rows.mapInPandas(decode, "symbol string, hour timestamp_ntz, ms long, price double, volume double, seq long").where("ms >= 0 and ms < 3600000")
    at = F.col("hour") + timefn.seconds(F.col("ms") / 1000)
    return ticks.select("symbol", at.alias("datetime"), "price", F.when(~F.isnan("volume"), F.col("volume")).alias("volume"), "seq")


def plain(metadata: str) -> Column:
    """A path or name from a file's metadata as it was given: there, signs such as ^ and blanks are escaped."""
    return F.url_decode(F.replace(F.col(metadata), F.lit("+"), F.lit("%2B")))


def literal(text: str) -> str:
    """A text as a glob that matches it alone."""
    return "".join("\\" + c if c in "*?[]{}\\," else c for c in text)


def scan_window_csv(spark: SparkSession, root: str, symbol: str | None = None, interval: str | None = None) -> DataFrame:
    """CSV bars of files named SYMBOL_INTERVAL_START_END.csv; other files are ignored, and not opened when a symbol or an
    interval is asked for. ``row`` orders the rows of a file as they stand in it, also where it is read in several splits."""
    # A name filter has no escapes, so a sign that is special to it stands for any; the names are compared below.
    pattern = "_".join(re.sub(r"[*?\[\]{}\\,]", "?", x) if x else "*" for x in (symbol, interval)) + "_*_*.csv"
    df = spark.read.schema(BAR_SCHEMA).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(root)
    name = plain("_metadata.file_name")
    df = df.where(name.rlike(WINDOW_NAME))
    part = [F.regexp_extract(name, WINDOW_NAME, k) for k in (1, 2, 3, 4)]
    for want, have in ((symbol, part[0]), (interval, part[1])):
        if want:
            df = df.where(have == want)
    return df.select(
        F.try_to_timestamp("datetime").cast("timestamp_ntz").alias("datetime"),
        "open", "high", "low", "close", "volume",
        part[0].alias("symbol"), part[1].alias("interval"), part[2].alias("window_start"), part[3].alias("window_end"),
        name.alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("row"),
    )


def range_from_name(name: Column) -> Column:
    """Struct (interval, start, end) of interval_YYYYMMDD_YYYYMMDD; null for names of another form."""
    p = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")

    def day(k: int) -> Column:
        return F.try_to_timestamp(F.get(p, F.lit(k)), F.lit("yyyyMMdd")).cast("date")

    return F.when(F.size(p) == 3, F.struct(F.get(p, F.lit(0)).alias("interval"), day(1).alias("start"), day(2).alias("end")))


def _about(spark: SparkSession, path: str) -> dict | None:
    """What a store says about itself: its number of buckets, its period and its columns. None where there is no store."""
    if not exists(spark, path):
        return None
    if not exists(spark, f"{path}/{ABOUT}"):
        raise ValueError(f"{path} is no bar store: it has no {ABOUT}")
    return json.loads(spark.read.text(f"{path}/{ABOUT}").first()[0])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The bars that ``write_bars`` has stored; asset types and intervals are text, whatever they look like.

    The store knows its columns, so no data file is opened to learn them. Filters on asset_type, interval, period or
    bucket leave folders out.
    """
    about = _about(spark, path)
    held = StructType.fromJson(about["schema"]) if about else StructType()
    types = [StringType(), StringType(), StringType(), IntegerType()]
    return spark.read.schema(StructType([*held.fields, *(StructField(c, t) for c, t in zip(PLACE, types, strict=True))])).parquet(path)


def period_of(t: Column, period: str) -> Column:
    """The stretch of time that a bar is stored under: its year, year and month, or day; ``none`` without a time."""
    day = F.substring(t.cast("date").cast("string"), 1, len(PERIODS[period]))  # much quicker than a format, but only for four digits
    return F.coalesce(F.when(F.year(t).between(1000, 9999), day).otherwise(F.date_format(t, PERIODS[period])), F.lit("none"))


def write_bars(bars: DataFrame, path: str, seq: str | None = None, buckets: int | None = None, period: str | None = None) -> None:
    """Merge bars into zstd parquet by asset type, interval, period and bucket of symbols, sorted by symbol and time.

    Only the folders that the given bars fall into are read and written anew; in them, a bar of the same symbol and time
    is replaced, and all others stay. Of several given bars with equal keys the one with the highest ``seq`` is written.
    The first write settles the number of buckets and the period (year, month or day), later ones must not ask for
    others. Tasks are dealt ranges of folders, symbols and times, so small folders share a task and large ones are split
    over several, each with a file of its own.
    """
    spark = bars.sparkSession
    about = _about(spark, path)
    asked = {"buckets": buckets, "period": period}
    if about and any(v not in (None, about[k]) for k, v in asked.items()):
        raise ValueError(f"the store has {about['buckets']} buckets by {about['period']}, not {asked}")
    form = about or {"buckets": buckets or BUCKETS, "period": period or "year"}
    new = bars.withColumns({"period": period_of(F.col("datetime"), form["period"]), "bucket": F.pmod(F.xxhash64("symbol"), F.lit(form["buckets"])).cast("int")})
    new = new.withColumns({"_new": F.lit(1), "_seq": F.col(seq) if seq else F.lit(0)})
    # Every bucket is 0 or more. A plain constant would be left out of the window's key below, and that shuffle all again.
    new = new.withColumns({c: F.when(F.col("bucket") >= 0, F.col(c)) for c in ("asset_type", "interval")})
    both = new
    if about:
        # One pass over the given bars finds the folders they fall into; few are sent to the tasks, and leave folders out.
        touched, old = new.select(*PLACE).distinct(), read_store(spark, path)
        few = touched.limit(FEW_PLACES + 1).collect()
        if len(few) <= FEW_PLACES:
            for c in PLACE:
                some = {r[c] for r in few if r[c] is not None}
                old = old.where(F.col(c).isin(*some) if some else F.lit(False))
            touched = F.broadcast(spark.createDataFrame(few, touched.schema))
        old = old.join(touched, PLACE, "left_semi").withColumns({"_new": F.lit(0), "_seq": F.lit(None).cast(new.schema["_seq"].dataType)})
        both = old.unionByName(new, allowMissingColumns=True)
    # The place begins the key, so one shuffle and one sort serve to find the rows that stay, and to write them.
    key = [*PLACE, "symbol", "datetime"]
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc("_seq")))
    out = both.repartitionByRange(*key).withColumn("_last", last).where("_last = 1").drop("_last", "_new", "_seq").sortWithinPartitions(*key)
    schema = StructType([f for f in out.schema.fields if f.name not in PLACE])
    if not about or StructType.fromJson(about["schema"]) != schema:  # before the data, so that a write that fails can be run again
        text = json.dumps(form | {"schema": json.loads(schema.json())})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{ABOUT}")
    writer = out.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*PLACE).parquet(path)


def write_windows(bars: DataFrame, path: str) -> None:
    """Window CSVs in folders by symbol, interval and window (its first and last day), times as yyyy-MM-dd HH:mm:ss, in time order."""
    tag = timefn.window_tag(F.col("start"), F.col("end"))
    out = bars.select("symbol", "interval", tag.alias("window"), F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("datetime"), *BARS)
    out = out.repartition("symbol", "interval", "window").sortWithinPartitions("symbol", "interval", "window", "datetime")
    out.write.mode("overwrite").option("header", True).partitionBy("symbol", "interval", "window").csv(path)


def page_symbols(pages: DataFrame, pattern: str, longest: int = 20) -> DataFrame:
    """Distinct symbols that the pattern's first group finds in pages: upper case, without slashes, not too long."""
    found = pages.select(F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("symbol"))
    found = found.select(F.upper(F.replace("symbol", F.lit("/"), F.lit(""))).alias("symbol"))
    return found.where(F.length("symbol").between(1, longest)).distinct()


def _price(name: str) -> Column:
    value = F.col(name).try_cast("double")
    bad = F.col(name).isNotNull() & value.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{name} is no number: "), F.col(name).cast("string"))).cast("double")).otherwise(value).alias(name)


def mt4_rows(bars: DataFrame) -> DataFrame:
    """Rows of the MT4 export: date, time, prices, and volume rounded half to even (null as 0).

    A row without a time, or with a price that is no number, is an error; a null price stays null.
    """
    at = F.when(F.col("datetime").isNull(), F.raise_error(F.lit("a bar without a time")).cast("timestamp_ntz")).otherwise(F.col("datetime"))
    return bars.select(
        "symbol",
        F.date_format(at, "yyyy.MM.dd").alias("date"),
        F.date_format(at, "HH:mm").alias("time"),
        *[_price(c) for c in ("open", "high", "low", "close")],
        half_even_long(F.col("volume")).alias("volume"),
    )


def column_arrays(bars: DataFrame, key: list[str], period: str | None = None) -> DataFrame:
    """One row a series, with one array a column, all in time order; with a period (year, month or day), one row for each
    of them, under ``period``, so that the length of a row is bounded."""
    names = ["datetime", "open", "high", "low", "close", "volume"]
    rows = F.array_sort(F.collect_list(F.struct(*names)))
    by = [*key, *([period_of(F.col("datetime"), period).alias("period")] if period else [])]
    out = bars.groupBy(*by).agg(rows.alias("r"))
    return out.select(*key, *(["period"] if period else []), *[F.col(f"r.{n}").alias(n) for n in names])
