"""Listings, chart and screener payloads, vendor bars, and the text forms of catalogs, issues and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import names
from tickloom.functions.timefn import NTZ, to_zone
from tickloom.operators import shape
from tickloom.operators.store import keep_last, upsert
from tickloom.sources import files

CATALOG = ["symbol", "name", "exchange", "asset_type", "market_category", "is_etf", "is_fund", "fund_category"]
LEDGER = ["version", "symbol", "interval", "start", "end", "asset_type", "adjust", "reason", "created_at"]
#: Payload forms and vendor headers. Fixed values.
CHART = """chart struct<result: array<struct<timestamp: array<bigint>, indicators: struct<
  quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>>,
  adjclose: array<struct<adjclose: array<double>>>>>>>"""
SCREENER = """finance struct<result: array<struct<quotes: array<struct<symbol: string, shortName: string, longName: string,
  displayName: string, exchange: string>>>>>"""
VENDOR_NAMES = {"日期": "datetime", "时间": "datetime", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume"}


def _text(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def _flag(name: str) -> Column:
    v = F.upper(_text(name))
    return F.when(v == "Y", True).when(v == "N", False)


def catalog_rows(text: DataFrame) -> DataFrame:
    """Catalog rows of a CSV's text columns: blanks null, no rows without symbol, Y and N as flags, type stock where none is given."""
    lack = [c for c in CATALOG if c not in text.columns]
    t = text.withColumns({c: F.lit(None).cast("string") for c in lack}) if lack else text
    plain = [_text(c).alias(c) for c in ("symbol", "name", "exchange")]
    rest = [F.coalesce(_text("asset_type"), F.lit("stock")).alias("asset_type"), _text("market_category").alias("market_category")]
    flags = [_flag(c).alias(c) for c in ("is_etf", "is_fund")]
    return t.select(*plain, *rest, *flags, _text("fund_category").alias("fund_category")).where("symbol is not null")


def scan_catalog(spark: SparkSession, path: str) -> DataFrame:
    return catalog_rows(spark.read.option("header", True).csv(path))


def catalog_text(catalog: DataFrame) -> DataFrame:
    """The catalog as text columns: nulls empty, flags Y, N or empty."""

    def text(name: str) -> Column:
        c = F.col(name)
        return F.when(c, "Y").when(~c, "N") if name.startswith("is_") else c

    return catalog.select(*[F.coalesce(text(c), F.lit("")).alias(c) for c in CATALOG])


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def listing_rows(text: DataFrame, symbol: str) -> DataFrame:
    """Catalog rows of an exchange's listing; blank symbols and the trailer that tells the file's time are left out."""
    name = next(c for c in ("Security Name", "SecurityName") if c in text.columns)

    def given(c: str) -> Column:
        return _text(c) if c in text.columns else F.lit(None).cast("string")

    market, etf = given("Market Category"), F.upper(given("ETF"))
    exchange = F.coalesce(given("Exchange"), F.when(market.isNotNull(), "NASDAQ"))
    rows = text.select(
        _text(symbol).alias("symbol"), _text(name).alias("name"), exchange.alias("exchange"), market.alias("market_category"),
        F.when(etf == "Y", True).when(etf.isNotNull(), False).alias("is_etf"),
    )
    return rows.where(F.col("symbol").isNotNull() & ~F.startswith("symbol", F.lit("File Creation")))


def scan_listing(spark: SparkSession, path: str, symbol: str = "Symbol") -> DataFrame:
    return listing_rows(spark.read.option("header", True).option("sep", "|").csv(path), symbol)


def chart_bars(payloads: DataFrame, column: str, key: list[str], zone: str = "Asia/Shanghai") -> DataFrame:
    """Bars of chart payloads, whose arrays run in parallel; times local to the zone, rows without a close left out."""
    r = F.get(F.from_json(column, CHART).getField("chart").getField("result"), F.lit(0))
    df = payloads.select(*key, r.alias("_r"))
    quote = F.get(F.col("_r.indicators.quote"), F.lit(0))
    adjusted = F.get(F.col("_r.indicators.adjclose"), F.lit(0)).getField("adjclose")
    ohlcv = shape.BASE[1:]
    arrays = [F.col("_r.timestamp").alias("t"), *[quote.getField(c).alias(c) for c in ohlcv], adjusted.alias("adjusted_close")]
    df = df.select(*key, *arrays)
    zipped = F.arrays_zip("t", *ohlcv, F.coalesce("adjusted_close", F.array().cast("array<double>")).alias("adjusted_close"))
    rows = df.select(*key, F.explode(zipped).alias("b"))
    at = to_zone(F.timestamp_seconds("b.t").cast(NTZ), "UTC", zone)
    fields = [F.col("b").getField(c).alias(c) for c in [*ohlcv, "adjusted_close"]]
    return rows.select(*key, at.alias("datetime"), *fields).where("close is not null and datetime is not null")


def screener_catalog(payloads: DataFrame, column: str) -> DataFrame:
    """(symbol, name, exchange) of screener payloads; the first name that is not blank."""
    r = F.get(F.from_json(column, SCREENER).getField("finance").getField("result"), F.lit(0))
    q = payloads.select(F.explode(r.getField("quotes")).alias("q")).select("q.*")
    rows = q.select(_text("symbol").alias("symbol"), F.coalesce(*[_text(c) for c in ("shortName", "longName", "displayName")]).alias("name"), "exchange")
    return rows.where("symbol is not null")


def vendor_bars(raw: DataFrame, key: list[str]) -> DataFrame:
    """Bars under a vendor's own headers; times as yyyy-MM-dd or yyyyMMddHHmmss (further digits ignored), others null."""
    df = raw.withColumnsRenamed({k: v for k, v in VENDOR_NAMES.items() if k in raw.columns})
    source = next(c for c in ("time", "datetime", "date") if c in df.columns)
    text = F.trim(F.col(source).cast("string"))
    at = F.when(text.rlike(r"^\d{14}"), F.try_to_timestamp(F.substring(text, 1, 14), F.lit("yyyyMMddHHmmss")))
    at = at.otherwise(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast(NTZ)
    return shape.conform(df.withColumn("datetime", at), key)


def configured_catalog(spark: SparkSession, symbols: list[str], source: str) -> DataFrame:
    """Catalog rows of configured symbols: trimmed, upper case, no blanks."""
    rows = spark.createDataFrame([(s,) for s in symbols], "symbol string").select(F.upper(F.trim("symbol")).alias("symbol"))
    return rows.where("symbol <> ''").withColumn("name", F.concat("symbol", F.lit(f" ({source})"))).distinct()


def ledger_rows(failures: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Failures as text rows of the ledger, stamped with the time they are written."""
    fixed = {"version": F.lit("1"), "created_at": F.current_timestamp() if created_at is None else created_at}

    def value(c: str) -> Column:
        return fixed[c] if c in fixed else F.col(c) if c in failures.columns else F.lit("")

    return failures.select(*[F.coalesce(value(c).cast("string"), F.lit("")).alias(c) for c in LEDGER])


ISSUES = ["path", "symbol", "interval", "rule_id", "severity", "message", "n", "created_at"]


def issue_rows(issues: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Issues in the fixed order of columns, as text; what an issue lacks is empty, the message tells the rule and its number."""
    made = {
        "message": F.concat_ws("=", "rule_id", F.col("n").cast("string")),
        "created_at": F.current_timestamp() if created_at is None else created_at,
    }

    def value(c: str) -> Column:
        return F.col(c) if c in issues.columns else made.get(c, F.lit(""))

    return issues.select(*[F.coalesce(value(c).cast("string"), F.lit("")).alias(c) for c in ISSUES])


def write_issues(issues: DataFrame, path: str, form: str = "json", created_at: Column | None = None) -> None:
    """The issues as JSON lines, or as CSV with a header."""
    rows = issue_rows(issues, created_at)
    if form == "json":
        rows.write.mode("overwrite").json(path)
    else:
        write_csv(rows, path)


def bridge_csv(
    spark: SparkSession, root: str, store: DataFrame | None = None, source: str = "csv", symbol: str | None = None, interval: str | None = None
) -> DataFrame:
    """Bars of a tree of window CSVs, or of one symbol's or interval's, with their source, merged over the bars of ``store``
    if that is given."""
    rows = files.scan_window_csv(spark, root, symbol, interval).where("datetime is not null")
    rows = keep_last(rows, ["symbol", "interval", "datetime"], ["file"])
    new = rows.select("symbol", "interval", *shape.BASE, F.lit(source).alias("source"), F.col("file").alias("seq"))
    old = None if store is None else store.withColumn("seq", F.lit(""))
    return (new if old is None else upsert(old, new, ["symbol", "interval", "datetime"])).drop("seq")


def mt4_batch(windows: DataFrame, symbol: str | None = None, interval: str | None = None) -> DataFrame:
    """MT4 rows of many window files: per series the later file wins; intervals that the format lacks are left out.

    With a symbol or an interval only its files count, whatever the case of their letters.
    """
    for column, want in (("symbol", symbol), ("interval", interval)):
        if want and want.strip():
            windows = windows.where(F.upper(column) == want.strip().upper())
    code = names.vendor_interval("mt4", F.col("interval"))
    rows = windows.withColumn("mt4_interval", code).where("mt4_interval is not null and datetime is not null")
    rows = keep_last(rows, ["symbol", "mt4_interval", "datetime"], ["file"])
    bars = rows.select(F.concat_ws("_", "symbol", "mt4_interval").alias("symbol"), *shape.BASE)
    return files.mt4_rows(bars).withColumnRenamed("symbol", "series")


def range_cache_put(ranges: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Cached ranges (symbol, interval, start, end) with the new ones; the last written wins, empty ones are ignored."""
    return upsert(ranges, new.where("n_rows > 0"), ["symbol", "interval", "start", "end"], seq)
