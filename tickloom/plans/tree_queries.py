"""Queries that write the given tables as trees of files, read them back and check them, each with its SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import bars, quality, shape, store, validation, windows
from tickloom.plans import views
from tickloom.plans.queries import ORACLE_SQL, QUERIES, SQL_1M, SQL_DIRTY, SQL_PROFILE, SQL_TICKS, query
from tickloom.sources import files, listings, tree
from tickloom.sources.shared import scratch


def _overwrite(paths: DataFrame, damage: str) -> None:
    """Damages the files: ``cut`` leaves half of them, ``blank`` fills the first half with zeros, ``empty`` leaves nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                fs, at = tree.open_path(path)
                with fs.open_input_file(at) as f:
                    raw = f.read()
                half = len(raw) // 2
                with fs.open_output_stream(at) as f:
                    f.write({"cut": raw[:half], "blank": raw[:4] + bytes(half) + raw[half + 4 :], "empty": b""}[damage])
            yield batch

    tree.run(paths.mapInPandas(run, "path string"))


def _digit(symbol: Column) -> Column:
    return symbol.cast("long") % 10


def _damaged_tree(spark: SparkSession, d: str) -> str:
    """lineitem's daily bars as a tree by supplier; of the last digit of its number 3 files are cut short, 5 lack the
    volume, 7 the close, 9 have damaged pages."""
    root = scratch(spark, "tree")
    rows = views.dirty_bars(spark, d).drop("seq").withColumns({"asset_type": F.lit("stock"), "interval": F.lit("1d")})
    digit = _digit(F.col("symbol"))
    for part in (rows.where(~digit.isin(5, 7)), rows.where(digit == 5).drop("volume"), rows.where(digit == 7).drop("close")):
        tree.run(tree.write_series_files(part, root))
    listed = tree.listed(spark, root, ".parquet").select("path")
    number = _digit(F.element_at(F.split("path", "/"), -2))
    for n, damage in ((3, "cut"), (9, "blank")):
        _overwrite(listed.where(number == n), damage)
    return root


SQL_TREE = f"""{SQL_DIRTY}, {SQL_PROFILE}, q AS (SELECT *, CAST(symbol AS BIGINT) % 10 AS d FROM p),
neg AS (SELECT symbol, count(*) FILTER (WHERE least(open, high, low, CASE WHEN CAST(symbol AS BIGINT) % 10 <> 7 THEN close END,
  CASE WHEN CAST(symbol AS BIGINT) % 10 <> 5 THEN volume END) < 0) AS n FROM bars GROUP BY symbol),
i AS (SELECT symbol, 'parquet.read_failed' AS rule_id, 'ERROR' AS severity, 1 AS n FROM q WHERE d = 3 UNION ALL
SELECT symbol, 'schema.missing_close', 'ERROR', 1 FROM q WHERE d = 7 UNION ALL
SELECT symbol, 'schema.missing_volume', 'WARN', 1 FROM q WHERE d = 5 UNION ALL
SELECT symbol, 'datetime.stats_failed', 'WARN', n_rows FROM q WHERE d = 9 UNION ALL
SELECT symbol, 'datetime.duplicated', 'WARN', duplicates FROM q WHERE duplicates > 0 AND d NOT IN (3, 9) UNION ALL
SELECT symbol, 'datetime.gap_too_large', 'WARN', max_gap_s FROM q WHERE max_gap_s > 864000 AND d NOT IN (3, 9) UNION ALL
SELECT symbol, 'close.has_nulls', 'WARN', null_close FROM q WHERE null_close > 0 AND d NOT IN (3, 7, 9) UNION ALL
SELECT symbol, 'ohlc.invalid_range', 'WARN', bad_range FROM q WHERE bad_range > 0 AND d NOT IN (3, 7, 9) UNION ALL
SELECT symbol, 'values.negative', 'WARN', neg.n FROM q JOIN neg USING (symbol) WHERE neg.n > 0 AND d NOT IN (3, 9))"""


@query(f"WITH {SQL_TREE} SELECT 'stock' AS asset_type, symbol, '1d' AS interval, rule_id, severity, n FROM i")
def tree_issues(spark: SparkSession, d: str) -> DataFrame:
    return validation.validate_tree(spark, _damaged_tree(spark, d))[1].drop("path")


@query(
    f"""WITH {SQL_TREE} SELECT symbol, CASE WHEN d <> 3 THEN n_rows END AS n_rows, CASE WHEN d IN (3, 9) THEN 0 ELSE n_rows END AS n_read,
  CASE d WHEN 3 THEN NULL WHEN 5 THEN 'volume' WHEN 7 THEN 'close' ELSE '' END AS missing_columns,
  CASE WHEN d NOT IN (3, 9) THEN min_dt END AS min_dt, CASE WHEN d NOT IN (3, 9) THEN max_dt END AS max_dt,
  CASE WHEN d NOT IN (3, 9) THEN duplicates END AS duplicates, CASE WHEN d NOT IN (3, 9) THEN max_gap_s END AS max_gap_s,
  CASE WHEN d NOT IN (3, 7, 9) THEN null_close END AS null_close, CASE WHEN d NOT IN (3, 7, 9) THEN bad_range END AS bad_range FROM q"""
)
def tree_summaries(spark: SparkSession, d: str) -> DataFrame:
    found = validation.validate_tree(spark, _damaged_tree(spark, d))[0]
    kept = ["symbol", "n_rows", "n_read", "min_dt", "max_dt", "duplicates", "max_gap_s", "null_close", "bad_range"]
    return found.select(*kept, F.array_join("missing_columns", ",").alias("missing_columns"))


@query(
    f"""WITH {SQL_TREE} SELECT count(*) FILTER (WHERE severity = 'ERROR') AS errors, count(*) FILTER (WHERE severity = 'WARN') AS warnings,
  count(DISTINCT symbol) FILTER (WHERE severity = 'ERROR') AS files_with_errors, count(DISTINCT symbol) FILTER (WHERE severity = 'WARN') AS files_with_warnings FROM i"""
)
def tree_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return validation.files_with_issues(validation.validate_tree(spark, _damaged_tree(spark, d))[1])


def _day_bars(spark: SparkSession, d: str) -> DataFrame:
    """events as minute bars of day windows, with a code from 0 to 4 of what becomes of the window's file."""
    b = bars.bars_from_ticks(views.ticks(spark, d))
    day = F.date_trunc("DAY", "datetime").cast("timestamp_ntz")
    b = b.select(F.col("symbol"), F.lit("1m").alias("interval"), day.alias("start"), (day + F.expr("INTERVAL 1 DAY")).alias("end"), "datetime", *files.BARS)
    return b.withColumn("code", (F.dayofmonth("start") + F.length("symbol")) % 5)


def _window_files(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """Window CSVs of the day windows: code 0 is not written, 1 emptied, 2 written without a volume; and the windows."""
    root = scratch(spark, "windows")
    b = _day_bars(spark, d)
    for part in (b.where("code in (1, 3, 4)"), b.where("code = 2").drop("volume")):
        tree.run(tree.write_window_files(part.drop("code"), root))
    w = b.select("symbol", "interval", "start", "end", "code").distinct()
    name = F.element_at(F.split("path", "/"), -1)
    day = F.to_timestamp_ntz(F.regexp_extract(name, files.WINDOW_NAME, 3), F.lit("yyyyMMdd"))
    code = (F.dayofmonth(day) + F.length(F.regexp_extract(name, files.WINDOW_NAME, 1))) % 5
    _overwrite(tree.listed(spark, root, ".csv").select("path").where(code == 1), "empty")
    return root, w


SQL_DAYS = f"""{SQL_TICKS}, {SQL_1M}, k AS (SELECT *, date_trunc('day', datetime) AS s FROM m),
w AS (SELECT symbol, s, (dayofmonth(s) + length(symbol)) % 5 AS code, count(*) AS n, round(avg(CASE WHEN volume IS NULL THEN 1.0 ELSE 0.0 END), 6) AS vr FROM k GROUP BY ALL)"""


@query(
    f"""WITH {SQL_DAYS}, f AS (SELECT *, CASE code WHEN 0 THEN ['missing_file'] WHEN 1 THEN ['empty_file'] WHEN 2 THEN ['missing_columns:volume']
  ELSE list_filter([CASE WHEN n <> 1440 THEN 'row_count_mismatch:' || n || '!=1440' END, CASE WHEN n < 1440 THEN 'missing_timestamps:' || (1440 - n) END], lambda x: x IS NOT NULL) END AS fails FROM w)
SELECT symbol, '1m' AS interval, s AS "start", s + INTERVAL 1 DAY AS "end", CASE WHEN len(fails) > 0 THEN 'fail' WHEN vr > 0.8 THEN 'warn' ELSE 'pass' END AS status,
  array_to_string(fails, '|') AS fails, CASE WHEN code > 2 THEN n ELSE 0 END AS n_rows, 1440 AS expected FROM f"""
)
def window_files_checked(spark: SparkSession, d: str) -> DataFrame:
    root, w = _window_files(spark, d)
    checked = validation.check_window_files(spark, root, w.drop("code"))
    return checked.select("symbol", "interval", "start", "end", "status", F.array_join("fails", "|").alias("fails"), "n_rows", "expected")


@query(
    f"""WITH {SQL_DAYS}, t AS (SELECT min(symbol) AS s0 FROM w) SELECT k.symbol, '1m' AS interval, k.datetime, open, high, low, close, volume
FROM k JOIN w USING (symbol, s), t WHERE code > 2 AND symbol = s0"""
)
def window_files_of_symbol(spark: SparkSession, d: str) -> DataFrame:
    """Reads back the windows of one symbol only."""
    root, w = _window_files(spark, d)
    symbol = w.agg(F.min("symbol")).first()[0]
    found = files.scan_window_csv(spark, root, symbol=symbol, interval="1m").join(
        w.where("code > 2").select("symbol", F.date_format("start", "yyyyMMdd").alias("window_start")), ["symbol", "window_start"], "left_semi"
    )
    return found.select("symbol", "interval", "datetime", *files.BARS)


@query(
    f"""WITH {SQL_DAYS} SELECT symbol, s AS "start", s + INTERVAL 1 DAY AS "end" FROM w WHERE code IN (0, 1)"""
)
def windows_left(spark: SparkSession, d: str) -> DataFrame:
    """The windows that a resumed run still has to make: those without a file, or with an empty one."""
    root, w = _window_files(spark, d)
    return windows.open_windows(w.select("symbol", "start", "end"), tree.written_windows(spark, root), ["1m"])


@query(
    f"""WITH {SQL_DIRTY}, u AS (SELECT *, 0 AS n FROM bars WHERE seq % 3 <> 0 UNION ALL SELECT *, 1 AS n FROM bars WHERE seq % 3 = 0)
SELECT 'stock' AS asset_type, '1d' AS interval, strftime(datetime, '%Y') AS period, symbol, datetime, open, high, low, close, volume, seq FROM u
QUALIFY row_number() OVER (PARTITION BY symbol, datetime ORDER BY n DESC, seq DESC) = 1"""
)
def stored_bars(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping writes of lineitem's bars into a store by year and bucket, read back."""
    path = scratch(spark, "store")
    b = views.dirty_bars(spark, d).withColumns({"asset_type": F.lit("stock"), "interval": F.lit("1d")})
    files.write_bars(b.where("seq % 3 <> 0"), path, "seq", buckets=4)
    files.write_bars(b.where("seq % 3 = 0"), path, "seq")
    return files.read_store(spark, path).drop("bucket")


@query(
    """SELECT l_suppkey % 2 = 0 OR count(DISTINCT l_shipdate) = 1 AS monotonic, CAST(l_suppkey AS VARCHAR) AS symbol FROM lineitem GROUP BY l_suppkey"""
)
def rising_files(spark: SparkSession, d: str) -> DataFrame:
    """Which files' rows rise in time as they stand in the file; those of odd suppliers are written backwards."""
    root = scratch(spark, "ordered")
    rows = views.dirty_bars(spark, d).drop("seq").withColumns({"asset_type": F.lit("stock"), "interval": F.lit("1d")})
    sign = F.when(F.col("symbol").cast("long") % 2 == 0, 1).otherwise(-1)
    tree.run(tree.write_series_files(rows, root, F.unix_seconds(F.col("datetime").cast("timestamp")) * sign))
    found = quality.monotonic(tree.rows_in_order(spark, root), ["path"], "row")
    return found.select("monotonic", F.element_at(F.split("path", "/"), -2).alias("symbol"))


@query(
    """SELECT CAST(l_suppkey AS VARCHAR) AS symbol, min(l_shipdate) AS stored_start, max(l_shipdate) AS stored_max, count(*) AS stored_rows FROM lineitem GROUP BY l_suppkey"""
)
def coverage_from_footers(spark: SparkSession, d: str) -> DataFrame:
    """What a tree of series files covers, by the statistics in their footers."""
    root = scratch(spark, "covered")
    rows = views.dirty_bars(spark, d).drop("seq").withColumns({"asset_type": F.lit("stock"), "interval": F.lit("1d")})
    tree.run(tree.write_series_files(rows, root))
    return store.coverage_from_footers(tree.footers(spark, root), ["symbol"])


@query(
    """WITH t AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS h, ts, event_id, CAST(round_even(value * 1000, 0) AS BIGINT) AS ask, event_id % 5 + event_id % 3 AS v,
  row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) - 1 AS seq FROM events)
SELECT symbol, date_trunc('milliseconds', ts) AS datetime, (ask + ask - 2) / 2 / 1000 AS price, CAST(nullif(v, 0) AS DOUBLE) AS volume, seq FROM t WHERE hour(h) NOT IN (5, 7)"""
)
def tick_files(spark: SparkSession, d: str) -> DataFrame:
    """events packed into binary hour files and read back; the files of hour 5 are cut short, those of hour 7 emptied."""
    root = scratch(spark, "ticks")
    k = F.col("event_id")
    ask = F.bround(F.col("value") * 1000) / 1000
    t = views.table(spark, d, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("datetime"), ask.alias("ask"), (ask - 0.002).alias("bid"),
        ((k % 5) / 1e6).alias("ask_volume"), ((k % 3) / 1e6).alias("bid_volume"), k.alias("seq"),
    )
    tree.run(tree.write_tick_files(t, root, 1000))
    for hour, damage in (("05", "cut"), ("07", "empty")):
        _overwrite(tree.listed(spark, root, f"_{hour}").select("path"), damage)
    return files.scan_tick_binary(spark, root, 1000)


@query(
    f"""WITH {SQL_DAYS}, x AS (SELECT *, CASE WHEN code = 0 THEN 'fail' WHEN code = 1 THEN 'warn' ELSE 'pass' END AS status FROM w),
r AS (SELECT symbol, code % 2 AS odd, status, s FROM x),
y AS (SELECT symbol, CASE odd WHEN 0 THEN '1m' ELSE '5m' END AS interval, status, s FROM r)
SELECT symbol, interval, CASE WHEN grouping(symbol, interval) = 0 THEN 'symbol_interval' WHEN grouping(symbol, interval) = 1 THEN 'symbol' WHEN grouping(symbol, interval) = 2 THEN 'interval' ELSE 'all' END AS level,
  count(*) AS total, count_if(status = 'pass') AS pass, count_if(status = 'warn') AS warn, count_if(status = 'fail') AS fail,
  count(DISTINCT (symbol, s)) FILTER (WHERE status = 'fail') AS fail_windows, count(DISTINCT (symbol, s)) FILTER (WHERE status = 'warn') AS warn_windows,
  round(count_if(status = 'fail') / count(*), 6) AS failure_rate FROM y GROUP BY GROUPING SETS ((symbol, interval), (symbol), (interval), ())"""
)
def status_report(spark: SparkSession, d: str) -> DataFrame:
    code = F.col("code")
    w = _day_bars(spark, d).select("symbol", "start", "end", "code").distinct()
    status = F.when(code == 0, "fail").when(code == 1, "warn").otherwise("pass")
    return windows.status_report(w.withColumns({"interval": F.when(code % 2 == 0, "1m").otherwise("5m"), "status": status}))


@query(
    f"""WITH {SQL_DIRTY} SELECT 'stock' AS asset_type, symbol, '1d' AS interval, datetime, open, high, low, close, volume FROM bars WHERE CAST(symbol AS BIGINT) % 10 IN (0, 2, 4)"""
)
def scanned_bars(spark: SparkSession, d: str) -> DataFrame:
    """A tree of two asset types and two intervals, of which one pair is scanned."""
    root = scratch(spark, "scanned")
    digit = _digit(F.col("symbol"))
    rows = views.dirty_bars(spark, d).drop("seq")
    rows = rows.withColumns({"asset_type": F.when(digit % 2 == 0, "stock").otherwise("fund"), "interval": F.when(digit < 5, "1d").otherwise("1wk")})
    tree.run(tree.write_series_files(rows, root))
    return files.scan_bars(spark, root, interval="1d", asset_type="stock")


@query(
    f"""WITH {SQL_DAYS} SELECT k.symbol, '1m' AS interval, k.datetime, open, high, low, CASE WHEN code > 1 THEN close ELSE close + 1 END AS close, volume,
  CASE WHEN code > 1 THEN 'csv' ELSE 'old' END AS source FROM k JOIN w USING (symbol, s)"""
)
def bridged_windows(spark: SparkSession, d: str) -> DataFrame:
    """Window CSVs merged over a store that holds other prices."""
    root = scratch(spark, "bridged")
    b = _day_bars(spark, d)
    tree.run(tree.write_window_files(b.where("code > 1").drop("code"), root))
    held = b.select("symbol", "interval", "datetime", "open", "high", "low", (F.col("close") + 1).alias("close"), "volume", F.lit("old").alias("source"))
    return listings.bridge_csv(spark, root, held)


@query(
    f"""SELECT '' AS path, symbol, '' AS interval, rule_id, severity, rule_id || '=' || n AS message, CAST(n AS VARCHAR) AS n, '2024-01-01' AS created_at FROM ({ORACLE_SQL['validate_series']})"""
)
def issues_written(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "issues")
    listings.write_issues(QUERIES["validate_series"](spark, d), path, "json", F.lit("2024-01-01"))
    return spark.read.json(path).select(*listings.ISSUES)


@query(
    f"""WITH {SQL_DAYS} SELECT symbol, '1m' AS interval, s AS "start", s + INTERVAL 1 DAY AS "end", 'row_count_mismatch:' || n || '!=1440' AS reason FROM w WHERE n <> 1440 AND code > 0
UNION ALL SELECT symbol, '1m', s, s + INTERVAL 1 DAY, 'missing_file' FROM w WHERE code = 0"""
)
def post_checked(spark: SparkSession, d: str) -> DataFrame:
    """The windows that are still not fine after repairs; some have no rows at all."""
    b = _day_bars(spark, d).withColumn("pos", F.unix_seconds(F.col("datetime").cast("timestamp")))
    return windows.post_check(b.select(*windows.KEY).distinct(), b.where("code > 0"))


@query("""SELECT l_shipdate AS datetime, l_extendedprice AS open, l_extendedprice + 1 AS high, l_extendedprice - 1 AS low, l_extendedprice AS close, l_quantity AS volume FROM lineitem""")
def conformed_feed(spark: SparkSession, d: str) -> DataFrame:
    """A feed with headers of two levels, in mixed case, repeated and blank ones, brought to the columns of bars."""
    p = F.col("l_extendedprice")
    feed = views.table(spark, d, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias(" Date "), p.alias("('Open', 'X')"), (p + 1).alias("HIGH"), (p - 1).alias("('Low', '')"), p.alias("Close"),
        F.col("l_quantity").alias("Volume"), F.lit(0).alias("volume "), F.lit(0).alias(" "), (p / 2).alias("Adj Close"),
    )
    found = shape.normalize_columns(feed)
    report = shape.schema_report(found)
    if report["missing"] or not report["adjusted"]:
        raise ValueError(f"the feed lacks {report}")
    return shape.require_ohlcv(shape.resolve_time(found))
