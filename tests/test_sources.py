import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.operators import shape, windows
from tickloom.sources import files, listings

T = dt.datetime
HEAD = "datetime,open,high,low,close,volume\n"


def put(root, name, *rows):
    (root / name).write_text(HEAD + "".join(r + "\n" for r in rows))


def test_mt4_batch_takes_the_later_file(spark, tmp_path):
    put(tmp_path, "XAU_1m_20240101_20240102.csv", "2024-01-01 00:00:00,100,101,99,100,12.0", "2024-01-01 00:01:00,1,1,1,1,12.5")
    put(tmp_path, "XAU_1m_20240102_20240103.csv", "2024-01-01 00:01:00,200,202,199.8,201,12", "2024-01-01 00:02:00,1,1,1,1,")
    put(tmp_path, "XAU_7m_20240102_20240103.csv", "2024-01-01 00:01:00,1,1,1,1,1")
    put(tmp_path, "badname.csv", "2024-01-01 00:01:00,1,1,1,1,1")
    got = listings.mt4_batch(files.scan_window_csv(spark, str(tmp_path))).orderBy("time").collect()
    assert [(r.series, r.time, r.close, r.volume) for r in got] == [("XAU_M1", "00:00", 100.0, 12), ("XAU_M1", "00:01", 201.0, 12), ("XAU_M1", "00:02", 1.0, 0)]


def test_bridge_merges_over_the_store(spark, tmp_path):
    put(tmp_path, "A_1m_20240101_20240102.csv", "2024-01-01 00:00:00,1,1,1,1,1", "bad,1,1,1,1,1")
    old = listings.bridge_csv(spark, str(tmp_path)).withColumn("close", F.lit(9.0))
    old = old.unionByName(old.withColumn("datetime", F.lit(T(2023, 1, 1)).cast("timestamp_ntz")))
    got = listings.bridge_csv(spark, str(tmp_path), old).orderBy("datetime").collect()
    assert [(r.datetime.year, r.close, r.source) for r in got] == [(2023, 9.0, "csv"), (2024, 1.0, "csv")]


def test_catalog_survives_its_text_form(spark, tmp_path):
    rows = spark.createDataFrame(
        [("A", "n", None, "stock", None, True, None, "ETF"), ("B", None, "X", "stock", "Q", False, True, None)],
        "symbol string, name string, exchange string, asset_type string, market_category string, is_etf boolean, is_fund boolean, fund_category string",
    )
    listings.write_csv(listings.catalog_text(rows), str(tmp_path / "c"))
    assert sorted(listings.scan_catalog(spark, str(tmp_path / "c")).collect()) == sorted(rows.collect())


def test_names_and_shapes(spark):
    assert shape.unique_names(["x", "x", "", "x_1", "x"]) == ["x", "x_2", "col", "x_1", "x_3"]
    df = shape.normalize_columns(spark.createDataFrame([("2024-01-01", 1.0, 2.0)], ["Date", "Close", "Adj Close"]))
    assert df.columns == ["datetime", "close", "adjusted_close"]
    assert shape.schema_report(df) == {"missing": ["open", "high", "low", "volume"], "adjusted": True}
    assert shape.conform(df, []).first().datetime == T(2024, 1, 1)
    with pytest.raises(ValueError):
        shape.require_ohlcv(df)
    with pytest.raises(ValueError):
        shape.resolve_time(spark.range(1).toDF("n"))
    ms = shape.epoch_time(spark.createDataFrame([(1704067200000,)], "t long"), "t").first().t
    assert ms == T(2024, 1, 1)


def rows(spark, data, interval="5m", hours=1):
    schema = "pos long, datetime string, open double, high double, low double, close double, volume double"
    end = T(2024, 1, 1) + dt.timedelta(hours=hours)
    at = {"symbol": F.lit("A"), "interval": F.lit(interval), "start": F.lit(T(2024, 1, 1)).cast("timestamp_ntz"), "end": F.lit(end).cast("timestamp_ntz")}
    return spark.createDataFrame(data, schema).withColumns(at)


def test_a_full_window_passes_and_a_bad_low_fails(spark):
    good = [(i, f"2024-01-01 00:{5 * i:02d}:00", 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(12)]
    r = rows(spark, good)
    w = r.select(*windows.KEY)
    assert windows.check_windows(r, w).first().status == "pass"
    bad = windows.check_windows(r.withColumn("low", F.when(F.col("pos") == 0, 2.0).otherwise(F.col("low"))), w).first()
    assert (bad.status, bad.fails) == ("fail", ["ohlc_relation_invalid:1"])
    assert windows.check_windows(r, w, missing_columns=["volume"]).first().fails == ["missing_columns:volume"]
    assert windows.check_windows(r.limit(0), w).first().fails == ["no_data_rows"]


def test_daily_bars_off_the_close_only_warn(spark):
    r = rows(spark, [(1, "2024-01-01 22:00:00", 1.0, 1.0, 1.0, 1.0, 1.0), (2, "2024-01-02 21:00:00", 1.0, 1.0, 1.0, 1.0, 1.0)], "1d", 48)
    c = windows.check_windows(r, r.select(*windows.KEY))
    assert (c.first().status, c.first().warns) == ("warn", ["1d_alignment_invalid:1"])
    assert (c.where(windows.repair_needed()).count(), c.where(windows.repair_needed(True)).count()) == (0, 1)
    plan = windows.repair_plan(windows.repair_groups(c, True), spark.createDataFrame([], "symbol string, start timestamp_ntz, end timestamp_ntz, reason string"), ["1m"])
    assert (plan.first().action, plan.first().force) == ("rebuild_1d_from_1m", True)


def test_daily_bars_are_rebuilt_from_full_minutes_only(spark):
    start, minute = T(2024, 1, 1), dt.timedelta(minutes=1)
    data = [(s, start + k * minute, 1.0, 1.0, 1.0, 1.0, 1.0) for s, n in (("A", 60), ("B", 59)) for k in range(n)]
    m = spark.createDataFrame(data, "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume double")
    w = spark.createDataFrame([(s, start, start + 60 * minute) for s in "ABC"], "symbol string, start timestamp_ntz, end timestamp_ntz")
    bars, status = windows.rebuild_daily(m, w)
    assert {r.symbol: r.status for r in status.collect()} == {"A": "rebuilt", "B": "incomplete_1m", "C": "missing_1m"}
    assert [(r.symbol, r.volume) for r in bars.collect()] == [("A", 60.0)]


BARS = "asset_type string, interval string, symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, seq long"


def bar(symbol, day, close, seq=0, interval="1d"):
    return ("stock", interval, symbol, T(2024, 1, day), 1.0, 1.0, 1.0, close, 1.0, seq)


def test_writing_one_series_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "store")
    write = lambda *rows: files.write_bars(spark.createDataFrame(list(rows), BARS), path, "seq", buckets=2)
    write(bar("A", 1, 1.0), bar("A", 2, 2.0), bar("A", 2, 2.5, 1))
    write(bar("B", 1, 3.0), bar("C", 1, 4.0), bar("A", 1, 9.0, interval="1h"))
    write(bar("A", 2, 5.0), bar("A", 3, 6.0))
    got = {(r.symbol, r.interval, r.datetime.day): r.close for r in spark.read.parquet(path).collect()}
    assert got == {("A", "1d", 1): 1.0, ("A", "1d", 2): 5.0, ("A", "1d", 3): 6.0, ("B", "1d", 1): 3.0, ("C", "1d", 1): 4.0, ("A", "1h", 1): 9.0}


def test_stream_upserts_into_the_store(spark, tmp_path):
    from tickloom.streaming.bars import stream_upsert

    landing, path = str(tmp_path / "in"), str(tmp_path / "store")
    for rows in ([bar("A", 1, 1.0), bar("B", 1, 2.0)], [bar("A", 1, 7.0)]):
        spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(landing)
        q = stream_upsert(spark.readStream.schema(BARS).parquet(landing), path, str(tmp_path / "c"))
        q.awaitTermination()
    assert {(r.symbol, r.close) for r in spark.read.parquet(path).collect()} == {("A", 7.0), ("B", 2.0)}


def test_scan_prunes_and_a_missing_root_is_empty(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    one = pa.table({"datetime": [T(2024, 1, 1)], "close": [1.0]})
    for place in ("stock/A/1d_20240101_20240131.parquet", "stock/B/1h_20240101_20240131.parquet", "fund/A/1d_20240101_20240131.parquet"):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(one, tmp_path / place)
    got = files.scan_bars(spark, str(tmp_path), "1d", asset_type="stock")
    assert files.scan_bars(spark, str(tmp_path / "none")).isEmpty() and files.scan_bars(spark, str(tmp_path), "5m").isEmpty()
    assert [(r.asset_type, r.symbol, r.interval) for r in got.collect()] == [("stock", "A", "1d")]


def test_binary_ticks(spark, tmp_path):
    import lzma
    import struct

    good = b"".join(struct.pack(">3i2f", *r) for r in [(0, 200, 100, 4e-6, 1e-6), (1500, 210, 110, 0.0, 0.0), (3_600_000, 1, 1, 1.0, 1.0)])
    (tmp_path / "XAG_2024-01-02_03").write_bytes(lzma.compress(good))
    (tmp_path / "XAG_2024-01-02_04").write_bytes(b"broken")
    (tmp_path / "XAG_2024-01-02_05").write_bytes(b"")
    (tmp_path / "notes").write_bytes(b"x")
    got = files.scan_tick_binary(spark, str(tmp_path), 10.0).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [("XAG", T(2024, 1, 2, 3), 15.0, 5.0, 0), ("XAG", T(2024, 1, 2, 3, 0, 1, 500000), 16.0, None, 1)]


def test_exports_name_bad_rows(spark):
    good = spark.createDataFrame([("A", T(2024, 1, 1), "1.5", 1.0, None, 1.0, 12.5)], "symbol string, datetime timestamp_ntz, open string, high double, low double, close double, volume double")
    assert tuple(files.mt4_rows(good).first()) == ("A", "2024.01.01", "00:00", 1.5, 1.0, None, 1.0, 12)
    for bad in (good.withColumn("open", F.lit("x")), good.withColumn("datetime", F.lit(None).cast("timestamp_ntz"))):
        with pytest.raises(Exception, match="no number|without a time"):
            files.mt4_rows(bad).collect()


def test_issue_and_window_files(spark, tmp_path):
    found = spark.createDataFrame([("A", "close.has_nulls", "WARN", 3)], "symbol string, rule_id string, severity string, n long")
    for form in ("json", "csv"):
        listings.write_issues(found, str(tmp_path / form), form, F.lit("now"))
    assert spark.read.json(str(tmp_path / "json")).first().message == "close.has_nulls=3"
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == listings.ISSUES
    b = spark.createDataFrame([("A", "1m", T(2024, 1, 1), T(2024, 1, 2), T(2024, 1, 1, 5), 1.0, 1.0, 1.0, 1.0, 1.0)], "symbol string, interval string, start timestamp_ntz, end timestamp_ntz, datetime timestamp_ntz, open double, high double, low double, close double, volume double")
    files.write_windows(b, str(tmp_path / "w"))
    got = spark.read.option("header", True).csv(str(tmp_path / "w")).first()
    assert (got.datetime, got.window) == ("2024-01-01 05:00:00", "20240101_20240102")


def test_ledger_strictness_and_row_numbers(spark):
    from tickloom.operators import ledger

    schema = "seq long, symbol string, interval string, start string, end string, adjust string, asset_type string"
    rows = spark.createDataFrame([(0, "A", "1d", "2024-01-01", "2024-01-02", "front", None), (1, "A", "1d", "not-a-date", "2024-01-02", "", None)], schema)
    got = ledger.validate(rows, "2020-01-01", "2021-01-01", seq="seq").orderBy("seq").collect()
    assert [(r.row, r.valid, r.warnings) for r in got] == [(2, True, []), (3, True, ["bad_start"])]
    with pytest.raises(Exception, match="bad ledger row 3"):
        ledger.validate(rows, "2020-01-01", "2021-01-01", strict=True, seq="seq").collect()


def test_feeds_with_epoch_numbers_and_keep_last(spark):
    raw = spark.createDataFrame([(1704067200, 2.0, 1.0, 3.0), (1704067200, 9.0, 9.0, 9.0)], "Time long, ask double, Bid double, askvol double").withColumn("n", F.monotonically_increasing_id())
    got = shape.normalize_ticks(raw, [], seq="n").collect()
    assert [tuple(r) for r in got] == [(T(2024, 1, 1), 1.5, 3.0)]
    bars = spark.createDataFrame([("2024-01-01", 1.0, 0), ("2024-01-01", 2.0, 1)], "datetime string, close double, n long")
    assert [r.close for r in shape.conform(bars, [], "n").collect()] == [2.0]
    with pytest.raises(Exception, match="unknown interval"):
        from tickloom.functions import timefn

        spark.range(1).select(timefn.checked_interval_seconds(F.lit("bad"))).collect()


def test_post_check_and_empty_windows(spark):
    good = rows(spark, [(i, f"2024-01-01 00:{5 * i:02d}:00", 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(12)])
    assert windows.post_check(good, good).isEmpty()
    assert windows.post_check(good, good.where("pos > 0")).first().reason == "row_count_mismatch:11!=12"
    assert windows.post_check(good, good.limit(0)).first().reason == "missing_file"
    assert windows.integrity_issues(good.where("pos > 0"), good).first().issues[-1] == "first_timestamp_unexpected"
