"""Trees of files: footers, validation, file order, the bar store's layout, stitched buckets and the interval index."""

import datetime as dt
import itertools
import json
import os
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tickloom.functions import timefn
from tickloom.operators import bars, ledger, quality, shape, store, validation, windows
from tickloom.plans import tree_queries
from tickloom.plans.queries import ORACLE_SQL, QUERIES
from tickloom.sources import files, tree
from tickloom.streaming import bars as streams

T = dt.datetime
BAR = "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume double"


def days(n, step=1):
    return [T(2024, 1, 1) + dt.timedelta(days=k * step) for k in range(n)]


def put(root, symbol, columns, name="1d_20240101_20240103", kind="stock"):
    folder = root / kind / symbol
    folder.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), folder / f"{name}.parquet")
    return folder / f"{name}.parquet"


def bar_columns(**other):
    base = {"datetime": pa.array(days(3), pa.timestamp("us"))} | {c: [1.0, 2.0, 3.0] for c in files.BARS}
    return {k: v for k, v in (base | other).items() if v is not None}


@pytest.fixture
def broken_tree(tmp_path):
    put(tmp_path, "GOOD", bar_columns())
    put(tmp_path, "LONG+ 1", bar_columns(volume=pa.array([1, 2, -3], pa.int64()), datetime=pa.array(days(3), pa.timestamp("us", "UTC"))))
    put(tmp_path, "TEXT", bar_columns(close=["a", "b", "c"]))
    put(tmp_path, "NOTIME", bar_columns(datetime=None, open=None))
    put(tmp_path, "GAP", bar_columns(datetime=pa.array([T(2024, 1, 1), T(2024, 1, 1), T(2024, 3, 1)], pa.timestamp("us"))))
    put(tmp_path, "NAME", bar_columns(), name="plain", kind="fund")
    cut = put(tmp_path, "CUT", bar_columns())
    cut.write_bytes(cut.read_bytes()[:60])
    (tmp_path / "stock" / "NONE").mkdir()
    (tmp_path / "stock" / "NONE" / "1d_20240101_20240102.parquet").write_bytes(b"")
    (tmp_path / "stock" / "GOOD" / "note.txt").write_text("x")
    return "file://" + str(tmp_path)


def test_validation_of_a_broken_tree(spark, broken_tree):
    summaries, issues = validation.validate_tree(spark, broken_tree)
    got = sorted((r.symbol, r.rule_id, r.severity, r.n) for r in issues.collect())
    assert got == sorted(
        [
            ("CUT", "parquet.read_failed", "ERROR", 1), ("NONE", "parquet.read_failed", "ERROR", 1),
            ("TEXT", "datetime.stats_failed", "WARN", 3), ("NOTIME", "schema.missing_datetime", "ERROR", 1), ("NOTIME", "schema.missing_open", "WARN", 1),
            ("LONG+ 1", "values.negative", "WARN", 1), ("GAP", "datetime.duplicated", "WARN", 1), ("GAP", "datetime.gap_too_large", "WARN", 60 * 86400),
        ]
    )
    s = {r.symbol: r for r in summaries.collect()}
    assert (s["NAME"].interval, s["NAME"].asset_type, s["NAME"].n_read) == (None, "fund", 3)
    assert s["NOTIME"].missing_columns == ["datetime", "open"] and s["NOTIME"].duplicates is None and s["NOTIME"].null_close == 0
    assert (s["CUT"].n_rows, s["CUT"].missing_columns, s["CUT"].n_read) == (None, None, 0)
    assert s["LONG+ 1"].max_dt == T(2024, 1, 3)
    assert tuple(validation.files_with_issues(issues).first()) == (3, 5, 3, 4)


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}/", "{}/../{name}"])
def test_validation_knows_the_root_in_every_form(spark, broken_tree, tmp_path, form):
    root = form.format(tmp_path, name=tmp_path.name)
    summaries, issues = validation.validate_tree(spark, root)
    assert {r.symbol: r.n_read for r in summaries.collect()} == {"GOOD": 3, "LONG+ 1": 3, "TEXT": 0, "NOTIME": 3, "GAP": 3, "NAME": 3, "CUT": 0, "NONE": 0}
    assert [r.symbol for r in issues.where("rule_id = 'datetime.stats_failed'").collect()] == ["TEXT"]


def test_series_files_go_where_a_scan_finds_them(spark, tmp_path):
    rows = spark.createDataFrame([("stock", "A", "1d", t, 1.0) for t in days(5)], "asset_type string, symbol string, interval string, datetime timestamp_ntz, close double")
    tree.run(tree.write_series_files(rows, str(tmp_path)))
    assert [(r.symbol, r.n_read) for r in validation.validate_tree(spark, str(tmp_path))[0].collect()] == [("A", 5)]


def test_validation_filters_and_missing_roots(spark, broken_tree):
    found = tree.footers(spark, broken_tree, asset_type="stock", symbol="GAP", interval="1d").collect()
    assert [(r.symbol, r.n_rows, r.first, r.last) for r in found] == [("GAP", 3, T(2024, 1, 1), T(2024, 3, 1))]
    assert validation.validate_tree(spark, broken_tree + "/nowhere")[1].isEmpty()
    with pytest.raises(Exception, match="nofs"):
        tree.open_path("nofs://x/y")


def test_series_files_are_streamed_in_order(spark, tmp_path):
    rows = [("stock", s, "1d", t, float(k)) for s in ("A", "B") for k, t in enumerate(days(50))]
    b = spark.createDataFrame(rows, "asset_type string, symbol string, interval string, datetime timestamp_ntz, open double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        written = tree.write_series_files(b, "file://" + str(tmp_path), -F.col("open")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(os.path.basename(r.path) for r in written) == ["1d_20240101_20240219.parquet"] * 2 and {r.n_rows for r in written} == {50}
    assert pq.read_table(written[0].path)["open"].to_pylist() == [float(k) for k in reversed(range(50))]
    got = quality.monotonic(tree.rows_in_order(spark, "file://" + str(tmp_path)), ["path"], "row", F.floor(F.col("row") / 8)).collect()
    assert [r.monotonic for r in got] == [False, False]
    assert not [f for f in os.listdir(tmp_path) if f.startswith(".")]


def test_window_files_round_trip_with_pruning(spark, tmp_path):
    day = [T(2024, 1, 1), T(2024, 1, 2), T(2024, 1, 3)]
    rows = [(s, i, a, b, a + dt.timedelta(minutes=k), 1.0, 2.0, 0.5, None if k == 1 else 1.5, 3.0) for s in ("A", "B_x", "[z]") for i in ("1m", "5m") for a, b in itertools.pairwise(day) for k in (2, 0, 1)]
    b = spark.createDataFrame(rows, "symbol string, interval string, start timestamp_ntz, end timestamp_ntz, datetime timestamp_ntz, open double, high double, low double, close double, volume double")
    root = "file://" + str(tmp_path)
    assert tree.write_window_files(b, root).count() == 12
    for symbol in ("A", "B_x", "[z]"):
        got = files.scan_window_csv(spark, root, symbol=symbol, interval="5m")
        assert len(got.inputFiles()) == 2
        assert {(r.symbol, r.interval, r.window_start) for r in got.collect()} == {(symbol, "5m", "20240101"), (symbol, "5m", "20240102")}
    ordered = quality.monotonic(files.scan_window_csv(spark, root), ["file"], "row", F.col("row.block"))
    assert {r.monotonic for r in ordered.collect()} == {True}
    done = tree.written_windows(spark, root)
    assert done.count() == 12
    w = spark.createDataFrame([("A", day[0], day[1]), ("A", day[1], day[2]), ("C", day[0], day[1])], "symbol string, start timestamp_ntz, end timestamp_ntz")
    assert [r.symbol for r in windows.open_windows(w, done, ["1m", "5m"]).collect()] == ["C"]
    resume = w.where("symbol = 'A'")
    assert windows.open_windows(w, done.limit(0), ["1m"], resume).count() == 2


def test_order_of_rows_across_splits_of_a_file(spark, tmp_path):
    lines = [f"{T(2024, 1, 1) + dt.timedelta(minutes=k):%Y-%m-%d %H:%M:%S},1,1,1,1,1" for k in range(4000)]
    (tmp_path / "A_1m_20240101_20240105.csv").write_text("\n".join(["datetime,open,high,low,close,volume", *lines]))
    lines[1500], lines[3000] = lines[3000], lines[1500]
    (tmp_path / "B_1m_20240101_20240105.csv").write_text("\n".join(["datetime,open,high,low,close,volume", *lines]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
    try:
        rows = files.scan_window_csv(spark, "file://" + str(tmp_path))
        assert rows.select("row.block").distinct().count() > 3
        got = quality.monotonic(rows, ["symbol"], "row", F.col("row.block")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.symbol: r.monotonic for r in got} == {"A": True, "B": False}


def test_window_files_that_cannot_be_checked(spark, tmp_path):
    (tmp_path / "A_1h_20240101_20240102.csv").write_text("datetime,open,high,low,close,volume\n2024-01-01 00:00:00,1,1,1,1,1\n")
    (tmp_path / "B_1h_20240101_20240102.csv").write_bytes(b"")
    (tmp_path / "C_1h_20240101_20240102.csv").write_bytes(b"\xff\xfe\x00bad")
    (tmp_path / "D_1h_20240101_20240102.csv").write_text("datetime,open\n")
    (tmp_path / "E_1h_20240101_20240102.csv").write_text("datetime,open,high,low,close,volume\n")
    w = spark.createDataFrame([(s, "1h", T(2024, 1, 1), T(2024, 1, 2)) for s in "ABCDEF"], "symbol string, interval string, start timestamp_ntz, end timestamp_ntz")
    got = {r.symbol: (r.status, r.fails) for r in validation.check_window_files(spark, "file://" + str(tmp_path), w).collect()}
    assert got == {
        "A": ("pass", []), "B": ("fail", ["empty_file"]), "C": ("fail", ["read_csv_failed"]), "D": ("fail", ["missing_columns:high,low,close,volume"]),
        "E": ("fail", ["no_data_rows"]), "F": ("fail", ["missing_file"]),
    }


def brute_profile(times):
    have = sorted(t for t in times if t is not None)
    gaps = [(b - a).total_seconds() for a, b in itertools.pairwise(have)]
    return len(times), len(times) - len(set(times)), int(max(gaps)) if gaps else None, have[0] if have else None, have[-1] if have else None


def test_stitched_profiles_equal_sorted_series(spark):
    rng = random.Random(3)
    series = {s: [T(2023, 1, 1) + dt.timedelta(seconds=rng.randrange(0, 86400 * rng.choice([1, 40, 700]))) for _ in range(rng.randrange(1, 60))] for s in map(str, range(30))}
    series["n"] = [None, None, T(2023, 5, 5)]
    series["only"] = [None]
    series["same"] = [T(2023, 1, 31, 23), T(2023, 2, 1, 1), T(2023, 2, 1, 1)]
    rows = [(s, t, 1.0, 1.0, 1.0, 1.0, 1.0) for s, own in series.items() for t in own]
    df = spark.createDataFrame(rows, BAR).repartition(5)
    for bucket in ("MONTH", "DAY", "YEAR"):
        got = {r.symbol: (r.n_rows, r.duplicates, r.max_gap_s, r.min_dt, r.max_dt) for r in quality.profile(df, ["symbol"], bucket).collect()}
        assert got == {s: brute_profile(own) for s, own in series.items()}
    order = spark.createDataFrame([(s, k * 40_000, t) for s, own in series.items() for k, t in enumerate(own)], "symbol string, pos long, datetime timestamp_ntz")
    rises = {r.symbol: r.monotonic for r in quality.monotonic(order, ["symbol"]).collect()}
    clean = {s: [t for t in own if t is not None] for s, own in series.items()}
    assert rises == {s: own == sorted(own) for s, own in clean.items() if own}


def test_stitched_gaps_equal_the_grid(spark):
    rng = random.Random(5)
    rows = [(s, T(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(-50, 6000)), 1.0, 1.0, 1.0, 1.0, 1.0) for s in "ABC" for _ in range(400)]
    bounds = spark.createDataFrame([(s, T(2024, 1, 1), T(2024, 1, 4, 12)) for s in "ABCD"] + [("E", T(2024, 1, 1), T(2024, 1, 1))], "symbol string, start timestamp_ntz, end timestamp_ntz")
    df = spark.createDataFrame(rows, BAR)
    want = sorted(map(tuple, quality.gap_ranges(quality.missing_slots(df, bounds, 5), 5).select("symbol", "gap_start", "gap_end", "slots").collect()))
    assert sorted(map(tuple, quality.gaps_between(df, bounds, 5).collect())) == want
    assert [r for r in want if r[0] == "D"] == [("D", T(2024, 1, 1), T(2024, 1, 4, 11, 55), 1008)]


def test_gaps_do_not_depend_on_the_zone_of_the_session(spark, tmp_path):
    # Summer time begins on 10 March and ends on 3 November; the second gap lies between two months, and 2:30 is no time on 10 March.
    times = {"MARCH": [T(2024, 3, 1), T(2024, 3, 20)], "AUTUMN": [T(2024, 10, 20), T(2024, 11, 5)], "NIGHT": [T(2024, 3, 10, 2, 30), T(2024, 3, 10, 3, 10)]}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [("stock", s, "1d", t, *[1.0] * 5) for s, found in times.items() for t in found]
        b = spark.createDataFrame(rows, "asset_type string, symbol string, interval string, datetime timestamp_ntz, open double, high double, low double, close double, volume double")
        tree.run(tree.write_series_files(b, str(tmp_path)))
        summaries, issues = validation.validate_tree(spark, str(tmp_path))
        assert {r.symbol: r.max_gap_s for r in summaries.collect()} == {"MARCH": 19 * 86400, "AUTUMN": 16 * 86400, "NIGHT": 2400}
        assert {(r.symbol, r.rule_id, r.n) for r in issues.collect()} == {(s, "datetime.gap_too_large", n * 86400) for s, n in (("MARCH", 19), ("AUTUMN", 16))}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("build", ["profile", "gaps", "monotonic"])
def test_no_window_is_dealt_by_series_alone(spark, build):
    df = spark.createDataFrame([("A", T(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0, 1)], BAR + ", pos long")
    bounds = spark.createDataFrame([("A", T(2024, 1, 1), T(2024, 1, 2))], "symbol string, start timestamp_ntz, end timestamp_ntz")
    out = {"profile": lambda: quality.profile(df, ["symbol"]), "gaps": lambda: quality.gaps_between(df, bounds, 1), "monotonic": lambda: quality.monotonic(df, ["symbol"])}[build]()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" in plan
    assert all("_bucket" in line for line in plan.splitlines() if "Window [" in line)


def test_canonical_segments_cover_each_number_once(spark):
    rows = [(a, b) for a in range(0, 40) for b in range(a, 41)]
    df = spark.createDataFrame(rows, "a long, b long").withColumn("s", store.canonical_segments(F.col("a"), F.col("b"), 6))
    for r in df.collect():
        covered = [n for x in r.s for n in range(x.node << x.level, (x.node + 1) << x.level)]
        assert sorted(covered) == list(range(r.a, r.b + 1)) and len(r.s) <= 12, (r.a, r.b, r.s)


def test_interval_index_meets_few_ranges(spark):
    hours = [T(2024, 1, 1) + dt.timedelta(minutes=4 * k) for k in range(10_000)]
    ranges = spark.createDataFrame([("A", t, t + dt.timedelta(hours=1)) for t in hours] + [("A", T(1970, 1, 1), T(2030, 1, 1)), ("A", T(2024, 2, 1), T(2024, 1, 1))], "k string, range_start timestamp_ntz, range_end timestamp_ntz")
    rng = random.Random(1)
    asked = [(t, t + dt.timedelta(minutes=rng.randrange(0, 90))) for t in rng.sample(hours, 300)] + [(T(1960, 1, 1), T(1961, 1, 1)), (T(1971, 1, 1), T(1972, 1, 1))]
    requests = spark.createDataFrame([("A", *x) for x in asked], "k string, start timestamp_ntz, end timestamp_ntz")
    got = {(r.start, r.end): (r.range_start, r.range_end) for r in store.range_cache_lookup(requests, ranges, ["k"]).collect()}
    want = {}
    spans = [(t, t + dt.timedelta(hours=1)) for t in hours] + [(T(1970, 1, 1), T(2030, 1, 1))]
    for s, e in asked:
        fits = [(b - a, a, b) for a, b in spans if a <= s and b >= e]
        if fits:
            want[s, e] = min(fits)[1:]
    assert got == want
    joined = requests.withColumn("n", F.lit(1)).alias("q").join(ranges.alias("r"), F.expr("q.k = r.k and floor(unix_seconds(cast(range_start as timestamp)) / 3600) <= floor(unix_seconds(cast(start as timestamp)) / 3600) and floor(unix_seconds(cast(range_end as timestamp)) / 3600) >= floor(unix_seconds(cast(start as timestamp)) / 3600)"))
    assert joined.groupBy("start", "end").count().agg(F.max("count")).first()[0] < 50  # what a request meets: ranges that hold its hour


@pytest.mark.parametrize("lengths", [[90], [0, 1, 2, 3, 7, 24, 90, 4000]])
def test_lookup_deals_requests_out_once(spark, lengths):
    rng = random.Random(2)
    first = T(1969, 11, 1)  # some times are before 1970, whose cells are negative
    spans = [(k, a, a + dt.timedelta(hours=n, minutes=m)) for k in "AB" for n in lengths for a in [first + dt.timedelta(hours=rng.randrange(3000)) for _ in range(60)] for m in (0, 0)]
    asked = [(k, a, a + dt.timedelta(hours=rng.randrange(60))) for k in "ABC" for a in [first + dt.timedelta(minutes=30 * rng.randrange(6200)) for _ in range(300)]]
    ranges = spark.createDataFrame([*spans, ("A", None, T(2030, 1, 1)), ("A", T(2024, 2, 1), T(2024, 1, 1))], "k string, range_start timestamp_ntz, range_end timestamp_ntz")
    requests = spark.createDataFrame([*asked, *asked[:50], ("A", None, first)], "k string, start timestamp_ntz, end timestamp_ntz")
    found = store.range_cache_lookup(requests, ranges, ["k"])
    want = {}
    for k, s, e in asked:
        fits = [(b - a, a, b) for k_, a, b in spans if k_ == k and a <= s and b >= e]
        if fits:
            want[k, s, e] = min(fits)[1:]
    rows = found.collect()
    assert len(want) > 100 and len(rows) == len(want) and {(r.k, r.start, r.end): (r.range_start, r.range_end) for r in rows} == want
    # One shuffle a side, and where ranges have several grids, one more for the tightest of them all.
    plan = store.range_cache_lookup(requests, ranges, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == (2 if len(lengths) == 1 else 3)
    assert "SortAggregate" not in plan or len(lengths) > 1


def test_store_keeps_its_layout(spark, tmp_path):
    path = "file://" + str(tmp_path / "store")
    rows = [("stock", "1d", f"S{k}", T(2020 + k % 3, 5, 1), float(k)) for k in range(20)]
    b = spark.createDataFrame(rows, "asset_type string, interval string, symbol string, datetime timestamp_ntz, close double")
    files.write_bars(b, path, buckets=4)
    with pytest.raises(ValueError, match="4 buckets"):
        files.write_bars(b, path, buckets=8)
    with pytest.raises(ValueError, match="by year"):
        files.write_bars(b, path, period="month")
    untouched = {f: os.path.getmtime(f) for f in glob_files(tmp_path / "store") if "period=2021" not in f}
    files.write_bars(b.where("year(datetime) = 2021").withColumn("close", F.lit(-1.0)), path)
    assert all(os.path.getmtime(f) == t for f, t in untouched.items())
    got = files.read_store(spark, path)
    assert got.count() == 20 and got.where("close = -1").count() == 7 and got.schema["period"].dataType.simpleString() == "string"
    assert len(got.where("period = '2020' and bucket = 1").inputFiles()) <= len(got.inputFiles())
    with pytest.raises(ValueError, match="no bar store"):
        files.write_bars(b, "file://" + str(tmp_path))


def glob_files(root):
    return [os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")]


def test_ingest_resumes_and_skips(spark, tmp_path):
    schema = "asset_type string, interval string, symbol string, datetime timestamp_ntz, close double, seq long"
    land, path, check = (str(tmp_path / x) for x in ("in", "store", "check"))

    def take(rows, **options):
        spark.createDataFrame([("s", "1d", *r) for r in rows], schema).write.mode("append").parquet(land)
        streams.ingest(spark, land, schema, path, check, **options).awaitTermination()
        return sorted((r.symbol, r.datetime.day, r.close) for r in files.read_store(spark, path).collect())

    assert take([("A", T(2024, 1, 1), 1.0, 1), ("A", T(2024, 1, 2), 2.0, 2)]) == [("A", 1, 1.0), ("A", 2, 2.0)]
    done = spark.createDataFrame([("B", "1d", T(2024, 1, 1), T(2024, 1, 3))], "symbol string, interval string, start timestamp_ntz, end timestamp_ntz")
    got = take([("A", T(2024, 1, 2), 9.0, 9), ("A", T(2024, 1, 3), 3.0, 3), ("B", T(2024, 1, 2), 4.0, 4), ("B", T(2024, 1, 4), 5.0, 5)], resume=True, done=done)
    assert got == [("A", 1, 1.0), ("A", 2, 2.0), ("A", 3, 3.0), ("B", 4, 5.0)]


def test_dates_of_a_ledger_are_judged_one_by_one(spark):
    schema = "symbol string, interval string, start string, end string, adjust string, asset_type string"
    rows = [
        ("A", "1d", "2024-01-05", "soon", None, None), ("A", "1d", "soon", "2024-01-05T10:30:00", None, None), ("A", "1d", " ", "", None, None),
        ("A", "1d", "2024-03-01", "2024-01-01", None, None), (" ", "1d", "bad", "bad", None, None), ("A", "1d", "2024", "x", "front", "fund"),
    ]
    got = [(r.valid, r.warnings, r.start, r.end) for r in ledger.validate(spark.createDataFrame(rows, schema).coalesce(1), "2020-01-01", "2021-01-01").collect()]
    low, high = T(2020, 1, 1), T(2021, 1, 1)
    assert got == [
        (True, ["bad_end", "start_after_end"], low, high), (True, ["bad_start"], low, T(2024, 1, 5, 10, 30)), (True, [], low, high),
        (True, ["start_after_end"], low, high), (False, ["invalid_record"], None, None), (True, ["bad_start", "bad_end"], low, high),
    ]
    assert ledger.validate(spark.createDataFrame(rows[2:3], schema), "2020-01-01", "2021-01-01", strict=True).count() == 1


def test_both_side_volumes_are_summed(spark):
    raw = spark.createDataFrame([("2024-01-01", 2.0, 1.0, 3.0, 7.0)], "time string, ask double, bid double, `ask-volume` double, `bid-volume` double")
    assert shape.normalize_ticks(raw, []).first().volume == 10.0


def test_interval_codes_are_trimmed_and_lowered(spark):
    df = spark.createDataFrame([(" 1H",), ("1D",), ("2Wk ",), ("MO",), ("x",)], "c string")
    got = [tuple(r) for r in df.select(timefn.interval_seconds(F.col("c")), timefn.gap_threshold_seconds(F.col("c"))).collect()]
    assert got == [(3600, 6 * 3600), (86400, 10 * 86400), (14 * 86400, 60 * 86400), (30 * 86400, 120 * 86400), (None, None)]


def test_ranges_shorter_than_a_second(spark):
    t = T(2024, 1, 1, 23, 59, 59, 900_000)
    w = spark.createDataFrame([("A", t, t + dt.timedelta(milliseconds=200)), ("A", t, t)], "symbol string, start timestamp_ntz, end timestamp_ntz")
    assert timefn.grid(w, "start", "end", 60).count() == 1
    ticks = spark.createDataFrame([("A", t), ("A", t + dt.timedelta(milliseconds=150))], "symbol string, datetime timestamp_ntz")
    assert sorted((r.hours, r.present) for r in windows.hour_coverage(ticks, w).collect()) == [(0, 0), (1, 1)]


def test_path_dates_go_by_shanghai(spark):
    df = spark.createDataFrame([(T(2024, 1, 1, 15, 59),), (T(2024, 1, 1, 16),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(timefn.path_date(F.col("t"))).collect()] == ["20240101", "20240102"]


def test_gate_takes_every_kind_of_fault(spark):
    w = [("A", "1m", T(2024, 1, 1), T(2024, 1, 2)), ("B", "1m", T(2024, 1, 1), T(2024, 1, 9)), ("C", "1m", T(2024, 1, 1), T(2024, 1, 2)), ("D", "1m", T(2024, 1, 1), T(2024, 1, 2))]
    key = "symbol string, interval string, start timestamp_ntz, end timestamp_ntz"
    checked = spark.createDataFrame([(*w[0], "pass", [], [], 5), (*w[1], "pass", [], [], 0), (*w[2], "fail", ["x", "x"], [], 5), (*w[3], "pass", [], [], 5)], f"{key}, status string, fails array<string>, warns array<string>, n_rows long")
    ticks = spark.createDataFrame([(s, T(2024, 1, 1), 1.0, 1.0, v, k) for k, (s, v) in enumerate((("A", 1.0), ("D", 2.0)))], "symbol string, datetime timestamp_ntz, price double, volume double, given double, seq long")
    reconciled = bars.reconcile_ticks(ticks, 5, "given")
    more = windows.reconcile_issues(reconciled, spark.createDataFrame(w, key))
    rows = spark.createDataFrame([(*x, 1.0) for x in w], f"{key}, close double")
    good, bad = windows.strict_gate(rows, checked, F.lit("now"), more)
    assert [r.symbol for r in good.collect()] == ["A"]
    assert {r.symbol: r.reason for r in bad.collect()} == {"B": "empty_window", "C": "x", "D": "volume_mismatch:1"}
    many = checked.where("symbol = 'C'").withColumn("fails", F.transform(F.sequence(F.lit(1), F.lit(11)), lambda x: x.cast("string")))
    assert windows.strict_gate(rows, many, F.lit("now"))[1].first().reason == "1|2|3|4|5|6|7|8 (+3 more)"


def test_whole_report(spark, tmp_path):
    key = "symbol string, interval string, start timestamp_ntz, end timestamp_ntz"
    w = [("A", "1m", T(2024, 1, 1), T(2024, 1, 2), "fail", ["x"], ["y"], 5, 6), ("A", "5m", T(2024, 1, 1), T(2024, 1, 2), "pass", [], [], 1, 1)]
    checked = spark.createDataFrame(w, f"{key}, status string, fails array<string>, warns array<string>, n_rows long, expected long")
    windows.write_report(checked, str(tmp_path), {"symbols": "A", "output": "here"})
    text = spark.read.text(str(tmp_path / "summary")).collect()
    assert len(text) == 1
    summary = json.loads(text[0][0])
    assert summary["meta"] == {"symbols": "A", "output": "here"} and summary["summary"]["total"] == 2 and summary["summary"]["failure_rate"] == 0.5
    assert spark.read.json(str(tmp_path / "results")).count() == 2
    assert spark.read.json(str(tmp_path / "repairs")).first().reasons == ["1m:x", "1m:y"]
    assert spark.read.option("header", True).csv(str(tmp_path / "rows")).where("fails = 'x'").count() == 1


def test_rebuilt_days_by_window(spark):
    start = T(2024, 1, 1)
    rows = [(s, start + dt.timedelta(minutes=k), 1.0, 1.0, 1.0, None if s == "N" else 1.0, 1.0) for s in "AIN" for k in range(1440 if s != "I" else 9)]
    w = spark.createDataFrame([(s, start, start + dt.timedelta(days=1)) for s in "AINX"], "symbol string, start timestamp_ntz, end timestamp_ntz")
    daily, status = windows.rebuild_daily(spark.createDataFrame(rows, BAR), w)
    assert {r.symbol: r.status for r in status.collect()} == {"A": "rebuilt", "I": "incomplete_1m", "N": "rebuild_empty", "X": "missing_1m"}
    assert [(r.symbol, r.datetime) for r in daily.orderBy("datetime").collect()] == [("A", T(2024, 1, 1, 22)), ("A", T(2024, 1, 2, 22))]


def test_mt4_batch_of_one_symbol_whatever_its_case(spark):
    from tickloom.sources import listings

    rows = spark.createDataFrame([(s, i, T(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0, "f") for s in ("eurusd", "GBPUSD") for i in ("1m", "5m")], "symbol string, interval string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, file string")
    assert listings.mt4_batch(rows).count() == 4
    assert listings.mt4_batch(rows, symbol=" EurUsd ", interval="5m").count() == 1


def tasks_of(spark, build):
    """The numbers of tasks of the stages that ran while ``build`` was called."""
    spark.sparkContext.setJobGroup(build.__name__ + str(random.random()), "")
    group = spark.sparkContext.getLocalProperty("spark.jobGroup.id")
    try:
        build()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {k for job in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(job).stageIds}
    return [info.numTasks for info in map(tracker.getStageInfo, stages) if info and info.numCompletedTasks]


def test_a_write_takes_one_shuffle_of_all_rows(spark, tmp_path):
    b = spark.range(2000).selectExpr("'stock' as asset_type", "'1d' as interval", "cast(id % 7 as string) as symbol", "timestamp_ntz '2020-01-01' + make_dt_interval(cast(id % 900 as int)) as datetime", "id as close", "id as seq")
    root = str(tmp_path / "store")
    assert len(tasks_of(spark, lambda: files.write_bars(b, root, "seq", buckets=3))) <= 4
    files.write_bars(b.where("seq < 3").withColumn("close", F.lit(-1).cast("long")), root)
    got = {(r.symbol, r.datetime): r.close for r in files.read_store(spark, root).collect()}
    want = {}
    for r in b.orderBy("seq").collect():
        want[r.symbol, r.datetime] = r.close if r.seq >= 3 else -1
    want |= {(r.symbol, r.datetime): -1 for r in b.where("seq < 3").collect()}
    assert got == want


def test_periods_of_years_beyond_four_digits(spark):
    times = ["0001-02-03", "0999-12-31", "1000-01-01", "2024-02-29 23:59:59", "9999-12-31"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("t")).unionAll(spark.sql("select timestamp_ntz '+12345-06-07' union all select null"))
    for name, form in files.PERIODS.items():
        assert df.where(~files.period_of(F.col("t"), name).eqNullSafe(F.coalesce(F.date_format("t", form), F.lit("none")))).isEmpty()


def test_folders_are_listed_in_few_tasks(spark, tmp_path):
    for k in range(80):
        put(tmp_path, f"S{k}", bar_columns())
    scan = lambda: files.scan_bars(spark, str(tmp_path), "1d", asset_type="stock")
    assert 0 < max(tasks_of(spark, scan)) <= 4 * spark.sparkContext.defaultParallelism
    assert scan().count() == 240 and spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


def test_rows_in_order_are_read_by_row_groups_and_listed_by_tasks(spark, tmp_path):
    columns = bar_columns(datetime=pa.array([*days(40)[:30], None, *days(9)], pa.timestamp("us"))) | {c: [1.0] * 40 for c in files.BARS}
    pq.write_table(pa.table(columns), put(tmp_path, "A^ +%20b", bar_columns()), row_group_size=7)
    put(tmp_path, "NOTIME", bar_columns(datetime=None))
    for k in range(40):
        put(tmp_path, f"S{k}", bar_columns(datetime=pa.array([t.replace(tzinfo=dt.timezone.utc) for t in days(3)], pa.timestamp("ms", "UTC"))))
    assert tasks_of(spark, lambda: tree.rows_in_order(spark, str(tmp_path))) == []  # no job of the driver's lists them
    rows = tree.rows_in_order(spark, str(tmp_path)).select(F.element_at(F.split("path", "/"), -2).alias("symbol"), "row", "datetime")
    got = {}
    for r in sorted(rows.collect()[:], key=lambda r: (r.symbol, r.row)):
        got.setdefault(r.symbol, []).append((r.row, r.datetime))
    assert got["A^ +%20b"] == list(enumerate([*days(40)[:30], None, *days(9)])) and got["NOTIME"] == [(k, None) for k in range(3)]
    assert got["S7"] == list(enumerate(days(3))) and len(got) == 42
    rises = {r.symbol: r.monotonic for r in quality.monotonic(rows, ["symbol"], "row").collect()}
    assert not rises.pop("A^ +%20b") and set(rises.values()) == {True} and len(rises) == 40


def test_runs_of_keys_in_a_batch_are_files(spark, tmp_path):
    keys = [("stock", "A", "1d"), ("stock", "A", "1h"), ("fund", "A", "1d"), ("fund", None, "1d"), ("fund", "B_+", "1d")]
    rows = [(*k, t, float(n)) for n, t in enumerate(days(20)) for k in keys[: 1 + n % 5]]
    b = spark.createDataFrame(rows, "asset_type string, symbol string, interval string, datetime timestamp_ntz, close double")
    written = {tuple(r.path.split("/")[-3:]): r for r in tree.write_series_files(b, str(tmp_path), -F.col("close")).collect()}
    assert {(k[0], str(k[1]), k[2]) for k in keys} == {(a, s, name.split("_")[0]) for a, s, name in written}
    for (a, s, name), r in written.items():
        want = [x[4] for x in rows if (x[0], str(x[1]), x[2]) == (a, s, name.split("_")[0])]
        assert pq.ParquetFile(r.path).read()["close"].to_pylist() == want[::-1] and r.n_rows == len(want)


@pytest.mark.parametrize("name", ["tree_issues", "tree_summaries"])
def test_tree_queries_equal_their_sql_in_a_folder_without_a_scheme(spark, tmp_path, monkeypatch, name):
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(tree_queries, "scratch", lambda _, label: str(tmp_path / label))
    got = QUERIES[name](spark, d)
    with duckdb.connect() as db:
        db.execute(f"create view lineitem as select * from '{d}/lineitem.parquet'")
        want = db.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert want and sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
