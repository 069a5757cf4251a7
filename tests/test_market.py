import datetime as dt
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.functions import numeric, timefn
from tickloom.operators import bars, catalog, quality, store
from tickloom.plans import queries as Q

SF = "/root/testdata/sf0.001"
T = dt.datetime


def table(rows, names):
    def norm(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(norm(r[n]) for n in sorted(names)) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(spark, duck, name):
    out = Q.QUERIES[name](spark, SF)
    want = duck.sql(Q.ORACLE_SQL[name])
    names = want.columns
    assert sorted(out.columns) == sorted(names)
    want = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    assert table([r.asDict() for r in out.collect()], names) == table(want, names)


def ticks(spark, rows):
    return spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, price double, volume double, seq long")


def test_bars_on_grid(spark):
    t = ticks(spark, [("A", T(2024, 1, 1, 0, 0, 5), 1.0, 10.0, 1), ("A", T(2024, 1, 1, 0, 0, 30), 1.5, 20.0, 2), ("A", T(2024, 1, 1, 0, 1), 2.0, 30.0, 3)])
    bounds = spark.createDataFrame([("A", T(2024, 1, 1), T(2024, 1, 1, 0, 4))], "symbol string, start timestamp_ntz, end timestamp_ntz")
    got = bars.bars_1m(t, bounds).orderBy("datetime").collect()
    assert [tuple(r)[2:] for r in got] == [(1.0, 1.5, 1.0, 1.5, 30.0), (2.0, 2.0, 2.0, 2.0, 30.0), (None,) * 5, (None,) * 5]


def test_no_ticks_give_null_bars(spark):
    bounds = spark.createDataFrame([("A", T(2024, 1, 1), T(2024, 1, 1, 0, 5))], "symbol string, start timestamp_ntz, end timestamp_ntz")
    assert [r.close for r in bars.bars_1m(ticks(spark, []), bounds).collect()] == [None] * 5


@pytest.mark.parametrize("day, close_utc", [(T(2024, 3, 8), 22), (T(2024, 3, 11), 21), (T(2024, 11, 1), 21), (T(2024, 11, 4), 22)])
def test_session_close_moves_with_daylight_saving(spark, day, close_utc):
    df = spark.createDataFrame([(day.replace(hour=close_utc - 1, minute=59),), (day.replace(hour=close_utc, minute=1),)], "t timestamp_ntz")
    got = [r[0] for r in df.select(timefn.session_close(F.col("t"))).collect()]
    assert got[0] == day.replace(hour=close_utc) and got[1] > got[0]


def test_rollup_of_rollup_equals_direct(spark):
    t = Q.views.ticks(spark, SF)
    a, b = bars.rollup(bars.bars_from_ticks(t), 15), bars.bars_from_ticks(t, 15)
    assert a.select(*b.columns).exceptAll(b).isEmpty() and b.exceptAll(a.select(*b.columns)).isEmpty()


def test_upsert_twice_is_once(spark):
    b = Q.views.dirty_bars(spark, SF)
    once = store.upsert(b.where("seq % 2 = 0"), b.where("seq % 2 = 1"), ["symbol", "datetime"])
    assert store.upsert(once, once, ["symbol", "datetime"]).exceptAll(once).isEmpty()


def test_missing_and_extra_slots(spark):
    b = spark.createDataFrame([("A", T(2024, 1, 1, 0, m)) for m in (0, 1, 4, 9)], "symbol string, datetime timestamp_ntz")
    bounds = spark.createDataFrame([("A", T(2024, 1, 1), T(2024, 1, 1, 0, 8))], "symbol string, start timestamp_ntz, end timestamp_ntz")
    gaps = quality.gap_ranges(quality.missing_slots(b, bounds, 1), 1).orderBy("gap_start").collect()
    assert [(g.gap_start.minute, g.gap_end.minute, g.slots) for g in gaps] == [(2, 3, 2), (5, 7, 3)]
    assert [r.datetime.minute for r in quality.extra_slots(b, bounds, 1).collect()] == [9]


def test_tick_scalars(spark):
    df = spark.createDataFrame([("1", None, "2", "3"), (None, None, "2", "4"), (None, None, None, None), ("inf", "x", "NaN", "5")], "l string, p string, a string, b string")
    c = [F.col(x) for x in "lpab"]
    assert [r[0] for r in df.select(numeric.tick_price(*c)).collect()] == [1.0, 3.0, None, 5.0]
    assert [r[0] for r in df.select(numeric.tick_volume(c[2], c[3])).collect()] == [5.0, 6.0, None, 5.0]


def test_interval_codes(spark):
    df = spark.createDataFrame([("5m", 300), ("1wk", 604800), ("d", 86400), ("2mo", 5184000), ("1x", None), ("", None)], "c string, s long")
    assert all(r[0] == r[1] for r in df.select(timefn.interval_seconds(F.col("c")), "s").collect())


def test_classification(spark):
    df = spark.createDataFrame([("sh.688001", "a"), ("sz.300123", "b ETF"), ("sz.000001", "c联接"), ("sh.510300", None), ("600000", "债券x")], "code string, name string")
    got = df.select(catalog.exchange_and_market(F.col("code")).alias("m"), catalog.fund_class(F.col("code"), F.col("name")).alias("f"), catalog.prefixed_code(F.col("code")).alias("p")).collect()
    assert [tuple(r.m) for r in got] == [("SSE", "STAR"), ("SZSE", "CHINEXT"), ("SZSE", "MAIN"), ("SSE", "MAIN"), (None, None)]
    assert [r.f.fund_category for r in got] == [None, "ETF", "ETF_LINK", "ETF", "BOND"] and got[4].p == "sh.600000"
