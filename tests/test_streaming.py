import datetime as dt

from tickloom.streaming import bars

T = dt.datetime
SCHEMA = "symbol string, ts timestamp, seq long, price double, volume double"


def run(spark, tmp_path, data, build):
    """The rows that a stream over one Parquet file of ticks emits in append mode."""
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = build(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_tumbling_bars_wait_for_the_watermark(spark, tmp_path):
    data = [("A", T(2024, 1, 1, 0, m), m, float(m), 1.0) for m in (0, 4, 5, 9)] + [("A", T(2024, 1, 1, 3), 99, 1.0, 1.0)]
    got = run(spark, tmp_path, data, lambda s: bars.stream_bars(s, 5)).orderBy("datetime").collect()
    assert [(r.datetime.minute, r.open, r.close, r.volume) for r in got] == [(0, 0.0, 4.0, 2.0), (5, 5.0, 9.0, 2.0)]


def test_session_bars_leave_the_last_session_open(spark, tmp_path):
    data = [("A", T(2024, 1, d, h), 100 * d + h, float(h), 1.0) for d in (2, 3, 4) for h in (1, 21)]
    got = run(spark, tmp_path, data, bars.stream_daily).orderBy("datetime").collect()
    assert [(r.datetime, r.open, r.close) for r in got] == [(T(2024, 1, 2, 22), 1.0, 21.0), (T(2024, 1, 3, 22), 1.0, 21.0)]


def test_repeated_ticks_are_dropped(spark, tmp_path):
    data = [("A", T(2024, 1, 1), 1, 1.0, 1.0), ("A", T(2024, 1, 1), 2, 1.0, 1.0), ("B", T(2024, 1, 1), 3, 1.0, 1.0)]
    assert run(spark, tmp_path, data, bars.stream_dedup).count() == 2
