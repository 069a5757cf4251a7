"""Queries of window checks and repairs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import timefn
from tickloom.operators import ledger, quality, windows
from tickloom.plans import views
from tickloom.plans.queries import SQL_TICKS, query
from tickloom.sources import listings
from tickloom.sources.shared import scratch

SQL_ROWS = """r AS (SELECT event_type AS symbol, CASE WHEN event_id % 5 = 0 THEN '5m' ELSE '1m' END AS interval, date_trunc('hour', ts) AS s, event_id AS pos,
  CASE WHEN event_id % 97 <> 0 THEN date_trunc('second', ts) END AS t, value AS o, CASE WHEN event_id % 89 = 0 THEN value - 5 ELSE value + 1 END AS h,
  value - 1 AS l, CASE WHEN event_id % 3 <> 0 THEN value END AS c, event_id % 7 = 0 AND event_id % 101 <> 0 AS no_v, event_id % 101 = 0 AS inf_v FROM events)"""
SQL_CHECKED = f"""{SQL_ROWS},
x AS (SELECT symbol, interval, s, pos, t < lag(t) OVER (PARTITION BY symbol, interval, s ORDER BY pos) AS back FROM r WHERE t IS NOT NULL),
y AS (SELECT symbol, interval, s, count_if(back) AS back FROM x GROUP BY ALL),
m AS (SELECT symbol, interval, s, count(*) AS n, count(t) AS times, count(DISTINCT t) AS d,
  count(DISTINCT CASE interval WHEN '1m' THEN date_trunc('minute', t) ELSE time_bucket(INTERVAL 5 MINUTE, t) END) AS slots,
  count_if(h < o OR h < c OR l > o OR l > c OR h < l) FILTER (WHERE c IS NOT NULL) AS bad, round(avg(CASE WHEN c IS NULL THEN 1.0 ELSE 0.0 END), 6) AS cr,
  round(avg(CASE WHEN no_v THEN 1.0 ELSE 0.0 END), 6) AS vr, count_if(inf_v) AS inf, CASE interval WHEN '1m' THEN 60 ELSE 12 END AS e FROM r GROUP BY ALL),
f AS (SELECT symbol, interval, s, n, e, times, CASE WHEN times = 0 THEN ['no_parseable_datetime'] ELSE list_filter([
  CASE WHEN back > 0 THEN 'datetime_not_monotonic_increasing' END, CASE WHEN times > d THEN 'duplicate_timestamps:' || (times - d) END,
  CASE WHEN n <> e THEN 'row_count_mismatch:' || n || '!=' || e END, CASE WHEN e > slots THEN 'missing_timestamps:' || (e - slots) END,
  CASE WHEN inf > 0 THEN 'non_finite_volume' END, CASE WHEN bad > 0 THEN 'ohlc_relation_invalid:' || bad END], lambda z: z IS NOT NULL) END AS fails,
  CASE WHEN times = 0 THEN [] ELSE list_filter([CASE WHEN times < n THEN 'datetime_parse_fail:' || (n - times) END,
  CASE WHEN cr > 0.8 THEN 'nan_ratio_close:' || cr END, CASE WHEN vr > 0.8 THEN 'nan_ratio_volume:' || vr END], lambda z: z IS NOT NULL) END AS warns
  FROM m LEFT JOIN y USING (symbol, interval, s)),
k AS (SELECT *, CASE WHEN len(fails) > 0 THEN 'fail' WHEN len(warns) > 0 THEN 'warn' ELSE 'pass' END AS status FROM f)"""
SQL_DAYS = f"""{SQL_TICKS}, w AS (SELECT DISTINCT symbol, date_trunc('day', datetime) AS s FROM ticks)"""


def checked(spark: SparkSession, d: str) -> DataFrame:
    rows = views.window_rows(spark, d)
    return windows.check_windows(rows, rows.select(*windows.KEY))


def days(spark: SparkSession, d: str) -> DataFrame:
    t = views.ticks(spark, d)
    start = F.date_trunc("DAY", "datetime").cast(timefn.NTZ)
    return t.select("symbol", start.alias("start")).distinct().withColumn("end", F.col("start") + timefn.seconds(86400))


@query(
    f"""WITH {SQL_CHECKED} SELECT symbol, interval, s AS start, s + INTERVAL 1 HOUR AS "end", status, array_to_string(fails, '|') AS fails,
  array_to_string(warns, '|') AS warns, n AS n_rows, CAST(e AS BIGINT) AS expected FROM k"""
)
def check_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.report_rows(checked(spark, d))


@query(
    f"""WITH {SQL_CHECKED} SELECT symbol, interval, count(*) AS total, count_if(status = 'pass')::BIGINT AS pass, count_if(status = 'warn')::BIGINT AS warn,
  count_if(status = 'fail')::BIGINT AS fail, count(DISTINCT CASE WHEN status = 'fail' THEN s END) AS fail_windows, count(DISTINCT CASE WHEN status = 'warn' THEN s END) AS warn_windows,
  round(count_if(status = 'fail') / count(*), 6) AS failure_rate FROM k GROUP BY 1, 2"""
)
def status_summary(spark: SparkSession, d: str) -> DataFrame:
    return windows.status_summary(checked(spark, d), ["symbol", "interval"])


SQL_GROUPS = f"""{SQL_CHECKED}, q AS (SELECT symbol, s, interval, unnest(list_concat(fails, warns)) AS x FROM k WHERE status = 'fail'),
g AS (SELECT symbol, s, list_sort(list(DISTINCT interval)) AS intervals, list_sort(list(interval || ':' || x)) AS reasons FROM q GROUP BY 1, 2)"""


@query(
    f"""WITH {SQL_GROUPS} SELECT symbol, s AS start, s + INTERVAL 1 HOUR AS "end", array_to_string(intervals, ',') AS intervals,
  array_to_string(reasons, '|') AS reasons FROM g"""
)
def repair_groups(spark: SparkSession, d: str) -> DataFrame:
    g = windows.repair_groups(checked(spark, d))
    return g.withColumns({"intervals": F.concat_ws(",", "intervals"), "reasons": F.concat_ws("|", "reasons")})


@query(
    f"""WITH {SQL_GROUPS}, l AS (SELECT DISTINCT event_type AS symbol, date_trunc('hour', ts) + INTERVAL 1 DAY AS s FROM events WHERE event_id % 11 = 0)
SELECT symbol, s AS start, s + INTERVAL 1 HOUR AS "end", array_to_string(coalesce(intervals, ['1m', '5m', '1d']), ',') AS intervals, 'refetch' AS action,
  intervals IS NOT NULL AS force, array_to_string(list_concat(coalesce(reasons, []), CASE WHEN l.s IS NULL THEN [] ELSE ['fetch_failed'] END), '|') AS reason
FROM g FULL JOIN l USING (symbol, s)"""
)
def repair_plan(spark: SparkSession, d: str) -> DataFrame:
    start = F.date_trunc("HOUR", "ts").cast(timefn.NTZ) + timefn.seconds(86400)
    failed = views.table(spark, d, "events").where("event_id % 11 = 0").select(F.col("event_type").alias("symbol"), start.alias("start"))
    failed = failed.withColumns({"end": F.col("start") + timefn.seconds(3600), "reason": F.lit("fetch_failed")})
    plan = windows.repair_plan(windows.repair_groups(checked(spark, d)), failed, ["1m", "5m", "1d"])
    return plan.withColumn("intervals", F.concat_ws(",", "intervals"))


@query(
    f"""WITH {SQL_CHECKED}, w AS (SELECT symbol, interval, s, fails FROM k WHERE status = 'fail')
SELECT symbol, interval, strftime(s, '%Y-%m-%d') AS start, strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d') AS "end", array_to_string(fails, '|') AS reason,
  '2024-01-01' AS created_at FROM w"""
)
def rejected_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = views.window_rows(spark, d)
    return windows.strict_gate(rows, checked(spark, d), F.lit("2024-01-01"))[1]


@query(
    """WITH d AS (SELECT *, date_trunc('day', ts) AS s FROM events), k AS (SELECT event_type, s, count_if(event_id % 89 = 0) + count(*) - count(DISTINCT ts) AS bad FROM d GROUP BY 1, 2)
SELECT event_type AS symbol, count(*) AS n, sum(value) AS total FROM d JOIN k USING (event_type, s) WHERE bad = 0 GROUP BY 1"""
)
def accepted_bars(spark: SparkSession, d: str) -> DataFrame:
    start = F.date_trunc("DAY", "ts").cast(timefn.NTZ)
    v = F.col("value")
    rows = views.table(spark, d, "events").select(
        F.col("event_type").alias("symbol"), F.lit("1h").alias("interval"), start.alias("start"), (start + timefn.seconds(86400)).alias("end"),
        F.row_number().over(Window.partitionBy("event_type", start).orderBy("ts", "event_id")).alias("pos"),
        (F.col("ts").cast(timefn.NTZ) + F.make_dt_interval(secs=F.lit(0.0))).alias("datetime"), v.alias("open"),
        F.when(F.col("event_id") % 89 == 0, v - 5).otherwise(v + 1).alias("high"), (v - 1).alias("low"), v.alias("close"), F.lit(1.0).alias("volume"),
    )
    bad = windows.check_windows(rows, rows.select(*windows.KEY))
    good = windows.strict_gate(rows, bad, F.lit("2024-01-01"))[0]
    return good.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("open").alias("total"))


@query(
    f"""WITH {SQL_DAYS}, h AS (SELECT symbol, date_trunc('day', datetime) AS s, count(DISTINCT date_trunc('hour', datetime)) AS n FROM ticks GROUP BY 1, 2)
SELECT symbol, s AS start, s + INTERVAL 1 DAY AS "end", CAST(24 AS BIGINT) AS hours, n AS present, 24 - n AS missing FROM w JOIN h USING (symbol, s)"""
)
def hour_coverage(spark: SparkSession, d: str) -> DataFrame:
    return windows.hour_coverage(views.ticks(spark, d), days(spark, d))


@query(
    f"""WITH {SQL_DAYS}, o AS (SELECT symbol, date_trunc('day', datetime) AS s, count(DISTINCT seq % 2) AS n FROM ticks WHERE day(datetime) % 3 <> 0 OR seq % 2 = 0 GROUP BY 1, 2)
SELECT symbol, s AS start, s + INTERVAL 1 DAY AS "end" FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.symbol = w.symbol AND o.s = w.s AND n = 2)"""
)
def open_windows(spark: SparkSession, d: str) -> DataFrame:
    start = F.date_trunc("DAY", "datetime").cast(timefn.NTZ)
    have = views.ticks(spark, d).where("day(datetime) % 3 <> 0 or seq % 2 = 0").select("symbol", F.when(F.col("seq") % 2 == 0, "1m").otherwise("1d").alias("interval"), start.alias("start"))
    return windows.open_windows(days(spark, d), have.withColumn("end", F.col("start") + timefn.seconds(86400)), ["1m", "1d"])


@query(
    f"""WITH {SQL_TICKS} SELECT symbol, date_trunc('hour', datetime) AS hour, count(*) AS parsed FROM ticks GROUP BY 1, 2 HAVING count_if(seq % 4 = 0) = 0"""
)
def rejected_slots(spark: SparkSession, d: str) -> DataFrame:
    return windows.rejected_slots(views.ticks(spark, d), F.col("seq") % 4 == 0)


@query(
    f"""WITH {SQL_TICKS}, x AS (SELECT symbol, datetime < lag(datetime) OVER (PARTITION BY symbol ORDER BY seq) AS back FROM ticks)
SELECT symbol, count_if(back) = 0 AS monotonic FROM x GROUP BY 1"""
)
def monotonic_series(spark: SparkSession, d: str) -> DataFrame:
    return quality.monotonic(views.ticks(spark, d), ["symbol"], "seq")


@query(
    f"""WITH {SQL_DAYS}, h AS (SELECT symbol, s, unnest(generate_series(s, s + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS hour FROM w)
SELECT symbol, s AS start, s + INTERVAL 1 DAY AS "end", hour FROM h"""
)
def hour_slots(spark: SparkSession, d: str) -> DataFrame:
    return windows.hour_slots(days(spark, d))


@query(f"""WITH {SQL_DAYS} SELECT symbol, s AS start, s + INTERVAL 1 DAY AS "end", unnest(['1m', '5m', '1d']) AS interval FROM w""")
def window_tasks(spark: SparkSession, d: str) -> DataFrame:
    return windows.tasks(days(spark, d), ["1m", "5m", "1d"])


@query(
    """WITH q AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN '../bad' ELSE 'C#' || o_custkey END AS symbol, CASE o_orderkey % 5 WHEN 0 THEN '1x' WHEN 1 THEN '0d' ELSE '5m' END AS interval,
  CASE WHEN o_orderkey % 11 = 0 THEN 'not-a-date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s, CASE WHEN o_orderkey % 7 = 0 THEN '1990-01-01' ELSE '2002-01-01' END AS e,
  CASE o_orderkey % 3 WHEN 0 THEN 'Back' WHEN 1 THEN '' ELSE 'odd' END AS adjust, CASE WHEN o_orderkey % 2 = 0 THEN 'stock' ELSE 'ashare' END AS asset_type FROM orders)
SELECT k, CASE WHEN symbol = '../bad' OR NOT regexp_full_match(symbol, '[A-Za-z0-9._+=#@$%&^-]{1,128}') THEN 'symbol' WHEN interval <> '5m' THEN 'interval' WHEN s = 'not-a-date' THEN 'date'
  WHEN s > e THEN 'start_after_end' WHEN adjust = 'odd' THEN 'adjust' WHEN adjust = 'Back' AND asset_type <> 'ashare' THEN 'adjust_not_supported' END AS fault FROM q"""
)
def validate_requests(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = views.table(spark, d, "orders").select(
        k.alias("k"),
        F.when(k % 13 == 0, "../bad").otherwise(F.concat(F.lit("C#"), F.col("o_custkey"))).alias("symbol"),
        F.when(k % 5 == 0, "1x").when(k % 5 == 1, "0d").otherwise("5m").alias("interval"),
        F.when(k % 11 == 0, "not-a-date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("start"),
        F.when(k % 7 == 0, "1990-01-01").otherwise("2002-01-01").alias("end"),
        F.when(k % 3 == 0, "Back").when(k % 3 == 1, "").otherwise("odd").alias("adjust"),
        F.when(k % 2 == 0, "stock").otherwise("ashare").alias("asset_type"),
    )
    return ledger.validate_requests(rows).select("k", "fault")


@query(
    """WITH f AS (SELECT DISTINCT o_orderpriority AS symbol, date_trunc('month', o_orderdate) AS s, CASE o_orderkey % 3 WHEN 0 THEN '1m' ELSE 'mvp' END AS interval, o_orderkey % 4 AS n FROM orders)
SELECT DISTINCT symbol, s AS "start", s + to_days(CAST(n AS INTEGER)) AS "end" FROM f WHERE interval = 'mvp' AND n > 0"""
)
def failed_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows of a ledger that is written as text and read back; orders stand for failures, some of an empty range."""
    k, month = F.col("o_orderkey"), F.date_trunc("MONTH", "o_orderdate").cast(timefn.NTZ)
    end = F.when(k % 4 == 0, F.lit("never")).otherwise(F.date_format(month + F.make_dt_interval((k % 4).cast("int")), "yyyy-MM-dd"))
    failures = views.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.when(k % 3 == 0, "1m").otherwise("mvp").alias("interval"), F.date_format(month, "yyyy-MM-dd").alias("start"), end.alias("end"), F.lit("fetch_failed").alias("reason"),
    )
    path = scratch(spark, "ledger")
    listings.write_csv(listings.ledger_rows(failures, F.lit("2024-01-01")), path)
    return windows.failed_windows(spark.read.option("header", True).csv(path))
