"""Queries of codes, stored ranges, issues, chunks and window edges, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import names, timefn
from tickloom.operators import catalog, quality, shape, store, windows
from tickloom.plans import views
from tickloom.plans.queries import ORACLE_SQL, QUERIES, SQL_1M, SQL_BOUNDS, SQL_CATALOG, SQL_DIRTY, SQL_PROFILE, SQL_TICKS, query
from tickloom.sources import files, listings

NTZ = timefn.NTZ
KINDS = ["", " ETF", " REIT", " LOF", " QDII", "货币基金", "债券基金", "基金", "ETF联接"]
STARTS = ["688", "300", "900", "200", "512", "430", "159", "6x", "000"]
SQL_CODES = f"""codes AS (SELECT p_partkey AS k, (['{"', '".join(STARTS)}'])[p_partkey % 9 + 1] || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS number,
  p_name || (['{"', '".join(KINDS)}'])[p_size % 9 + 1] AS name FROM part),
c AS (SELECT *, CASE WHEN NOT regexp_full_match(number, '[0-9]+') THEN NULL WHEN number[1] IN ('5', '6', '9') THEN 'sh.' || number
  WHEN number[1] IN ('0', '1', '2', '3') THEN 'sz.' || number WHEN number[1] IN ('4', '8') THEN 'bj.' || number END AS code FROM codes)"""


def codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")

    def of(values: list[str], n) -> F.Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))

    number = F.concat(of(STARTS, k), F.lpad((k % 1000).cast("string"), 3, "0"))
    return views.table(spark, d, "part").select(k.alias("k"), number.alias("number"), F.concat("p_name", of(KINDS, F.col("p_size"))).alias("name"))


@query(
    f"""WITH {SQL_CODES} SELECT k, code, CASE code[1:2] WHEN 'sh' THEN 'SSE' WHEN 'sz' THEN 'SZSE' WHEN 'bj' THEN 'BSE' END AS exchange,
  CASE WHEN code LIKE 'bj.%' THEN 'BSE' WHEN code LIKE 'sh.688%' THEN 'STAR' WHEN code LIKE 'sh.900%' OR code LIKE 'sz.200%' THEN 'B'
    WHEN code LIKE 'sz.300%' THEN 'CHINEXT' WHEN code IS NOT NULL THEN 'MAIN' END AS market FROM c"""
)
def exchange_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = codes(spark, d).withColumn("code", catalog.prefixed_code(F.col("number")))
    return rows.withColumn("x", catalog.exchange_and_market(F.col("code"))).select("k", "code", "x.exchange", "x.market")


@query(
    f"""WITH {SQL_CODES}, f AS (SELECT k, code, CASE WHEN contains(name, '联接') THEN 'ETF_LINK' WHEN contains(upper(name), 'REIT') THEN 'REIT' WHEN contains(upper(name), 'LOF') THEN 'LOF'
  WHEN contains(upper(name), 'QDII') THEN 'QDII' WHEN contains(upper(name), 'ETF') OR regexp_matches(code, '^[a-z]+\\.(51|15)') THEN 'ETF' WHEN contains(name, '货币') THEN 'MONEY'
  WHEN contains(name, '债') THEN 'BOND' WHEN contains(name, '基金') THEN 'FUND' END AS fund_category FROM c)
SELECT k, fund_category, CASE WHEN fund_category IS NOT NULL THEN fund_category = 'ETF' END AS is_etf, CASE WHEN fund_category IS NOT NULL THEN true END AS is_fund,
  coalesce(regexp_matches(code, '^(sh\\.(51[0-3]|51[5-8]|56[0-3]|588)|sz\\.159)'), false) AS etf_code FROM f"""
)
def fund_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = codes(spark, d).withColumn("code", catalog.prefixed_code(F.col("number")))
    rows = rows.withColumn("x", catalog.fund_class(F.col("code"), F.col("name")))
    return rows.select("k", "x.fund_category", "x.is_etf", "x.is_fund", F.coalesce(names.is_etf_code(F.col("code")), F.lit(False)).alias("etf_code"))


@query(
    """WITH x AS (SELECT c_custkey AS k, (['1m', '1h', '1d', '1wk', '4h', ' 5M ', '7m'])[c_custkey % 7 + 1] AS i, (['front', 'back', 'none', 'odd', NULL])[c_custkey % 5 + 1] AS a FROM customer)
SELECT k, CASE i WHEN '1m' THEN '1' WHEN '1h' THEN '60' WHEN '1d' THEN 'd' WHEN '1wk' THEN 'w' WHEN ' 5M ' THEN '5' END AS baostock,
  CASE i WHEN '1m' THEN 'M1' WHEN '1h' THEN 'H1' WHEN '1d' THEN 'D1' WHEN '4h' THEN 'H4' WHEN ' 5M ' THEN 'M5' END AS dukascopy,
  CASE i WHEN '1h' THEN '60m' WHEN ' 5M ' THEN '5m' ELSE i END AS chart, CASE a WHEN 'front' THEN '2' WHEN 'none' THEN '3' ELSE '1' END AS adjust FROM x"""
)
def vendor_codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    i = F.element_at(F.array(*[F.lit(x) for x in ("1m", "1h", "1d", "1wk", "4h", " 5M ", "7m")]), (k % 7 + 1).cast("int"))
    a = F.element_at(F.array(*[F.lit(x) for x in ("front", "back", "none", "odd", None)]), (k % 5 + 1).cast("int"))
    vendors = [names.vendor_interval(v, i).alias(v) for v in ("baostock", "dukascopy", "chart")]
    return views.table(spark, d, "customer").select(k.alias("k"), *vendors, names.vendor_adjust(a).alias("adjust"))


@query(f"WITH {SQL_CATALOG} SELECT symbol, name FROM catalog WHERE symbol NOT IN ('P17', 'P27') AND (symbol LIKE '%7' OR regexp_matches(symbol, '(?i)^p[0-9]*33$'))")
def symbol_filter(spark: SparkSession, d: str) -> DataFrame:
    spec = catalog.CatalogFilter(exclude_symbols=["p17"], include_regex=["7$", "(?P<n>x)"]).merged(catalog.CatalogFilter(exclude_symbols=["P27"], include_regex=["^p[0-9]*33$", "["]))
    return catalog.catalog_filter(views.catalog(spark, d), spec).select("symbol", "name")


@query(f"WITH {SQL_CATALOG} SELECT symbol, name, (SELECT count(*) FROM catalog WHERE is_fund) AS total FROM catalog WHERE is_fund ORDER BY name, symbol LIMIT 25")
def catalog_page(spark: SparkSession, d: str) -> DataFrame:
    rows = views.catalog(spark, d).where("is_fund").withColumn("order", F.struct("name", "symbol"))
    page, total = catalog.first_rows(rows, 25, "order")
    return page.select("symbol", "name").join(F.broadcast(total), how="cross")  # one row


@query("SELECT p_brand AS category, count(DISTINCT p_type) AS symbols FROM part GROUP BY ROLLUP (p_brand)")
def instrument_group_counts(spark: SparkSession, d: str) -> DataFrame:
    groups = views.table(spark, d, "part").groupBy(F.col("p_brand").alias("category")).agg(F.collect_set("p_type").alias("symbols"))
    return catalog.group_counts(groups)


@query("SELECT p_type AS symbol, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS categories FROM part GROUP BY 1")
def instrument_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = views.table(spark, d, "part").groupBy(F.col("p_brand").alias("category")).agg(F.collect_set("p_type").alias("symbols"))
    return catalog.group_members(groups).withColumn("categories", F.concat_ws(",", "categories"))


@query(
    """SELECT o_orderkey AS k, h = 17 AND m = 0 AS aligned FROM (SELECT o_orderkey, hour(t) AS h, minute(t) AS m FROM (
SELECT o_orderkey, ((o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 2)) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM orders))"""
)
def session_alignment(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    at = F.col("o_orderdate").cast(NTZ) + timefn.seconds((k % 24) * 3600 + (k % 2) * 60)
    return views.table(spark, d, "orders").select(k.alias("k"), timefn.is_session_close(at).alias("aligned"))


SQL_SPANS = "r AS (SELECT o_orderpriority AS symbol, min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders GROUP BY 1)"


@query(
    f"""WITH {SQL_SPANS}, c AS (SELECT symbol, e, unnest(generate_series(s, e - INTERVAL 1 SECOND, INTERVAL 10 DAY)) AS a FROM r)
SELECT symbol, a AS chunk_start, least(e, a + INTERVAL 10 DAY) AS chunk_end, strftime(a, '%Y%m%d') || '_' || strftime(least(e, a + INTERVAL 10 DAY), '%Y%m%d') AS tag FROM c"""
)
def fetch_chunks(spark: SparkSession, d: str) -> DataFrame:
    r = views.daily_ticks(spark, d).groupBy("symbol").agg(F.min("datetime").alias("start"), F.max("datetime").alias("end"))
    out = timefn.chunks(r, "start", "end", 10)
    return out.select("symbol", "chunk_start", "chunk_end", timefn.window_tag(F.col("chunk_start"), F.col("chunk_end")).alias("tag"))


@query(
    f"""WITH {SQL_TICKS} SELECT seq, datetime + INTERVAL 90 MINUTE AS shifted, CASE WHEN date_trunc('hour', datetime) = datetime THEN datetime
  ELSE date_trunc('hour', datetime) + INTERVAL 1 HOUR END AS hour_end, datetime - INTERVAL 30 DAY AS since, least(TIMESTAMP '2024-01-10', datetime) AS upto FROM ticks"""
)
def shifted_times(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("datetime")
    since, upto = timefn.last_days(30, t, F.lit("2024-01-10").cast(NTZ))
    return views.ticks(spark, d).select("seq", timefn.shift_hours(t, 1.5).alias("shifted"), timefn.hour_ceil(t).alias("hour_end"), since.alias("since"), upto.alias("upto"))


SQL_FILES = """f AS (SELECT o_orderpriority AS symbol, CASE WHEN o_orderkey % 9 = 0 THEN 'notes' WHEN o_orderkey % 8 = 0 THEN '1d_bad_' || strftime(o_orderdate, '%Y%m%d') ELSE
  CASE WHEN o_orderkey % 2 = 0 THEN '1d' ELSE '1h' END || '_' || strftime(o_orderdate, '%Y%m%d') || '_' || strftime(o_orderdate + to_days(CAST(o_orderkey % 50 AS INTEGER)), '%Y%m%d') END || '.parquet' AS name FROM orders),
p AS (SELECT symbol, split_part(replace(name, '.parquet', ''), '_', 1) AS interval, try_strptime(split_part(name, '_', 2), '%Y%m%d')::DATE AS s,
  try_strptime(replace(split_part(name, '_', 3), '.parquet', ''), '%Y%m%d')::DATE AS e FROM f WHERE name LIKE '%\\_%\\_%' ESCAPE '\\')"""


def stored_files(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    days = F.date_format(F.date_add(F.to_date(t), (k % 50).cast("int")), "yyyyMMdd")
    good = F.concat(F.when(k % 2 == 0, "1d").otherwise("1h"), F.lit("_"), F.date_format(t, "yyyyMMdd"), F.lit("_"), days)
    name = F.when(k % 9 == 0, "notes").when(k % 8 == 0, F.concat(F.lit("1d_bad_"), F.date_format(t, "yyyyMMdd"))).otherwise(good)
    rows = views.table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), files.range_from_name(F.concat(name, F.lit(".parquet"))).alias("r"))
    return rows.where("r is not null").select("symbol", "r.*")


@query(f"WITH {SQL_FILES} SELECT symbol, interval, s AS start, e AS \"end\" FROM p WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, interval ORDER BY e DESC, s) = 1")
def latest_range(spark: SparkSession, d: str) -> DataFrame:
    return store.latest_range(stored_files(spark, d).where("start is not null"), ["symbol", "interval"])


@query(f"WITH {SQL_FILES} SELECT interval, min(s) AS start, max(e) AS \"end\" FROM p GROUP BY 1")
def infer_window(spark: SparkSession, d: str) -> DataFrame:
    return store.infer_window(stored_files(spark, d), ["interval"])


@query(
    f"""WITH {SQL_DIRTY} SELECT symbol, datetime, close, volume FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, datetime ORDER BY seq % 4 DESC, seq DESC) = 1"""
)
def concat_chunks(spark: SparkSession, d: str) -> DataFrame:
    b = views.dirty_bars(spark, d).withColumn("chunk", F.struct(F.col("seq") % 4, F.col("seq"))).select("symbol", "datetime", "close", "volume", "chunk")
    return store.concat_chunks(b, ["symbol", "datetime"])


@query(
    """WITH a AS (SELECT o_custkey AS symbol, '1d' AS interval, date_trunc('month', o_orderdate) AS s, o_orderkey AS seq, o_orderkey % 5 AS n_rows FROM orders),
u AS (SELECT *, 0 AS w FROM a WHERE seq % 2 = 0 UNION ALL SELECT *, 1 FROM a WHERE seq % 2 = 1 AND n_rows > 0)
SELECT symbol, interval, s AS start, s + INTERVAL 30 DAY AS "end", seq, n_rows FROM u QUALIFY row_number() OVER (PARTITION BY symbol, s ORDER BY w DESC, seq DESC) = 1"""
)
def range_cache_put(spark: SparkSession, d: str) -> DataFrame:
    s = F.date_trunc("MONTH", "o_orderdate").cast(NTZ)
    a = views.table(spark, d, "orders").select(
        F.col("o_custkey").alias("symbol"), F.lit("1d").alias("interval"), s.alias("start"), (s + timefn.seconds(30 * 86400)).alias("end"),
        F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 5).alias("n_rows"),
    )
    return listings.range_cache_put(a.where("seq % 2 = 0"), a.where("seq % 2 = 1"))


@query(
    """WITH b AS (SELECT l_suppkey AS symbol, l_shipdate AS t, l_quantity AS close, date_trunc('year', l_shipdate) AS rs FROM lineitem),
h AS (SELECT s_suppkey AS symbol, TIMESTAMP '1995-01-01' AS rs, TIMESTAMP '1995-01-01' + to_days(CAST(s_suppkey % 300 AS INTEGER)) AS s, TIMESTAMP '1995-12-20' AS e FROM supplier)
SELECT symbol, count(*) AS n, sum(close) AS total FROM b JOIN h USING (symbol, rs) WHERE t BETWEEN s AND e GROUP BY 1"""
)
def cached_bars(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("l_shipdate").cast(NTZ)
    year = F.date_trunc("YEAR", t).cast(NTZ)
    ranges = [year.alias("range_start"), (year + timefn.seconds(366 * 86400)).alias("range_end")]
    b = views.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), t.alias("datetime"), F.col("l_quantity").alias("close"), *ranges)
    first = F.lit("1995-01-01").cast(NTZ)
    requests = views.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("symbol"), (first + timefn.seconds((F.col("s_suppkey") % 300) * 86400)).alias("start"), F.lit("1995-12-20").cast(NTZ).alias("end")
    )
    hits = store.range_cache_lookup(requests, b.select("symbol", "range_start", "range_end").distinct(), ["symbol"])
    return store.trimmed(b, hits, ["symbol"]).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("close").alias("total"))


@query(
    """WITH s AS (SELECT s_suppkey AS k, (['datetime', 'close', 'open', 'high', 'low', 'volume'])[s_suppkey % 6 + 1] AS lack, s_suppkey % 7 = 0 AS bad FROM supplier)
SELECT k, CASE WHEN bad THEN 'parquet.read_failed' ELSE 'schema.missing_' || lack END AS rule_id, CASE WHEN bad OR lack IN ('datetime', 'close') THEN 'ERROR' ELSE 'WARN' END AS severity,
  CAST(1 AS BIGINT) AS n FROM s"""
)
def schema_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    every = ["datetime", "close", "open", "high", "low", "volume"]
    lack = F.element_at(F.array(*[F.lit(c) for c in every]), (k % 6 + 1).cast("int"))
    have = F.array_remove(F.array(*[F.lit(c) for c in every]), lack)
    return quality.schema_issues(views.table(spark, d, "supplier").select(k.alias("k"), F.when(k % 7 != 0, have).alias("columns")), ["k"])


SQL_RULES = """r AS (SELECT symbol, 'datetime.duplicated' AS rule_id, duplicates AS n FROM p WHERE duplicates > 0 UNION ALL SELECT symbol, 'datetime.gap_too_large', max_gap_s FROM p WHERE max_gap_s > 864000
  UNION ALL SELECT symbol, 'close.has_nulls', null_close FROM p WHERE null_close > 0 UNION ALL SELECT symbol, 'ohlc.invalid_range', bad_range FROM p WHERE bad_range > 0
  UNION ALL SELECT symbol, 'values.negative', negatives FROM p WHERE negatives > 0)"""


def series_issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.series_issues(quality.profile(views.dirty_bars(spark, d), ["symbol"]), ["symbol"], F.lit("1d"))


@query(f"WITH {SQL_DIRTY}, {SQL_PROFILE}, {SQL_RULES} SELECT 'WARN' AS severity, rule_id, count(*) AS series, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 2")
def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.issue_counts(series_issues(spark, d))


@query(
    f"""WITH {SQL_DIRTY}, {SQL_PROFILE}, {SQL_RULES} SELECT '' AS path, symbol, '' AS interval, rule_id, 'WARN' AS severity, rule_id || '=' || n AS message, CAST(n AS VARCHAR) AS n,
  '2024-01-01' AS created_at FROM r"""
)
def issue_rows(spark: SparkSession, d: str) -> DataFrame:
    return listings.issue_rows(series_issues(spark, d), F.lit("2024-01-01"))


@query(f"WITH {SQL_TICKS} SELECT symbol, count(*) AS n, sum(price) AS total FROM ticks WHERE datetime >= TIMESTAMP '2024-01-05' AND datetime < TIMESTAMP '2024-01-20' GROUP BY 1")
def ticks_in_window(spark: SparkSession, d: str) -> DataFrame:
    t = views.ticks(spark, d).withColumn("TS", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS")).drop("datetime")
    out = shape.normalize_ticks(t, ["symbol", "seq"], "2024-01-05", "2024-01-20")
    return out.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


@query(
    """SELECT o_orderpriority AS symbol, o_orderdate AS datetime, o_totalprice AS price, CAST(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 100 END AS DOUBLE) AS volume
FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderkey) = 1"""
)
def first_ticks(spark: SparkSession, d: str) -> DataFrame:
    t = views.daily_ticks(spark, d)
    epoch = F.unix_millis(F.col("datetime").cast("timestamp"))
    rows = t.select("symbol", epoch.alias("time_utc"), F.col("price").alias("Last"), "volume", "seq")
    return shape.normalize_ticks(rows, ["symbol"], seq="seq")


SQL_EDGES = """r AS (SELECT event_type AS symbol, date_trunc('hour', ts - INTERVAL 10 MINUTE) AS s, event_id AS pos, date_trunc('second', ts) AS t, time_bucket(INTERVAL 5 MINUTE, ts) AS slot FROM events),
b AS (SELECT *, t < lag(t) OVER (PARTITION BY symbol, s ORDER BY pos) AS back FROM r),
m AS (SELECT symbol, s, count(*) AS n_rows, count_if(back) AS backwards, count(*) - count(DISTINCT t) AS repeated, count_if(t >= s + INTERVAL 1 HOUR) AS out_of_range, count(DISTINCT slot) FILTER (WHERE slot >= s + INTERVAL 1 HOUR) AS extra,
  count(DISTINCT slot) FILTER (WHERE slot < s + INTERVAL 1 HOUR) AS slots, arg_min(t, pos) AS a, arg_max(t, pos) AS z FROM b GROUP BY 1, 2)"""


def edge_rows(spark: SparkSession, d: str) -> DataFrame:
    start = F.date_trunc("HOUR", F.col("ts").cast(NTZ) - timefn.seconds(600)).cast(NTZ)
    v = F.col("value")
    return views.table(spark, d, "events").select(
        F.col("event_type").alias("symbol"), F.lit("5m").alias("interval"), start.alias("start"), (start + timefn.seconds(3600)).alias("end"),
        F.col("event_id").alias("pos"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"),
        v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"), F.lit(1.0).alias("volume"),
    )


@query(f"WITH {SQL_EDGES} SELECT symbol, s AS start, n_rows, out_of_range, extra, slots FROM m")
def window_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = edge_rows(spark, d)
    return windows.window_metrics(rows, rows).select("symbol", "start", "n_rows", "out_of_range", "extra", "slots")


@query(
    f"""WITH {SQL_EDGES} SELECT symbol, s AS start, unnest(list_filter([CASE WHEN out_of_range > 0 THEN 'out_of_range_rows:' || out_of_range END, CASE WHEN backwards > 0 THEN 'datetime_not_monotonic_increasing' END,
  CASE WHEN repeated > 0 THEN 'duplicate_timestamps:' || repeated END, CASE WHEN n_rows <> 12 THEN 'row_count_mismatch:' || n_rows || '!=12' END,
  CASE WHEN slots < 12 THEN 'missing_timestamps:' || (12 - slots) END, CASE WHEN extra > 0 THEN 'extra_timestamps:' || extra END, CASE WHEN a <> s THEN 'first_timestamp_unexpected' END,
  CASE WHEN z <> s + INTERVAL 55 MINUTE THEN 'last_timestamp_unexpected' END], lambda x: x IS NOT NULL)) AS issue FROM m"""
)
def window_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = edge_rows(spark, d)
    return windows.integrity_issues(rows, rows).select("symbol", "start", F.explode("issues").alias("issue"))


@query(
    f"""WITH {SQL_TICKS}, w AS (SELECT symbol, date_trunc('hour', datetime) AS s, count(*) AS n FROM ticks GROUP BY 1, 2), q AS (SELECT symbol, s FROM w UNION SELECT symbol, s + INTERVAL 1 DAY FROM w)
SELECT symbol, q.s AS start, CASE WHEN n IS NULL THEN 'missing_file' WHEN n <> 60 THEN 'row_count_mismatch:' || n || '!=60' END AS reason FROM q LEFT JOIN w USING (symbol, s)"""
)
def assess_windows(spark: SparkSession, d: str) -> DataFrame:
    hour = timefn.hour_floor(F.col("datetime"))
    counts = views.ticks(spark, d).groupBy("symbol", hour.alias("start")).agg(F.count("*").alias("n_rows")).withColumns(
        {"interval": F.lit("1m"), "end": F.col("start") + timefn.seconds(3600), "unaligned": F.lit(0)}
    )
    later = counts.withColumns({"start": F.col("start") + timefn.seconds(86400), "end": F.col("end") + timefn.seconds(86400)})
    return windows.assess_windows(counts.unionByName(later), counts).select("symbol", "start", "reason")


@query(
    f"""WITH {SQL_TICKS}, m AS (SELECT DISTINCT symbol, date_trunc('minute', datetime) AS t FROM ticks), w AS (SELECT symbol, time_bucket(INTERVAL 2 MINUTE, t) AS s, count(*) AS n FROM m GROUP BY 1, 2)
SELECT symbol, CASE n WHEN 2 THEN 'rebuilt' ELSE 'incomplete_1m' END AS status, count(*) AS windows FROM w GROUP BY 1, 2"""
)
def rebuild_status(spark: SparkSession, d: str) -> DataFrame:
    from tickloom.operators import bars

    m = bars.bars_from_ticks(views.ticks(spark, d))
    start = timefn.minute_floor(F.col("datetime"), 2)
    w = m.select("symbol", start.alias("start"), (start + timefn.seconds(120)).alias("end")).distinct()
    return windows.rebuild_daily(m, w)[1].groupBy("symbol", "status").agg(F.count("*").alias("windows"))


@query(
    f"""WITH {SQL_TICKS}, {SQL_BOUNDS}, o AS (SELECT symbol, arg_min(date_trunc('minute', datetime), seq) AS a, arg_max(date_trunc('minute', datetime), seq) AS z FROM ticks GROUP BY 1)
SELECT symbol, a = s AS first_ok, z = e - INTERVAL 1 MINUTE AS last_ok FROM o JOIN b USING (symbol)"""
)
def ends_expected(spark: SparkSession, d: str) -> DataFrame:
    from tickloom.operators import bars

    t = views.ticks(spark, d)
    return windows.ends_expected(t.withColumn("datetime", timefn.minute_floor(F.col("datetime"))), bars.tick_bounds(t), 60, "seq")


@query(
    """WITH w AS (SELECT c_custkey AS k, c_custkey % 14 AS days, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT k, CASE WHEN n = 0 AND days >= 7 THEN 'empty_window' END AS issue FROM w"""
)
def empty_windows(spark: SparkSession, d: str) -> DataFrame:
    n = views.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_rows"))
    start = F.lit("2024-01-01").cast(NTZ)
    w = views.table(spark, d, "customer").join(n, "c_custkey", "left").na.fill(0, ["n_rows"])
    w = w.withColumns({"start": start, "end": start + timefn.seconds((F.col("c_custkey") % 14) * 86400)})
    return w.select(F.col("c_custkey").alias("k"), windows.empty_window_issue().alias("issue"))


@query(
    """WITH w AS (SELECT l_suppkey, l_shipdate, l_quantity, CASE l_linenumber % 3 WHEN 0 THEN 'M1' WHEN 1 THEN 'M5' END AS i, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || l_linenumber AS file FROM lineitem)
SELECT l_suppkey || '_' || i AS series, strftime(l_shipdate, '%Y.%m.%d') AS date, '00:00' AS time, l_quantity AS open, l_quantity AS high, l_quantity AS low, l_quantity AS close,
  CAST(round_even(l_quantity, 0) AS BIGINT) AS volume FROM w WHERE i IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_suppkey, i, l_shipdate ORDER BY file DESC) = 1"""
)
def mt4_batch(spark: SparkSession, d: str) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    rows = views.table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.when(n % 3 == 0, "1m").when(n % 3 == 1, "5m").otherwise("7m").alias("interval"),
        F.col("l_shipdate").cast(NTZ).alias("datetime"), *[q.alias(c) for c in files.BARS],
        F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), n.cast("string")).alias("file"),
    )
    return listings.mt4_batch(rows)


@query(f"WITH {SQL_TICKS}, {SQL_1M} SELECT symbol, strftime(datetime, '%Y-%m-%d') AS period, count(*) AS n, arg_min(close, datetime) AS first_close, arg_max(close, datetime) AS last_close, min(datetime) AS first_time FROM m GROUP BY 1, 2")
def column_arrays(spark: SparkSession, d: str) -> DataFrame:
    from tickloom.operators import bars

    a = files.column_arrays(bars.bars_from_ticks(views.ticks(spark, d)), ["symbol"], "day")
    ends = [F.element_at("close", 1).alias("first_close"), F.element_at("close", -1).alias("last_close"), F.element_at("datetime", 1).alias("first_time")]
    return a.select("symbol", "period", F.size("close").cast("long").alias("n"), *ends)


@query(f"SELECT status, count(*) AS n FROM ({ORACLE_SQL['coverage_plan']}) GROUP BY status")
def plan_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.plan_stats(QUERIES["coverage_plan"](spark, d))


@query(f"WITH {SQL_TICKS}, {SQL_1M} SELECT symbol, datetime, close, 'events' AS source, 'none' AS adjust FROM m")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    from tickloom.operators import bars

    tagged = shape.with_provenance(bars.bars_from_ticks(views.ticks(spark, d)), source="events", adjust="none")
    return tagged.select("symbol", "datetime", "close", *[F.col("provenance")[c].alias(c) for c in ("source", "adjust")])
