"""The engine's queries on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import numeric, timefn
from tickloom.operators import bars, catalog, ledger, quality, store
from tickloom.plans import views
from tickloom.sources import files

SQL_TICKS = """ticks AS (SELECT event_type AS symbol, ts AS datetime, value AS price,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, event_id AS seq FROM events)"""
SQL_BOUNDS = """b AS (SELECT symbol, date_trunc('minute', min(datetime)) AS s, date_trunc('minute', max(datetime)) + INTERVAL 1 MINUTE AS e
  FROM ticks GROUP BY symbol)"""
SQL_1M = """m AS (SELECT symbol, date_trunc('minute', datetime) AS datetime, arg_min(price, (datetime, seq)) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, (datetime, seq)) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 2)"""
SQL_DIRTY = """bars AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS datetime, l_extendedprice AS open,
  CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN l_extendedprice - 5 ELSE l_extendedprice + 1 END AS high, l_extendedprice - 1 AS low,
  CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN NULL ELSE l_extendedprice END AS close,
  CASE WHEN (l_orderkey + l_linenumber) % 17 = 0 THEN -l_quantity ELSE l_quantity END AS volume,
  l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"""
SQL_PROFILE = """g AS (SELECT *, epoch_us(datetime) - epoch_us(lag(datetime) OVER (PARTITION BY symbol ORDER BY datetime)) AS gap FROM bars),
p AS (SELECT symbol, count(*) AS n_rows, min(datetime) AS min_dt, max(datetime) AS max_dt, count(*) - count(DISTINCT datetime) AS duplicates,
  CAST(max(gap) // 1000000 AS BIGINT) AS max_gap_s, count(*) FILTER (WHERE close IS NULL) AS null_close,
  count(*) FILTER (WHERE high < low OR close < low OR close > high) AS bad_range,
  count(*) FILTER (WHERE open < 0 OR high < 0 OR low < 0 OR close < 0 OR volume < 0) AS negatives FROM g GROUP BY symbol)"""
SQL_CATALOG = """catalog AS (SELECT 'P' || p_partkey AS symbol, p_name AS name, p_brand AS exchange, 'stock' AS asset_type, p_type AS market_category,
  CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_etf, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false END AS is_fund FROM part)"""


def rollup_sql(slot: str, source: str = "m") -> str:
    return f"""SELECT symbol, {slot} AS datetime, arg_min(open, datetime) FILTER (WHERE open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, datetime) FILTER (WHERE close IS NOT NULL) AS close, sum(volume) AS volume FROM {source} GROUP BY 1, 2"""


SESSION = """(date_trunc('day', ((datetime AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') + INTERVAL 7 HOUR) + INTERVAL 17 HOUR)
  AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC'"""
SLOT5 = "time_bucket(INTERVAL 5 MINUTE, datetime)"
SLOT15 = "time_bucket(INTERVAL 15 MINUTE, datetime)"

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


@query(f"WITH {SQL_TICKS}, {SQL_1M} SELECT * FROM m")
def bars_1m(spark: SparkSession, d: str) -> DataFrame:
    return bars.bars_from_ticks(views.ticks(spark, d))


@query(
    f"""WITH {SQL_TICKS}, {SQL_BOUNDS}, {SQL_1M}, g AS (SELECT symbol, unnest(generate_series(s, e - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS datetime FROM b)
SELECT g.symbol, g.datetime, open, high, low, close, volume FROM g LEFT JOIN m ON g.symbol = m.symbol AND g.datetime = m.datetime"""
)
def bars_1m_grid(spark: SparkSession, d: str) -> DataFrame:
    t = views.ticks(spark, d)
    return bars.bars_1m(t, bars.tick_bounds(t))


@query(f"WITH {SQL_TICKS}, {SQL_1M} {rollup_sql(SLOT5)}")
def bars_5m(spark: SparkSession, d: str) -> DataFrame:
    return bars.rollup(bars.bars_from_ticks(views.ticks(spark, d)), 5)


@query(f"WITH {SQL_TICKS}, {SQL_1M} {rollup_sql(SLOT15)}")
def bars_15m(spark: SparkSession, d: str) -> DataFrame:
    return bars.rollup(bars.bars_from_ticks(views.ticks(spark, d)), 15)


@query(f"WITH {SQL_TICKS}, {SQL_1M} {rollup_sql(SESSION)}")
def bars_daily_ny_close(spark: SparkSession, d: str) -> DataFrame:
    return bars.bars_daily(bars.bars_from_ticks(views.ticks(spark, d)))


@query(
    f"""WITH {SQL_TICKS}, {SQL_1M}, a AS ({rollup_sql(SLOT5)}), t5 AS (SELECT symbol, {SLOT5} AS datetime, arg_min(price, (datetime, seq)) AS open,
  max(price) AS high, min(price) AS low, arg_max(price, (datetime, seq)) AS close, sum(volume + CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END) AS volume FROM ticks GROUP BY 1, 2),
j AS (SELECT a.symbol, {", ".join(f"CASE WHEN coalesce(abs(a.{c} - t5.{c}) <= 1e-9, a.{c} IS NOT DISTINCT FROM t5.{c}) THEN 0 ELSE 1 END AS {c}" for c in bars.OHLCV)}
  FROM a JOIN t5 ON a.symbol = t5.symbol AND a.datetime = t5.datetime)
SELECT symbol, count(*) AS overlap, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}_mismatch" for c in bars.OHLCV)},
  sum(open + high + low + close + volume) = 0 AS ok FROM j GROUP BY symbol"""
)
def reconcile_bars(spark: SparkSession, d: str) -> DataFrame:
    t = views.ticks(spark, d)
    given = t.withColumn("given", F.col("volume") + F.when(F.col("seq") % 50 == 0, 1).otherwise(0))  # some volumes are off
    return bars.reconcile_ticks(given, 5, "given")


@query(
    f"""WITH {SQL_TICKS}, {SQL_BOUNDS}, {SQL_1M}, g AS (SELECT symbol, unnest(generate_series(s, e - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS datetime FROM b),
x AS (SELECT g.symbol, g.datetime FROM g ANTI JOIN m ON g.symbol = m.symbol AND g.datetime = m.datetime),
i AS (SELECT *, datetime - to_minutes(row_number() OVER (PARTITION BY symbol ORDER BY datetime)) AS k FROM x)
SELECT symbol, min(datetime) AS gap_start, max(datetime) AS gap_end, count(*) AS slots FROM i GROUP BY symbol, k"""
)
def gap_ranges(spark: SparkSession, d: str) -> DataFrame:
    t = views.ticks(spark, d)
    return quality.gaps_between(t, bars.tick_bounds(t), 1)


@query(f"WITH {SQL_DIRTY}, {SQL_PROFILE} SELECT * FROM p")
def profile_bars(spark: SparkSession, d: str) -> DataFrame:
    return quality.profile(views.dirty_bars(spark, d), ["symbol"])


@query(
    f"""WITH {SQL_DIRTY}, {SQL_PROFILE}, r AS (
SELECT symbol, 'datetime.duplicated' AS rule_id, duplicates AS n FROM p WHERE duplicates > 0 UNION ALL
SELECT symbol, 'datetime.gap_too_large', max_gap_s FROM p WHERE max_gap_s > 864000 UNION ALL
SELECT symbol, 'close.has_nulls', null_close FROM p WHERE null_close > 0 UNION ALL
SELECT symbol, 'ohlc.invalid_range', bad_range FROM p WHERE bad_range > 0 UNION ALL
SELECT symbol, 'values.negative', negatives FROM p WHERE negatives > 0)
SELECT symbol, rule_id, 'WARN' AS severity, n FROM r"""
)
def validate_series(spark: SparkSession, d: str) -> DataFrame:
    return quality.series_issues(quality.profile(views.dirty_bars(spark, d), ["symbol"]), ["symbol"], F.lit("1d"))


@query(
    f"""WITH {SQL_DIRTY} SELECT symbol, {", ".join(f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS {c}_null_ratio" for c in bars.OHLCV)}
FROM bars GROUP BY symbol"""
)
def null_ratios(spark: SparkSession, d: str) -> DataFrame:
    return quality.null_ratios(views.dirty_bars(spark, d), ["symbol"])


@query(
    f"""WITH {SQL_DIRTY}, u AS (SELECT *, 0 AS n FROM bars WHERE seq % 3 <> 0 UNION ALL SELECT *, 1 AS n FROM bars WHERE seq % 3 = 0)
SELECT symbol, datetime, open, high, low, close, volume, seq FROM u QUALIFY row_number() OVER (PARTITION BY symbol, datetime ORDER BY n DESC, seq DESC) = 1"""
)
def upsert_bars(spark: SparkSession, d: str) -> DataFrame:
    b = views.dirty_bars(spark, d)
    return store.upsert(b.where("seq % 3 <> 0"), b.where("seq % 3 = 0"), ["symbol", "datetime"])


@query(
    """SELECT o_orderpriority AS symbol, o_orderdate AS datetime, o_totalprice AS price,
  CAST(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 100 END AS DOUBLE) AS volume, o_orderkey AS seq
FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderkey) = 1"""
)
def keep_first_tick(spark: SparkSession, d: str) -> DataFrame:
    return store.keep_first(views.daily_ticks(spark, d), ["symbol", "datetime"], ["seq"])


@query(
    """WITH c AS (SELECT o_custkey AS k, min(o_orderdate) AS s, max(o_orderdate) AS m FROM orders GROUP BY 1),
r AS (SELECT c_custkey AS k, TIMESTAMP '1996-01-01' AS st, TIMESTAMP '1998-01-01' AS en FROM customer),
j AS (SELECT r.*, s, m, CASE WHEN s <= st AND m >= en THEN 'skipped' WHEN s <= st THEN 'resume' ELSE 'full' END AS status FROM r LEFT JOIN c ON r.k = c.k)
SELECT k AS symbol, st AS "start", en AS "end", status, CASE status WHEN 'resume' THEN m + INTERVAL 1 DAY WHEN 'full' THEN st END AS fetch_start,
  least(s, st) AS output_start FROM j"""
)
def coverage_plan(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("timestamp_ntz").alias("datetime"))
    r = views.table(spark, d, "customer").select(
        F.col("c_custkey").alias("symbol"), F.lit("1996-01-01").cast("timestamp_ntz").alias("start"), F.lit("1998-01-01").cast("timestamp_ntz").alias("end")
    )
    return store.coverage_plan(r, store.coverage(o, ["symbol"]), ["symbol"], 86400)


@query(
    """WITH c AS (SELECT l_suppkey AS symbol, date_trunc('month', l_shipdate) AS rs, date_trunc('month', l_shipdate) + INTERVAL 90 DAY AS re FROM lineitem GROUP BY ALL),
r AS (SELECT DISTINCT l_suppkey AS symbol, l_shipdate AS s, l_shipdate + INTERVAL 20 DAY AS e FROM lineitem)
SELECT r.symbol, s AS "start", e AS "end", rs AS range_start, re AS range_end FROM r JOIN c ON r.symbol = c.symbol AND rs <= s AND re >= e
QUALIFY row_number() OVER (PARTITION BY r.symbol, s, e ORDER BY re - rs, rs) = 1"""
)
def range_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("l_shipdate").cast("timestamp_ntz")
    rows = views.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), t.alias("start"))
    month = F.date_trunc("MONTH", "start").cast("timestamp_ntz")
    ranges = rows.select("symbol", month.alias("range_start")).distinct().withColumn("range_end", F.col("range_start") + timefn.seconds(90 * 86400))
    requests = rows.withColumn("end", F.col("start") + timefn.seconds(20 * 86400))  # repeated ones give one row
    return store.range_cache_lookup(requests, ranges, ["symbol"], cell=7 * 86400)  # ranges of 90 days by months: weeks tell them apart


@query(
    f"""WITH {SQL_CATALOG} SELECT * FROM catalog WHERE (regexp_matches(name, '(?i)ring|BOX') AND NOT symbol LIKE 'P1%' AND upper(exchange) <> 'BRAND#3')
  AND coalesce(is_etf, false) = false"""
)
def catalog_filter(spark: SparkSession, d: str) -> DataFrame:
    spec = catalog.CatalogFilter(include_name_regex=["ring|BOX", "["], exclude_prefixes=["p1"], exclude_exchanges=["brand#3"], only_etf=False)
    return catalog.catalog_filter(views.catalog(spark, d), spec)


@query(
    f"""WITH {SQL_CATALOG} SELECT facet, value, count(*) AS n FROM (SELECT 'exchange' AS facet, exchange AS value FROM catalog UNION ALL
SELECT 'market_category', market_category FROM catalog) WHERE value IS NOT NULL GROUP BY 1, 2"""
)
def catalog_facets(spark: SparkSession, d: str) -> DataFrame:
    return catalog.facets(views.catalog(spark, d), ["exchange", "market_category"])


@query(
    f"""WITH {SQL_CATALOG}, o AS (SELECT symbol FROM catalog WHERE length(name) % 5 <> 0 OR length(name) % 7 = 0), n AS (SELECT symbol FROM catalog WHERE length(name) % 7 <> 0)
SELECT symbol, 'added' AS status FROM n ANTI JOIN o USING (symbol) UNION ALL SELECT symbol, 'removed' FROM o ANTI JOIN n USING (symbol)"""
)
def symbols_compare(spark: SparkSession, d: str) -> DataFrame:
    c = views.catalog(spark, d)
    n = F.length("name")
    return catalog.compare(c.where((n % 5 != 0) | (n % 7 == 0)), c.where(n % 7 != 0))


@query(
    """SELECT DISTINCT s AS symbol FROM (SELECT upper(replace(replace(unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)), '/', ''), 'ß', 'ss')) AS s FROM pages)
WHERE length(s) BETWEEN 1 AND 20"""
)
def page_symbols(spark: SparkSession, d: str) -> DataFrame:
    return files.page_symbols(views.table(spark, d, "pages"), 'href="([^"]+)"')


@query(
    """WITH q AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS ask, CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice * (1 - l_discount) END AS bid,
  CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS av, CASE WHEN l_linenumber % 4 = 0 THEN l_quantity END AS bv FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce((ask + bid) / 2, ask, bid) AS price,
  CASE WHEN av IS NOT NULL OR bv IS NOT NULL THEN coalesce(av, 0) + coalesce(bv, 0) END AS volume FROM q"""
)
def tick_values(spark: SparkSession, d: str) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    bid = F.when(n % 3 != 0, F.col("l_extendedprice") * (1 - F.col("l_discount")))
    none = F.lit(None).cast("double")
    price = numeric.tick_price(none, none, F.col("l_extendedprice"), bid)
    volume = numeric.tick_volume(F.when(n % 2 == 0, q), F.when(n % 4 == 0, q))
    rows = views.table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", price.alias("price"), volume.alias("volume"))


@query(
    f"""WITH {SQL_TICKS}, {SQL_1M} SELECT symbol, strftime(datetime, '%Y.%m.%d') AS date, strftime(datetime, '%H:%M') AS time, open, high, low, close,
  CAST(round_even(coalesce(volume, 0) / 4, 0) AS BIGINT) AS volume FROM m"""
)
def export_mt4(spark: SparkSession, d: str) -> DataFrame:
    b = bars.bars_from_ticks(views.ticks(spark, d)).withColumn("volume", F.col("volume") / 4)
    return files.mt4_rows(b)


@query(
    """WITH r AS (SELECT o_orderpriority AS symbol, min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders GROUP BY 1),
y AS (SELECT symbol, s, e, unnest(generate_series(year(s), year(e))) AS y FROM r)
SELECT symbol, s AS "start", e AS "end", greatest(s, make_timestamp(y, 1, 1, 0, 0, 0)) AS window_start, least(e, make_timestamp(y + 1, 1, 1, 0, 0, 0)) AS window_end
FROM y WHERE make_timestamp(y, 1, 1, 0, 0, 0) < e"""
)
def year_windows(spark: SparkSession, d: str) -> DataFrame:
    r = views.daily_ticks(spark, d).groupBy("symbol").agg(F.min("datetime").alias("start"), F.max("datetime").alias("end"))
    return timefn.year_windows(r, "start", "end")


@query(
    """WITH l AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderpriority END AS symbol,
  CASE WHEN o_orderkey % 5 = 0 THEN 'not-a-date' WHEN o_orderkey % 6 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS s,
  CASE WHEN o_orderkey % 7 = 0 THEN '1990-01-01' WHEN o_orderkey % 9 = 0 THEN 'soon' WHEN o_orderkey % 8 = 0 THEN '' ELSE '2002-01-01T06:30:00' END AS e,
  CASE o_orderkey % 4 WHEN 0 THEN 'AUTO' WHEN 1 THEN '' WHEN 2 THEN 'Front' ELSE 'bad' END AS a FROM orders),
t AS (SELECT *, try_cast(s AS TIMESTAMP) AS sd, try_cast(nullif(e, '') AS TIMESTAMP) AS ed, coalesce(nullif(lower(a), ''), 'auto') AS adj,
  trim(symbol) <> '' AND adj <> 'bad' AS valid FROM l),
f AS (SELECT *, coalesce(sd, TIMESTAMP '2020-01-01') AS fs, coalesce(ed, TIMESTAMP '2021-01-01') AS fe FROM t)
SELECT k AS seq, nullif(trim(symbol), '') AS symbol, '1d' AS interval, adj AS adjust, 'stock' AS asset_type, valid,
  concat_ws('|', CASE WHEN NOT valid THEN 'invalid_record' END, CASE WHEN valid AND s IS NOT NULL AND sd IS NULL THEN 'bad_start' END,
    CASE WHEN valid AND e <> '' AND ed IS NULL THEN 'bad_end' END, CASE WHEN valid AND fs > fe THEN 'start_after_end' END) AS warnings,
  CASE WHEN valid THEN CASE WHEN fs > fe THEN TIMESTAMP '2020-01-01' ELSE fs END END AS "start",
  CASE WHEN valid THEN CASE WHEN fs > fe THEN TIMESTAMP '2021-01-01' ELSE fe END END AS "end" FROM f"""
)
def validate_ledger(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = views.table(spark, d, "orders").select(
        k.alias("seq"),
        F.when(k % 11 == 0, " ").otherwise(F.col("o_orderpriority")).alias("symbol"),
        F.lit("1d").alias("interval"),
        F.when(k % 5 == 0, "not-a-date").when(k % 6 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("start"),
        F.when(k % 7 == 0, "1990-01-01").when(k % 9 == 0, "soon").when(k % 8 == 0, "").otherwise("2002-01-01T06:30:00").alias("end"),
        F.when(k % 4 == 0, "AUTO").when(k % 4 == 1, "").when(k % 4 == 2, "Front").otherwise("bad").alias("adjust"),
        F.lit(None).cast("string").alias("asset_type"),
    )
    return ledger.validate(rows, "2020-01-01", "2021-01-01").withColumn("warnings", F.array_join("warnings", "|"))


from tickloom.plans import catalog_queries, listing_queries, store_queries, stream_queries, tree_queries, window_queries  # noqa: E402, F401  these add their queries to the same table
