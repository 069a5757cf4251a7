"""Checks of bar windows, and the repairs that follow from them.

A window is (symbol, interval, start, end) with start <= t < end. All windows are checked at once: rows are dealt by window, each
count comes from flags set in two sorts of the same partitions, and no expected grid is laid out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import timefn
from tickloom.operators import bars as bar_ops

KEY = ["symbol", "interval", "start", "end"]
OHLCV = ["open", "high", "low", "close", "volume"]
GRIDDED = ["1m", "5m", "15m"]


def _epoch(t: Column) -> Column:
    return F.unix_seconds(t.cast("timestamp"))


def expected_rows(interval: Column, start: Column, end: Column) -> Column:
    """Bars that a window of a gridded interval holds; null for other intervals."""
    step = timefn.interval_seconds(interval)
    first = _epoch(start) - F.pmod(_epoch(start), step)
    n = F.greatest(F.lit(0).cast("long"), F.ceil((_epoch(end) - first) / step).cast("long"))
    return F.when(interval.isin(GRIDDED), n)


def window_metrics(rows: DataFrame, windows: DataFrame, order: str = "pos") -> DataFrame:
    """Per window the counts the rules need. ``rows`` has the key, ``order``, datetime and OHLCV as text or numbers.

    Times that do not parse, and values that are no numbers, count as null. Windows without rows have n_rows 0.
    """
    t = F.try_to_timestamp(F.col("datetime").cast("string")).cast(timefn.NTZ)
    values = {c: F.col(c).try_cast("double") for c in OHLCV}
    b = rows.select(*KEY, order, t.alias("t"), *[F.when(~F.isnan(v), v).alias(c) for c, v in values.items()])
    step = timefn.interval_seconds(F.col("interval"))
    slot = _epoch(F.col("t")) - F.pmod(_epoch(F.col("t")), step)
    first = _epoch(F.col("start")) - F.pmod(_epoch(F.col("start")), step)
    by_order = Window.partitionBy(*KEY).orderBy(order)
    by_time = Window.partitionBy(*KEY).orderBy("t")
    earlier = F.last("t", ignorenulls=True).over(by_order.rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumns({"_slot": slot, "_back": F.col("t") < earlier})
    b = b.withColumns({"_new_t": ~F.col("t").eqNullSafe(F.lag("t").over(by_time)), "_new_slot": ~F.col("_slot").eqNullSafe(F.lag("_slot").over(by_time))})
    on_grid = (F.col("_slot") >= first) & (F.col("_slot") < _epoch(F.col("end")))
    o, h, lo, c = (F.col(x) for x in OHLCV[:4])
    wrong = (h < o) | (h < c) | (lo > o) | (lo > c) | (h < lo)
    there = F.col("t").isNotNull()
    outside = (F.col("t") < F.col("start")) | (F.col("t") >= F.col("end"))
    m = b.groupBy(*KEY).agg(
        F.count("*").alias("n_rows"),
        F.count("t").alias("n_times"),
        F.count_if(F.coalesce(outside, F.lit(False))).alias("out_of_range"),
        F.count_if(F.coalesce(F.col("_back"), F.lit(False))).alias("backwards"),
        F.count_if(there & F.col("_new_t")).alias("distinct_times"),
        F.count_if(there & F.col("_new_slot") & on_grid).alias("slots"),
        F.count_if(there & F.col("_new_slot") & ~on_grid).alias("extra"),
        F.count_if(F.coalesce(wrong & o.isNotNull() & c.isNotNull() & h.isNotNull() & lo.isNotNull(), F.lit(False))).alias("bad_ohlc"),
        F.count_if(there & ~timefn.is_session_close(F.col("t"))).alias("unaligned"),
        *[F.round(F.avg(F.col(x).isNull().cast("double")), 6).alias(f"{x}_null_ratio") for x in OHLCV],
        *[F.count_if(F.coalesce(F.abs(F.col(x)) == float("inf"), F.lit(False))).alias(f"{x}_infinite") for x in OHLCV],
    )
    return windows.select(*KEY).distinct().join(m, KEY, "left").na.fill(0, ["n_rows"])


def _messages(*rules: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(fired, F.lit(False)), text) for fired, text in rules]))


def _count(name: str, n: Column) -> Column:
    return F.concat(F.lit(name + ":"), n.cast("string"))


def check_windows(rows: DataFrame, windows: DataFrame, null_limit: float = 0.8, missing_columns: list[str] | None = None) -> DataFrame:
    """(key, status, fails, warns, n_rows, expected): every window against every rule; fail beats warn beats pass.

    Windows without rows, or without a time that parses, have that one fault only. ``missing_columns`` names columns that the
    whole data set lacks.
    """
    m = window_metrics(rows, windows)
    expected = expected_rows(F.col("interval"), F.col("start"), F.col("end"))
    m = m.withColumns({"expected": expected, "_daily": F.col("interval") == "1d"})
    n, times = F.col("n_rows"), F.col("n_times")
    gridded = F.col("expected").isNotNull()
    repeated = times - F.col("distinct_times")
    missing = F.col("expected") - F.col("slots")
    fails = _messages(
        (~F.col("_daily") & (F.col("out_of_range") > 0), _count("out_of_range_rows", F.col("out_of_range"))),
        (F.col("backwards") > 0, F.lit("datetime_not_monotonic_increasing")),
        (repeated > 0, _count("duplicate_timestamps", repeated)),
        (gridded & (n != F.col("expected")), F.concat(F.lit("row_count_mismatch:"), n, F.lit("!="), F.col("expected"))),
        (gridded & (missing > 0), _count("missing_timestamps", missing)),
        (gridded & (F.col("extra") > 0), _count("extra_timestamps", F.col("extra"))),
        *[(F.col(f"{c}_infinite") > 0, F.lit(f"non_finite_{c}")) for c in OHLCV],
        (F.col("bad_ohlc") > 0, _count("ohlc_relation_invalid", F.col("bad_ohlc"))),
    )
    warns = _messages(
        (times < n, _count("datetime_parse_fail", n - times)),
        *[(F.col(f"{c}_null_ratio") > null_limit, _count(f"nan_ratio_{c}", F.col(f"{c}_null_ratio"))) for c in OHLCV],
        (F.col("_daily") & (F.col("unaligned") > 0), _count("1d_alignment_invalid", F.col("unaligned"))),
    )
    only = F.when(n == 0, "no_data_rows")
    if missing_columns:
        only = only.otherwise("missing_columns:" + ",".join(missing_columns))
    else:
        only = only.when(times == 0, "no_parseable_datetime")
    m = m.withColumn("_only", only)
    none = F.array().cast("array<string>")
    m = m.withColumns({"fails": F.when(F.col("_only").isNotNull(), F.array("_only")).otherwise(fails), "warns": F.when(F.col("_only").isNotNull(), none).otherwise(warns)})
    status = F.when(F.size("fails") > 0, "fail").when(F.size("warns") > 0, "warn").otherwise("pass")
    return m.select(*KEY, status.alias("status"), "fails", "warns", "n_rows", "expected")


def report_rows(checked: DataFrame) -> DataFrame:
    """The check as flat rows for a CSV report."""
    return checked.withColumns({c: F.concat_ws("|", c) for c in ("fails", "warns")})


def _status_counts() -> list[Column]:
    s = F.col("status")
    n = [F.count_if(s == x).alias(x) for x in ("pass", "warn", "fail")]
    window = F.struct("symbol", "start", "end")
    return n + [F.count_distinct(F.when(s == x, window)).alias(f"{x}_windows") for x in ("fail", "warn")]


def _failure_rate(counts: DataFrame) -> DataFrame:
    return counts.withColumn("failure_rate", F.when(F.col("total") > 0, F.round(F.col("fail") / F.col("total"), 6)).otherwise(0.0))


def status_summary(checked: DataFrame, by: list[str]) -> DataFrame:
    """Windows in all, by status, and the share of failing ones."""
    return _failure_rate(checked.groupBy(*by).agg(F.count("*").alias("total"), *_status_counts()))


def status_report(checked: DataFrame) -> DataFrame:
    """``status_summary`` by symbol and interval, by each of them, and of all, from one aggregation: ``level`` says which,
    and a column that a row sums over is null."""
    c = checked.select(F.col("symbol").alias("_symbol"), F.col("interval").alias("_interval"), "symbol", "start", "end", "status")
    keys = [F.col("_symbol"), F.col("_interval")]
    sets = [keys, keys[:1], keys[1:], []]
    level = F.element_at(F.array(*[F.lit(x) for x in ("symbol_interval", "symbol", "interval", "all")]), F.grouping_id("_symbol", "_interval").cast("int") + 1)
    out = c.groupingSets(sets, *keys).agg(level.alias("level"), F.count("*").alias("total"), *_status_counts())
    return _failure_rate(out.withColumnsRenamed({"_symbol": "symbol", "_interval": "interval"}))


def write_report(checked: DataFrame, path: str, meta: dict[str, str], alignment: bool = False) -> None:
    """The whole check below path: ``summary`` is one JSON document with meta and summary; ``results`` and ``repairs`` hold
    one JSON document a window, ``rows`` the flat rows as CSV. Results are never gathered into one document."""
    total = status_summary(checked, [])
    document = F.struct(F.struct(*[F.lit(v).alias(k) for k, v in meta.items()]).alias("meta"), F.struct(*total.columns).alias("summary"))
    total.select(F.to_json(document).alias("value")).write.mode("overwrite").text(f"{path}/summary")
    checked.write.mode("overwrite").json(f"{path}/results")
    repair_groups(checked, alignment).write.mode("overwrite").json(f"{path}/repairs")
    report_rows(checked).write.mode("overwrite").option("header", True).csv(f"{path}/rows")


def repair_needed(alignment: bool = False) -> Column:
    """A failing window; with ``alignment`` also one that warns of daily bars off the session close."""
    fail = F.col("status") == "fail"
    return fail | F.exists("warns", lambda w: w.startswith("1d_alignment_invalid")) if alignment else fail


def repair_groups(checked: DataFrame, alignment: bool = False) -> DataFrame:
    """Per (symbol, start, end): the intervals to mend, and interval:reason for each fault, both sorted."""
    bad = checked.where(repair_needed(alignment))
    reasons = F.transform(F.concat("fails", "warns"), lambda x: F.concat(F.col("interval"), F.lit(":"), x))
    return bad.groupBy("symbol", "start", "end").agg(
        F.sort_array(F.collect_set("interval")).alias("intervals"), F.sort_array(F.flatten(F.collect_list(reasons))).alias("reasons")
    )


def repair_plan(groups: DataFrame, failed: DataFrame, all_intervals: list[str]) -> DataFrame:
    """What to do for each window with faults or in the failure ledger ``failed(symbol, start, end, reason)``.

    Windows only in the ledger take all intervals. If nothing but daily bars is wrong they are rebuilt from minutes. Faults force.
    """
    key = ["symbol", "start", "end"]
    ledger = failed.groupBy(*key).agg(F.sort_array(F.collect_set("reason")).alias("_ledger"))
    both = groups.join(ledger, key, "full_outer")
    had = F.col("intervals").isNotNull()
    none = F.array().cast("array<string>")
    out = both.withColumns({"force": had, "intervals": F.coalesce("intervals", F.array(*[F.lit(i) for i in all_intervals]))})
    action = F.when(F.col("intervals") == F.array(F.lit("1d")), "rebuild_1d_from_1m").otherwise("refetch")
    reasons = F.concat(F.coalesce("reasons", none), F.coalesce("_ledger", none))
    return out.select(*key, "intervals", action.alias("action"), "force", F.concat_ws("|", reasons).alias("reason"))


def assess_windows(windows: DataFrame, counts: DataFrame, alignment: bool = True) -> DataFrame:
    """A light check, also after repairs: (key, reason), null where the window is fine.

    ``counts`` has the key, n_rows, and unaligned; a window that it lacks is missing.
    """
    j = windows.select(*KEY).distinct().join(counts, KEY, "left")
    expected = expected_rows(F.col("interval"), F.col("start"), F.col("end"))
    reason = F.when(F.col("n_rows").isNull(), "missing_file").when(F.col("n_rows") == 0, "empty_file")
    reason = reason.when(F.col("n_rows") != expected, F.concat(F.lit("row_count_mismatch:"), F.col("n_rows"), F.lit("!="), expected))
    if alignment:
        reason = reason.when((F.col("interval") == "1d") & (F.col("unaligned") > 0), _count("1d_alignment_invalid", F.col("unaligned")))
    return j.select(*KEY, reason.alias("reason"))


def _inside(windows: DataFrame, rows: DataFrame, time: str = "datetime") -> DataFrame:
    """Every window (symbol, start, end) with the rows whose time it holds, by the days it covers; at least one row each."""
    key = ["symbol", "start", "end"]
    day = F.date_trunc("DAY", time).cast(timefn.NTZ)
    first, last = (F.date_trunc("DAY", c).cast(timefn.NTZ) for c in (F.col("start"), F.col("end") - timefn.a_moment()))
    w = windows.select(*key).distinct()
    days = F.when(F.col("start") < F.col("end"), F.sequence(first, last, F.expr("INTERVAL 1 DAY"))).otherwise(F.array(first))
    hit = w.withColumn("_day", F.explode(days)).join(rows.withColumn("_day", day), ["symbol", "_day"])
    hit = hit.where((F.col(time) >= F.col("start")) & (F.col(time) < F.col("end"))).drop("_day")
    return w.join(hit, key, "left")


def post_check(repaired: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, reason) of the repaired windows that are still not fine, by the light check of their rows as they are now."""
    m = window_metrics(rows.join(repaired.select(*KEY).distinct(), KEY, "left_semi"), repaired)
    counts = m.where("n_rows > 0").select(*KEY, "n_rows", "unaligned")
    return assess_windows(repaired, counts).where(F.col("reason").isNotNull())


def integrity_issues(rows: DataFrame, windows: DataFrame, step: str = "pos") -> DataFrame:
    """(key, issues): for each window all faults of its rows as one list, with those of its first and last time."""
    checked = check_windows(rows, windows)
    t = F.try_to_timestamp(F.col("datetime").cast("string")).cast(timefn.NTZ)
    ends = rows.select(*KEY, step, t.alias("t")).groupBy(*KEY).agg(F.min_by("t", step).alias("first_dt"), F.max_by("t", step).alias("last_dt"))
    seconds = timefn.interval_seconds(F.col("interval"))
    gridded = F.col("interval").isin(GRIDDED)
    j = checked.join(ends, KEY, "left")
    more = _messages(
        (gridded & (F.col("first_dt") != F.col("start")), F.lit("first_timestamp_unexpected")),
        (gridded & (F.col("last_dt") != F.col("end") - timefn.seconds(seconds)), F.lit("last_timestamp_unexpected")),
    )
    return j.select(*KEY, F.concat("fails", "warns", more).alias("issues"))


def empty_window_issue(days: int = 7) -> Column:
    """The issue of a window without rows that is ``days`` long or longer; null otherwise."""
    long = _epoch(F.col("end")) - _epoch(F.col("start")) >= days * 86400
    return F.when((F.col("n_rows") == 0) & long, F.lit("empty_window"))


def rebuild_daily(minutes: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Daily session bars from stored minutes of windows (symbol, start, end) that hold all their minutes; and each window's status.

    A window without minutes is ``missing_1m``, one that lacks some ``incomplete_1m``; one without a bar that has a price is
    ``rebuild_empty``, and one with bars off the session close ``alignment_invalid:n``. None of these gives a bar.
    """
    key = ["symbol", "start", "end"]
    rows = _inside(windows, minutes.select("symbol", "datetime", *OHLCV))
    want = expected_rows(F.lit("1m"), F.col("start"), F.col("end"))
    have = rows.groupBy(*key).agg(F.count("datetime").alias("n_rows"))
    own = rows.select(F.struct(*key).alias("symbol"), "datetime", *OHLCV)  # sessions are cut at the ends of their window
    daily = bar_ops.bars_daily(own, drop_empty=True)
    bars = daily.select(*[F.col(f"symbol.{c}").alias(c) for c in key], "datetime", *OHLCV)
    found = bars.groupBy(*key).agg(F.count("*").alias("_bars"), F.count_if(~timefn.is_session_close(F.col("datetime"))).alias("_off"))
    state = F.when(F.col("n_rows") == 0, "missing_1m").when(F.col("n_rows") != want, "incomplete_1m").when(F.col("_bars").isNull(), "rebuild_empty")
    state = state.when(F.col("_off") > 0, _count("alignment_invalid", F.col("_off"))).otherwise("rebuilt")
    status = have.join(found, key, "left").select(*key, state.alias("status"))
    return bars.join(status.where("status = 'rebuilt'"), key, "left_semi").select("symbol", "datetime", *OHLCV), status


def reconcile_issues(reconciled: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, issue) for every window of a symbol whose bars do not agree with the ticks, one issue a column."""
    kinds = F.array(*[F.when(F.col(f"{c}_mismatch") > 0, _count(f"{c}_mismatch", F.col(f"{c}_mismatch"))) for c in OHLCV])
    bad = reconciled.where("not ok").select("symbol", F.explode(F.array_compact(kinds)).alias("issue"))
    return windows.select(*KEY).distinct().join(bad, "symbol").select(*KEY, "issue")


def strict_gate(bars: DataFrame, checked: DataFrame, created_at: Column, issues: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Bars of windows without faults, and ledger rows for the others; nothing of a rejected window is written.

    Faults are those of a failing check, an empty window of a week or longer, and what ``issues(key, issue)`` adds, such
    as those of ``reconcile_issues``. A reason names each fault once, eight of them at most, and how many more there are.
    """
    none = F.array().cast("array<string>")
    fails = F.concat(F.when(F.col("status") == "fail", F.col("fails")).otherwise(none), F.array_compact(F.array(empty_window_issue())))
    bad = checked.select(*KEY, fails.alias("fails"))
    if issues is not None:
        more = issues.groupBy(*KEY).agg(F.sort_array(F.collect_set("issue")).alias("_more"))
        bad = bad.join(more, KEY, "full_outer").select(*KEY, F.concat(F.coalesce("fails", none), F.coalesce("_more", none)).alias("fails"))
    bad = bad.where(F.size("fails") > 0)
    accepted = bars.join(bad.select(*KEY), KEY, "left_anti")
    text = [F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("start", "end")]
    preview = F.concat_ws("|", F.slice(F.array_distinct("fails"), 1, 8))
    more = F.size(F.array_distinct("fails")) - 8
    reason = F.when(more > 0, F.concat(preview, F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(preview)
    return accepted, bad.select("symbol", "interval", *text, reason.alias("reason"), created_at.alias("created_at"))


def open_windows(windows: DataFrame, outputs: DataFrame, intervals: list[str], resume: DataFrame | None = None) -> DataFrame:
    """Windows (symbol, start, end) of which not every interval is in ``outputs(symbol, interval, start, end)`` yet; with a
    resume list (symbol, start, end), only those on it."""
    key = ["symbol", "start", "end"]
    if resume is not None:
        windows = windows.join(resume.select(*key).distinct(), key, "left_semi")
    done = outputs.where(F.col("interval").isin(intervals)).groupBy(*key).agg(F.collect_set("interval").alias("have"))
    return windows.join(done.where(F.size("have") == len(set(intervals))), key, "left_anti")


def hour_coverage(ticks: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window (symbol, start, end), hours in it, hours with ticks, and hours without."""
    hour = timefn.hour_floor(F.col("datetime"))
    have = ticks.select("symbol", hour.alias("hour")).where("hour is not null").distinct()
    out = _inside(windows, have, "hour").groupBy("symbol", "start", "end").agg(F.count("hour").alias("present"))
    hours = F.ceil((_epoch(F.col("end")) - _epoch(F.col("start"))) / 3600).cast("long")
    return out.select("symbol", "start", "end", hours.alias("hours"), "present", (hours - F.col("present")).alias("missing"))


def rejected_slots(rows: DataFrame, kept: Column) -> DataFrame:
    """(symbol, hour, parsed): hours that had rows with a time, but kept none."""
    r = rows.where(F.col("datetime").isNotNull()).groupBy("symbol", timefn.hour_floor(F.col("datetime")).alias("hour"))
    r = r.agg(F.count("*").alias("parsed"), F.count_if(F.coalesce(kept, F.lit(False))).alias("_kept"))
    return r.where("_kept = 0").drop("_kept")


def ends_expected(bars: DataFrame, bounds: DataFrame, step_seconds: int, order: str = "pos") -> DataFrame:
    """Per symbol of ``bounds(symbol, start, end)``: whether the first and last row of the series are the grid's."""
    e = bars.groupBy("symbol").agg(F.min_by("datetime", order).alias("first_dt"), F.max_by("datetime", order).alias("last_dt"))
    j = bounds.join(e, "symbol", "left")
    ok = [F.col("first_dt").eqNullSafe(F.col("start")).alias("first_ok"), F.col("last_dt").eqNullSafe(F.col("end") - timefn.seconds(step_seconds)).alias("last_ok")]
    return j.select("symbol", *ok)


def tasks(windows: DataFrame, intervals: list[str]) -> DataFrame:
    """One row for each window and interval."""
    return windows.withColumn("interval", F.explode(F.array(*[F.lit(i) for i in intervals])))


def hour_slots(windows: DataFrame, include_partial: bool = True) -> DataFrame:
    """The hours that a window (start, end) touches; without ``include_partial`` the first one is the next full hour."""
    first = timefn.hour_floor(F.col("start")) if include_partial else timefn.hour_ceil(F.col("start"))
    return timefn.grid(windows.withColumn("_first", first), "_first", "end", 3600, "hour").drop("_first")


def failed_windows(ledger: DataFrame, interval: str = "mvp", symbol: str | None = None) -> DataFrame:
    """Distinct windows (symbol, start, end) of a ledger's text rows of one interval; bad dates and empty ranges are left out."""
    day = [F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")).cast(timefn.NTZ).alias(c) for c in ("start", "end")]
    keep = [F.col("interval") == interval, *([F.col("symbol") == symbol] if symbol else [])]
    rows = ledger.where(reduce(lambda a, b: a & b, keep)).select("symbol", *day)
    return rows.where("start < end").distinct()
