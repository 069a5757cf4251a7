"""Validation of whole trees of files: what can't be read, what columns are missing, and what the rows break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import quality, windows
from tickloom.sources import files, tree
from tickloom.sources.shared import stored

FILE = ["path", "asset_type", "symbol", "interval"]
ISSUE = [*FILE, "rule_id", "severity", "n"]


def file_summaries(spark: SparkSession, found: DataFrame) -> DataFrame:
    """One row for each file of ``footers``: its keys, rows, missing columns, and the profile of what could be read.

    Counts of a column that the file lacks are null; so is the whole profile of a file without a row that could be read.
    ``n_read`` is the number of rows that could be.
    """
    p = quality.profile(tree.scan_files(spark, found), ["path"]).withColumnRenamed("n_rows", "n_read")
    has = {c: F.array_contains("columns", c) for c in ["datetime", *files.BARS]}
    whole = has["high"] & has["low"] & has["close"]
    only = {"min_dt": has["datetime"], "max_dt": has["datetime"], "duplicates": has["datetime"], "max_gap_s": has["datetime"], "null_close": has["close"], "bad_range": whole}
    j = found.join(p, "path", "left").withColumns({c: F.when(cond, F.col(c)) for c, cond in only.items()})
    missing = F.when(F.col("columns").isNotNull(), F.filter(F.array(*[F.lit(c) for c in has]), lambda c: ~F.array_contains("columns", c)))
    return j.withColumns({"missing_columns": missing, "n_read": F.coalesce("n_read", F.lit(0).cast("long"))})


def file_issues(summaries: DataFrame) -> DataFrame:
    """(path, asset_type, symbol, interval, rule_id, severity, n): every rule that a file breaks, reading and schema first.

    A file whose footer could not be read has that one issue. Where fewer rows could be read than the footer says, the
    statistics of the file have failed and ``n`` is the number of lost rows; the other rules then hold for the rest.
    """
    schema = quality.schema_issues(summaries, FILE)
    rows = quality.series_issues(summaries.where("columns is not null"), FILE, F.col("interval"))
    lost = F.col("n_rows") - F.col("n_read")
    failed = summaries.where((lost != 0) & F.array_contains("columns", "datetime"))
    failed = failed.select(*FILE, F.lit("datetime.stats_failed").alias("rule_id"), F.lit("WARN").alias("severity"), F.abs(lost).alias("n"))
    return schema.unionByName(rows).unionByName(failed).select(*ISSUE)


def validate_tree(
    spark: SparkSession, root: str, asset_type: str | None = None, symbol: str | None = None, interval: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(summaries, issues) of the Parquet files below root, of all or of those that the filters name.

    The summaries are written to the shared folder, so that the files are opened and read through once.
    """
    found = stored(tree.footers(spark, root, asset_type, symbol, interval), "footers")
    summaries = stored(file_summaries(spark, found), "summaries")
    return summaries, file_issues(summaries)


def files_with_issues(issues: DataFrame) -> DataFrame:
    """One row: issues, and files, by severity."""
    error, warn = (F.col("severity") == s for s in ("ERROR", "WARN"))
    return issues.agg(
        F.count_if(error).alias("errors"), F.count_if(warn).alias("warnings"),
        F.count_distinct(F.when(error, F.col("path"))).alias("files_with_errors"), F.count_distinct(F.when(warn, F.col("path"))).alias("files_with_warnings"),
    )


def _name(symbol: Column, interval: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("_", symbol, interval, F.date_format(start, "yyyyMMdd"), F.date_format(end, "yyyyMMdd"))


def window_file_faults(expected: DataFrame, heads: DataFrame) -> DataFrame:
    """(key, path, fault) of the windows whose CSV can't be checked; fault is null where it can.

    The first that applies: the file is missing, empty, its first line can't be read, or it lacks columns.
    """
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.csv$", "")
    have = heads.groupBy(name.alias("_name")).agg(F.min_by(F.struct("path", "length", "columns", "error"), "path").alias("f"))
    w = expected.select(*windows.KEY).distinct().withColumn("_name", _name(*[F.col(c) for c in windows.KEY]))
    j = w.join(have, "_name", "left")
    lost = F.filter(F.array(*[F.lit(c) for c in ["datetime", *files.BARS]]), lambda c: ~F.array_contains("f.columns", c))
    fault = (
        F.when(F.col("f").isNull(), "missing_file")
        .when(F.col("f.length") == 0, "empty_file")
        .when(F.col("f.error").isNotNull(), "read_csv_failed")
        .when(F.size(lost) > 0, F.concat(F.lit("missing_columns:"), F.array_join(lost, ",")))
    )
    return j.select(*windows.KEY, F.col("f.path").alias("path"), fault.alias("fault"))


def check_window_files(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """``check_windows`` for the CSVs below root: windows (key) whose file can't be checked fail with that fault alone."""
    faults = window_file_faults(expected, tree.csv_heads(spark, root))
    rows = files.scan_window_csv(spark, root)
    day = [F.to_timestamp_ntz(F.col(c), F.lit("yyyyMMdd")).alias(x) for c, x in (("window_start", "start"), ("window_end", "end"))]
    rows = rows.select("symbol", "interval", *day, F.col("row").alias("pos"), "datetime", *files.BARS)
    checked = windows.check_windows(rows, faults.where("fault is null"))
    none = F.array().cast("array<string>")
    bad = faults.where("fault is not null").select(
        *windows.KEY, F.lit("fail").alias("status"), F.array("fault").alias("fails"), none.alias("warns"), F.lit(0).cast("long").alias("n_rows"),
        windows.expected_rows(F.col("interval"), F.col("start"), F.col("end")).alias("expected"),
    )
    return checked.unionByName(bad)
