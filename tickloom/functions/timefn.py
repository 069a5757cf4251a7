"""Time functions on TIMESTAMP_NTZ columns; UTC unless a zone is named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"
#: Seconds of one unit of an interval code. Fixed values.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 7 * 86400, "wk": 7 * 86400, "mo": 30 * 86400, "y": 365 * 86400}


def seconds(n: Column | int) -> Column:
    zero = F.lit(0)
    return F.make_dt_interval(zero, zero, zero, F.lit(n) if isinstance(n, int) else n)


def a_moment() -> Column:
    """The least difference of two times."""
    return F.expr("INTERVAL 1 MICROSECOND")


def minute_floor(t: Column, minutes: int = 1) -> Column:
    """Start of the slot of ``minutes`` (a divisor of 60) that holds t."""
    start = F.date_trunc("MINUTE", t).cast(NTZ)
    return start - seconds((F.minute(t) % minutes) * 60)


def hour_floor(t: Column) -> Column:
    return F.date_trunc("HOUR", t).cast(NTZ)


def hour_ceil(t: Column) -> Column:
    return F.when(hour_floor(t) == t, t).otherwise(hour_floor(t) + seconds(3600))


def to_zone(t: Column, source: str, target: str) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), t)


def session_close(t: Column, zone: str = "America/New_York", close_hour: int = 17) -> Column:
    """UTC time of the close of the trading session that holds t; a session runs from close to close, local time."""
    local = to_zone(t, "UTC", zone)
    day = F.date_trunc("DAY", local + seconds((24 - close_hour) * 3600)).cast(NTZ)
    return to_zone(day + seconds(close_hour * 3600), zone, "UTC")


def is_session_close(t: Column, zone: str = "America/New_York", close_hour: int = 17) -> Column:
    local = to_zone(t, "UTC", zone)
    return (F.hour(local) == close_hour) & (F.minute(local) == 0) & (F.second(local) == 0)


def interval_seconds(code: Column) -> Column:
    """Length of an interval code such as 5m, 1wk, " 1H" or d; null for codes that are none."""
    code = F.lower(F.trim(code))
    n = F.regexp_extract(code, r"^(\d*)(wk|mo|[wydhms])$", 1)
    unit = F.regexp_extract(code, r"^(\d*)(wk|mo|[wydhms])$", 2)
    size = F.lit(None).cast("long")
    for name, s in UNIT_SECONDS.items():
        size = F.when(unit == name, F.lit(s).cast("long")).otherwise(size)
    return size * F.when(n == "", F.lit(1).cast("long")).otherwise(n.try_cast("long"))


def gap_threshold_seconds(code: Column) -> Column:
    """Largest gap between bars of an interval that is not suspicious; null where none is set."""
    day = 86400
    code = F.lower(F.trim(code))
    return (
        F.when(code.endswith("d"), 10 * day)
        .when(code.endswith("m") | code.endswith("h"), 6 * 3600)
        .when(code.endswith("wk") | code.endswith("w"), 60 * day)
        .when(code.endswith("mo"), 120 * day)
        .cast("long")
    )


def grid(bounds: DataFrame, start: str, end: str, step_seconds: int, name: str = "datetime") -> DataFrame:
    """One row per slot of [start, end) for each row of bounds, made on the executors."""
    last = F.col(end) - a_moment()
    slots = F.when(F.col(start) < F.col(end), F.sequence(F.col(start), last, seconds(step_seconds)))
    return bounds.withColumn(name, F.explode(slots))


def year_windows(df: DataFrame, start: str, end: str) -> DataFrame:
    """Splits [start, end) at each first of January; rows with start >= end give none."""
    years = F.when(F.col(start) < F.col(end), F.sequence(F.year(start), F.year(F.col(end) - a_moment())))
    out = df.withColumn("_y", F.explode(years))

    def first(y: Column) -> Column:
        return F.make_date(y, F.lit(1), F.lit(1)).cast(NTZ)

    return out.select(
        *df.columns,
        F.greatest(F.col(start), first(F.col("_y"))).alias("window_start"),
        F.least(F.col(end), first(F.col("_y") + 1)).alias("window_end"),
    )


def chunks(df: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """Splits [start, end) into chunks of ``days``; the last one ends at end."""
    out = grid(df, start, end, days * 86400, "chunk_start")
    return out.withColumn("chunk_end", F.least(F.col(end), F.col("chunk_start") + seconds(days * 86400)))


def shift_hours(t: Column, hours: float) -> Column:
    """t moved by a number of hours that may have a fraction."""
    return t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours) * 3600))


def last_days(days: int, now: Column, end: Column | None = None) -> tuple[Column, Column]:
    """(start, end) of the last ``days`` before ``now``; a given end is used up to now."""
    stop = now if end is None else F.least(end, now)
    return now - F.make_dt_interval(F.lit(days)), stop


def checked_interval_seconds(code: Column) -> Column:
    """Like ``interval_seconds``, but a code that is none is an error."""
    found = interval_seconds(code)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown interval: "), F.coalesce(code, F.lit("null")))).cast("long"))


def path_date(t: Column, zone: str = "Asia/Shanghai") -> Column:
    """The day of a UTC time in file names, yyyyMMdd by the clock of ``zone``."""
    return F.date_format(to_zone(t, "UTC", zone), "yyyyMMdd")


def window_tag(start: Column, end: Column) -> Column:
    return F.concat_ws("_", F.date_format(start, "yyyyMMdd"), F.date_format(end, "yyyyMMdd"))
