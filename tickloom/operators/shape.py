"""Bringing loose inputs to the column sets of bars and ticks; names are settled on the driver, rows only in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import finite, tick_volume
from tickloom.functions.timefn import NTZ
from tickloom.operators.store import keep_first, keep_last

BASE = ["datetime", "open", "high", "low", "close", "volume"]
#: Column names that feeds use. Fixed values.
TIME_NAMES = ["time", "datetime", "ts", "timestamp", "time_utc"]
PRICE_NAMES = ["price", "last", "mid", "close"]
ASK_NAMES, BID_NAMES = ["ask", "ask_price"], ["bid", "bid_price"]
ASK_VOLUMES = ["ask_volume", "ask-volume", "ask-vol", "askvol", "ask_volume_", "ask_qty"]
BID_VOLUMES = ["bid_volume", "bid-volume", "bid-vol", "bidvol", "bid_qty"]
VOLUME_NAMES = ["volume"]


def unique_names(names: list[str]) -> list[str]:
    """Blank names become col, repeats x, x_1, x_2, never one that is there already."""
    out: list[str] = []
    taken = {n.strip() for n in names if n and n.strip()}
    for n in names:
        base = (n or "").strip() or "col"
        name, k = base, 0
        while name in out or (k and name in taken):
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def flat_name(name: str) -> str:
    """The first part that is not blank of a two-level header, which files hold as ('Close', 'AAPL'); other names as they are."""
    levels = re.fullmatch(r"\('([^']*)', '([^']*)'\)", name.strip())
    return next((x for x in levels.groups() if x.strip()), "") if levels else name


def normalize_columns(df: DataFrame) -> DataFrame:
    """Names trimmed, in lower case, with underscores; index or date becomes datetime and adj_close adjusted_close where these
    lack. Of two-level headers the first level counts."""
    names = unique_names([flat_name(c).strip().lower().replace(" ", "_") for c in df.columns])
    if "datetime" not in names:
        for alias in ("index", "date"):
            if alias in names:
                names[names.index(alias)] = "datetime"
                break
    if "adjusted_close" not in names and "adj_close" in names:
        names[names.index("adj_close")] = "adjusted_close"
    return df.toDF(*names)


def schema_report(df: DataFrame) -> dict[str, list[str] | bool]:
    return {"missing": [c for c in BASE if c not in df.columns], "adjusted": "adjusted_close" in df.columns}


def ensure_datetime(df: DataFrame, name: str = "datetime") -> DataFrame:
    """A text time column parsed, bad times null; other types stay as they are."""
    if dict(df.dtypes)[name] != "string":
        return df
    return df.withColumn(name, F.try_to_timestamp(name).cast(NTZ))


def resolve_time(df: DataFrame) -> DataFrame:
    """The time column under the name datetime, rows without a time left out; without any time column an error."""
    names = df.columns
    found = next((c for c in names if c.lower() in ("datetime", "date", "index")), None)
    found = found or next((c for c, t in df.dtypes if t.startswith("timestamp") and c.lower() not in BASE[1:]), None)
    if found is None:
        raise ValueError("no time column among " + ", ".join(names))
    return ensure_datetime(df.withColumnRenamed(found, "datetime")).where("datetime is not null")


def require_ohlcv(df: DataFrame) -> DataFrame:
    lack = [c for c in BASE if c not in df.columns]
    if lack:
        raise ValueError("missing columns: " + ", ".join(lack))
    return df.select(*BASE)


def conform(df: DataFrame, key: list[str], seq: str | None = None) -> DataFrame:
    """Key and bar columns, numbers as DOUBLE; open, high, low and volume may lack and are null then, datetime and close may not.

    With ``seq``, the column that tells the order of rows, of rows with equal key and time the last one stays.
    """
    lack = [c for c in ("datetime", "close") if c not in df.columns]
    if lack:
        raise ValueError("missing columns: " + ", ".join(lack))
    none = F.lit(None).cast("double")
    columns = [(F.col(c).try_cast("double") if c in df.columns else none).alias(c) for c in BASE[1:]]
    if "adjusted_close" in df.columns:
        columns.append(F.col("adjusted_close").try_cast("double").alias("adjusted_close"))
    out = ensure_datetime(df)
    out = keep_last(out, [*key, "datetime"], [seq]) if seq else out
    return out.select(*key, "datetime", *columns)


def epoch_time(df: DataFrame, name: str, unit: str = "auto", limit: float = 1e11) -> DataFrame:
    """A time column as TIMESTAMP_NTZ: text is parsed (bad times null), times stay, and epoch numbers count as seconds or
    milliseconds, by ``unit`` or by the largest number of the whole column."""
    kind = dict(df.dtypes)[name]
    if kind == "string" or kind.startswith(("timestamp", "date")):
        return ensure_datetime(df, name)
    x = F.col(name).try_cast("double")

    def time(ms: Column) -> Column:
        return F.timestamp_micros((x * F.when(ms, 1_000).otherwise(1_000_000)).cast("long")).cast(NTZ)

    if unit != "auto":
        return df.withColumn(name, time(F.lit(unit == "ms")))
    largest = df.agg((F.max(F.abs(x)) > limit).alias("_ms"))  # one row
    return df.join(F.broadcast(largest), how="cross").withColumn(name, time(F.col("_ms"))).drop("_ms")


def in_window(rows: DataFrame, start, end, name: str = "datetime") -> DataFrame:
    """Rows with start <= time < end; start and end are values or columns."""
    ends = [x if isinstance(x, Column) else F.lit(x).cast(NTZ) for x in (start, end)]
    return rows.where((F.col(name) >= ends[0]) & (F.col(name) < ends[1]))


def normalize_ticks(raw: DataFrame, key: list[str], start=None, end=None, seq: str | None = None) -> DataFrame:
    """(key, datetime, price, volume) of a feed under its own names, rows without time or price left out.

    The price is a price column of the feed, else the middle of ask and bid, else the side it has; without any, an error.
    Volumes of the sides are summed where there is no volume column. Times may be text or epoch numbers. With a window only
    its rows stay, and with ``seq``, the column that tells the order of rows, the first row of each key and time.
    """
    have = {c.strip().lower(): c for c in raw.columns}

    def pick(names: list[str]) -> Column | None:
        return next((F.col(f"`{have[n]}`") for n in names if n in have), None)

    time, price, ask, bid = pick(TIME_NAMES), pick(PRICE_NAMES), pick(ASK_NAMES), pick(BID_NAMES)
    if time is None:
        raise ValueError("no time column")
    if price is None and ask is not None and bid is not None:
        price = (ask.try_cast("double") + bid.try_cast("double")) / 2
    price = next((p for p in (price, ask, bid) if p is not None), None)
    if price is None:
        raise ValueError("no price column")
    volume = pick(VOLUME_NAMES)
    sides = [v for v in (pick(ASK_VOLUMES), pick(BID_VOLUMES)) if v is not None]
    total = finite(volume) if volume is not None else tick_volume(*sides) if sides else F.lit(None).cast("double")
    order = [F.col(seq).alias("_seq")] if seq else []
    out = raw.select(*key, time.alias("datetime"), finite(price).alias("price"), total.alias("volume"), *order)
    out = epoch_time(out, "datetime").where("datetime is not null and price is not null")
    out = out if start is None else in_window(out, start, end)
    return keep_first(out, [*key, "datetime"], ["_seq"]).drop("_seq") if seq else out


def with_provenance(bars: DataFrame, **tags: str) -> DataFrame:
    """The bars with a map of tags, such as source and adjustment."""
    pairs = [F.lit(x) for item in sorted(tags.items()) for x in item]
    return bars.withColumn("provenance", F.create_map(*pairs))
