"""Failure ledgers: text rows to valid tasks and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.timefn import NTZ
from tickloom.operators.catalog import safe_symbol

#: Price adjustments a task or request may name. Fixed values.
ADJUSTMENTS = ["auto", "back", "forward", "none", "front", "backward"]
#: Number of a ledger's first row: the header is row 1.
FIRST_ROW = 2
DATES = "yyyy-MM-dd"
#: A date, or a date and a time, in ISO form.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"


def _blank(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def _date(text: Column) -> Column:
    """A date or a date with a time in ISO form, as a time; null for anything else."""
    return F.when(text.rlike(ISO), F.try_to_timestamp(text).cast(NTZ))


def validate(rows: DataFrame, default_start: str, default_end: str, strict: bool = False, seq: str | None = None) -> DataFrame:
    """Ledger rows with typed start and end, defaults for what is missing, and the warnings each row earned, in order.

    Each date is judged by itself: a blank one becomes its default without a warning, a bad one its default with
    ``bad_start`` or ``bad_end``. A start after the end then puts both defaults in place (``start_after_end``). A row
    without symbol or interval, or with an unknown adjustment, is not valid, has no dates, and the one warning
    ``invalid_record``. With ``seq``, the column of a row's place in its file from 0, rows get their number as ``row``.
    ``strict`` makes any warning an error that names the row.
    """
    text = {c: _blank(c) for c in ("start", "end")}
    at = {c: _date(text[c]) for c in text}
    default = {"start": F.lit(default_start).cast(NTZ), "end": F.lit(default_end).cast(NTZ)}
    adjust = F.coalesce(F.lower(_blank("adjust")), F.lit("auto"))
    out = rows.withColumns({"_s": F.coalesce(at["start"], default["start"]), "_e": F.coalesce(at["end"], default["end"]), "adjust": adjust})
    valid = _blank("symbol").isNotNull() & _blank("interval").isNotNull() & F.col("adjust").isin(ADJUSTMENTS)
    turned = F.col("_s") > F.col("_e")
    found = [F.when(~valid, "invalid_record")]
    found += [F.when(valid & text[c].isNotNull() & at[c].isNull(), f"bad_{c}") for c in text]
    found.append(F.when(valid & turned, "start_after_end"))
    if seq:
        out = out.withColumn("row", F.col(seq) + FIRST_ROW)
    out = out.withColumns({"valid": valid, "warnings": F.array_compact(F.array(*found))})
    if strict:
        place = F.concat(F.lit("bad ledger row "), F.col("row").cast("string")) if seq else F.lit("bad ledger row")
        text_of = F.concat_ws(": ", place, F.array_join("warnings", ", "))
        out = out.withColumn("valid", F.when(F.size("warnings") == 0, F.col("valid")).otherwise(F.raise_error(text_of).cast("boolean")))
    kept = {c: F.when(F.col("valid"), F.when(turned, default[c]).otherwise(F.col(x))) for c, x in (("start", "_s"), ("end", "_e"))}
    trimmed = {c: _blank(c) for c in ("symbol", "interval")}
    return out.withColumns({**kept, **trimmed, "asset_type": F.coalesce(_blank("asset_type"), F.lit("stock"))}).drop("_s", "_e")


def validate_requests(requests: DataFrame, ashare: str = "ashare") -> DataFrame:
    """Requests (symbol, interval, start, end, adjust, asset_type as text) with the first fault of each, null where there is none.

    Symbols must be safe, intervals a positive number and a unit, dates parse and be in order; adjustments other than auto and none
    are for A-shares only.
    """
    start, end = (F.try_to_timestamp(F.trim(F.col(c)), F.lit(DATES)).cast("date") for c in ("start", "end"))
    interval, adjust = F.lower(F.trim("interval")), F.coalesce(F.lower(_blank("adjust")), F.lit("auto"))
    count = F.regexp_extract(interval, r"^(\d+)(d|wk|w|mo|m|h|y|s)$", 1).try_cast("long")
    no = F.lit(False)
    fault = (
        F.when(~safe_symbol(F.col("symbol")), "symbol")
        .when(~F.coalesce(count > 0, no), "interval")
        .when(start.isNull() | end.isNull(), "date")
        .when(start > end, "start_after_end")
        .when(~adjust.isin(ADJUSTMENTS), "adjust")
        .when(~adjust.isin("auto", "none") & ~F.coalesce(F.col("asset_type") == ashare, no), "adjust_not_supported")
    )
    return requests.withColumn("fault", fault)
