"""Number functions of the market-data engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """The value as DOUBLE, or null where it is text, NaN or infinite."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def close_to(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Within the absolute tolerance, or both null."""
    return F.coalesce(F.abs(a - b) <= tolerance, a.eqNullSafe(b))


def mid_price(ask: Column, bid: Column) -> Column:
    return (ask + bid) / 2


def tick_price(last: Column, price: Column, ask: Column, bid: Column) -> Column:
    """First finite of last and price, else the middle of the quote, else the side that is there."""
    a, b = finite(ask), finite(bid)
    return F.coalesce(finite(last), finite(price), mid_price(a, b), a, b)


def tick_volume(*parts: Column) -> Column:
    """Sum of the finite parts; null where none is."""
    values = [finite(p) for p in parts]
    total = reduce(lambda x, y: x + y, [F.coalesce(v, F.lit(0.0)) for v in values])
    return F.when(F.coalesce(*values).isNotNull(), total)


def half_even_long(x: Column) -> Column:
    return F.bround(F.coalesce(finite(x), F.lit(0.0)), 0).cast("bigint")
