"""Sharding by a minimax contiguous partition.

Rows with equal texts form an atomic group. The groups, in the order of their text hash, are cut into contiguous
shards so that the largest shard is as small as it can be. Prefix sums over the groups are made in two levels
(within hash ranges, then over the ranges), so no task sees all groups, and the search for the smallest capacity asks
the prefix sums many capacities at a time until the groups still in question are few.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import documents, stored

#: Capacities tried in one pass over the prefix sums.
TRIED = 32
#: Groups that the last, exact step may bring to the driver.
FEW_GROUPS = 20_000
#: Rows that one hash range, or one salt of a group with all rows, is meant to hold; the least number of salts.
ROWS_A_RANGE, SALTS = 50_000, 64
#: Stretches of equal bytes in which the driver sees the first and the last group end, to make the shards even.
STRETCHES = 1024


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text plus one, so that rows without text weigh something too."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _running(df: DataFrame, n_ranges: int) -> DataFrame:
    """Adds cum_size and cum_rows, running totals over all groups in the order (range, h, key)."""
    df = df.withColumn("range", F.shiftrightunsigned("h", 32) % n_ranges)
    total = df.groupBy("range").agg(F.sum("g_size").alias("s"), F.sum("g_rows").alias("r"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(
        "range",
        F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base_size"),
        F.coalesce(F.sum("r").over(before), F.lit(0)).alias("base_rows"),
    )
    w = Window.partitionBy("range").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("cum_size", F.sum("g_size").over(w)).withColumn("cum_rows", F.sum("g_rows").over(w))
    df = df.join(total, "range")
    return df.select(
        "key",
        "g_size",
        "g_rows",
        (F.col("cum_size") + F.col("base_size")).alias("cum_size"),
        (F.col("cum_rows") + F.col("base_rows")).alias("cum_rows"),
    )


def _ends(groups: DataFrame, capacities: list[int], n_shards: int) -> list[list[int]]:
    """For each capacity the running size at which greedy filling ends each shard.

    One pass over the prefix sums for each shard serves all capacities.
    """
    ends: list[list[int]] = [[] for _ in capacities]
    start = [0] * len(capacities)
    for _ in range(n_shards):
        tops = [s + c for s, c in zip(start, capacities, strict=True)]
        found = groups.where(F.col("cum_size") <= max(tops)).agg(
            *[F.max(F.when(F.col("cum_size") <= t, F.col("cum_size"))).alias(f"e{i}") for i, t in enumerate(tops)]
        ).first()
        start = [max(s, found[i] or 0) for i, s in enumerate(start)]
        for e, s in zip(ends, start, strict=True):
            e.append(s)
    return ends


def _greedy(cums: list[int], capacity: int, n_shards: int) -> list[int]:
    at, out = 0, []
    for _ in range(n_shards):
        k = bisect.bisect_right(cums, at + capacity)
        at = max(at, cums[k - 1] if k else 0)
        out.append(at)
    return out


def smallest_capacity(groups: DataFrame, n_shards: int, tried: int = TRIED, few: int = FEW_GROUPS) -> tuple[int, list[int]]:
    """(capacity, ends): the least capacity for which greedy filling needs at most n_shards, and the cuts it makes."""
    total, largest = groups.agg(F.max("cum_size"), F.max("g_size")).first()
    if not total:
        return 0, [0] * n_shards
    low, high = max(largest, -(-total // n_shards)), -(-total // n_shards) + largest  # low may fail, high cannot
    low_ends, high_ends = _ends(groups, [low, high], n_shards)
    if low_ends[-1] == total:
        return low, low_ends
    while high - low > 1:
        # Between two tried capacities each cut can only move between its two places.
        near = groups.where(" or ".join(f"cum_size between {a} and {b}" for a, b in zip(low_ends, high_ends, strict=True)))
        found = [r[0] for r in near.select("cum_size").limit(few + 1).collect()]
        if len(found) <= few:
            cums = sorted(found)
            while high - low > 1:
                mid = (low + high) // 2
                ends = _greedy(cums, mid, n_shards)
                low, high, high_ends = (low, mid, ends) if ends[-1] == total else (mid, high, high_ends)
            break
        step = max(1, (high - low) // (tried + 1))
        caps = [c for c in (low + step * k for k in range(1, tried + 1)) if c < high]
        for c, ends in zip(caps, _ends(groups, caps, n_shards), strict=True):
            if ends[-1] == total:
                high, high_ends = c, ends
                break
            low, low_ends = c, ends
    return high, high_ends


def _places(groups: DataFrame, total: int, n_shards: int) -> list[int]:
    """Group ends to cut at: first and last of each stretch, so both ends of every group longer than a stretch."""
    stretches = max(STRETCHES, 16 * n_shards)
    g = groups.select("cum_size", F.expr(f"cast((cum_size - 1) div {-(-total // stretches)} as int)").alias("stretch"))
    found = g.groupBy("stretch").agg(F.min("cum_size"), F.max("cum_size")).collect()
    places = {r[1] for r in found} | {r[2] for r in found}
    if len(found) < n_shards:  # then the groups may be in few stretches
        nth = F.row_number().over(Window.partitionBy("stretch").orderBy("cum_size"))
        places |= {r[0] for r in g.withColumn("nth", nth).where(F.col("nth") <= n_shards).select("cum_size").collect()}
    return sorted(places)


def _even(places: list[int], capacity: int, n_shards: int) -> list[int]:
    """The cuts at ``places`` with the least sum of squared sizes, no shard empty (while there are places) or above the capacity."""
    at = np.array([0, *places], float)
    first = np.searchsorted(at, at - capacity)
    used = min(n_shards, len(places))
    cost, steps = np.where(at == 0, 0.0, np.inf), []
    for _ in range(used):
        new, step = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
        for i in range(1, len(at)):
            j = first[i]
            if j < i:
                x = cost[j:i] + (at[i] - at[j:i]) ** 2
                step[i] = j + int(x.argmin())
                new[i] = x[step[i] - j]
        cost = new
        steps.append(step)
    ends, i = [], len(at) - 1
    for step in reversed(steps):
        ends.append(int(at[i]))
        i = step[i]
    return ends[::-1] + [places[-1]] * (n_shards - used)


def even_ends(groups: DataFrame, capacity: int, ends: list[int], n_shards: int) -> list[int]:
    """Cuts as even as the groups allow below the capacity; ``ends`` are cuts that keep to it."""
    total = ends[-1]
    if not total:
        return ends
    return _even(sorted({*_places(groups, total, n_shards), *ends}), capacity, n_shards)


def shard_rows(docs: DataFrame, n_shards: int = 8, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row, null text as empty; equal texts share a shard.

    The largest shard's bytes are the least that contiguous cuts of the groups in hash order allow, and below that the
    shards are even, so a large group of copies leaves the other shards no less than their share. Slots count from
    0 in each shard without gaps. Rows of a large group are ranked by salt, so that it needs no task of its own. With
    fewer groups than shards some shards stay empty; an empty table gives an empty result. Equal rows get slots of
    their own.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        text_bytes(F.col("text")).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("key"),
        F.xxhash64(F.monotonically_increasing_id()).alias("u"),
    )
    rows = stored(rows, "rows")
    n_salts = max(SALTS, rows.count() // rows_a_range)
    rows = rows.withColumn("salt", F.pmod("u", F.lit(n_salts))).drop("u")
    parts = rows.groupBy("key", "salt").agg(F.sum("size").alias("s"), F.count("*").alias("r"))
    parts = stored(parts, "parts")
    groups = parts.groupBy("key").agg(F.sum("s").alias("g_size"), F.sum("r").alias("g_rows"))
    groups = groups.withColumn("h", F.xxhash64("key"))
    n_ranges = max(16, parts.count() // rows_a_range)
    groups = stored(_running(groups, n_ranges), "groups")
    ends = even_ends(groups, *smallest_capacity(groups, n_shards), n_shards)
    shard = F.lit(0)
    for e in ends[:-1]:
        shard = shard + F.when(F.col("cum_size") > e, 1).otherwise(0)
    cut = groups.withColumn("shard", shard)
    first = cut.groupBy("shard").agg(F.min(F.col("cum_rows") - F.col("g_rows")).alias("first_row"))
    cut = cut.join(F.broadcast(first), "shard")  # one row a shard
    cut = cut.select("key", "shard", (F.col("cum_rows") - F.col("g_rows") - F.col("first_row")).alias("group_at"))
    before = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("part_at", F.coalesce(F.sum("r").over(before), F.lit(0))).join(cut, "key")
    placed = placed.select("key", "salt", "shard", (F.col("group_at") + F.col("part_at")).alias("at"))
    w = Window.partitionBy("key", "salt").orderBy("doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(w) - 1).join(placed, ["key", "salt"])
    return ranked.select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("at") + F.col("rank")).alias("slot")
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_rows(documents(spark, sf_dir))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
