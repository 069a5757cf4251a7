"""The keyed bar store: merging, planning of coverage, and range lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import timefn


def _pick(df: DataFrame, key: list[str], row: Column) -> DataFrame:
    out = df.groupBy(*key).agg(row.alias("_row"))
    return out.select(*[(F.col(c) if c in key else F.col(f"_row.{c}")).alias(c) for c in df.columns])


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal key, the last by ``order``, whole; copies combine before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return _pick(df, key, F.max_by(F.struct(*rest), F.struct(*order)))


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return _pick(df, key, F.min_by(F.struct(*rest), F.struct(*order)))


def upsert(old: DataFrame, new: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """Old and new rows by name; for equal keys the new row wins whole, and among several the one with the highest seq."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, key, ["_new", seq]).drop("_new")


def coverage(bars: DataFrame, key: list[str]) -> DataFrame:
    return bars.groupBy(*key).agg(
        F.min("datetime").alias("stored_start"), F.max("datetime").alias("stored_max"), F.count("*").alias("stored_rows")
    )


def coverage_from_footers(found: DataFrame, key: list[str]) -> DataFrame:
    """``coverage`` of a tree of series files from their footers alone; no page of data is read."""
    return found.groupBy(*key).agg(F.min("first").alias("stored_start"), F.max("last").alias("stored_max"), F.sum("n_rows").alias("stored_rows"))


def coverage_plan(requests: DataFrame, stored: DataFrame, key: list[str], step_seconds: int) -> DataFrame:
    """Per request (key, start, end): what to fetch, given the stored range.

    ``skipped`` when it is stored already, ``resume`` after the last stored bar, else ``full``.
    """
    r = requests.join(stored, key, "left")
    begins = F.col("stored_start") <= F.col("start")
    status = F.when(begins & (F.col("stored_max") >= F.col("end")), "skipped").when(begins, "resume").otherwise("full")
    r = r.withColumn("status", status)
    fetch = F.when(F.col("status") == "resume", F.col("stored_max") + timefn.seconds(step_seconds)).when(
        F.col("status") == "full", F.col("start")
    )
    return r.select(
        *key, "start", "end", "status", fetch.alias("fetch_start"), F.least("stored_start", "start").alias("output_start")
    )


def canonical_segments(first: Column, last: Column, levels: int) -> Column:
    """The fewest segments of a binary tree over whole numbers that cover [first, last]: an array of (level, node), at most
    two a level. Node n of level k holds the numbers from n * 2**k on, 2**k of them."""
    start = F.struct(first.alias("a"), last.alias("b"), F.array().cast("array<struct<level:int,node:bigint>>").alias("found"))
    one = F.lit(1).cast("long")

    def step(acc: Column, level: Column) -> Column:
        a, b = acc["a"], acc["b"]
        left = (a <= b) & ((a % 2 == 1) | (level == levels))
        right = (a <= b) & (b % 2 == 0) & ~(left & (a == b))
        node = [F.when(taken, F.struct(level.alias("level"), n.alias("node"))) for taken, n in ((left, a), (right, b))]
        up = [F.shiftright(F.when(left, a + one).otherwise(a), 1), F.shiftright(F.when(right, b - one).otherwise(b), 1)]
        # A range that is used up stays so: its first number is after its last.
        done = a > b
        return F.struct(
            F.when(done, one).otherwise(up[0]).alias("a"), F.when(done, one - 1).otherwise(F.when(up[0] > up[1], up[0] - 1).otherwise(up[1])).alias("b"),
            F.concat(acc["found"], F.array_compact(F.array(*node))).alias("found"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda acc: acc["found"])


def range_cache_lookup(requests: DataFrame, ranges: DataFrame, key: list[str], cell: int = 3600) -> DataFrame:
    """Per request the tightest cached range (key, range_start, range_end) that contains it; none gives no row.

    Ranges of about one length share a grid, whose nodes of 2**level cells (of ``cell`` seconds) are no longer than they are
    and more than half as long, so a range lies in three nodes at most. A request looks into the node of its start on each
    grid that has ranges, so it meets those that overlap this node and no others, however many ranges its key has.
    """
    number = {c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / cell) for c in ("range_start", "range_end", "start")}
    held = ranges.where("range_start <= range_end").select(*key, "range_start", "range_end", number["range_start"].alias("_first"), number["range_end"].alias("_last"))
    held = held.withColumn("_level", F.greatest(F.length(F.bin(F.col("_last") - F.col("_first"))) - 1, F.lit(0)))
    levels = sorted(r[0] for r in held.select("_level").distinct().collect())  # one for each power of two at most
    place, request = [*key, "_level", "_node"], [*key, "start", "end"]
    length = F.col("range_end") - F.col("range_start")
    nodes = F.explode(F.expr("sequence(shiftright(_first, _level), shiftright(_last, _level))"))
    rank = F.row_number().over(Window.partitionBy(*place).orderBy(length, "range_start")).alias("_rank")
    index = held.select(*key, "range_start", "range_end", "_level", nodes.alias("_node")).select(*place, "range_start", "range_end", rank)
    asked = requests.select(*request, number["start"].alias("_cell"), F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("_level"))
    asked = asked.select(*request, "_level", F.expr("shiftright(_cell, _level)").alias("_node"))
    # Requests are dealt out by their places once; repeated ones, the ranges they meet and the tightest are found where they lie.
    c = asked.repartition(*place).distinct().join(index, place).where("range_start <= start and range_end >= end")
    best = [F.min_by(x, "_rank").alias(x) for x in ("range_start", "range_end")]  # by a plain number, so that nothing is sorted for it
    out = c.groupBy(*place, "start", "end").agg(*best).select(*request, "range_start", "range_end")
    if len(levels) > 1:
        out = keep_first(out.withColumn("_length", length), request, ["_length", "range_start"]).drop("_length")
    return out


def trimmed(bars: DataFrame, hits: DataFrame, key: list[str]) -> DataFrame:
    """The cached bars (key, range_start, range_end, datetime, ...) of the ranges found, cut to each request's start and end."""
    rows = bars.join(hits, [*key, "range_start", "range_end"])
    return rows.where((F.col("datetime") >= F.col("start")) & (F.col("datetime") <= F.col("end")))


def latest_range(ranges: DataFrame, key: list[str]) -> DataFrame:
    """Per key the stored range (start, end) that ends last; of several the one that starts first."""
    best = F.max_by(F.struct("start", "end"), F.struct(F.col("end"), -F.unix_micros(F.col("start").cast("timestamp"))))
    return ranges.groupBy(*key).agg(best.alias("r")).select(*key, "r.start", "r.end")


def infer_window(files: DataFrame, by: list[str]) -> DataFrame:
    """Earliest start and latest end over the matching files; without files no row."""
    return files.groupBy(*by).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def concat_chunks(chunks: DataFrame, key: list[str], number: str = "chunk") -> DataFrame:
    """Chunks of one fetch as one series: for equal keys the row of the later chunk stays."""
    return keep_last(chunks, key, [number]).drop(number)


def plan_stats(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count("*").alias("n"))
