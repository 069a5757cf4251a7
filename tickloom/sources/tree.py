"""Trees of bar files, one file a series: root/asset_type/symbol/interval_start_end.parquet.

Files are listed and opened by the executors; of a file's footer or first line nothing comes to the driver but what a
query asks for. Paths are opened with Arrow's file systems.
"""

from __future__ import annotations

import lzma
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.timefn import hour_floor
from tickloom.sources.files import BARS, STORED_BARS, TICK, WINDOW_NAME, few_listings, literal, plain, qualified

#: Schemes of Hadoop's file systems that Arrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfs"}
#: Kinds of columns that a scan can read as times or as numbers; others are ``other``.
TIMES, DOUBLES, LONGS = "time", "double", "long"
FOOTER = "path string, length long, asset_type string, symbol string, interval string, columns array<string>, kinds map<string,string>, n_rows long, first timestamp_ntz, last timestamp_ntz, error string"


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; the path may hold any sign as it is."""
    scheme, colon, rest = path.partition(":")
    if not colon or path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + quote(rest, safe="/:@"))


def _tasks(spark: SparkSession) -> int:
    """Tasks that open files: two a core. A number that is given is kept, else few bytes of paths would all be put into one task."""
    return 2 * spark.sparkContext.defaultParallelism


def listed(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, length) of the files below root with this ending, empty ones too; none if there is no root.

    One task lists root's own entries, others the folders below these, and each of theirs is dealt to a task by itself, so
    what reads the files is spread too. Hidden files are left out. Paths are as Spark names them, so that they can be
    joined to those of a scan, whatever form root has.
    """

    def entries(path: str, deep: bool) -> pd.DataFrame:
        fs, top = open_path(path)
        found = fs.get_file_info(pafs.FileSelector(top, recursive=deep, allow_not_found=True))
        begin = path.rstrip("/")
        rows = [(begin + i.path[len(top) :], i.size, i.type == pafs.FileType.Directory) for i in found if not i.base_name.startswith((".", "_"))]
        return pd.DataFrame(rows, columns=["path", "length", "folder"])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield entries(path, False)

    def below(deep: bool) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [batch[~batch["folder"]], *(entries(path, deep) for path in batch.loc[batch["folder"], "path"])]
                yield pd.concat(found) if len(found) > 1 else found[0]

        return run

    form = "path string, length long, folder boolean"
    top = spark.createDataFrame([(qualified(spark, root),)], "path string").mapInPandas(first, form)
    found = top.repartition("path").mapInPandas(below(False), form).repartition(_tasks(spark), "path").mapInPandas(below(True), form)
    found = found.where(F.col("path").endswith(suffix) & ~F.col("folder"))
    return found.select("path", F.coalesce("length", F.lit(0)).alias("length"))


def _kind(field: pa.Field) -> str:
    t = field.type
    if pa.types.is_timestamp(t):
        return TIMES if t.tz is None else TIMES + "_zone"
    if pa.types.is_floating(t) and t.bit_width >= 32 or pa.types.is_signed_integer(t) and t.bit_width <= 32:
        return DOUBLES
    return LONGS if t == pa.int64() else "other"


def _time_range(meta: pq.FileMetaData) -> tuple:
    """The least and the greatest ``datetime`` that the row groups' statistics tell of."""
    at = next((k for k in range(meta.num_columns) if meta.schema.column(k).name == "datetime"), None)
    if at is None or not meta.num_row_groups:
        return None, None
    stats = [meta.row_group(k).column(at).statistics for k in range(meta.num_row_groups)]
    if not all(s is not None and s.has_min_max and hasattr(s.min, "year") for s in stats):
        return None, None
    ends = [pd.Timestamp(min(s.min for s in stats)), pd.Timestamp(max(s.max for s in stats))]
    return tuple(t if t.tz is None else t.tz_convert("UTC").tz_localize(None) for t in ends)


def footers(spark: SparkSession, root: str, asset_type: str | None = None, symbol: str | None = None, interval: str | None = None) -> DataFrame:
    """One row for each Parquet file below root with its columns, their kinds and its rows, from the footer alone.

    ``first`` and ``last`` are the range of ``datetime`` by the statistics of all row groups, null where one has none.
    ``error`` says why a footer could not be read; then ``columns`` is null. Keys come from the path; a name without an
    underscore has no interval. The three filters leave files out before they are opened.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                where, path = open_path(row.path)  # a path that no file system takes is an error of the job
                try:
                    with where.open_input_file(path) as f:
                        meta = pq.read_metadata(f)
                    schema = meta.schema.to_arrow_schema()
                    found = (schema.names, {x.name: _kind(x) for x in schema}, meta.num_rows, *_time_range(meta), None)
                except (pa.ArrowException, OSError) as e:
                    found = (None, None, None, None, None, str(e)[:200])
                out.append((*row, *found))
            yield pd.DataFrame(out, columns=[*batch.columns, "columns", "kinds", "n_rows", "first", "last", "error"])

    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    keys = [F.try_element_at(parts, F.lit(-3)).alias("asset_type"), F.try_element_at(parts, F.lit(-2)).alias("symbol")]
    files = listed(spark, root, ".parquet").select("path", "length", *keys, F.when(F.contains(name, F.lit("_")), F.substring_index(name, "_", 1)).alias("interval"))
    for column, value in (("asset_type", asset_type), ("symbol", symbol), ("interval", interval)):
        if value:
            files = files.where(F.col(column) == value)
    return files.mapInPandas(read, FOOTER)


def rows_in_order(spark: SparkSession, root: str) -> DataFrame:
    """(path, row, datetime) of the Parquet files below root: each row with its place in its file. Times with a zone are in UTC.

    The driver lists nothing: files are opened by the tasks, which read one column, row group by row group, as dealt out.
    """

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                fs, at = open_path(path)
                with fs.open_input_file(at) as f:
                    meta = pq.read_metadata(f)
                n = [meta.row_group(k).num_rows for k in range(meta.num_row_groups)]
                out += [(path, k, sum(n[:k])) for k in range(len(n))]
            yield pd.DataFrame(out, columns=["path", "part", "begin"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, part, row in zip(*(batch.column(c).to_pylist() for c in ("path", "part", "begin")), strict=True):
                fs, at = open_path(path)
                with fs.open_input_file(at) as f:
                    file = pq.ParquetFile(f)
                    names = [c for c in ["datetime"] if c in file.schema_arrow.names]
                    for rows in file.iter_batches(65_536, row_groups=[part], columns=names):
                        n = rows.num_rows
                        time = rows.column(0).cast(pa.timestamp("us")) if names else pa.nulls(n, pa.timestamp("us"))
                        yield pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.array(np.arange(row, row + n)), time], names=["path", "row", "datetime"])
                        row += n

    found = listed(spark, root, ".parquet").select("path").mapInPandas(groups, "path string, part long, begin long")
    found = found.repartition(_tasks(spark), "path", "part")
    return found.mapInArrow(read, "path string, row long, datetime timestamp_ntz")


def scan_files(spark: SparkSession, found: DataFrame) -> DataFrame:
    """(path, bars) of the readable files among ``footers``; columns that a file lacks are null.

    Files are read by what their time and number columns are, at most 96 ways, each with one scan over its files. Their
    paths pass through the driver, which lists the files of a scan in any case. Files with a column of another kind are
    not read; of a file whose pages are damaged, the rows before the damage may be.
    """
    kinds = [F.when(F.col("kinds")[c] == LONGS, LONGS).otherwise(DOUBLES) for c in BARS]
    ok = F.col("columns").isNotNull() & ~F.exists(F.array(*[F.coalesce(F.col("kinds")[c], F.lit("")) for c in ["datetime", *BARS]]), lambda k: k == "other")
    ok &= ~F.coalesce(F.col("kinds")["datetime"].isin(LONGS, DOUBLES), F.lit(False))
    ok &= ~F.exists(F.array(*[F.coalesce(F.col("kinds")[c], F.lit("")) for c in BARS]), lambda k: k.startswith(TIMES))
    form = F.concat_ws(",", F.coalesce(F.col("kinds")["datetime"], F.lit(TIMES)), *kinds)
    out = spark.createDataFrame([], f"path string, {STORED_BARS}")
    for form_, paths in found.where(ok).groupBy(form).agg(F.collect_list("path")).collect():
        time, *numbers = form_.split(",")
        types = [("datetime", "timestamp_ntz" if time == TIMES else "timestamp"), *zip(BARS, numbers, strict=True)]
        schema = ", ".join(f"{c} {'bigint' if t == LONGS else t}" for c, t in types)
        with few_listings(spark):
            rows = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(*map(literal, paths))
        values = [F.col("datetime").cast("timestamp_ntz"), *[F.col(c).cast("double") for c in BARS]]
        path = F.regexp_replace(plain("_metadata.file_path"), "^file:/+", "file:/")
        out = out.unionByName(rows.select(path.alias("path"), *values))
    return out


def _together(rows: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """Rows of one key in one task, one after the other and in order. They are sorted by a hash before the key, as the
    first bytes of keys are often the same, which makes sorting slow."""
    rows = rows.withColumn("_hash", F.xxhash64(*key)).repartition(*key)
    return rows.sortWithinPartitions("_hash", *key, *order).drop("_hash")


def _stream_files(rows: DataFrame, key: list[str], root: str, suffix: str, place: Callable, begin: Callable) -> DataFrame:
    """(path, n_rows) of files written from rows that lie together by ``key``, in their order: one file a run of equal keys.

    ``place(key, first, last)`` gives a file's path below root from the times of its first and last row, ``begin(file,
    schema)`` a writer. A task holds one batch, however long a run is. A file is moved to its name when it is whole, and
    another attempt of the task gives it the same name again.
    """
    names, root = [c for c in rows.columns if c not in key], qualified(rows.sparkSession, root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_path(root)
        run, writer, file, n, first, last = None, None, None, 0, None, None
        part = f"{top}/.{uuid.uuid4().hex}.part"

        def close() -> pa.RecordBatch:
            writer.close()
            file.close()
            path = f"{top}/{place(run, first, last)}{suffix}"
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            fs.move(part, path)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_rows"])

        for batch in batches:
            codes, times, rows = [batch.column(c) for c in key], batch.column("datetime"), pa.Table.from_batches([batch]).select(names)
            ends = np.unique(np.concatenate([pc.run_end_encode(c).run_ends.to_numpy() for c in codes])).tolist()
            for a, b in zip([0, *ends], ends):
                own, code = rows.slice(a, b - a), tuple(c[a].as_py() for c in codes)
                if code != run:
                    if writer is not None:
                        yield close()
                    fs.create_dir(top, recursive=True)
                    run, n, first = code, 0, times[a].as_py()
                    file = fs.open_output_stream(part)
                    writer = begin(file, own.schema)
                writer.write_table(own)
                n, last = n + b - a, times[b - 1].as_py()
        if writer is not None:
            yield close()

    return rows.mapInArrow(write, "path string, n_rows long")


def write_series_files(bars: DataFrame, root: str, order: Column | None = None) -> DataFrame:
    """(path, n_rows) of one Parquet file for each series (asset_type, symbol, interval), written when the result is read.

    A name holds the interval and the days of the file's ends; rows are in time order, or in that of ``order``, and those
    without a time are left out.
    """
    key = ["asset_type", "symbol", "interval"]
    rows = bars.where("datetime is not null").withColumn("_order", F.col("datetime") if order is None else order)
    rows = _together(rows, key, "_order").drop("_order")

    def place(run: tuple, first, last) -> str:
        return f"{run[0]}/{run[1]}/{run[2]}_{min(first, last):%Y%m%d}_{max(first, last):%Y%m%d}"

    return _stream_files(rows, key, root, ".parquet", place, lambda file, schema: pq.ParquetWriter(file, schema, compression="zstd"))


def write_window_files(bars: DataFrame, root: str) -> DataFrame:
    """(path, n_rows) of one CSV SYMBOL_INTERVAL_START_END.csv for each window (symbol, interval, start, end) of the bars,
    written when the result is read. Bars are in time order, with times as yyyy-MM-dd HH:mm:ss."""
    key = ["symbol", "interval", "start", "end"]
    rows = _together(bars, key, "datetime")
    rows = rows.withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))

    def place(run: tuple, first, last) -> str:
        return f"{run[0]}_{run[1]}_{run[2]:%Y%m%d}_{run[3]:%Y%m%d}"

    def begin(file, schema: pa.Schema) -> pacsv.CSVWriter:
        return pacsv.CSVWriter(file, schema, write_options=pacsv.WriteOptions(quoting_style="none"))

    return _stream_files(rows, key, root, ".csv", place, begin)


class _TickWriter:
    """Packs ticks as the records of a binary tick file and compresses them as they come."""

    def __init__(self, file):
        self.file, self.lzma = file, lzma.LZMACompressor(format=lzma.FORMAT_ALONE)

    def write_table(self, ticks: pa.Table) -> None:
        packed = np.zeros(len(ticks), TICK)
        for c in TICK.names:
            packed[c] = ticks.column(c).to_numpy()
        self.file.write(self.lzma.compress(packed.tobytes()))

    def close(self) -> None:
        self.file.write(self.lzma.flush())


def write_tick_files(ticks: DataFrame, root: str, point: float, order: str = "seq") -> DataFrame:
    """(path, n_rows) of one LZMA file SYMBOL_YYYY-MM-DD_HH for each symbol and hour of the ticks (symbol, datetime, ask, bid,
    ask_volume, bid_volume), written when the result is read. Prices are stored in units of 1 / ``point``, times in
    milliseconds of the hour; ticks of one time are in the order of ``order``."""
    key = ["symbol", "hour"]
    micros = F.unix_micros(F.col("datetime").cast("timestamp"))
    prices = [F.round(F.col(c) * point).cast("int").alias(c) for c in ("ask", "bid")]
    volumes = [F.coalesce(F.col(c), F.lit(0.0)).cast("float").alias(c) for c in ("ask_volume", "bid_volume")]
    rows = ticks.where("datetime is not null").select(
        "symbol", hour_floor(F.col("datetime")).alias("hour"), "datetime", F.floor(F.pmod(micros, F.lit(3_600_000_000)) / 1000).cast("int").alias("ms"), *prices, *volumes, F.col(order).alias("_order"),
    )
    rows = _together(rows, key, "datetime", "_order").drop("_order")

    def place(run: tuple, first, last) -> str:
        return f"{run[0]}_{run[1]:%Y-%m-%d_%H}"

    return _stream_files(rows, key, root, "", place, lambda file, schema: _TickWriter(file))


def run(written: DataFrame) -> None:
    """Writes the files of a result that is not wanted itself."""
    written.write.format("noop").mode("overwrite").save()


def written_windows(spark: SparkSession, root: str) -> DataFrame:
    """(symbol, interval, start, end) of the window CSVs below root that are not empty: what a resumed run may skip."""
    name = F.element_at(F.split("path", "/"), -1)
    part = [F.regexp_extract(name, WINDOW_NAME, k) for k in (1, 2, 3, 4)]
    days = [F.try_to_timestamp(p, F.lit("yyyyMMdd")).cast("timestamp_ntz").alias(c) for p, c in zip(part[2:], ("start", "end"), strict=True)]
    found = listed(spark, root, ".csv").where((F.col("length") > 0) & name.rlike(WINDOW_NAME))
    return found.select(part[0].alias("symbol"), part[1].alias("interval"), *days).distinct()


def csv_heads(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, columns, error) of the CSV files below root: the names in the first line; no more is read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                where, path = open_path(row.path)
                try:
                    with where.open_input_stream(path) as f:
                        line = f.read(1 << 16).split(b"\n", 1)[0].decode("utf-8-sig").strip()
                    found = ([x.strip().strip('"') for x in line.split(",")] if line else [], None)
                except (OSError, UnicodeDecodeError) as e:
                    found = (None, str(e)[:200])
                out.append((*row, *found))
            yield pd.DataFrame(out, columns=[*batch.columns, "columns", "error"])

    return listed(spark, root, ".csv").mapInPandas(read, "path string, length long, columns array<string>, error string")
