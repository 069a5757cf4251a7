"""Media columns: payloads kept in archive directories, and a data source that writes and reads them.

An archive is a plain ZIP file whose members are stored as they are, so a member is one byte range. Reading plans byte
ranges over the archives of a directory from their sizes alone; a task finds the members that begin in its range from
the archive's own index, reads each by its offset from one open file, tries a failed one again without touching the
others, and streams them on in small Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tickloom.llm.common import documents, map_batches, shared_path

WIDTH = 64
#: Bytes of one planned range, of one archive before the next is begun, and of one Arrow batch.
RANGE_BYTES, ARCHIVE_BYTES, BATCH_BYTES = 16 << 20, 64 << 20, 4 << 20
TRIES = 4
PNG = b"\x89PNG\r\n\x1a\n"
LOCAL, CENTRAL, TRAILER = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH")
#: Fixed marks of the ZIP format.
LOCAL_MARK, CENTRAL_MARK, TRAILER_MARK = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
#: How the names of manifests begin.
MANIFEST = "_manifest-"


def padded(text: bytes | None) -> bytes:
    """The text followed by zero bytes up to a positive multiple of WIDTH."""
    raw = text or b""
    return raw + b"\0" * (WIDTH * max(1, -(-len(raw) // WIDTH)) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """The payload as an 8-bit grey image of WIDTH columns; its unpadded length is kept in a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = rows
    head = struct.pack(">2I5B", WIDTH, len(rows), 8, 0, 0, 0, 0)
    note = _chunk(b"tEXt", b"n_bytes\0" + str(n_bytes).encode())
    return PNG + _chunk(b"IHDR", head) + note + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of an image made by ``encode_png``; damage raises ValueError."""
    if media[:8] != PNG:
        raise ValueError("not an image")
    at, found = 8, {}
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        found[kind] = body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(-1, WIDTH + 1)
    return lines[:, 1:].tobytes(), int(found[b"tEXt"].split(b"\0")[1])


def feature(payload: bytes) -> str:
    """A 64-bit average hash of the samples in hex: whether each of 64 equal stretches is brighter than their median."""
    x = np.frombuffer(payload, np.uint8).astype(float)
    cuts = (np.arange(65) * len(x)) // 64
    mean = np.add.reduceat(x, cuts[:-1]) / np.diff(cuts)
    bits = np.packbits(mean > np.median(mean)).tobytes().hex()
    return f"{bits}-{x.mean():.3f}"


#: Hadoop's names of stores that Arrow knows by another one. Fixed values.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a Hadoop path and the path in it; schemes that Arrow has no client for are left to fsspec."""
    if ":" not in uri:
        return pafs.LocalFileSystem(), uri
    scheme, rest = uri.split(":", 1)
    scheme = SCHEMES.get(scheme, scheme)
    try:
        return pafs.FileSystem.from_uri(f"{scheme}:{rest}")
    except pa.ArrowInvalid:
        try:
            import fsspec
        except ImportError:
            raise ValueError(f"no client for {uri}: Arrow does not know {scheme}:, and fsspec is not installed") from None
        system, path = fsspec.core.url_to_fs(uri)
        return pafs.PyFileSystem(pafs.FSSpecHandler(system)), path


class Archive:
    """Writes members one after another, then the index."""

    def __init__(self, system: pafs.FileSystem, path: str):
        self.path, self.out = path, system.open_output_stream(path)
        self.at, self.index = 0, []

    def add(self, name: str, media: bytes) -> None:
        raw, crc = name.encode(), zlib.crc32(media)
        head = LOCAL.pack(LOCAL_MARK, 20, 0, 0, 0, 33, crc, len(media), len(media), len(raw), 0)
        self.index.append(CENTRAL.pack(CENTRAL_MARK, 20, 20, 0, 0, 0, 33, crc, len(media), len(media), len(raw), 0, 0, 0, 0, 0, self.at) + raw)
        self.out.write(head + raw + media)
        self.at += len(head) + len(raw) + len(media)

    def close(self) -> None:
        body = b"".join(self.index)
        n = len(self.index)
        self.out.write(body + TRAILER.pack(TRAILER_MARK, 0, 0, min(n, 65535), min(n, 65535), len(body), self.at, 0))
        self.out.close()


@dataclass
class Written(WriterCommitMessage):
    files: list


class MediaWriter(DataSourceWriter):
    """Each task writes archives of its own; only those named by the commit are part of the directory."""

    def __init__(self, path: str, archive_bytes: int):
        self.path, self.archive_bytes = path, archive_bytes

    def write(self, iterator) -> Written:
        system, folder = _open_fs(self.path)
        system.create_dir(folder, recursive=True)
        files, archive = [], None
        for row in iterator:
            # 65,535 members and 4 GB are the limits of the plain format
            if archive is None or archive.at >= self.archive_bytes or len(archive.index) >= 65_000:
                if archive is not None:
                    archive.close()
                archive = Archive(system, f"{folder}/{uuid.uuid4().hex}.zip")
                files.append(archive.path.rsplit("/", 1)[1])
            archive.add("null" if row.doc_id is None else str(row.doc_id), bytes(row.media))
        if archive is not None:
            archive.close()
        return Written(files)

    def commit(self, messages) -> None:
        """Each job has a manifest of its own, so that an append keeps what was there."""
        system, folder = _open_fs(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())

    def abort(self, messages) -> None:
        system, folder = _open_fs(self.path)
        for m in messages:
            for f in m.files if m else ():
                system.delete_file(f"{folder}/{f}")


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    end: int


class MediaReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[ByteRange]:
        system, folder = _open_fs(self.path)
        names = []
        for info in system.get_file_info(pafs.FileSelector(folder)):
            if info.base_name.startswith(MANIFEST):
                with system.open_input_stream(info.path) as f:
                    names += json.loads(f.read())
        infos = system.get_file_info([f"{folder}/{n}" for n in sorted(names)])
        ranges = [ByteRange(i.path, s, min(s + self.range_bytes, i.size)) for i in infos for s in range(0, i.size, self.range_bytes)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, _ = _open_fs(self.path)
        ids, media, held = [], [], 0
        file = OpenFile(system, partition.file)
        for name, offset, size, crc in members(file, partition.start, partition.end):
            body = read_member(file, offset, size, crc)
            ids.append(None if name == "null" else int(name))
            media.append(body)
            held += len(body)
            if held >= BATCH_BYTES:
                yield self._batch(ids, media)
                ids, media, held = [], [], 0
        if ids:
            yield self._batch(ids, media)

    @staticmethod
    def _batch(ids: list, media: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "media"])


class OpenFile:
    """A file that is opened once, and anew only after a failure."""

    def __init__(self, system: pafs.FileSystem, path: str):
        self.system, self.path, self.file = system, path, None

    def read(self, size: int, offset: int) -> bytes:
        if self.file is None:
            self.file = self.system.open_input_file(self.path)
        return self.file.read_at(size, offset)

    def size(self) -> int:
        if self.file is None:
            self.file = self.system.open_input_file(self.path)
        return self.file.size()

    def drop(self) -> None:
        if self.file is not None:
            try:
                self.file.close()
            except OSError:
                pass  # it has failed already
        self.file = None


def members(file: OpenFile, start: int, end: int) -> Iterator[tuple[str, int, int, int]]:
    """(name, offset of the body, size, crc) of the members whose header begins in [start, end), from the index."""
    size = file.size()
    tail = TRAILER.unpack(file.read(TRAILER.size, size - TRAILER.size))
    if tail[0] != TRAILER_MARK:
        raise ValueError(f"{file.path} has no index")
    index = file.read(tail[5], tail[6])
    at = 0
    while at < len(index):
        c = CENTRAL.unpack_from(index, at)
        name = index[at + CENTRAL.size : at + CENTRAL.size + c[10]].decode()
        at += CENTRAL.size + c[10] + c[11] + c[12]
        if start <= c[16] < end:
            yield name, c[16] + LOCAL.size + c[10], c[8], c[7]


def read_member(file: OpenFile, offset: int, size: int, crc: int, tries: int = TRIES) -> bytes:
    """One member's bytes, checked; a failed or damaged read is repeated for this member alone, from the file opened anew."""
    for k in range(tries):
        try:
            body = bytes(file.read(size, offset))
            if len(body) == size and zlib.crc32(body) == crc:
                return body
            failure: Exception = ValueError(f"{file.path}: member at {offset} is damaged")
        except OSError as e:
            failure = e
        file.drop()
        time.sleep(0.05 * 4**k if k + 1 < tries else 0)
    raise failure


class MediaArchive(DataSource):
    """Format ``media_archive``: rows (doc_id, media) in a directory of archives.

    Options: range_bytes (bytes a read task plans), archive_bytes (size after which a writer begins a new archive).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, media binary"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> MediaWriter:
        return MediaWriter(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE_BYTES)))


def registered(spark: SparkSession) -> None:
    """Make the format known to the session, and the session the calling thread's active one, where Spark looks formats up."""
    spark.createDataFrame([], "x int")
    spark.dataSource.register(MediaArchive)


def store_media(docs: DataFrame, path: str) -> None:
    """Encode every row's text (null as empty) and append the images to the archives under ``path``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            media = [encode_png(padded(t), len(t or b"")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])

    registered(docs.sparkSession)
    out = map_batches(docs.select("doc_id", "text"), run, "doc_id long, media binary")
    out.write.format("media_archive").mode("append").save(path)


def media_features(media: DataFrame) -> DataFrame:
    """(doc_id, payload length, digests, feature) of rows (doc_id, media), from the stored bytes alone.

    A null id stays null, and repeated rows stay apart. Media that is null or damaged fails the task. An empty table gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for doc_id, m in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                p, n = decode_png(m)
                rows.append((doc_id, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-WIDTH:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(media, run, schema)


def media_table(docs: DataFrame, path: str) -> DataFrame:
    """Store the texts of docs as media under ``path``, and return what reading them back gives.

    One row for each row of docs, repeated ones too; equal texts give equal values. An empty table makes a directory
    without archives and an empty result. Null texts are stored as empty ones, very long texts whole. Other columns of
    docs are ignored. What was under ``path`` before is read back as well.
    """
    store_media(docs, path)
    spark = docs.sparkSession
    registered(spark)
    return media_features(spark.read.format("media_archive").load(path))


def op5_media(spark, sf_dir: str) -> DataFrame:
    return media_table(documents(spark, sf_dir), shared_path(spark, "media"))
