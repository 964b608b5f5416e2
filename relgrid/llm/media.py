"""Media columns: samples kept losslessly in archives, and a Spark data source that reads their members by byte range.

An archive is a ZIP file whose members are 8-bit grey-scale PNG images, 64 samples wide. The source `media_archive` writes one
archive or more per task into a directory (names are unique to the attempt; a manifest of what was committed is written last, so what a lost
attempt leaves is never read), and reads them in partitions of about `split_bytes`: a partition reads the archive's central
directory, takes the members that begin in its range, fetches each by its own offset with `attempts` tries, and streams
record batches of about `batch_bytes`. A member that can't be read gives a row with its error and no payload; the others are not affected.

Defined results: null and empty texts are one row of 64 zero bytes. Rows with equal texts are members with equal bytes. An empty
table is a directory without archives and reads as no rows. Ids of any type keep it; a null id is kept as null.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from relgrid.llm.common import scratch, small_batches

WIDTH = 64
READ = "archive string, member_offset bigint, name string, media binary, error string"
WRITE = "name string, media binary"
MANIFEST = "_manifest.json"
DEFAULTS = {"split_bytes": 16 << 20, "batch_bytes": 4 << 20, "archive_bytes": 64 << 20, "attempts": 3}
_HEADER = struct.Struct("<4s5H3I2H")  # of a ZIP member, before its name

#: What a read that is cut short, lost or broken can raise.
FAULTS = (OSError, EOFError, ValueError, IndexError, struct.error, zlib.error, zipfile.BadZipFile, pa.ArrowException)

PNG_START = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """The payload, a multiple of WIDTH bytes, as the samples of an 8-bit grey-scale image."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">2I5B", WIDTH, height, 8, 0, 0, 0, 0)
    return PNG_START + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of an image that encode_png made; ValueError where anything doesn't hold together."""
    if media[:8] != PNG_START:
        raise ValueError("not a PNG image")
    at, data, size = 8, [], None
    while at < len(media):
        length, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + length]
        if struct.unpack_from(">I", media, at + 8 + length)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">2I5B", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey-scale image")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not supported")
    return rows[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, deviation, entropy and an average hash of the samples, as text."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    n = len(x)
    mean = int((counts * values).sum()) / n
    deviation = (int((counts * values * values).sum()) / n - mean * mean) ** 0.5
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    cells = np.add.reduceat(x.astype(np.int64), np.linspace(0, n, 65)[:-1].astype(int)) / np.diff(np.linspace(0, n, 65).astype(int))
    bits = int("".join("1" if c > mean else "0" for c in cells), 2)
    return f"mean={mean:.6f};std={deviation:.6f};entropy={entropy:.6f};ahash={bits:016x}"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


@dataclass
class Archives(WriterCommitMessage):
    names: list


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class _Tail(io.RawIOBase):
    """Output through a file system that can't seek; zipfile then writes sizes after each member."""

    def __init__(self, out: pa.NativeFile) -> None:
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, options: dict[str, int]) -> None:
        self.path, self.options = path, options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        names: list[str] = []
        out = tail = archive = None
        for batch in iterator:
            for name, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if archive is None:
                    names.append(f"{uuid.uuid4().hex}.zip")
                    out = system.open_output_stream(f"{root}/{names[-1]}")
                    tail = _Tail(out)
                    archive = zipfile.ZipFile(tail, "w", zipfile.ZIP_STORED, allowZip64=True)
                archive.writestr(zipfile.ZipInfo(name), media.as_py())
                if tail.at >= self.options["archive_bytes"]:
                    archive.close()
                    out.close()
                    archive = None
        if archive is not None:
            archive.close()
            out.close()
        return Archives(names)

    def commit(self, messages: list[Archives | None]) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages: list[Archives | None]) -> None:
        system, root = _open(self.path)
        for name in (n for m in messages if m for n in m.names):
            try:
                system.delete_file(f"{root}/{name}")
            except OSError:
                pass  # what stays is not in the manifest


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, options: dict[str, int]) -> None:
        self.path, self.options = path, options

    def partitions(self) -> list[ByteRange]:
        system, root = _open(self.path)
        with system.open_input_stream(f"{root}/{MANIFEST}") as f:
            names = json.loads(f.read())
        step = self.options["split_bytes"]
        out = []
        for info in system.get_file_info([f"{root}/{n}" for n in names]) if names else []:
            if info.type != pafs.FileType.File:
                raise FileNotFoundError(info.path)
            out += [ByteRange(info.path, at, min(at + step, info.size)) for at in range(0, info.size, step)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _open(self.path)
        attempts = self.options["attempts"]
        members = self.directory(system, partition, attempts)
        held: list[tuple] = []
        size = 0
        for offset, name, length, crc in members:
            media, error = self.fetch(system, partition.path, offset, length, crc, attempts)
            held.append((partition.path, offset, name, media, error))
            size += len(media or b"")
            if size >= self.options["batch_bytes"]:
                yield self.batch(held)
                held, size = [], 0
        if held:
            yield self.batch(held)

    def directory(self, system: pafs.FileSystem, partition: ByteRange, attempts: int) -> list[tuple]:
        """(offset, name, bytes, checksum) of the members that begin in the range; an archive whose directory can't be read in any try stops the job."""
        for k in range(attempts):
            try:
                with system.open_input_file(partition.path) as f, zipfile.ZipFile(f) as archive:
                    return sorted((m.header_offset, m.filename, m.compress_size, m.CRC) for m in archive.infolist() if partition.start <= m.header_offset < partition.end)
            except FAULTS as e:
                if k + 1 == attempts:
                    raise OSError(f"{partition.path}: {type(e).__name__}: {e}") from e
                time.sleep(0.1 * 2**k)
        return []

    def fetch(self, system: pafs.FileSystem, path: str, offset: int, length: int, crc: int, attempts: int) -> tuple[bytes | None, str | None]:
        """A member's bytes, read by its offset in a file opened for each try after the first."""
        error = None
        for k in range(attempts):
            try:
                if k:
                    time.sleep(0.05 * 2**k)
                    self._files.pop(path, None)
                f = self._files.get(path)
                if f is None:
                    f = self._files[path] = system.open_input_file(path)
                head = _HEADER.unpack(f.read_at(_HEADER.size, offset))
                if head[0] != b"PK\x03\x04":
                    raise OSError("no member begins here")
                media = f.read_at(length, offset + _HEADER.size + head[9] + head[10])
                if len(media) != length or zlib.crc32(media) != crc:
                    raise OSError("checksum")
                return media, None
            except FAULTS as e:
                error = f"{type(e).__name__}: {e}"[:300]
        return None, error

    @property
    def _files(self) -> dict:
        return self.__dict__.setdefault("_open_files", {})

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"archive": pa.string(), "member_offset": pa.int64(), "name": pa.string(), "media": pa.binary(), "error": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


class MediaArchive(DataSource):
    """format("media_archive"): load(directory) and save(directory); options split_bytes, batch_bytes, archive_bytes, attempts."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def _set(self) -> tuple[str, dict[str, int]]:
        return self.options["path"], {k: int(self.options.get(k, v)) for k, v in DEFAULTS.items()}

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(*self._set())

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(*self._set())


def store(rows: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes each row's payload to archives in the directory; members are named by id and unpadded size."""
    rows.sparkSession.dataSource.register(MediaArchive)
    kept = small_batches(rows).select(F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit("-")).alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, media = [], []
                for ident, value in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    raw = value.as_py()
                    names.append(f"{quote(ident, safe='=')}/{len(raw)}.png")
                    media.append(encode_png(raw + b"\0" * (-len(raw) % WIDTH or (0 if raw else WIDTH))))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary())], names=["name", "media"])

    kept.mapInArrow(run, WRITE).write.format("media_archive").mode("append").save(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """archive, member_offset, name, media, error of all members."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(path)


OUT = "doc_id string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, error string"


def describe(members: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The digests and features of stored members; a member that can't be read or decoded has its error and no more."""

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(StructType.fromDDL(OUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, media, error in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ident, _, size = name.removesuffix(".png").rpartition("/")
                row = [unquote(ident)[1:] if ident.startswith("=") else None, int(size)]
                if error is None:
                    try:
                        raw = media.as_py()
                        payload = decode_png(raw)
                        row += [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), features(payload), None]
                    except FAULTS as e:
                        error = f"{type(e).__name__}: {e}"[:300]
                rows.append(row if error is None else [*row, *[None] * 6, error])
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(k).type) for k, c in enumerate(zip(*rows, strict=True))], names=kinds.names)

    return members.select("name", "media", "error").mapInArrow(run, OUT).withColumn("doc_id", F.col("doc_id").cast(id_type))


def stored_features(rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every row in the shared folder, reads it back and describes it."""
    path = scratch(rows.sparkSession, "media")
    store(rows, path, doc_id, text)
    return describe(load(rows.sparkSession, path), rows.schema[doc_id].dataType.simpleString())
