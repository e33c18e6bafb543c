"""Media columns: payloads stored as PNG members of ZIP archives, and a Spark data source that plans byte ranges over a folder of archives, streams members through Arrow, and retries each member alone by its offset."""

from __future__ import annotations

import io
import os
import struct
import time
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from zephyrine.session import shared_dir

from .words import as_bytes

#: Samples of a row of an image, and the unit that payloads are padded to.
WIDTH = 576
#: Bytes after which an archive is closed, least bytes of a read partition, and bytes of an outgoing batch.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 16 << 20, 16 << 20, 4 << 20
#: Read partitions that a plan has at most: beyond that they grow.
RANGES = 20_000
ATTEMPTS = 3
SCHEMA = "doc_id bigint, archive string, offset bigint, media binary, payload binary, n_bytes bigint, height int, feature string, error string"
#: Fixed value: how every PNG file begins.
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_LOCAL = struct.Struct("<4s5H3L2H")


def padded(text: bytes) -> bytes:
    """Bytes 255, which UTF-8 never holds, up to a positive multiple of WIDTH."""
    n = -(-max(len(text), 1) // WIDTH) * WIDTH
    return text + b"\xff" * (n - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey image of WIDTH columns, without loss."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    data = np.zeros((len(rows), WIDTH + 1), np.uint8)  # the first byte of a row is its filter: none
    data[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(data, 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an image that encode_png wrote; ValueError for anything else or anything damaged."""
    if media[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, size, parts = 8, (0, 0), []
    while at < len(media):
        if len(media) < at + 12:
            raise ValueError("cut off")
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError("checksum of a chunk")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", data)
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(size[1], size[0] + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Height, mean, deviation and the shares of sixteen grey levels, rounded."""
    counts = np.bincount(samples.ravel() >> 4, minlength=16)
    return f"h{samples.shape[0]};m{samples.mean():.3f};s{samples.std():.3f};" + ",".join(f"{x / samples.size:.4f}" for x in counts)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def write_archives(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Store each text as a PNG member of ZIP archives (members stored, not packed again) under folder; returns the number of archives.

    An archive has a name of its own for each attempt and is written at once; only those that the finished tasks name get into the list that the reader goes by, so what a lost executor leaves is never read. The list is a table, not a collected value. Null texts are empty; the member's name carries the id, empty for null; repeated rows are members each.
    """

    def write(batches):
        fs, top = _store(folder)
        fs.create_dir(f"{top}/archives", recursive=True)
        buffer, archive, n = io.BytesIO(), None, 0

        def close():
            archive.close()
            name = f"archives/{uuid.uuid4().hex}.zip"
            data = buffer.getvalue()
            with fs.open_output_stream(f"{top}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"name": [name], "bytes": [len(data)], "members": [n]})

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if archive is None:
                    buffer, n = io.BytesIO(), 0
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(f"{n}_{'' if doc is None else doc}.png"), encode_png(padded(text)))
                n += 1
                if buffer.tell() >= archive_bytes:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(write, "name string, bytes long, members long").write.parquet(f"{folder}/list")
    return docs.sparkSession.read.schema("name string").parquet(f"{folder}/list").count()


@dataclass
class ByteRange(InputPartition):
    """Ranges of bytes of archives: (name, start, end)."""

    pieces: list[tuple[str, int, int]]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.size = int(options.get("rangebytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[ByteRange]:
        """Ranges of bytes by the archives' sizes, as large as a share of the total; the planner reads no archive, only their list, column by column."""
        import pyarrow.parquet as pq

        fs, top = _store(self.folder)
        files = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(f"{top}/list")) if x.path.endswith(".parquet"))
        names, sizes = [], []
        for file in files:
            with fs.open_input_file(file) as f:
                table = pq.read_table(f, columns=["name", "bytes"])
            names.append(table.column("name").combine_chunks())
            sizes.append(table.column("bytes").to_numpy())
        size = max(self.size, sum(int(x.sum()) for x in sizes) // RANGES)
        ranges, pieces, held = [], [], 0
        for some, lengths in zip(names, sizes, strict=True):
            for name, length in zip(some.to_pylist(), lengths.tolist(), strict=True):
                for a in range(0, length, size):
                    pieces.append((name, a, min(a + size, length)))
                    held += pieces[-1][2] - a
                    if held >= size:
                        ranges.append(ByteRange(pieces))
                        pieces, held = [], 0
        return [*ranges, ByteRange(pieces)]

    def member(self, fs: pafs.FileSystem, path: str, info: zipfile.ZipInfo) -> tuple[bytes, np.ndarray]:
        """One member by its offset, read anew for each attempt."""
        for attempt in range(self.attempts):
            try:
                with fs.open_input_file(path) as f:
                    f.seek(info.header_offset)
                    return self.open(f.read(_LOCAL.size + len(info.filename.encode()) + info.compress_size + 64), info)
            except (OSError, ValueError, zlib.error):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(0.05 * 2**attempt)
        raise ValueError("no attempt")

    @staticmethod
    def open(data: bytes, info: zipfile.ZipInfo) -> tuple[bytes, np.ndarray]:
        if len(data) < _LOCAL.size:
            raise ValueError("cut off")
        head = _LOCAL.unpack_from(data)
        at = _LOCAL.size + head[9] + head[10]
        media = data[at : at + info.compress_size]
        if head[0] != b"PK\x03\x04" or zlib.crc32(media) != info.CRC:
            raise ValueError("damaged member")
        return media, decode_png(media)

    def read(self, partition: ByteRange):
        """Members whose header begins in the range, in batches of bounded size. The range is read once from end to end; a member that fails is tried again by its offset, and after the last attempt it is a row with error set and no media."""
        fs, top = _store(self.folder)
        rows, held = [], 0
        for name, start, end in partition.pieces:
            path = f"{top}/{name}"
            with fs.open_input_file(path) as f:
                infos = [i for i in zipfile.ZipFile(f).infolist() if start <= i.header_offset < end]
                for info in infos:
                    doc = os.path.splitext(info.filename)[0].partition("_")[2]
                    row = [int(doc) if doc else None, name, info.header_offset]
                    try:
                        try:
                            f.seek(info.header_offset)
                            media, samples = self.open(f.read(_LOCAL.size + len(info.filename.encode()) + info.compress_size), info)
                        except (OSError, ValueError, zlib.error):
                            media, samples = self.member(fs, path, info)
                        payload = samples.tobytes()
                        row += [media, payload, len(payload.rstrip(b"\xff")), samples.shape[0], feature_of(samples), None]
                        held += len(media) + len(payload)
                    except (OSError, ValueError, zlib.error) as error:
                        row += [None, None, None, None, None, str(error)]
                    rows.append(row)
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


class MediaArchive(DataSource):
    """Format `media_archive`: option path, the folder that write_archives filled; rangebytes; attempts."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """A row for each member: doc_id, archive, offset, media (the stored PNG), payload (its samples), n_bytes (without padding), height, feature, error."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).option("path", folder).load()


def media_columns(docs: DataFrame, **columns: str) -> DataFrame:
    """Store documents and read them back. An empty table gives no rows. Writing is an action, run at once."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    write_archives(docs, folder, **columns)
    return read_archives(spark, folder)
