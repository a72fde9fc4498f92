"""Media columns: payloads as 8-bit greyscale images in ZIP archives, read back by a Spark data source.

A payload is a text's bytes, padded with bytes 0 to a positive multiple of 64: an image of 64 samples a row, stored as
PNG (lossless) with the unpadded size in a text chunk. Tasks write archives of many members to a shared folder. The
source ``media_archive`` plans byte ranges over the archives of a folder; a task reads the directory of its archive,
takes the members that begin in its range, and streams them in Arrow batches of bounded size. A member is read by its
offset and checked; if that fails, this member alone is read again.

Edge cases: a null text is an empty one (64 bytes 0); texts of any length stay whole; repeated rows, and ties of doc_id, are members of their
own; an empty table writes no archive and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gaugework.llm import files
from gaugework.llm.common import small_batches, texts
from gaugework.session import work_dir

WIDTH, SIGNATURE = 64, b"\x89PNG\r\n\x1a\n"


def to_png(data: bytes) -> bytes:
    """data, padded, as a greyscale image of WIDTH samples a row."""
    rows = max(1, -(-len(data) // WIDTH))
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # each row begins with its filter, 0
    flat = np.zeros(rows * WIDTH, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    lines[:, 1:] = flat.reshape(rows, WIDTH)
    chunks = [
        (b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)), (b"tEXt", b"bytes\0%d" % len(data)),
        (b"IDAT", zlib.compress(lines.tobytes(), 1)), (b"IEND", b"")
    ]
    return SIGNATURE + b"".join(struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x)) for kind, x in chunks)


def from_png(data: bytes) -> tuple[bytes, int]:
    """The payload of an image that to_png made, and the size without padding."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, chunks = 8, {}
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} is damaged")
        chunks[kind] = body
        at += 12 + n
    rows = struct.unpack(">I", chunks[b"IHDR"][4:8])[0]
    lines = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(rows, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("only rows without a filter are read")
    return lines[:, 1:].tobytes(), int(chunks[b"tEXt"].partition(b"\0")[2])


def feature(payload: bytes) -> str:
    """Mean, deviation, entropy in bits, and mean step between neighbouring samples, of all samples."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    values = np.arange(256)
    mean = float((n * values).sum() / len(x))
    spread = float(np.sqrt((n * (values - mean) ** 2).sum() / len(x)))
    steps = np.abs(np.diff(x.astype(np.int16))).mean(dtype=np.float64)
    return f"mean={mean:.4f};deviation={spread:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={steps:.4f}"


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = 256 << 20) -> int:
    """Every text as a member doc_id-number.png of an archive in the folder; gives the number of members."""
    small_batches(docs.sparkSession)
    files.make_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, archive, member, done = TaskContext.get().partitionId(), 0, 0, False
        rows = ((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        row = next(rows, None)
        while row is not None:
            size = 0
            with files.Put(folder, f"part-{part:06d}-{archive:06d}.zip") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
                while row is not None and size < archive_bytes:
                    name = "" if row[0] is None else row[0]
                    media = to_png(row[1].encode())
                    z.writestr(zipfile.ZipInfo(f"{name}_{member}.png", (1980, 1, 1, 0, 0, 0)), media)
                    size, member, row = size + len(media), member + 1, next(rows, None)
            archive += 1
        yield pa.RecordBatch.from_pydict({"n": [member]})

    return texts(docs, "doc_id").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", 64 << 20))
        self.batch_bytes = int(options.get("batchbytes", 4 << 20))
        self.attempts = int(options.get("attempts", 4))

    def partitions(self) -> list[Range]:
        """Byte ranges from the archives' names and sizes alone; their directories are read by the tasks."""
        return [Range(name, at, at + self.range_bytes) for name, size in files.listed(self.folder, ".zip") for at in range(0, size, self.range_bytes)]

    def open(self, archive: str):
        fs, path = files.at(self.folder)
        return fs.open_input_file(f"{path}/{archive}")

    @staticmethod
    def checked(data: bytes, info: zipfile.ZipInfo, base: int) -> bytes:
        """A member's bytes out of the archive's bytes from ``base`` on."""
        at = info.header_offset - base
        if data[at : at + 4] != b"PK\3\4" or len(data) < at + 30:
            raise ValueError("no member begins here")
        at += 30 + sum(struct.unpack("<HH", data[at + 26 : at + 30]))
        own = data[at : at + info.compress_size]
        if len(own) != info.file_size or zlib.crc32(own) != info.CRC:
            raise ValueError("the bytes differ from the directory's checksum")
        return own

    def member(self, archive: str, info: zipfile.ZipInfo, end: int) -> bytes:
        """One member by its offset, with a handle of its own, checked; tried again by itself if anything about it fails."""
        for attempt in range(self.attempts):
            try:
                with self.open(archive) as f:
                    f.seek(info.header_offset)
                    return self.checked(f.read(end - info.header_offset), info, info.header_offset)
            except (OSError, ValueError) as e:
                if attempt + 1 == self.attempts:
                    raise OSError(f"{archive}, member {info.filename} at {info.header_offset}: {e}") from e
                time.sleep(0.1 * 2**attempt)
        raise AssertionError("attempts must be positive")

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive at all
            return
        with self.open(partition.archive) as f, zipfile.ZipFile(f) as z:  # one handle a range: the directory, then spans of members
            infos = sorted(z.infolist(), key=lambda i: i.header_offset)
            ends = [i.header_offset for i in infos[1:]] + [z.start_dir]
            own = [(i, end) for i, end in zip(infos, ends) if partition.start <= i.header_offset < partition.end]
            while own:
                base, n = own[0][0].header_offset, 1
                while n < len(own) and own[n][1] - base <= self.batch_bytes:
                    n += 1
                span, own = own[:n], own[n:]
                try:
                    f.seek(base)
                    data = f.read(span[-1][1] - base)
                except OSError:
                    data = b""  # each of its members is read by itself
                held = []
                for info, end in span:
                    try:
                        media = self.checked(data, info, base)
                    except ValueError:
                        media = self.member(partition.archive, info, end)
                    held.append((partition.archive, info.filename, info.header_offset, media))
                yield self.batch(held)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)],
            ["archive", "member", "offset", "media"]
        )


class MediaArchiveSource(DataSource):
    """spark.read.format("media_archive").load(folder): archive, member, offset, media. Options rangeBytes, batchBytes, attempts."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").options(**options).load(folder)


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each image."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for member, image in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                image = image.as_buffer().to_pybytes()
                payload, n = from_png(image)
                doc_id = member.partition("_")[0]
                out.append((
                    int(doc_id) if doc_id else None, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image),
                    hashlib.sha256(image).hexdigest(), feature(payload)
                ))
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    return media.select("member", "media").mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def media_table(docs: DataFrame) -> DataFrame:
    """Stores all texts in archives in the shared folder, reads them back and computes features."""
    folder = work_dir(docs.sparkSession, "media")
    write_archives(docs, folder)
    return media_features(read_archives(docs.sparkSession, folder))
