"""Token ids in compressed files: one wavelet matrix a shard.

A wavelet matrix keeps the ids of a shard as bit planes, the highest bit first; after every plane the ids are dealt
stably into zeros and ones. With counts of ones before every block of 512 bits, one file supports access to any token,
counts of a token in a range and its k-th occurrence, without the ids being spelled out anywhere.

Documents are sorted by doc_id over all shards. Edge cases: a null text is an empty one and has the end id alone; null
doc_ids come first; repeated rows each keep a place; an empty table writes no file and gives an empty result; texts of
any length stay whole (a shard ends at a document's end, after at least ``shard_tokens`` ids); other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm import files
from gaugework.llm.common import give_back, grouped, small_batches, texts, written
from gaugework.llm.token_ids import TokenIds
from gaugework.session import work_dir

MAGIC, BLOCK = b"WVM1", 512


class WaveletMatrix:
    """planes: packed bits, the highest first; zeros: zeros of each plane; ranks: ones before every block of each plane."""

    def __init__(self, n: int, planes: list, zeros: list[int], ranks: list):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max(initial=0)).bit_length())
        now, planes, zeros, ranks = ids.astype(np.uint16 if width <= 16 else np.uint32), [], [], []
        for shift in range(width - 1, -1, -1):
            bit = ((now >> shift) & 1).astype(bool)
            plane = np.packbits(bit, bitorder="little")
            plane = np.pad(plane, (0, -len(plane) % (BLOCK // 8)))
            ones = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
            low = now[~bit]
            now = np.concatenate([low, now[bit]])
            planes.append(plane)
            zeros.append(len(low))
            ranks.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)]))
        return cls(len(ids), planes, zeros, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        rest = self.planes[level][block * BLOCK // 8 : -(-i // 8)]
        bits = np.unpackbits(rest, bitorder="little")[: i - block * BLOCK]
        return int(self.ranks[level][block]) + int(bits.sum())

    def access(self, i: int) -> int:
        """The i-th id."""
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self.planes[level][i // 8]) >> (i % 8) & 1
            ones = self._ones(level, i)
            value, i = value << 1 | bit, zeros + ones if bit else i - ones
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        width = len(self.zeros)
        if token >> width:
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, start), self._ones(level, end)
            start, end = (zeros + a, zeros + b) if token >> (width - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id among places start to end."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th one or zero (from 0) of a plane."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def occurrence(self, token: int, k: int) -> int | None:
        """The place of the k-th occurrence (from 0) of an id, None if there are fewer."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            return None
        i, width = a + k, len(self.zeros)
        for level in range(width - 1, -1, -1):
            bit = token >> (width - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids: the planes from the lowest bit up, each undoing one deal."""
        width = len(self.zeros)
        now = np.zeros(self.n, np.uint16 if width <= 16 else np.uint32)
        for level in range(width - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            back = np.empty_like(now)
            back[~bit], back[bit] = now[: self.zeros[level]], now[self.zeros[level] :]
            back |= bit.astype(now.dtype) << np.array(width - 1 - level, now.dtype)
            now = back
        return now


def to_bytes(ids: np.ndarray, docs: pa.RecordBatch) -> bytes:
    """A shard: a head with the places of its parts, the documents (doc_id, end), then planes and ranks, each compressed."""
    w = WaveletMatrix.of(ids)
    squeeze = pa.Codec("zstd", compression_level=1).compress
    table = docs.serialize().to_pybytes()
    parts = [table, *(x.tobytes() for pair in zip(w.planes, w.ranks, strict=True) for x in pair)]
    packed = [squeeze(p, asbytes=True) for p in parts]
    head = json.dumps({"n": w.n, "zeros": w.zeros, "raw": [len(p) for p in parts], "packed": [len(p) for p in packed]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *packed])


DOCS = pa.schema([("doc_id", pa.int64()), ("end", pa.int64())])


def from_bytes(data: bytes) -> tuple[WaveletMatrix, pa.RecordBatch]:
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    at = 8 + struct.unpack("<I", data[4:8])[0]
    head = json.loads(data[8:at])
    parts, codec = [], pa.Codec("zstd")
    for raw, packed in zip(head["raw"], head["packed"], strict=True):
        parts.append(codec.decompress(data[at : at + packed], decompressed_size=raw, asbytes=True))
        at += packed
    planes, ranks = ([np.frombuffer(p, kind) for p in parts[k::2]] for k, kind in ((1, np.uint8), (2, np.uint32)))
    return WaveletMatrix(head["n"], planes, head["zeros"], ranks), pa.ipc.read_record_batch(parts[0], DOCS)


@functools.cache
def tokenizer(path: str, keep_space: bool) -> TokenIds:
    """One for each Python worker, so that its memo outlives a task."""
    return TokenIds(path, keep_space)


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 2, shard_tokens: int = 1 << 20) -> DataFrame:
    """Encodes all texts and writes the shards; gives part, shard, name, start (in the part) and n_tokens of each."""
    small_batches(docs.sparkSession)
    files.make_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        encode, end = tokenizer(path, True).encode, np.array([end_id], "<u4").tobytes()
        held: list[bytes] = []
        names: list[int | None] = []
        size = 0

        def put() -> pa.RecordBatch:
            nonlocal shard, start, size
            ids = np.frombuffer(b"".join(held), "<u4")
            ends = np.cumsum([len(x) // 4 for x in held])
            name = f"part-{part:06d}-{shard:06d}.wvm"
            with files.Put(folder, name) as f:
                f.write(to_bytes(ids, pa.record_batch([pa.array(names, pa.int64()), pa.array(ends, pa.int64())], schema=DOCS)))
            row = pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "name": [name], "start": [start], "n_tokens": [size]})
            shard, start, size = shard + 1, start + size, 0
            held.clear()
            names.clear()
            return row

        for doc_ids, own in grouped(batches):
            for doc_id, ids in zip(doc_ids, encode(own), strict=True):
                held.append(ids + end)
                names.append(doc_id)
                size += len(ids) // 4 + 1
                if size >= shard_tokens:
                    yield put()
        if held:
            yield put()
        give_back()

    rows = texts(docs, "doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(run, "part long, shard long, name string, start long, n_tokens long"), "token-shards")


def read_token_files(shards: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, name, start in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                matrix, docs = from_bytes(files.read(folder, name))
                raw, ends = matrix.decode().astype("<u4").tobytes(), docs.column(1).to_numpy()
                starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
                sums = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(ends), pa.int64()), docs.column(0), pa.array(starts + start), pa.array(ends - starts),
                        pa.array(sums, pa.int64())
                    ],
                    ["part", "doc_id", "at", "n_tokens", "ids_crc32"]
                )

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of doc_ids
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    n = max(1, shards.count() // 4)
    rows = shards.select("part", "name", "start").repartition(n, "name").mapInArrow(
        run, "part long, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, path: str, end_id: int = 2, shard_tokens: int = 1 << 20) -> DataFrame:
    """Writes the token files of all documents to the shared folder and reads them back."""
    folder = work_dir(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, path, end_id, shard_tokens), folder)
