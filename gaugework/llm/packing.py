"""Best-fit packing of token sequences by minimum bin slack, on the histogram of lengths.

No length exceeds the capacity, so the numbers of pieces by length say all that packing needs, and stay as small as
the capacity however many pieces there are. Sequence by sequence, the longest piece left is joined by the combination
of available lengths that fills the rest best (subset sums as bits of one integer); the combination is then used as
often as the counts allow. Pieces are numbered within their length over all partitions and find their place by number.

Edge cases: a null or empty text has the end id alone; texts of any length are cut at the capacity and stay whole;
repeated rows, and ties of doc_id, are packed each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.common import give_back, grouped, small_batches, texts, written
from gaugework.llm.token_files import tokenizer


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and nth: the piece's number among those of its length in its partition."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        encode, end = tokenizer(path, False).encode, np.array([end_id], "<u4").tobytes()
        for doc_ids, texts_of in grouped(batches):
            out: list[tuple] = []
            for doc_id, ids in zip(doc_ids, encode(texts_of), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    out.append((doc_id, k, at // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            if out:
                types = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                )
        give_back()

    return texts(docs, "doc_id").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The lengths, with numbers, whose sum comes nearest to room from below."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (k * length)) & mask
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= k * length
            used[length] = used.get(length, 0) + k
    return used


def patterns(histogram: dict[int, int], capacity: int) -> Iterator[tuple[int, dict[int, int]]]:
    """How often, and with which lengths and numbers of them, sequences are filled; all pieces are used up."""
    counts = {k: n for k, n in histogram.items() if n > 0}
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = fullest({k: n for k, n in counts.items() if n}, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        often = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= often * n
            if not counts[k]:
                del counts[k]
        yield often, used


def slots(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (number of the first piece, first sequence, pieces in each sequence, first offset), by number."""
    taken: dict[int, int] = dict.fromkeys(histogram, 0)
    rows: dict[int, list] = {}
    sequence = 0
    for often, used in patterns(histogram, capacity):
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.setdefault(length, []).append((taken[length], sequence, n, offset))
            taken[length] += often * n
            offset += n * length
        sequence += often
    return {k: np.array(x, np.int64) for k, x in rows.items()}


def pack(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """``cut`` as pieces() gives it, once written, with sequence_id and offset for part and nth."""
    spark = cut.sparkSession
    by_part = written(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = spark.sparkContext.broadcast(slots(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # dealt out by key: the table of first numbers grows with the partitions, and in memory it is many times its files' size
    rows = cut.join(firsts.hint("shuffle_hash"), ["part", "length"]).withColumn("number", F.col("first") + F.col("nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length).tolist():
                at, rule = np.flatnonzero(length == k), table.value[k]
                first, base, each, start = rule[np.searchsorted(rule[:, 0], number[at], side="right") - 1].T
                sequence[at], offset[at] = base + (number[at] - first) // each, start + (number[at] - first) % each * k
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "number"]
    return rows.select(*columns).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(written(pieces(docs, path, capacity, end_id), "pack-pieces"), capacity)
