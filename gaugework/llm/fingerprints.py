"""Document fingerprints by locally consistent parsing.

A text is a sequence of symbols. Runs of one symbol become one; deterministic coin tossing (each symbol by the lowest
bit in which it differs from the one before, and that bit's value, until few labels are left) gives labels that differ
from their neighbours; phrases begin at the largest labels. A phrase's name is a hash of its symbols, and names are the
symbols of the next level. Where phrases begin depends on a few symbols around, so equal substrings have equal names
inside, wherever they stand. The fingerprint has the smallest name of each of SLOTS classes among all names from level
``first`` up, 32 bits of it, so that minima of long unrelated texts don't agree by chance; likeness is the share of
classes that agree, an estimate of how many names two texts share.

Edge cases: null and empty texts have no names, and a likeness of 1 to each other and 0 to others; the next document of
a table's only row is itself; repeated rows and ties of doc_id stand in the order of their texts, null doc_ids first;
texts of any length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.common import small_batches, texts, written

SLOTS, EMPTY, PIECE = 64, 0xFFFFFFFF, 1 << 19
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
POWERS = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(64)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x + A) * B
    x ^= x >> np.uint64(29)
    x *= C
    x ^= x >> np.uint64(32)
    return x


def tossed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5 of symbols, neighbours within a text differing, from symbols of which neighbours differ."""
    for kind in (np.uint64, np.uint8, np.uint8, np.uint8):
        one = kind(1)
        x = x.astype(kind, copy=False)
        differ = np.empty_like(x)
        np.bitwise_xor(x[1:], x[:-1], out=differ[1:])
        differ[first] = one  # a text's first symbol: by its lowest bit
        low = differ & (~differ + one)
        x = (np.bitwise_count(low - one) << np.uint8(1)) | ((x & low) != 0).view(np.uint8)
    return x


def level_up(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of symbols x, and which of them are the first of a text."""
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new |= first
    if not new.all():
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(x))).astype(np.uint64)
        x, first = x[at], first[at]
        many = length > 1
        x[many] = mixed(x[many] ^ (length[many] * POWERS[1]))
    label = tossed(x, first)
    begins = first.copy()
    if len(x) > 2:
        mid = label[1:-1]
        begins[1:-1] |= (mid > label[:-2]) & (mid > label[2:]) & ~first[2:]  # never a text's last symbol alone
    at = np.flatnonzero(begins)
    place = np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))
    return mixed(np.add.reduceat(mixed(x) * POWERS[place], at)), first[at]


def _sketches(parts: list[str], first_level: int) -> np.ndarray:
    """A row of SLOTS 32-bit values for each of these texts, none of them empty."""
    out = np.full(len(parts) * SLOTS, EMPTY, np.uint32)
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    first = np.zeros(len(codes), bool)
    first[np.cumsum([0, *(len(p) for p in parts[:-1])])] = True
    x, owner, level = codes.astype(np.uint64), np.arange(len(parts)), 0
    while True:
        x, first = level_up(x, first)
        level += 1
        size = np.diff(np.append(np.flatnonzero(first), len(x)))
        if level >= first_level:
            names = mixed(x ^ np.uint64(level))
            slot = np.repeat(owner, size) * SLOTS + (names >> np.uint64(58)).astype(np.int64)
            np.minimum.at(out, slot, np.minimum(names.astype(np.uint32), EMPTY - 1))
            done = size == 1
            if done.all():
                return out.reshape(-1, SLOTS)
            keep = np.repeat(~done, size)
            x, first, owner = x[keep], first[keep], owner[~done]


def sketches(parts: list[str], first_level: int = 3) -> np.ndarray:
    out = np.full((len(parts), SLOTS), EMPTY, np.uint32)
    todo = [i for i, p in enumerate(parts) if p]
    while todo:
        now, size = [], 0
        while todo and (not now or size + len(parts[todo[-1]]) <= PIECE):
            now.append(todo.pop())
            size += len(parts[now[-1]])
        out[now] = _sketches([parts[i] for i in now], first_level)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of sketches, pair by pair."""
    some = (a != EMPTY) | (b != EMPTY)
    same = (a == b) & some
    n = some.sum(1)
    return np.where(n == 0, 1.0, same.sum(1) / np.maximum(n, 1))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double"
NAMES = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"]


def _compared(
    ids: list, own: list[str], following: list[str], first_level: int, known: np.ndarray | None = None
) -> tuple[list[pa.Array], np.ndarray]:
    """The result's columns for texts and those that follow them, and all sketches in the texts' order and of the last that follows."""
    new = [edited(t, f) for t, f in zip(own, following, strict=True)]
    marks = sketches([*own, *following[-1:]], first_level) if known is None else known
    fresh = sketches(new, first_level)
    hashed = [hashlib.sha256(t.encode()).hexdigest() for t in new]
    columns = [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array(hashed, pa.string()),
        pa.array([m.tobytes() for m in marks[: len(own)]], pa.binary()), pa.array([m.tobytes() for m in fresh], pa.binary())
    ]
    return [*columns, pa.array(likeness(marks[: len(own)], fresh)), pa.array(likeness(marks[: len(own)], marks[1 : len(own) + 1]))], marks


def fingerprint_table(docs: DataFrame, first_level: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    Texts are dealt out by ranges of doc_id once; the last document of a range meets the first of the next in a join
    of one row a range.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def edge(kind: str, doc_id, text: str) -> pa.RecordBatch:
            empty = [
                pa.array([doc_id], pa.int64()),
                *(pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()))
            ]
            return pa.RecordBatch.from_arrays(
                [*empty, pa.array([part], pa.int64()), pa.array([kind]), pa.array([text])], [*NAMES, "part", "edge", "text"]
            )

        for b in batches:
            ids, own = b.column(0).to_pylist(), b.column(1).to_pylist()
            if not ids:
                continue
            if last is None:
                yield edge("first", ids[0], own[0])
            else:
                ids, own = [last[0], *ids], [last[1], *own]
            last = ids[-1], own[-1]
            if len(ids) > 1:
                columns, _ = _compared(ids[:-1], own[:-1], own[1:], first_level)
                n = len(ids) - 1
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([part] * n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], [*NAMES, "part", "edge", "text"]
                )
        if last is not None:
            yield edge("last", *last)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text, following in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield pa.RecordBatch.from_arrays(_compared([doc_id], [text], [following], first_level)[0], NAMES)

    rows = texts(docs, "doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = written(rows.mapInArrow(run, f"{RESULT}, part long, edge string, text string"), "fingerprints")
    first = rows.where("edge = 'first'").select("part", F.col("text").alias("following"))
    parts = first.select(
        "part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next")
    )  # one row a range
    last = rows.where("edge = 'last'").select("part", "doc_id", "text").join(parts, "part")
    last = last.join(first.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following").mapInArrow(joined, RESULT)
    every = rows.where("edge is null").select(*NAMES).unionByName(last)
    return every.select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"), F.lower(F.hex("edited_fp")).alias("edited_fingerprint"),
        "near_edited", "near_next"
    )
