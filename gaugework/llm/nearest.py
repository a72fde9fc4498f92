"""Nearest neighbours by randomly rotated one-bit codes with error bounds, and exact distances of the vectors that these leave.

A vector minus the table's centre is turned by a random rotation (into more dimensions than it has, so that a code is as long as
asked) and kept as the signs of its coordinates, with its length and the share of its direction that the signs hold. A query's
turned coordinates are rounded to four bits; its inner product with a code's signs is then sums of counted bits (AND and popcount
of packed words) and gives, by the two scalars, an estimate of the distance and a bound of its error. A query first measures the k
vectors that are nearest by estimate; then every vector whose lower bound is below the k-th of these distances is measured on the
original vectors. The bounds hold with a stated chance (``width`` standard deviations), so few neighbours can be missed.

Vectors stay in the blocks that the tasks which read them pack; queries, packed too, are dealt to all blocks and meet them in an
equality join on the block's place. A block gives k rows a query, of which the k best of all blocks are kept.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than
the most frequent one (of equally frequent ones the shortest); repeated rows are candidates of each other; a null vec_id is a
candidate, never a query, and comes last among equals; fewer candidates than k: all of them; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.common import give_back, small_batches, written

PLANES = 4  # bits of a query's coordinate
PACKED = "block long, n long, ids binary, known binary, vectors binary, codes binary, lengths binary, shares binary"


def valid(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """The places of the vectors that take part, and these as doubles."""
    places, found = [], []
    for k, x in enumerate(column.to_pylist()):
        if x and None not in x:
            v = np.array(x, np.float64)
            if np.isfinite(v).all() and v.any():
                places.append(k)
                found.append(v)
    return np.array(places, np.int64), found


def centre_of(vectors: DataFrame, column: str) -> np.ndarray | None:
    """The mean of the vectors of the most frequent length; None if there is no vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for v in valid(b.column(0))[1]:
                own = total.setdefault(len(v), [0, np.zeros(len(v))])
                own[0] += 1
                own[1] += v
        rows = [(d, i, n, float(x)) for d, (n, s) in total.items() for i, x in enumerate(s)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["dim", "at", "n", "x"]
        )

    sums = vectors.select(column).mapInArrow(run, "dim long, at long, n long, x double").groupBy("dim", "at")
    sums = written(sums.agg(F.sum("n").alias("n"), F.sum("x").alias("x")), "centre")
    dim = sums.where("at = 0").orderBy(F.desc("n"), "dim").first()
    if dim is None:
        return None
    rows = sums.where(F.col("dim") == dim["dim"]).orderBy("at").collect()  # a row a dimension
    return np.round(np.array([r["x"] / r["n"] for r in rows]), 6)


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """``bits`` rows of ``dim`` numbers: a random turn of the space into one of ``bits`` dimensions that keeps all lengths."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, dim)))[0]


def turned(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the vectors from the centre, and their turned directions (zero for the centre itself)."""
    away = vectors - centre
    length = np.sqrt((away * away).sum(1))
    return length, (away / np.where(length > 0, length, 1)[:, None]) @ turn.T


def coded(direction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signs as packed words (a column a word), and the inner products of the directions with the directions of their signs."""
    bits = np.packbits(direction >= 0, axis=1, bitorder="little").view("<u8")
    share = np.abs(direction).sum(1) / np.sqrt(direction.shape[1])
    return np.ascontiguousarray(bits.T), np.where(share > 0, share, 1.0)


class Query:
    """A query's rounded coordinates as bit planes, and what turns counted bits into an inner product."""

    def __init__(self, direction: np.ndarray):
        bits = len(direction)
        self.low, top = float(direction.min()), float(direction.max())
        self.step = (top - self.low) / ((1 << PLANES) - 1) or 1.0
        level = np.clip(np.rint((direction - self.low) / self.step), 0, (1 << PLANES) - 1).astype(np.int64)
        rounded = self.low + self.step * level
        self.total, self.root = float(rounded.sum()), bits**0.5
        self.off = float(np.sqrt(((direction - rounded) ** 2).sum()))
        self.planes = [np.packbits(level >> j & 1, bitorder="little").view("<u8") for j in range(PLANES)]

    def products(self, codes: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Inner products with the directions of the codes' signs. ones: their numbers of set bits."""
        counted = np.zeros(codes.shape[1], np.int64)
        for w, word in enumerate(codes):
            for j, plane in enumerate(self.planes):
                counted += np.bitwise_count(word & plane[w]).astype(np.int64) << j
        return (2 * (self.low * ones + self.step * counted) - self.total) / self.root


def found_in(block: dict, query: np.ndarray, own: int | None, k: int, centre: np.ndarray, turn: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest of a block's vectors, by distance, then by vec_id. own: the query's own place."""
    length, direction = turned(query[None], centre, turn)
    s, q, bits = float(length[0]), Query(direction[0]), turn.shape[0]
    r, share = block["lengths"], block["shares"]
    product = np.clip(q.products(block["codes"], block["ones"]) / share, -1, 1)
    error = width * (np.sqrt(np.maximum(1 - share**2, 0)) / np.sqrt(max(bits - 1, 1)) + q.off / np.sqrt(bits)) / share
    square = r * r + s * s - 2 * r * s * product
    low = square - 2 * r * s * error
    if own is not None:
        square[own] = low[own] = np.inf
    rest = len(r) - (own is not None)
    if rest <= 0:
        return np.zeros(0, np.int64), np.zeros(0)
    measure = lambda at: ((block["vectors"][at] - query) ** 2).sum(1)
    first = np.argpartition(square, min(k, rest) - 1)[: min(k, rest)]
    limit = measure(first).max() * (1 + 1e-9)
    chosen = np.union1d(first, np.flatnonzero(low <= limit))
    chosen = chosen[chosen != own] if own is not None else chosen
    distance = np.sqrt(measure(chosen))
    best = np.lexsort((block["ids"][chosen], ~block["known"][chosen], distance))[:k]
    return chosen[best], distance[best]


def blocks_of(vectors: DataFrame, column: str, asked: Column, centre: np.ndarray, turn: np.ndarray, rows: int) -> DataFrame:
    """Packed blocks of at most ``rows`` vectors, in the tasks that read them. known: 1 for an id, 2 more if it is a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, ids, known, held = TaskContext.get().partitionId() << 32, [], [], []

        def packed() -> pa.RecordBatch:
            v = np.array(held)
            length, direction = turned(v, centre, turn)
            codes, share = coded(direction)
            parts = [np.array(ids, "<i8"), np.array(known, "u1"), v, codes, length, share]
            return pa.RecordBatch.from_arrays(
                [pa.array([made], pa.int64()), pa.array([len(v)], pa.int64()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts)],
                [c.split()[0] for c in PACKED.split(", ")]
            )

        for b in batches:
            places, own = valid(b.column(1))
            names, wanted = b.column(0).to_pylist(), b.column(2).to_pylist()
            for place, v in zip(places.tolist(), own, strict=True):
                if len(v) == len(centre):
                    ids.append(names[place] or 0)
                    known.append((names[place] is not None) + 2 * bool(wanted[place]))
                    held.append(v)
                if len(held) == rows:
                    yield packed()
                    made, ids, known, held = made + 1, [], [], []
        if held:
            yield packed()
        give_back()

    return vectors.select(F.col("vec_id").cast("long"), column, asked.alias("asked")).mapInArrow(run, PACKED)


def opened(names: list[str], row: list, dim: int, words: int) -> dict:
    kinds = {"ids": "<i8", "known": "u1", "vectors": "<f8", "codes": "<u8", "lengths": "<f8", "shares": "<f8"}
    x = {n: np.frombuffer(v, kinds[n]) if n in kinds else v for n, v in zip(names, row, strict=True)}
    x["vectors"] = x["vectors"].reshape(-1, dim)
    if "codes" in x:
        x["codes"] = x["codes"].reshape(words, -1)
        x["ones"] = np.bitwise_count(x["codes"]).sum(0, dtype=np.int64)
    return x


def nearest(
    vectors: DataFrame, asked: Column, k: int = 10, column: str = "embedding", stretch: int = 4, width: float = 3.0, size: int = 16 << 20, seed: int = 7
) -> DataFrame:
    """query_id, rank, vec_id, score (the distance) of the k nearest found of every row that ``asked`` is true for.

    A code has ``stretch`` bits a dimension, rounded up to whole words of 64. ``width``: how many standard deviations of an
    estimate the bounds allow for. Work grows with the queries times the vectors, in blocks of ``size`` bytes of vectors.
    """
    spark = vectors.sparkSession
    small_batches(spark, 1024)
    centre = centre_of(vectors, column)
    if centre is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, words = len(centre), -(-stretch * len(centre) // 64)
    turn = rotation(dim, words * 64, seed)
    packed = written(blocks_of(vectors, column, F.coalesce(asked, F.lit(False)) & F.col("vec_id").isNotNull(), centre, turn, max(1, size // (8 * dim))), "nearest-blocks")
    names = [c.split()[0] for c in PACKED.split(", ")]

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of a block, packed a thousand at a time: place of the block, own places, ids, vectors."""
        for b in batches:
            for row in zip(*(b.column(n).to_pylist() for n in ("block", "ids", "known", "vectors")), strict=True):
                x = opened(["block", "ids", "known", "vectors"], list(row), dim, words)
                at = np.flatnonzero(x["known"] >= 2)
                for lo in range(0, len(at), 1024):
                    own = at[lo : lo + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["block"]], pa.int64()), *(pa.array([y.tobytes()], pa.binary()) for y in (own, x["ids"][own], x["vectors"][own]))],
                        ["of", "at", "qids", "qvectors"]
                    )

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and near vector of a block. Blocks come after one another, so the last one is kept open."""
        last, block = None, {}
        for b in batches:
            cells = [b.column(c).to_pylist() for c in range(b.num_columns)]
            for row in zip(*cells, strict=True):
                if row[0] != last:
                    last, block = row[0], opened(names, list(row[: len(names)]), dim, words)
                    block["known"] = block["known"] % 2 == 1
                of, at, ids, wanted = row[len(names) :]
                at, ids, wanted = np.frombuffer(at, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(wanted, "<f8").reshape(-1, dim)
                out = []
                for place, v in zip(at.tolist(), wanted, strict=True):
                    out.append(found_in(block, v, place if of == last else None, k, centre, turn, width))
                n = [len(p) for p, _ in out]
                places, far = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(of, len(places))), pa.array(np.repeat(at, n)), pa.array(np.repeat(ids, n)),
                    pa.array(block["ids"][places], mask=~block["known"][places]), pa.array(np.full(len(places), last)), pa.array(places), pa.array(far)
                ], ["of", "at", "query_id", "vec_id", "block", "place", "score"])
        give_back()

    blocks = packed.count()
    home = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    asks = packed.select("block", "ids", "known", "vectors").mapInArrow(queries, "of long, at binary, qids binary, qvectors binary")
    asks = asks.withColumn("home", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    parts = min(max(blocks, 1), 10_000)
    met = packed.withColumn("home", home("block")).repartition(parts, "home").hint("merge").join(asks.repartition(parts, "home"), "home").drop("home")
    each = met.mapInArrow(tiles, "of long, at long, query_id long, vec_id long, block long, place long, score double")
    w = Window.partitionBy("of", "at").orderBy("score", F.asc_nulls_last("vec_id"), "block", "place")
    best = each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
