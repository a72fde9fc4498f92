"""Ranked lexical search by pipelined term partitioning, in whole numbers.

Documents are read once, into blocks: each block holds its documents' ids and numbers of terms, and for every term that some item
asks for the documents that hold it, with the occurrences. The terms are dealt to owners, rarest first, each with about as many
occurrences. Items travel in bundles, one for every block: a bundle starts with no accumulator, meets one owner's postings of its
block after another by a cogroup, and carries its sparse accumulators (item, document, score so far) on; the last owner's stage
gives each item's best documents of the block, and the best of all blocks are kept.

Between stages an accumulator goes if even the most that the later owners can add leaves its document below the k-th of the
item's documents in the block: it can't come back to the top, so results stay whole.

Edge cases: null and empty texts hold no term and are found by no item; a null doc_id comes last among equals; repeated rows of
documents are documents of their own, repeated rows of items are ranked each for itself; items without a term, and empty tables,
give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.common import give_back, small_batches, texts, written

#: Bytes of a term are kept (A to Z as small letters), all others become spaces: terms are what stands between spaces.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCK = "block long, docs array<long>, sizes array<long>, n long, words long, terms array<int>, counts array<int>, places binary, times binary"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TERMS).split()


def item_terms(items: DataFrame, key: str) -> DataFrame:
    """item (a row's number), key, term, times. The rows of a term: one an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, name, text in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                found = Counter(terms_of(text))
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * n, pa.int64()), pa.array([name] * n, pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                    ["item", "key", "term", "times"]
                )

    rows = texts(items.withColumn("_item", F.monotonically_increasing_id()), "_item", key).select("_item", F.col(key).cast("long"), "text")
    return rows.mapInArrow(run, "item long, key long, term binary, times long")


def blocks(docs: DataFrame, vocabulary: dict[bytes, int], rows: int) -> DataFrame:
    """Blocks of at most ``rows`` documents: ids and numbers of terms; for each asked term the places in the block and the occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, ids, sizes, codes, times = TaskContext.get().partitionId() << 32, [], [], [], []

        def packed() -> pa.RecordBatch:
            code = np.array(codes, np.int64)
            order = np.argsort(code)
            term, count = np.unique(code[order] // rows, return_counts=True)
            parts = ((code % rows)[order].astype("<i4").tobytes(), np.array(times, "<i8")[order].astype("<i4").tobytes())
            columns = [
                pa.array([made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([sum(s > 0 for s in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64()), pa.array([term.astype(np.int32)], pa.list_(pa.int32())),
                pa.array([count.astype(np.int32)], pa.list_(pa.int32())), *(pa.array([p], pa.binary()) for p in parts)
            ]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCK.split(", ")])

        known = vocabulary.get
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                for term, n in Counter(filter(lambda t: t is not None, map(known, words))).items():
                    codes.append(term * rows + len(ids))
                    times.append(n)
                ids.append(doc)
                sizes.append(len(words))
                if len(ids) == rows:
                    yield packed()
                    made, ids, sizes, codes, times = made + 1, [], [], [], []
        if ids:
            yield packed()
        give_back()

    small_batches(docs.sparkSession)
    return texts(docs, "doc_id").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCK)


def owners_of(found: dict[int, int], owners: int) -> dict[int, int]:
    """Term -> owner: rarest terms first, the owners with about as many occurrences each."""
    total, upto, of = sum(found.values()), 0, {}
    for term, df in sorted(found.items(), key=lambda x: (x[1], x[0])):
        of[term] = min(owners - 1, upto * owners // max(total, 1))
        upto += df
    return of


def best_of(score: np.ndarray, k: int) -> np.ndarray:
    """By row the k-th highest number, zero if there are fewer columns."""
    return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] if score.shape[1] >= k else np.zeros(len(score), np.int64)


def postings(read: DataFrame, owner: int, of: dict[int, int], bundles: list[list[int]]) -> DataFrame:
    """block, bundle, and an owner's part of the block for the bundles that ask for one of its terms. bundles: their terms."""
    own = np.array(sorted(t for t, o in of.items() if o == owner), np.int64)
    asked = [np.intersect1d(own, np.array(terms, np.int64)) for terms in bundles]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, terms, counts, places, times in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                term, count = np.array(terms, np.int64), np.array(counts, np.int64)
                end = np.cumsum(count)
                for bundle, wanted in enumerate(asked):
                    at = np.flatnonzero(np.isin(term, wanted))
                    if len(at):
                        pick = np.concatenate([np.arange(end[k] - count[k], end[k]) for k in at])
                        parts = (np.frombuffer(places, "<i4")[pick].tobytes(), np.frombuffer(times, "<i4")[pick].tobytes())
                        yield pa.RecordBatch.from_arrays([
                            pa.array([block], pa.int64()), pa.array([bundle], pa.int32()), pa.array([term[at].astype("<i4").tobytes()], pa.binary()),
                            pa.array([count[at].astype("<i4").tobytes()], pa.binary()), *(pa.array([p], pa.binary()) for p in parts)
                        ], ["block", "bundle", "terms", "counts", "places", "times"])

    rows = read.select("block", "terms", "counts", "places", "times")
    return rows.mapInArrow(run, "block long, bundle int, terms binary, counts binary, places binary, times binary")


class Stage:
    """What one owner adds to a bundle's accumulators in one block."""

    def __init__(self, asks: list[list[list[tuple[int, int]]]], weight: dict[int, int], of: dict[int, int], owner: int, owners: int, k: int, n: int, words: int):
        self.k, self.n, self.words, self.last = k, n, words, owner == owners - 1
        self.asks: list[dict[int, list[tuple[int, int]]]] = []  # by bundle: term -> (item's place in the bundle, weight times its occurrences)
        self.later: list[np.ndarray] = []  # by bundle and item: the most that later owners add
        for bundle in asks:
            own: dict[int, list[tuple[int, int]]] = {}
            later = np.zeros(len(bundle), np.int64)
            for place, terms in enumerate(bundle):
                for term, times in terms:
                    if of.get(term) == owner:
                        own.setdefault(term, []).append((place, weight[term] * times))
                    elif of.get(term, -1) > owner:
                        later[place] += weight[term] * times * 1_000_000
            self.asks.append(own)
            self.later.append(later)

    def added(self, bundle: int, sizes: list[int], held: tuple | None, found: tuple | None) -> np.ndarray:
        """The bundle's scores, a row an item and a column a document of the block."""
        score = np.zeros((len(self.later[bundle]), len(sizes)), np.int64)
        if held is not None:
            items, places, scores = (np.frombuffer(x, t) for x, t in zip(held, ("<i4", "<i4", "<i8")))
            score[items, places] = scores
        if found is not None:
            terms, counts, places, times = (np.frombuffer(x, "<i4").astype(np.int64) for x in found)
            m = 12 * np.array([75 + 25 * s * self.n // self.words for s in sizes], np.int64)[places]
            part, end = 1_000_000_000 * times // (1000 * times + m), np.cumsum(counts)
            for term, a, z in zip(terms.tolist(), (end - counts).tolist(), end.tolist()):
                for item, weight in self.asks[bundle][term]:
                    score[item, places[a:z]] += weight * part[a:z]
        return score

    def kept(self, bundle: int, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and places of the accumulators that can still be among the best k."""
        return np.nonzero((score > 0) & (score + self.later[bundle][:, None] >= best_of(score, self.k)[:, None]))


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "item_id", owners: int = 4, rows: int = 4096, items_a_bundle: int = 256, most: int = 1_000_000) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of the highest score above 0.

    The items' terms go to all tasks, so of tables with more than ``most`` different (item, term) the items are ranked in so many
    turns that each has about as many; every turn reads all documents.
    """
    asks = written(item_terms(items, key), "search-items")
    turns = -(-asks.count() // most)
    own = [_ranked(docs, asks.where(F.pmod(F.xxhash64("item"), F.lit(turns)) == t), k, owners, rows, items_a_bundle) for t in range(turns)]
    out = [x for x in own if x is not None]
    if not out:
        return docs.sparkSession.createDataFrame([], f"{key} long, rank int, doc_id long, score long")
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found.withColumnRenamed("key", key)


def _ranked(docs: DataFrame, asks: DataFrame, k: int, owners: int, rows: int, items_a_bundle: int) -> DataFrame | None:
    """key, rank, doc_id, score of the items of one turn."""
    spark = docs.sparkSession
    named: dict[int, list] = {}
    vocabulary: dict[bytes, int] = {}
    for r in asks.orderBy("item").collect():  # a turn's terms, of a stated number
        named.setdefault(r["item"], [r["key"], []])[1].append((vocabulary.setdefault(bytes(r["term"]), len(vocabulary)), r["times"]))
    if not named:
        return None
    numbers = list(named)
    parts = [numbers[lo : lo + items_a_bundle] for lo in range(0, len(numbers), items_a_bundle)]
    bundles = [[named[i][1] for i in part] for part in parts]
    read = written(blocks(docs, vocabulary, rows), "search-blocks")
    total = read.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    n, words = total["n"] or 0, total["words"] or 0
    if not n:
        return None
    counted = read.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
    found = {r["terms"]: r["df"] for r in counted.collect()}  # a row a term of the turn's
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in found.items()}
    of = owners_of(found, owners)
    wanted = [sorted({t for terms in bundle for t, _ in terms if t in of}) for bundle in bundles]
    sizes = read.select("block", F.explode(F.array(*(F.lit(b) for b in range(len(bundles))))).alias("bundle"), "docs", "sizes")

    def stage(owner: int):
        step = Stage([[[(t, m) for t, m in terms if t in of] for terms in bundle] for bundle in bundles], weight, of, owner, owners, k, n, words)
        names = [[(i, named[i][0]) for i in part] for part in parts]

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            bundle = key[1].as_py()
            row = {c: left.column(c)[0].as_py() for c in left.column_names}
            part = [right.column(c)[0].as_py() for c in ("terms", "counts", "places", "times")] if len(right) else None
            score = step.added(bundle, row["sizes"], (row["items"], row["places"], row["scores"]), part)
            items, places = step.kept(bundle, score)
            values = score[items, places]
            if not step.last:
                packed = [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((items, "<i4"), (places, "<i4"), (values, "<i8"))]
                return pa.table([*(left.column(c) for c in ("block", "bundle", "docs", "sizes")), *packed], names=["block", "bundle", "docs", "sizes", "items", "places", "scores"])
            docs_of = [row["docs"][p] for p in places.tolist()]
            numbers, keys = zip(*(names[bundle][i] for i in items.tolist())) if len(items) else ((), ())
            return pa.table([
                pa.array(numbers, pa.int64()), pa.array(keys, pa.int64()), pa.array(docs_of, pa.int64()), pa.array(values, pa.int64()),
                pa.array(np.full(len(items), row["block"]), pa.int64()), pa.array(places, pa.int64())
            ], names=["item", "key", "doc_id", "score", "block", "place"])

        return run

    nothing = F.lit(b"")
    carried = sizes.select("*", nothing.alias("items"), nothing.alias("places"), nothing.alias("scores"))
    on = ["block", "bundle"]
    for owner in range(owners):
        schema = "item long, key long, doc_id long, score long, block long, place long"
        if owner < owners - 1:
            schema = "block long, bundle int, docs array<long>, sizes array<long>, items binary, places binary, scores binary"
        carried = carried.groupBy(*on).cogroup(postings(read, owner, of, wanted).groupBy(*on)).applyInArrow(stage(owner), schema)
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "place")
    best = carried.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("key", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
