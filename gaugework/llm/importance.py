"""Target-distribution importance resampling: documents whose n-grams are likelier in a target than here get higher scores.

Arrow kernels cut a batch of texts into words (ascii_lower, split_pattern_regex, list_flatten) and number them
(dictionary_encode); shifted numbers form the n-grams, each distinct one is hashed once (CRC-32), and the gains of their buckets
are taken and summed by document. One pass counts both tables' buckets, a second one scores; a score is the mean gain of a
document's features plus Gumbel noise that its doc_id fixes, so the highest scores are a draw without replacement.

Edge cases: null and empty texts have no feature and weight 0; documents of fewer than ``least`` words get a score but no rank;
repeated rows are rows of their own (the same score, ranks after each other); a null doc_id's noise is that of the empty text,
and it comes last among equals; empty tables give an empty result, an empty target counts as no feature; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import give_back, scratch, small_batches, texts, written

#: What stands between words: all of ASCII but digits and (lower-cased) letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of texts: the number of words of each, the words' numbers in order, and the numbered words."""
    parts = pc.split_pattern_regex(pc.ascii_lower(text), pattern=BETWEEN)
    flat = pc.list_flatten(parts)
    of = pc.list_parent_indices(parts).to_numpy()
    real = pc.not_equal(pc.binary_length(flat), 0)  # an end of a text may be no word
    coded = pc.dictionary_encode(flat.filter(real))
    return np.bincount(of[real.to_numpy(zero_copy_only=False)], minlength=len(text)), coded.indices.to_numpy().astype(np.int64), [
        w.encode() for w in coded.dictionary.to_pylist()
    ]


def features_of(text: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: words of each, the bucket of every run of 1 to ``longest`` words, and the text that it is of."""
    n, word, names = words_of(text)
    doc = np.repeat(np.arange(len(n)), n)
    code, known = word, names  # the runs of a length, numbered, and their bytes
    made, owner = [], []
    for length in range(1, longest + 1):
        if length > 1:
            inside = np.flatnonzero(doc[: len(doc) - length + 1] == doc[length - 1 :])
            pairs, code_of = np.unique(code[inside] * max(1, len(names)) + word[inside + length - 1], return_inverse=True)
            first, last = np.divmod(pairs, max(1, len(names)))
            known = [known[a] + b" " + names[b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            code = np.zeros(len(doc), np.int64)  # by the run's first word
            code[inside] = code_of
        else:
            inside = np.arange(len(doc))
        bucket = np.array([zlib.crc32(x) % buckets for x in known], np.int64)
        made.append(bucket[code[inside]] if len(inside) else np.zeros(0, np.int64))
        owner.append(doc[inside])
    return n, np.concatenate(made), np.concatenate(owner)


def bucket_counts(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """bucket, n: how many features fall into each; a task sends a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(features_of(b.column(0), longest, buckets)[1], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])
        give_back()

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int, buckets: int) -> list[int]:
    """A thousand times the log of how much likelier each bucket is in the target, rounded down; one number a bucket."""
    own, wanted = ({r.bucket: r.n for r in bucket_counts(t, longest, buckets).collect()} for t in (docs, target))  # a row a bucket
    here, there = sum(own.values()) + buckets, sum(wanted.values()) + buckets
    return [math.floor(1000 * math.log(float((wanted.get(k, 0) + 1) * here) / float((own.get(k, 0) + 1) * there))) for k in range(buckets)]


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise, in thousandths, that the number and the seed fix."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], longest: int, seed: int) -> DataFrame:
    """row, doc_id, n_words, n_features, weight, score of every document."""
    values, buckets = np.array(gain, np.int64), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, bucket, doc = features_of(b.column(2), longest, buckets)
            order = np.argsort(doc, kind="stable")
            count = np.bincount(doc, minlength=len(n))
            some = np.flatnonzero(count)
            total = np.zeros(len(n), np.int64)
            if len(some):
                total[some] = np.add.reduceat(values[bucket[order]], (np.cumsum(count) - count)[some])
            weight = total // np.maximum(count, 1)
            score = weight + np.array([noise(seed, i) for i in b.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *map(pa.array, (n, count, weight, score))], ["row", "doc_id", "n_words", "n_features", "weight", "score"]
            )
        give_back()

    small_batches(docs.sparkSession)
    rows = texts(docs.withColumn("_row", F.monotonically_increasing_id()), "_row", "doc_id").select("_row", F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least: int = 20, percent: int = 10, seed: int = 2024
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score, and rank among the ``percent`` of the documents of at least ``least``
    words that are drawn (null: not drawn).

    Scores are whole thousandths of logarithms, so they have some ten thousand values at any size: their counts give the score
    from which documents are drawn. Those from there on are dealt by ranges of (score, doc_id, row), so that no value is one
    task's work; a range's ranks begin after the rows of the ranges before it.
    """
    spark = docs.sparkSession
    rows = written(scored(docs, gains(docs, target, longest, buckets), longest, seed), "importance-scores")
    able = rows.where(F.col("n_words") >= least)
    counts = able.groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()  # a row a value of the score
    wanted, upto, cut = sum(r.n for r in counts) * percent // 100, 0, None
    for r in counts:
        if upto >= wanted:
            break
        cut, upto = r.score, upto + r.n
    if cut is None:
        return rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    with scratch(spark):
        order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), upto // 1_000_000)
        best = able.where(F.col("score") >= cut).select("row", "doc_id", "score").repartitionByRange(parts, *order).sortWithinPartitions(*order)
        place = F.monotonically_increasing_id()
        best = written(best.select("row", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "importance-best")
        before, starts = 0, []
        for r in best.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row a range
            starts.append((r.part, before))
            before += r.n
        start = spark.createDataFrame(starts, "part long, before long")
        ranks = best.join(F.broadcast(start), "part").select("row", (F.col("before") + F.col("place") + 1).alias("rank"))  # a row a range
        ranks = written(ranks.where(F.col("rank") <= wanted), "importance-ranks")
    return rows.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
