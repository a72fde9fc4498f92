"""Which keys are in a set: an exact flag, with a Bloom filter of the set before the join.

The distinct members are written once, to the shared folder. The filter is an array of 64-bit words, made by a bitwise aggregate of
their places, and comes back as a scalar subquery. Keys that it refuses are no members for certain, so they are flagged where they
lie; only the others are dealt out and joined. Its size follows the number of members; a set that would need more than ``widest``
bits (8 MB, which the driver holds once) has no filter, and all keys are joined.

Edge cases: a null key is in no set, and null members are ignored (but counted); repeated candidates each keep a row, repeated
members count once; an empty set flags nothing; other columns of the candidates are kept (a column found is replaced), also where ``members`` has the same names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.session import work_dir

WIDEST = 1 << 26


def bits_for(n: int, hashes: int = 7) -> int:
    """The bits at which so many hashes err least: half of them are set. At 7 hashes, that is 0.8 %."""
    return max(64, math.ceil(n * hashes / math.log(2)))


def error_rate(n: int, bits: int, hashes: int) -> float:
    """The share of keys that aren't members which a filter lets pass, by the formula."""
    return (1 - math.exp(-hashes * n / bits)) ** hashes


def places(key: Column, bits: int, hashes: int) -> list[Column]:
    """A key's places among the bits, by two hashes of it."""
    first, step = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) for seed in (1, 2))
    return [F.pmod(first + i * step, F.lit(bits)) for i in range(hashes)]


def filter_words(members: DataFrame, key: str, bits: int, hashes: int = 7) -> DataFrame:
    """One row with the filter's words, a local table of at most bits / 8 bytes: partial masks before the shuffle, at most bits / 64 rows after it."""
    rows = members.where(F.col(key).isNotNull()).select(F.explode(F.array(*places(F.col(key), bits, hashes))).alias("p"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    own = rows.groupBy((F.col("p") / 64).cast("long").alias("id")).agg(F.bit_or(mask).alias("mask"))
    every = members.sparkSession.range(math.ceil(bits / 64)).join(own, "id", "left")
    entry = F.struct("id", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    words = every.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["mask"]).alias("words"))
    return members.sparkSession.createDataFrame(words.toArrow())


def may_hold(words: DataFrame, key: Column, bits: int, hashes: int = 7) -> Column:
    """Whether the filter lets a key pass; never null."""
    held = key.isNotNull()
    for p in places(key, bits, hashes):
        held = held & (F.getbit(F.get(words.scalar(), (p / 64).cast("int")), p % 64) == 1)
    return F.coalesce(held, F.lit(False))


def distinct_members(members: DataFrame, key: str) -> DataFrame:
    spark, path = members.sparkSession, work_dir(members.sparkSession, "members")
    members.select(key).distinct().write.parquet(path)
    return spark.read.schema(members.select(key).schema).parquet(path)


def membership(
    candidates: DataFrame, members: DataFrame, key: str, bits: int | None = None, hashes: int = 7, widest: int = WIDEST
) -> DataFrame:
    """Each candidate with found, exact, and fp_estimate: the share that the filter would err by. ``bits``: by the set's size."""
    own = distinct_members(members, key)
    n = own.count()
    bits = bits or bits_for(n, hashes)
    if bits <= widest:
        held = may_hold(filter_words(own, key, bits, hashes), F.col(key), bits, hashes)
        asked, refused = candidates.where(held), candidates.where(~held).withColumn("found", F.lit(False))
    else:
        asked, refused = candidates, None
    flagged = asked.join(own.withColumn("_in", F.lit(True)), key, "left").withColumn("found", F.coalesce("_in", F.lit(False))).drop("_in")
    if refused is not None:
        flagged = flagged.unionByName(refused)
    return flagged.withColumn("fp_estimate", F.lit(error_rate(n, bits, hashes)))


def filter_report(candidates: DataFrame, members: DataFrame, key: str, bits: int | None = None, hashes: int = 7) -> DataFrame:
    """One row: members, bits, candidates, those that pass the filter, those found, and the measured share of the others that
    passes (null without others) beside the formula's."""
    own = distinct_members(members, key)
    n = own.count()
    bits = bits or bits_for(n, hashes)
    held = may_hold(filter_words(own, key, bits, hashes), F.col(key), bits, hashes)
    rows = membership(candidates.select(key), own, key, bits, hashes, widest=0).withColumn("passes", held)
    wrong = F.count_if(F.col("passes") & ~F.col("found"))
    return rows.agg(
        F.count("*").alias("candidates"), F.count_if("passes").alias("passed"), F.count_if("found").alias("found"),
        (wrong / F.nullif(F.count_if(~F.col("found")), F.lit(0))).alias("fp_measured")
    ).withColumns({"members": F.lit(n), "bits": F.lit(bits), "fp_estimate": F.lit(error_rate(n, bits, hashes))})
