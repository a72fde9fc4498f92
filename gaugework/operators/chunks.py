"""How well series compress, and their packing into one array a window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from gaugework.model import SERIES
from gaugework.operators.segments import SPLIT, over_series

#: Delta-of-delta ranges in seconds and the bits that one takes; beyond them 68 bits.
DELTA_BITS = ((0, 0, 1), (-63, 64, 9), (-255, 256, 12), (-2047, 2048, 16))


def deltas(samples: DataFrame, keys: tuple[str, ...] = SERIES, split: int | None = SPLIT) -> DataFrame:
    """Each point with the difference of its time step (in whole seconds) to the one before, its bits, and the value before.

    The first point of a series has no step (and 64 bits); the second one's step counts against 0.
    """


    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("step", F.col("t") - F.lag("t").over(w)).withColumn("prev", F.lag("value").over(w))
        return rows.withColumn("dod", F.when(F.col("step").isNotNull(), F.col("step") - F.coalesce(F.lag("step").over(w), F.lit(0))))

    rows = over_series(samples.withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp"))), keys, 2, split, add)
    bits = F.lit(68)
    for lo, hi, n in reversed(DELTA_BITS):
        bits = F.when(F.col("dod").between(lo, hi), n).otherwise(bits)
    return rows.withColumn("time_bits", F.when(F.col("dod").isNull(), 64).otherwise(bits))


def delta_profile(samples: DataFrame, split: int | None = SPLIT) -> DataFrame:
    """Per series: points, points by the bits of their time step, all time bits, share of values equal to the one before."""
    d = deltas(samples, split=split)
    by = [F.count_if(F.col("dod").isNotNull() & (F.col("time_bits") == n)).alias(f"n_{n}") for n in (1, 9, 12, 16, 68)]
    same = F.count_if(F.col("value") == F.col("prev")) / F.count("*")
    return d.groupBy(*SERIES).agg(F.count("*").alias("n"), *by, F.sum("time_bits").alias("time_bits"), same.alias("repeated"))


def _xor_bits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Bits of a value against the one before: 64 without one, 1 if equal, else 14 and the bits between the ends of the difference."""
    import numpy as np

    for value, before in batches:
        x = value.to_numpy("float64").view("uint64") ^ before.to_numpy("float64").view("uint64")
        length = np.bitwise_count(_filled(x)).astype("int64")
        trailing = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype("int64")
        out = np.where(x == 0, 1, 14 + length - trailing)
        yield pd.Series(np.where(before.isna().to_numpy(), 64, out))


def _filled(x):
    """All bits below the highest set one, and it."""
    import numpy as np

    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(k)
    return x


def compressibility(samples: DataFrame, interval: str = "60 minutes", least_points: int = 10, least_ratio: float = 1.2) -> DataFrame:
    """Per series and window: points, estimated bytes, ratio to 16 bytes a point; only windows that are worth it."""
    xor_bits = F.pandas_udf(_xor_bits, "long")
    rows = samples.withColumn("window", F.window("ts", interval)["start"])
    keys = (*SERIES, "window")
    d = deltas(rows, keys).withColumn("value_bits", xor_bits("value", "prev"))
    size = F.ceil(F.sum(F.col("time_bits") + F.col("value_bits")) / 8)
    out = d.groupBy(*keys).agg(F.count("*").alias("n"), size.alias("bytes")).withColumn("ratio", F.col("n") * 16 / F.col("bytes"))
    return out.where((F.col("n") >= least_points) & (F.col("ratio") >= least_ratio))


def pack_chunks(samples: DataFrame, interval: str = "60 minutes") -> DataFrame:
    """One row a series and window with its points in order; the window bounds the array."""
    point = F.struct("ts", "seq", "value")
    rows = samples.groupBy(*SERIES, F.window("ts", interval)["start"].alias("window")).agg(F.array_sort(F.collect_list(point)).alias("points"))
    return rows.withColumn("n", F.size("points"))


def unpack_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select(*SERIES, F.inline("points"))


def compression_stats(profile: DataFrame) -> DataFrame:
    """``profile`` as compressibility() gives it: windows, original and compressed bytes, mean ratio, savings."""
    original = F.sum(F.col("n") * 16)
    return profile.agg(
        F.count("*").alias("windows"), original.alias("original_bytes"), F.sum("bytes").alias("compressed_bytes"), F.avg("ratio").alias("avg_ratio"),
        (1 - F.sum("bytes") / original).alias("savings")
    )
