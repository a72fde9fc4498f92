"""Series that are too long for one task: their rows in blocks of equal size, each with the last rows of the block before it.

A window over a series is one task's work. So series of more than ``split`` rows are ranked in two levels (rows of an hour within
the hour, after the rows of the hours before it, which are counts), cut into blocks of ``split`` rows by rank, and each block gets
copies of the ``halo`` rows before it. What a window over at most ``halo`` rows back gives in the block is what it would give in the
whole series. Other series keep their one window, and where no series is long, the plan is the plain one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gaugework.model import SERIES

#: Rows of a series that a task takes at once.
SPLIT = 5_000_000


def same(a: str, b: str, keys: tuple[str, ...]) -> Column:
    """Equal keys, nulls too."""
    return functools.reduce(lambda x, y: x & y, [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys], F.lit(True))


def long_series(rows: DataFrame, keys: tuple[str, ...], split: int | None) -> DataFrame | None:
    """The keys of the series of more than ``split`` rows; None if there is none (or no limit)."""
    if split is None:
        return None
    found = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > split).select(*keys)
    held = found.collect()  # fewer than the rows divided by split
    return rows.sparkSession.createDataFrame(held, found.schema) if held else None


def parted(rows: DataFrame, keys: tuple[str, ...], long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the other series, and those of the long ones."""
    on = same("x", "y", keys)
    own, names = rows.alias("x"), F.broadcast(long).alias("y")  # fewer than the rows divided by split
    return own.join(names, on, "left_anti"), own.join(names, on, "left_semi")


def ranked(rows: DataFrame, keys: tuple[str, ...] = SERIES, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """With _rank: how many rows of the series come before. Rows of one hour are one task's work, whatever the series' length."""
    each = rows.withColumn("_hour", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600))
    upto = Window.partitionBy(*keys).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    counts = each.groupBy(*keys, "_hour").agg(F.count("*").alias("_n"))
    counts = counts.select(*keys, "_hour", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))  # a row an hour
    both = each.alias("x").join(counts.alias("y"), same("x", "y", (*keys, "_hour"))).select("x.*", "y._before")
    within = F.row_number().over(Window.partitionBy(*keys, "_hour").orderBy(*order))
    return both.withColumn("_rank", F.col("_before") + within - 1).drop("_hour", "_before")


def in_blocks(rows: DataFrame, split: int, halo: int) -> DataFrame:
    """Ranked rows with _block and _copy: the last ``halo`` rows of a block are copied to the block after it."""
    if halo > split:
        raise ValueError(f"windows of {halo} rows in blocks of {split}")
    block = F.floor(F.col("_rank") / split)
    own = F.struct(block.alias("_block"), F.lit(False).alias("_copy"))
    more = F.struct((block + 1).alias("_block"), F.lit(True).alias("_copy"))
    places = F.when(F.col("_rank") % split >= split - halo, F.array(own, more)).otherwise(F.array(own)) if halo else F.array(own)
    return rows.select("*", F.explode(places).alias("_at")).select("*", "_at._block", "_at._copy").drop("_at")


def over_series(
    rows: DataFrame, keys: tuple[str, ...], halo: int, split: int | None, apply: Callable[[DataFrame, WindowSpec], DataFrame], order: tuple[str, ...] = ("ts", "seq")
) -> DataFrame:
    """apply(rows, w) adds columns by windows over w, an ordered series, that reach at most ``halo`` rows back; it keeps all rows."""
    plain = lambda r: apply(r, Window.partitionBy(*keys).orderBy(*order))
    long = long_series(rows, keys, split)
    if long is None:
        return plain(rows)
    rest, big = parted(rows, keys, long)
    blocks = in_blocks(ranked(big, keys, order), split, halo)
    done = apply(blocks, Window.partitionBy(*keys, "_block").orderBy("_rank")).where(~F.col("_copy")).drop("_rank", "_block", "_copy")
    return plain(rest).unionByName(done)


def with_rank(rows: DataFrame, keys: tuple[str, ...], split: int | None, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """_rank of every row in its series: one window for short series, two levels for long ones."""
    plain = lambda r: r.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    long = long_series(rows, keys, split)
    if long is None:
        return plain(rows)
    rest, big = parted(rows, keys, long)
    return plain(rest).unionByName(ranked(big, keys, order))


def carried(rows: DataFrame, keys: tuple[str, ...], split: int | None, column: str, pick: Callable[[Column], Column], order: tuple[str, ...]) -> DataFrame:
    """With _upto: pick (a running aggregate that skips nulls and in which later rows win, as the last or a growing greatest)
    of the column over the series up to the row. Of long series over the row's block, and over the summaries, one a block, of the blocks before it."""
    running = lambda w: pick(F.col(column)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    long = long_series(rows, keys, split)
    if long is None:
        return rows.withColumn("_upto", running(Window.partitionBy(*keys).orderBy(*order)))
    rest, big = parted(rows, keys, long)
    blocks = in_blocks(ranked(big, keys, order), split, 0)
    own = blocks.withColumn("_own", running(Window.partitionBy(*keys, "_block").orderBy("_rank")))
    sums = own.groupBy(*keys, "_block").agg(F.max_by("_own", "_rank").alias("_own"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_block", pick(F.col("_own")).over(before).alias("_before"))  # a row a block
    both = own.alias("x").join(sums.alias("y"), same("x", "y", (*keys, "_block"))).select("x.*", "y._before")
    both = both.withColumn("_upto", F.coalesce("_own", "_before"))
    return rest.withColumn("_upto", running(Window.partitionBy(*keys).orderBy(*order))).unionByName(both.drop("_own", "_before", "_rank", "_block", "_copy"))

