"""Small helpers that the operators share: shared folders, written tables, text columns, token ids."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.session import remove_dir, work_dir

#: A word is a longest run of characters that are no space, tab, line feed, vertical tab, form feed or return.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders that written() has made and nobody has removed; the last one is the newest.
MADE: list[str] = []


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet to the shared folder and reads them again."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, tag)
    df.write.parquet(path)
    MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what written() makes inside, but for the table made last: the result, which needs the others no more.

    ``with scratch(spark): ...; result = written(...)``
    """
    first = len(MADE)
    yield
    gone, MADE[first:] = MADE[first:-1], MADE[-1:] if len(MADE) > first else []
    for path in gone:
        remove_dir(spark, path)


def small_batches(spark: SparkSession, rows: int = 256, size: int = 16 << 20) -> None:
    """Keeps Arrow batches of long texts small, in rows and in bytes, for this session, unless the user set another size."""
    for key, default, least in (("maxRecordsPerBatch", "10000", rows), ("maxBytesPerBatch", str((1 << 31) - 1), size)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, default) in (default, str((1 << 63) - 1), "-1"):
            spark.conf.set(key, str(least))


def give_back() -> None:
    """At the end of a task: returns what the allocators of a worker, which later tasks use again, still hold."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and the text, a null text as an empty one; all other columns go."""
    return docs.select(*columns, F.coalesce(docs["text"], F.lit("")).alias("text"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grouped(batches: Iterator, size: int = 1 << 22) -> Iterator[tuple[list, list[str]]]:
    """Columns doc_id and text of Arrow batches, in groups of about ``size`` characters."""
    ids, own, n = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            own.append(t)
            n += len(t)
            if n >= size:
                yield ids, own
                ids, own, n = [], [], 0
    if ids:
        yield ids, own
