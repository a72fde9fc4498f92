"""Stored samples: read with pruning, upserted, deleted from, and kept for a time. The store is in store.py."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.sources.store import ARRIVAL, POINT, SCHEMA, Store

__all__ = ["ARRIVAL", "POINT", "SCHEMA", "apply_retention", "delete_points", "drop_old", "expire_keys", "merged", "read_samples", "without_points", "write_samples"]


def read_samples(spark: SparkSession, path: str, hosts: tuple[str, ...] = (), start=None, end=None) -> DataFrame:
    """Samples of the hosts (all, if none is named) from start to end, as the store's latest version has them."""
    return Store(spark, path).read(hosts, start, end)


def merged(samples: DataFrame) -> DataFrame:
    """One row for each point: the one that arrived last. Other metrics of the same scrape are points of their own."""
    last = samples.groupBy(*POINT).agg(F.max(F.struct("seq", "value", "unit")).alias("x"))
    return last.select(*POINT, "x.value", "x.unit", "x.seq")


def write_samples(samples: DataFrame, path: str, writer: str | None = None, transaction: int = 0, key: tuple[str, ...] | None = None) -> bool:
    """Idempotent upsert: adds a batch with the new rows alone. A writer's transaction counts once. A store made with the key
    ARRIVAL keeps several samples of a point."""
    return Store(samples.sparkSession, path, key=key).upsert(samples, writer, transaction)


def without_points(samples: DataFrame, deleted: DataFrame) -> DataFrame:
    """Samples but for the scrapes (host_id, ts) of the delete list."""
    return samples.join(deleted.select("host_id", "ts").distinct(), ["host_id", "ts"], "left_anti")


def delete_points(spark: SparkSession, path: str, deleted: DataFrame) -> bool:
    """Takes the scrapes (host_id, ts) of the list out of the store, with all their metrics."""
    return Store(spark, path).delete(deleted)


def apply_retention(samples: DataFrame, as_of, days: int = 7) -> DataFrame:
    return samples.where(F.col("ts") >= F.lit(as_of) - F.make_dt_interval(days=F.lit(days)))


def drop_old(spark: SparkSession, path: str, as_of: datetime.date, days: int = 7) -> bool:
    """Retention of whole days in the store, without reading a row."""
    return Store(spark, path).drop_dates(as_of - datetime.timedelta(days=days))


def expire_keys(rows: DataFrame, as_of) -> DataFrame:
    """``rows`` with expires_at: those that haven't expired; null never does."""
    return rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of)))
