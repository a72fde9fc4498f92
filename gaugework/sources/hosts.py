"""The host table as JSON, and sources by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugework.operators.filters import validate_hosts

SOURCES: dict[str, Callable[[SparkSession], DataFrame]] = {}


def register_source(name: str, make: Callable[[SparkSession], DataFrame]) -> None:
    """A source of samples by name; read_source calls it."""
    SOURCES[name] = make


def read_source(spark: SparkSession, name: str) -> DataFrame:
    if name not in SOURCES:
        raise ValueError(f"unknown source {name}; there are {', '.join(sorted(SOURCES)) or 'none'}")
    return SOURCES[name](spark)


def write_hosts_json(hosts: DataFrame, path: str) -> None:
    hosts.write.mode("overwrite").json(path)


def read_hosts_json(spark: SparkSession, path: str, schema, max_hosts: int | None = None) -> DataFrame:
    """Valid hosts of an export; upsert_hosts applies them."""
    return validate_hosts(spark.read.schema(schema).json(path), max_hosts)
