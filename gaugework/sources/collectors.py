"""Collectors: sources of samples that users write, with the filters on hosts, metrics and times handed down to them.

A Collector names the parts of its source that can hold what is wanted, and reads one part; Spark plans a task a part. What it
reads is cut to the filters here, so a collector may give more than was asked for, never less.
"""

from __future__ import annotations

import dataclasses
import datetime
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
)

from gaugework.sources.store import SCHEMA

ROWS = pa.schema([
    ("host_id", pa.string()), ("metric", pa.string()), ("ts", pa.timestamp("us")), ("value", pa.float64()), ("unit", pa.string()), ("seq", pa.int64())
])
PUSH = "spark.sql.python.filterPushdown.enabled"


@dataclass(frozen=True)
class Wanted:
    """What is asked for: hosts and metrics (None: all), and times from start to end, both included (None: open)."""

    hosts: frozenset[str] | None = None
    metrics: frozenset[str] | None = None
    start: datetime.datetime | None = None
    end: datetime.datetime | None = None

    def narrowed(self, f: Filter) -> Wanted | None:
        """With the filter too; None if it isn't of a kind that collectors know."""
        column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
        field = {"host_id": "hosts", "metric": "metrics"}.get(column)
        if field and isinstance(f, (EqualTo, In)):
            names = frozenset([f.value] if isinstance(f, EqualTo) else f.value) - {None}
            had = getattr(self, field)
            return dataclasses.replace(self, **{field: names if had is None else had & names})
        if column == "ts" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            step = datetime.timedelta(microseconds=1)  # times are whole microseconds
            low = f.value + step if isinstance(f, GreaterThan) else f.value if isinstance(f, (EqualTo, GreaterThanOrEqual)) else None
            high = f.value - step if isinstance(f, LessThan) else f.value if isinstance(f, (EqualTo, LessThanOrEqual)) else None
            pick = lambda had, new, of: new if had is None else had if new is None else of(had, new)
            return dataclasses.replace(self, start=pick(self.start, low, max), end=pick(self.end, high, min))
        return None

    def may_hold(self, first: datetime.datetime | None, last: datetime.datetime | None) -> bool:
        """Whether rows of times from first to last (None: unknown) can be wanted."""
        return not (self.end is not None and first is not None and first > self.end or self.start is not None and last is not None and last < self.start)

    def cut(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        for names, column in ((self.hosts, "host_id"), (self.metrics, "metric")):
            if names is not None:
                rows = rows.filter(pc.is_in(rows.column(column), pa.array(sorted(names), pa.string())))
        kind = pa.timestamp("us")
        if self.start is not None:
            rows = rows.filter(pc.greater_equal(rows.column("ts"), pa.scalar(self.start, kind)))
        if self.end is not None:
            rows = rows.filter(pc.less_equal(rows.column("ts"), pa.scalar(self.end, kind)))
        return rows


class Collector(ABC):
    """A source of samples. It is made anew on the driver and in each task, from the options of the reader."""

    name: str

    def __init__(self, options: dict[str, str]):
        self.options = options

    @abstractmethod
    def parts(self, wanted: Wanted) -> Sequence[Any]:
        """Small values that can be pickled, one for each part that may hold wanted samples."""

    @abstractmethod
    def read(self, part: Any, wanted: Wanted) -> Iterator[pa.RecordBatch]:
        """Batches of ROWS' columns, in any order of columns; at least the wanted ones of the part."""


@dataclass
class Part(InputPartition):
    own: Any


class CollectorReader(DataSourceReader):
    def __init__(self, collector: type[Collector], options: dict[str, str]):
        self.collector, self.options, self.wanted = collector, options, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        left = []
        for f in filters:
            new = self.wanted.narrowed(f)
            if new is not None:
                self.wanted = new
            else:
                left.append(f)
        return [f for f in left if not (isinstance(f, IsNotNull) and self._sure(".".join(f.attribute)))]

    def _sure(self, column: str) -> bool:
        """Whether what is wanted leaves no null in the column."""
        w = self.wanted
        return {"host_id": w.hosts is not None, "metric": w.metrics is not None, "ts": (w.start, w.end) != (None, None)}.get(column, False)

    def partitions(self) -> list[Part]:
        w = self.wanted
        none = w.hosts == frozenset() or w.metrics == frozenset() or (w.start is not None and w.end is not None and w.start > w.end)
        return [Part(p) for p in ([] if none else self.collector(self.options).parts(w))] or [Part(None)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.own is not None:
            for rows in self.collector(self.options).read(partition.own, self.wanted):
                rows = self.wanted.cut(rows.select(ROWS.names).cast(ROWS))
                if rows.num_rows:
                    yield rows


def register_collector(spark: SparkSession, collector: type[Collector]) -> None:
    """Makes it a format of spark.read by its name, with filters handed down."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return collector.name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> CollectorReader:
            return CollectorReader(collector, dict(self.options))

    spark.conf.set(PUSH, "true")
    spark.dataSource.register(Source)


def collected(spark: SparkSession, name: str, **options: str) -> DataFrame:
    """Samples of a registered collector; where() on host_id, metric and ts reaches it."""
    return spark.read.format(name).options(**options).load()
