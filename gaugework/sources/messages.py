"""Topics of messages in a shared folder, with partitions and offsets, for where no broker is at hand: a Spark data source of
batches and streams, and a writer whose tasks hand their segments over in commit messages.

``<path>/<topic>/segments`` has Arrow files of messages; ``commits/<n>.json`` names the segments that a write added, each with
its partition, first offset and rows, and has every partition's end and the last transaction of every named writer. A write counts
once its commit is there, under a number that must be new; who comes second takes the next number and the offsets after it. A
writer's transaction counts once, so a stream that publishes from foreachBatch does so exactly once. Rows are those of the Kafka
source (topic, partition, offset, timestamp, key, value), so decode_messages() takes both. The folder must be on a file system with
a rename that doesn't replace a file (local or HDFS).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
)

from gaugework.session import qualified

FORMAT = "gaugework_messages"
SCHEMA = "topic string, partition int, offset long, timestamp timestamp, key binary, value binary"
_STORED = pa.schema([("timestamp", pa.timestamp("us", tz="UTC")), ("key", pa.binary()), ("value", pa.binary())])
_ROWS = pa.schema([("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), *_STORED])
SEGMENT_BYTES = 32 << 20  # a segment ends at the first batch past it
TASK_BYTES = 64 << 20  # what one task reads, in segments' bytes


class Topic:
    """Commits and segments of one topic; ``path`` is a URI."""

    def __init__(self, path: str, topic: str):
        self.fs, root = pafs.FileSystem.from_uri(path)
        self.topic, self.root = topic, f"{root.rstrip('/')}/{topic}"

    def _numbers(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        return [int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit()]

    def commit(self, n: int) -> dict:
        with self.fs.open_input_stream(f"{self.root}/commits/{n:020d}.json") as f:
            return json.loads(f.read())

    def last(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            raise ValueError(f"no topic {self.topic} at {self.root}; create_topic makes one")
        return self.commit(max(numbers))

    def create(self, partitions: int) -> bool:
        """Whether it is new; one that is there stays as it is."""
        for part in ("commits", "segments"):
            self.fs.create_dir(f"{self.root}/{part}", recursive=True)
        return not self._numbers() and self._put({"n": 0, "ends": [0] * partitions, "done": {}, "segments": [], "token": ""})

    def _put(self, commit: dict) -> bool:
        """Whether the number was new and the commit is now there, whole."""
        temp, name = f"{self.root}/commits/.{uuid.uuid4().hex}", f"{self.root}/commits/{commit['n']:020d}.json"
        with self.fs.open_output_stream(temp) as f:
            f.write(json.dumps(commit).encode())
        try:
            if self.fs.type_name == "local":
                os.link(temp, name)
            elif self.fs.type_name == "hdfs":
                self.fs.move(temp, name)
                return True
            else:
                raise NotImplementedError(f"{self.fs.type_name}: its rename may replace a file")
        except OSError:
            self.fs.delete_file(temp)
            if commit["n"] in self._numbers():
                return False
            raise
        self.fs.delete_file(temp)
        return True

    def append(self, segments: list[tuple[int, str, int, int]], token: str, writer: str | None, transaction: int) -> bool:
        """Gives the segments (partition, name, rows, bytes) their offsets; False if the writer's transaction was already in."""
        for _ in range(100):
            now = self.last()
            if writer is not None and now["done"].get(writer, -1) >= transaction:
                return False
            ends, placed = list(now["ends"]), []
            for p, name, rows, size in segments:
                placed.append((p, name, ends[p], rows, size))
                ends[p] += rows
            done = now["done"] | ({writer: transaction} if writer is not None else {})
            if self._put({"n": now["n"] + 1, "ends": ends, "done": done, "segments": placed, "token": token}):
                return True
        raise RuntimeError(f"{self.root}: other writers were first a hundred times")

    def offsets(self, wanted: str) -> list[int]:
        """Of ``earliest``, ``latest`` or JSON by partition (one that isn't named starts at 0), an offset for each partition."""
        ends = self.last()["ends"]
        if wanted == "latest":
            return ends
        given = {} if wanted == "earliest" else {int(p): int(x) for p, x in json.loads(wanted).items()}
        bad = {p: x for p, x in given.items() if not (0 <= p < len(ends) and 0 <= x <= ends[p])}
        if bad:
            raise ValueError(f"topic {self.topic} has no offsets {bad}; its partitions end at {ends}")
        return [given.get(p, 0) for p in range(len(ends))]

    def slices(self, start: list[int], end: list[int]) -> Iterator[tuple[int, str, int, int, int, int]]:
        """(partition, segment, its first offset, from, to, bytes) of what lies between the offsets. The first commit that goes
        past the start is found by halving, as ends only grow."""
        low, high = 0, self.last()["n"]
        while low < high:
            mid = (low + high) // 2
            if any(e > s for e, s in zip(self.commit(mid)["ends"], start)):
                high = mid
            else:
                low = mid + 1
        last = self.last()["n"]
        while low <= last:
            c = self.commit(low)
            for p, name, base, rows, size in c["segments"]:
                a, z = max(base, start[p]), min(base + rows, end[p])
                if a < z:
                    yield p, name, base, a, z, size * (z - a) // rows
            if all(e >= z for e, z in zip(c["ends"], end)):
                return
            low += 1


@dataclass
class Slices(InputPartition):
    parts: list[tuple[int, str, int, int, int, int]]


def _tasks(topic: Topic, start: list[int], end: list[int]) -> list[Slices]:
    """Segments by partition and offset, as many to a task as TASK_BYTES take."""
    tasks: list[Slices] = []
    room = 0
    for part in sorted(topic.slices(start, end), key=lambda s: (s[0], s[2])):
        if not tasks or part[5] > room:
            tasks.append(Slices([]))
            room = TASK_BYTES
        tasks[-1].parts.append(part)
        room -= part[5]
    return tasks or [Slices([])]


def _read(topic: Topic, task: Slices) -> Iterator[pa.RecordBatch]:
    for p, name, base, first, last, _ in task.parts:
        with topic.fs.open_input_file(f"{topic.root}/segments/{name}") as f, pa.ipc.open_file(f) as file:
            at = base
            for k in range(file.num_record_batches):
                rows = file.get_batch(k)
                a, z = max(first, at), min(last, at + rows.num_rows)
                if a < z:
                    own = rows.slice(a - at, z - a)
                    n = own.num_rows
                    made = [pa.repeat(topic.topic, n), pa.repeat(pa.scalar(p, pa.int32()), n), pa.array(range(a, z), pa.int64()), *own.columns]
                    yield pa.RecordBatch.from_arrays(made, schema=_ROWS)
                at += rows.num_rows
                if at >= last:
                    break


class Batches(DataSourceReader):
    def __init__(self, options):
        self.path, self.name = options["path"], options["topic"]
        self.start, self.end = options.get("startingOffsets", "earliest"), options.get("endingOffsets", "latest")

    def partitions(self) -> list[Slices]:
        topic = Topic(self.path, self.name)
        return _tasks(topic, topic.offsets(self.start), topic.offsets(self.end))

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        return _read(Topic(self.path, self.name), partition)


class Stream(DataSourceStreamReader):
    """Offsets are {partition: next offset}; the query's checkpoint keeps them."""

    def __init__(self, options):
        self.path, self.name, self.start = options["path"], options["topic"], options.get("startingOffsets", "latest")

    def _known(self, offsets: list[int]) -> dict[str, int]:
        return {str(p): x for p, x in enumerate(offsets)}

    def initialOffset(self) -> dict[str, int]:
        return self._known(Topic(self.path, self.name).offsets(self.start))

    def latestOffset(self) -> dict[str, int]:
        return self._known(Topic(self.path, self.name).last()["ends"])

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Slices]:
        of = lambda o: [o[str(p)] for p in range(len(o))]
        return _tasks(Topic(self.path, self.name), of(start), of(end))

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        return _read(Topic(self.path, self.name), partition)


@dataclass
class Written(WriterCommitMessage):
    segments: list[tuple[int, str, int, int]]


class Segments(DataSourceArrowWriter):
    """Each task attempt writes segments under names of its own; only those in the commit messages of tasks that succeeded count."""

    def __init__(self, options):
        self.path, self.name = options["path"], options["topic"]
        self.by, self.transaction = options.get("writer"), int(options.get("transaction", "0"))
        self.token, self.seen = uuid.uuid4().hex, Topic(self.path, self.name).last()["n"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        topic, made, still = Topic(self.path, self.name), [], {}

        def end(p: int) -> None:
            name, out, file, rows = still.pop(p)
            file.close()
            size = out.tell()
            out.close()
            made.append((p, name, rows, size))

        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in iterator:
            own = batch.select(["timestamp", "key", "value"]).cast(_STORED)
            of = batch.column("partition")
            for p in pc.unique(of).to_pylist():
                rows = own.filter(pc.equal(of, p))
                if p not in still:
                    name = f"{self.token}-{uuid.uuid4().hex}.arrow"
                    out = topic.fs.open_output_stream(f"{topic.root}/segments/{name}")
                    still[p] = (name, out, pa.ipc.new_file(out, _STORED, options=options), 0)
                name, out, file, n = still[p]
                file.write_batch(rows)
                still[p] = (name, out, file, n + rows.num_rows)
                if out.tell() >= SEGMENT_BYTES:
                    end(p)
        for p in list(still):
            end(p)
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        segments = [s for m in messages if m is not None for s in m.segments]
        topic = Topic(self.path, self.name)
        if (segments or self.by is not None) and not topic.append(segments, self.token, self.by, self.transaction):
            self._remove(topic, messages)

    def abort(self, messages: list[Written | None]) -> None:
        topic = Topic(self.path, self.name)
        if all(topic.commit(n)["token"] != self.token for n in range(self.seen + 1, topic.last()["n"] + 1)):
            self._remove(topic, messages)

    def _remove(self, topic: Topic, messages: list[Written | None]) -> None:
        for m in messages:
            for _, name, *_ in m.segments if m is not None else ():
                topic.fs.delete_file(f"{topic.root}/segments/{name}")


class Messages(DataSource):
    """Options: path (a URI), topic; startingOffsets and endingOffsets to read; writer and transaction to write."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Batches:
        return Batches(self.options)

    def streamReader(self, schema) -> Stream:
        return Stream(self.options)

    def writer(self, schema, overwrite: bool) -> Segments:
        if overwrite:
            raise ValueError("topics are appended to")
        return Segments(self.options)


def create_topic(spark: SparkSession, path: str, topic: str, partitions: int = 8) -> bool:
    """False if it was there; it then keeps its partitions."""
    return Topic(qualified(spark, path), topic).create(partitions)


def _options(spark: SparkSession, path: str, topic: str, **more: str) -> dict[str, str]:
    spark.dataSource.register(Messages)
    return {"path": qualified(spark, path), "topic": topic} | more


def publish(messages: DataFrame, path: str, topic: str, writer: str | None = None, transaction: int = 0) -> None:
    """Appends a batch of key and value (text or bytes; timestamp: now, if there is none). A key has one partition; messages
    without a key are spread by their value. A writer's transaction counts once.

    Rows are dealt by partition, and AQE splits partitions that are large, so a hot key isn't one task's work: order within
    a batch isn't kept, that of batches is.
    """
    spark = messages.sparkSession
    options = _options(spark, path, topic)
    n = len(Topic(options["path"], topic).last()["ends"])
    key, value = F.col("key").cast("binary"), F.col("value").cast("binary")
    at = F.col("timestamp").cast("timestamp") if "timestamp" in messages.columns else F.current_timestamp()
    of = F.pmod(F.coalesce(F.crc32(key), F.crc32(value), F.lit(0)), F.lit(n)).cast("int")
    rows = messages.select(of.alias("partition"), at.alias("timestamp"), key.alias("key"), value.alias("value")).hint("rebalance", "partition")
    named = {"writer": writer, "transaction": str(transaction)} if writer is not None else {}
    rows.write.format(FORMAT).options(**options, **named).mode("append").save()


def publish_sink(path: str, topic: str, name: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: publishes each batch of the stream of that name exactly once."""
    return lambda batch, batch_id: publish(batch, path, topic, name, batch_id)


def read_messages(spark: SparkSession, path: str, topic: str, starting: str = "earliest", ending: str = "latest") -> DataFrame:
    """Messages from the starting to before the ending offsets: earliest, latest, or JSON by partition."""
    return spark.read.format(FORMAT).options(**_options(spark, path, topic, startingOffsets=starting, endingOffsets=ending)).load()


def stream_messages(spark: SparkSession, path: str, topic: str, starting: str = "latest") -> DataFrame:
    """A stream of messages; offsets are kept by the query's checkpoint, ``starting`` counts for its first start alone."""
    return spark.readStream.format(FORMAT).options(**_options(spark, path, topic, startingOffsets=starting)).load()
