"""A store of samples that merges on read: immutable batches by date, tombstones, and a manifest that is swapped in one step.

``rows/batch=<token>/date=<day>`` has a batch's points, ``tombs/batch=<token>/date=<day>`` scrapes (host_id, ts) that were
deleted. ``manifests/<version>.json`` names the (batch, day) pairs that count and each batch's generation; a reader takes one
version and sees nothing else, whatever is written or removed meanwhile. A writer writes its own rows alone and then puts the next
version under a name that must be new; who comes second takes the version then current and tries again. Of a point the row with
the greatest seq counts, of equal ones that of the later generation; a tombstone takes away rows of earlier generations. A store
whose first writer asked for the key ARRIVAL keeps all rows of a point that have different seqs. Days that
have several batches or tombstones are merged in a shuffle by point, all others are read as they lie. compact() turns days into
one batch; vacuum() removes folders that no kept version names.
"""

from __future__ import annotations

import datetime
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from gaugework.model import SERIES
from gaugework.operators.filters import host_filter, time_range

SCHEMA = "host_id string, metric string, ts timestamp_ntz, value double, unit string, seq long"
POINT = (*SERIES, "ts")
ARRIVAL = (*POINT, "seq")  # every sample that arrived, also several of one point; of the same one the later generation counts
NAMES = tuple(c.split()[0] for c in SCHEMA.split(", "))
NO_DATE = "__HIVE_DEFAULT_PARTITION__"  # the folder of rows without a time


@dataclass
class Manifest:
    version: int = 0
    batches: list[dict] = field(default_factory=list)  # token, gen, kind (rows or tombs), dates
    done: dict[str, int] = field(default_factory=dict)  # writer -> its last transaction
    key: list[str] = field(default_factory=lambda: list(POINT))  # columns of which equal rows are one

    def pairs(self, kind: str) -> list[tuple[str, int, str]]:
        """(token, gen, day) that count."""
        return [(b["token"], b["gen"], d) for b in self.batches if b["kind"] == kind for d in b["dates"]]

    def without(self, gone: set[tuple[str, str]]) -> list[dict]:
        """The batches without the (token, day) pairs."""
        left = [b | {"dates": [d for d in b["dates"] if (b["token"], d) not in gone]} for b in self.batches]
        return [b for b in left if b["dates"]]


class Store:
    """Samples under a folder of any file system that Spark writes to. ``key``: POINT or ARRIVAL, for a new store (POINT, if none
    is named); a store keeps its key, and a writer that names another one fails."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, key: tuple[str, ...] | None = None):
        if key not in (None, POINT, ARRIVAL):
            raise ValueError(f"a store's key is {POINT} or {ARRIVAL}, not {key}")
        self.spark, self.path, self.jvm, self.key = spark, path.rstrip("/"), spark._jvm, key
        # parts of a day; by default they grow with the tasks that a shuffle has
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)

    def _at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        fs, folder = self._fs(), self._at(*parts)
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The named version, or the latest; an empty one if nothing has been stored."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return Manifest()
        stream = self._fs().open(self._at("manifests", f"{version:020d}.json"))
        try:
            return Manifest(**json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _put(self, m: Manifest) -> bool:
        """Whether the version was new and is now there, whole."""
        fs, temp = self._fs(), self._at("manifests", f".{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(m.__dict__).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no overwriting
        try:
            context.rename(temp, self._at("manifests", f"{m.version:020d}.json"), none)
            return True
        except Exception:
            fs.delete(temp, False)
            if m.version in self.versions():
                return False
            raise

    def _key_of(self, m: Manifest, expected: tuple[str, ...] | None) -> tuple[str, ...]:
        """The key of a version, or of the next one if nothing has been stored; it must be the expected one, if there is one."""
        key = tuple(m.key) if m.version else expected or POINT
        if expected not in (None, key):
            raise ValueError(f"{self.path}: rows are one by {key}, not by {expected}")
        return key

    def commit(
        self, change: Callable[[Manifest], list[dict] | None], writer: str | None = None, transaction: int = 0, tries: int = 100, key: tuple[str, ...] | None = None
    ) -> bool:
        """Puts the next version with the batches that ``change`` makes of the latest one's; None leaves all as it is. A
        writer's transaction that is already in, or an earlier one, isn't put again. ``key`` is that of the rows written."""
        for _ in range(tries):
            now = self.manifest()
            own = self._key_of(now, key or self.key)
            if writer is not None and now.done.get(writer, -1) >= transaction:
                return False
            batches = change(now)
            if batches is None:
                return False
            done = now.done | ({writer: transaction} if writer is not None else {})
            if self._put(Manifest(now.version + 1, batches, done, list(own))):
                return True
        raise RuntimeError(f"{self.path}: other writers were first {tries} times")

    def _written(self, rows: DataFrame, kind: str) -> tuple[str, list[str]]:
        """Writes a batch that no version names yet; its token and days."""
        token = uuid.uuid4().hex
        rows.write.partitionBy("date").parquet(f"{self.path}/{kind}/batch={token}")
        return token, sorted(n[5:] for n in self._names(kind, f"batch={token}") if n.startswith("date="))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """By day and a bucket of (series, hour), so that neither a day nor a series is one task's work."""
        hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
        return rows.withColumns({"date": F.to_date("ts"), "bucket": F.pmod(F.xxhash64(*SERIES, hour), F.lit(self.buckets))}).repartition("date", "bucket")

    def upsert(self, samples: DataFrame, writer: str | None = None, transaction: int = 0) -> bool:
        """Adds the samples; of a point the row with the greatest seq counts, or, by ARRIVAL, each seq's. False if the
        transaction was already in."""
        now = self.manifest()
        if writer is not None and now.done.get(writer, -1) >= transaction:
            return False
        key = self._key_of(now, self.key)
        rows = self._dealt(samples.select(*NAMES)).groupBy("date", "bucket", *key)
        rows = _last(rows, key, "seq", "value", "unit").select(*NAMES, "date")
        token, dates = self._written(rows.sortWithinPartitions("date", *POINT), "rows")
        add = lambda m: [*m.batches, {"token": token, "gen": m.version + 1, "kind": "rows", "dates": dates}] if dates or writer is not None else None
        return self.commit(lambda m: None if (x := add(m)) is None else [b for b in x if b["dates"]], writer, transaction, key=key)

    def delete(self, scrapes: DataFrame) -> bool:
        """Takes away all points of the scrapes (host_id, ts) that are stored by now."""
        rows = scrapes.select("host_id", "ts").where("host_id is not null and ts is not null").distinct().withColumn("date", F.to_date("ts"))
        token, dates = self._written(rows.repartition("date", F.pmod(F.xxhash64("host_id"), F.lit(self.buckets))).sortWithinPartitions("date", "host_id", "ts"), "tombs")
        return self.commit(lambda m: [*m.batches, {"token": token, "gen": m.version + 1, "kind": "tombs", "dates": dates}] if dates else None)

    def drop_dates(self, before: datetime.date) -> bool:
        """Retention: days before the named one no longer count; a change of the manifest alone."""
        gone = lambda m: {(b["token"], d) for b in m.batches for d in b["dates"] if d != NO_DATE and d < before.isoformat()}
        return self.commit(lambda m: m.without(gone(m)) if gone(m) else None)

    def read(self, hosts: tuple[str, ...] = (), start=None, end=None, version: int | None = None) -> DataFrame:
        """Samples of the hosts (all, if none is named) from start to end. Days are picked by the manifest; hosts and times
        prune Parquet row groups."""
        picked = lambda rows: host_filter(time_range(rows, start, end), *hosts)
        return self._read(self.manifest(version), picked, lambda d: _meets(d, start, end))

    def _read(self, m: Manifest, picked: Callable[[DataFrame], DataFrame], wanted: Callable[[str], bool]) -> DataFrame:
        rows, tombs = ([p for p in m.pairs(k) if wanted(p[2])] for k in ("rows", "tombs"))
        batches: dict[str, list[int]] = {}
        for _, gen, day in rows:
            batches.setdefault(day, []).append(gen)
        tombs = [p for p in tombs if p[2] in batches and min(batches[p[2]]) < p[1]]
        mixed = {d for d, gens in batches.items() if len(gens) > 1} | {d for *_, d in tombs}
        clean, merge = [p for p in rows if p[2] not in mixed], [p for p in rows if p[2] in mixed]
        parts = []
        if clean or not merge:
            parts.append(picked(self._scan(clean, "rows", SCHEMA)).select(*NAMES))
        if merge:
            old = picked(self._scan(merge, "rows", SCHEMA))
            if tombs:
                gone = picked(self._scan(tombs, "tombs", "host_id string, ts timestamp_ntz")).groupBy("host_id", "ts").agg(F.max("gen").alias("gone"))
                old = old.join(gone, ["host_id", "ts"], "left").where(F.col("gone").isNull() | (F.col("gone") < F.col("gen")))
            parts.append(_last(old.groupBy(*m.key), tuple(m.key), "seq", "gen", "value", "unit").select(*NAMES))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _scan(self, pairs: list[tuple[str, int, str]], kind: str, schema: str) -> DataFrame:
        """The rows of the folders, with gen."""
        if not pairs:
            return self.spark.createDataFrame([], f"{schema}, gen long")
        gens = {token: gen for token, gen, _ in pairs}
        rows = self.spark.read.schema(f"{schema}, batch string, date date").option("basePath", f"{self.path}/{kind}")
        rows = rows.parquet(*(f"{self.path}/{kind}/batch={t}/date={d}" for t, _, d in pairs))
        gen = F.element_at(F.create_map(*(F.lit(x) for pair in gens.items() for x in pair)), F.col("batch"))  # a live batch each
        return rows.withColumn("gen", gen.cast("long")).drop("batch", "date")

    def compact(self, least: int = 2) -> int:
        """Makes one batch of the days that have at least ``least`` batches and tombstones; how many these were.

        The new batch has the latest generation of those that it replaces, so what other writers add meanwhile counts after
        it. A day that others have changed otherwise meanwhile stays as they left it.
        """
        m = self.manifest()
        of: dict[str, list[tuple[str, int]]] = {}
        for kind in ("rows", "tombs"):
            for token, gen, day in m.pairs(kind):
                of.setdefault(day, []).append((token, gen))
        days = {d: own for d, own in of.items() if len(own) >= least}
        if not days:
            return 0
        gen = max(g for own in days.values() for _, g in own)
        rows = self._dealt(self._read(m, lambda r: r, lambda d: d in days)).drop("bucket")
        token, dates = self._written(rows.sortWithinPartitions("date", *POINT), "rows")

        def change(now: Manifest) -> list[dict] | None:
            live = {(b["token"], d) for b in now.batches for d in b["dates"]}
            still = {d for d, own in days.items() if all((t, d) in live for t, _ in own)}
            left = now.without({(t, d) for d in still for t, _ in days[d]})
            made = [d for d in dates if d in still]
            return [*left, {"token": token, "gen": gen, "kind": "rows", "dates": made}] if made else left if still else None

        return len(days) if self.commit(change) else 0

    def vacuum(self, keep: int = 10, hours: float = 24.0) -> int:
        """Removes versions but the last ``keep``, and folders that none of those names and that are older than ``hours``, so
        that what is being written stays. How many folders went."""
        fs, versions = self._fs(), self.versions()
        for v in versions[:-keep]:
            fs.delete(self._at("manifests", f"{v:020d}.json"), False)
        named = {b["token"] for v in versions[-keep:] for b in self.manifest(v).batches}
        gone = 0
        for kind in ("rows", "tombs"):
            for name in self._names(kind):
                old = time.time() * 1000 - fs.getFileStatus(self._at(kind, name)).getModificationTime() >= hours * 3_600_000
                if name.removeprefix("batch=") not in named and old:
                    gone += fs.delete(self._at(kind, name), True)
        return gone


def _last(groups: GroupedData, key: tuple[str, ...], *columns: str) -> DataFrame:
    """Of each group the row with the greatest of the columns that aren't in its key."""
    return groups.agg(F.max(F.struct(*(c for c in columns if c not in key))).alias("x")).select("*", "x.*").drop("x")


def _meets(day: str, start, end) -> bool:
    """Whether a day's rows can lie between the times."""
    if day == NO_DATE:
        return start is None and end is None
    text = lambda t: t if isinstance(t, str) else t.isoformat()
    return (start is None or day >= text(start)[:10]) and (end is None or day <= text(end)[:10])
