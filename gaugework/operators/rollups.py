"""Stored rollups: statistics of every series and day that merge, so that ranges of days are answered without reading samples.

A rollup row has the count, the extremes, mean and sum of squared deviations, first and last point, and a KLL sketch of the values;
a second table has, by metric and day, an HLL sketch of the hosts. Moments merge exactly (up to rounding), quantiles within the
sketch's rank error (about 0.7 % at k = 400, 99 times of 100), numbers of hosts within about 2 %. refresh() rewrites the days of a
store that have changed since a version; edges of a range that cut a day are rolled up from the samples when asked.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugework.model import SERIES
from gaugework.operators.filters import time_range
from gaugework.sources.store import NO_DATE, Store

K, HLL_K = 400, 12
ROLLUP = (
    "host_id string, metric string, n long, min double, max double, mean double, m2 double, first_ts timestamp_ntz, last_ts timestamp_ntz, "
    "last double, sketch binary"
)
HOSTS = "metric string, hosts binary"


def rollup(samples: DataFrame) -> DataFrame:
    """A row a series and day (date) of the samples with a value."""
    v, n = F.col("value"), F.count("value")
    rows = samples.where("value is not null").groupBy(*SERIES, F.to_date("ts").alias("date"))
    return rows.agg(
        n.alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), (F.var_pop(v) * n).alias("m2"), F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"), F.max_by(v, F.struct("ts", "seq")).alias("last"), F.kll_sketch_agg_double(v, K).alias("sketch")
    )


def host_rollup(samples: DataFrame) -> DataFrame:
    """A row a metric and day, with the hosts seen."""
    return samples.groupBy("metric", F.to_date("ts").alias("date")).agg(F.hll_sketch_agg("host_id", F.lit(HLL_K)).alias("hosts"))


def refresh(store: Store, path: str, since: int = 0) -> int:
    """Brings the rollups under ``path`` from the store's version ``since`` to its latest, whose number it returns: days with
    batches of later versions are computed anew, days that are gone go. A refresh that was cut short is repeated."""
    now, spark = store.manifest(), store.spark
    live = {d for *_, d in now.pairs("rows")}
    before = {d for b in store.manifest(since).batches for d in b["dates"]} if since else set()
    changed = {d for b in now.batches for d in b["dates"] if b["gen"] > since} - {NO_DATE}
    gone = (before - live) - {NO_DATE}
    rows = store._read(now, lambda r: r, lambda d: d in changed)
    for name, made, counted in (("series", rollup(rows), rows.where("value is not null")), ("hosts", host_rollup(rows), rows)):
        held = {str(r[0]) for r in counted.select(F.to_date("ts")).distinct().collect()} if changed & live else set()  # a row a day
        if held:
            out = made.repartition("date").sortWithinPartitions("date", *(c for c in SERIES if c in made.columns))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{path}/{name}")
        for day in (gone | changed) - held:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/date={day}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return now.version


def _days(spark: SparkSession, path: str, name: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return [n[5:] for n in names if n.startswith("date=")]


def read_rollups(spark: SparkSession, path: str, first: datetime.date | None = None, last: datetime.date | None = None, name: str = "series") -> DataFrame:
    """The rollups of the days from first to last (all, if none is named); folders of other days aren't read."""
    schema = f"{ROLLUP if name == 'series' else HOSTS}, date date"
    rows = spark.read.schema(schema).parquet(f"{path}/{name}") if _days(spark, path, name) else spark.createDataFrame([], schema)
    rows = rows if first is None else rows.where(F.col("date") >= F.lit(first))
    return rows if last is None else rows.where(F.col("date") <= F.lit(last))


def merged_stats(rollups: DataFrame, keys: tuple[str, ...] = SERIES, points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """count, sum, avg, min, max, stddev, last and pNN of the keys over all their rollup rows, which are a row a day."""
    w = Window.partitionBy(*keys)
    rows = rollups.withColumn("all_mean", F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w))
    apart = F.col("mean") - F.col("all_mean")
    a = rows.groupBy(*keys).agg(
        F.sum("n").alias("count"), F.sum(F.col("n") * F.col("mean")).alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"), F.max_by("last", "last_ts").alias("last"), F.kll_merge_agg_double("sketch").alias("sketch")
    )
    shares = F.kll_sketch_get_quantile_double("sketch", F.array(*(F.lit(p / 100) for p in points)))
    made = a.withColumn("p", shares)
    return made.select(
        *keys, "count", "sum", (F.col("sum") / F.col("count")).alias("avg"), "min", "max", F.sqrt(F.col("m2") / F.col("count")).alias("stddev"), "last",
        *(F.col("p")[i].alias(f"p{p}") for i, p in enumerate(points))
    )


def range_rollups(store: Store, path: str, start: datetime.datetime, end: datetime.datetime) -> DataFrame:
    """Rollup rows for the times from start to end, both included: stored ones of whole days, and of the days that the ends
    cut, rollups of their samples."""
    day = datetime.timedelta(days=1)
    midnight = lambda t: datetime.datetime.combine(t.date(), datetime.time())
    first = midnight(start) if start == midnight(start) else midnight(start) + day
    last = midnight(end) - day if end < midnight(end) + day - datetime.timedelta(microseconds=1) else midnight(end)
    if first > last:
        return rollup(store.read(start=start, end=end))
    whole = read_rollups(store.spark, path, first.date(), last.date())
    edges = []
    if start < first:
        edges.append((start, first - datetime.timedelta(microseconds=1)))
    if end >= last + day:
        edges.append((last + day, end))
    for a, z in edges:
        whole = whole.unionByName(rollup(time_range(store.read(start=a, end=z), a, z)).select(*whole.columns))
    return whole


def host_counts(rollups: DataFrame) -> DataFrame:
    """metric, series: about how many hosts its days have seen."""
    return rollups.groupBy("metric").agg(F.hll_sketch_estimate(F.hll_union_agg("hosts")).alias("series"))
