"""Rollups against the statistics of the samples that they stand for."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gaugework.operators import aggregates as A
from gaugework.operators import rollups as R
from gaugework.operators.filters import time_range
from gaugework.sources.store import SCHEMA, Store

T0 = datetime.datetime(2024, 5, 1)


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


def frame(spark, n, seed, hosts="abc"):
    rng = random.Random(seed)
    rows = [(rng.choice(hosts), rng.choice(["x", "y"]), T0 + datetime.timedelta(seconds=rng.randrange(6 * 86_400)), 1e6 + rng.gauss(0, 3), "", k) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def near(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert x == pytest.approx(y, rel=1e-12, abs=1e-7), (k, x, y)


def stats(rows):
    return {(r.host_id, r.metric): (r["count"], r["sum"], r.avg, r.min, r.max, r.stddev) for r in rows.collect()}


def exact(samples):
    return stats(A.aggregate(samples, ("count", "sum", "avg", "min", "max", "stddev")))


def test_ranges_by_rollups(spark, tmp_path):
    store, path = Store(spark, f"{tmp_path}/s"), f"{tmp_path}/r"
    store.upsert(frame(spark, 3000, 1))
    version = R.refresh(store, path)
    near(stats(R.merged_stats(R.read_rollups(spark, path))), exact(store.read()))
    for start, end in ((at(0), at(48)), (at(5), at(100)), (at(24), at(72) - datetime.timedelta(microseconds=1)), (at(30), at(31)), (at(20), at(30)), (at(-50), at(999))):
        near(stats(R.merged_stats(R.range_rollups(store, path, start, end))), exact(time_range(store.read(), start, end)))
    plan = R.read_rollups(spark, path, at(24).date(), at(48).date())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    # a day changes, a day loses its rows, a day goes: only these are written
    before = {f for f in R.read_rollups(spark, path).inputFiles()}
    day = store.read(start=at(48), end=at(72) - datetime.timedelta(microseconds=1))
    store.delete(day.select("host_id", "ts"))
    store.upsert(spark.createDataFrame([("a", "x", at(100), 5.0, "", 10**6)], SCHEMA))
    store.drop_dates((T0 + datetime.timedelta(days=1)).date())
    assert R.refresh(store, path, version) > version
    near(stats(R.merged_stats(R.read_rollups(spark, path))), exact(store.read()))
    after = {f for f in R.read_rollups(spark, path).inputFiles()}
    store.upsert(store.read(start=at(72), end=at(95)).withColumns({"value": F.lit(None).cast("double"), "seq": F.col("seq") + 10**7}))
    R.refresh(store, path, store.versions()[-1] - 1)  # a day with rows, but without a value
    near(stats(R.merged_stats(R.read_rollups(spark, path))), exact(store.read().where("value is not null")))
    assert "2024-05-04" in {str(r.date) for r in R.read_rollups(spark, path, name="hosts").select("date").distinct().collect()}
    kept = {f for f in before if "date=2024-05-02" in f or "date=2024-05-04" in f or "date=2024-05-06" in f}
    assert kept and kept <= after and not any("date=2024-05-01" in f or "date=2024-05-03" in f for f in after)


def test_rank_error_and_hosts(spark):
    rng = random.Random(3)
    rows = [(f"h{k % 3000}", "m", T0 + datetime.timedelta(seconds=60 * k), rng.lognormvariate(0, 2), "", k) for k in range(40_000)]
    samples = spark.createDataFrame(rows, SCHEMA)
    (got,) = R.merged_stats(R.rollup(samples.withColumn("host_id", F.lit("one"))), ("metric",), (1, 50, 95, 99)).collect()
    values = sorted(r[3] for r in rows)
    for p in (1, 50, 95, 99):
        rank = sum(v <= got[f"p{p}"] for v in values) / len(values)
        assert abs(rank - p / 100) < 0.01, (p, rank)
    (hosts,) = R.host_counts(R.host_rollup(samples)).collect()
    assert abs(hosts.series - 3000) < 150


def test_empty(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    assert R.refresh(store, f"{tmp_path}/r") == 0 and R.read_rollups(spark, f"{tmp_path}/r").count() == 0
    assert R.merged_stats(R.read_rollups(spark, f"{tmp_path}/r")).count() == 0
