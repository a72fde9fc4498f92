"""Trends whose slope is just at a limit, and odd series, against the SQL and a plain loop."""

import datetime
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugework import registry
from gaugework.operators import aggregates as A

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def at_the_limit(rng):
    """Cents whose slope is 0.1, -0.1 or 0 a point: 0.06 S / (n (n² - 1)), S being the sum of (2 i - n + 1) times the cents."""
    while True:
        n, times = rng.randrange(3, 34), rng.choice((-1, 0, 1))
        cents = [round(rng.expovariate(1 / 5000)) for _ in range(n)]
        off = times * 5 * n * (n * n - 1) // 3 - sum((2 * i - n + 1) * c for i, c in enumerate(cents))
        if n * (n * n - 1) % 3 == 0 and off % 2 == 0:
            for k in range(n - 1):  # a cent more here and one less there are two more
                d = off // 2 // (n - 1) + (k < off // 2 % (n - 1))
                cents[k + 1] += d
                cents[k] -= d
            return [c / 100 for c in cents]


def written(spark, path, series):
    """As events: of user k the values of the k-th series, an hour apart."""
    rows = [(i * 100_000 + k, T0 + datetime.timedelta(hours=i), k, "click", v, None) for k, own in enumerate(series) for i, v in enumerate(own)]
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(f"{path}/events.parquet")
    return str(path)


def by_sql(path):
    """The SQL's rows as text, negative zeros included. One thread: with more, a series can be summed in two parts."""
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet/*.parquet')")
    return sorted(map(str, c.execute(registry.oracle_sql()["trend"]).fetchall()))


def by_spark(spark, path):
    names = ("host_id", "metric", "n", "slope", "correlation", "direction", "prediction", "confidence")
    return sorted(str(tuple(r)) for r in registry.queries()["trend"](spark, path).select(*names).collect())


def test_slopes_at_the_limits(spark, tmp_path):
    rng = random.Random(7)
    path = written(spark, tmp_path, [at_the_limit(rng) for _ in range(1500)])
    got = by_spark(spark, path)
    assert got == by_sql(path) and all(any(d in row for row in got) for d in ("'up'", "'down'", "'stable'", "-0.0,"))


def test_odd_series(spark, tmp_path):
    series = [[], [1.0], [2.0, 2.0], [1.0, None], [None, None], [None, 1.0, 3.0, None, 2.0], [3.0, None, 3.0], [5.0, 1.0, None], [0.1] * 9, [1e9, -1e9, 7.0, None, 0.0]]
    path = written(spark, tmp_path, series)
    assert by_spark(spark, path) == by_sql(path)


def test_covariance_in_order(spark):
    """Equal to the last bit with a plain loop of fused steps; near the engine's own; too great values and none."""
    if not hasattr(math, "fma"):
        pytest.skip("no math.fma")
    rng = random.Random(3)
    series = [[rng.uniform(-1, 1) * 10 ** rng.randrange(-3, 9) for _ in range(rng.randrange(1, 60))] for _ in range(400)]
    rows = spark.createDataFrame([(k, [(float(i), v) for i, v in enumerate(own)]) for k, own in enumerate(series)], "k int, points array<struct<x double, value double>>")
    for r in rows.select("k", A.covariance_in_order(F.col("points")).alias("c")).collect():
        mx = my = c = 0.0
        for i, v in enumerate(series[r.k]):
            dx, mx, my = i - mx, mx + (i - mx) / (i + 1), my + (v - my) / (i + 1)
            c = math.fma(dx, v - my, c)
        assert r.c == c / len(series[r.k])


def test_long_and_great_series(spark, monkeypatch):
    """Series beyond the points kept, and values too great to be cut in halves, have the engine's own covariance."""
    rows = [("a", "x", T0 + datetime.timedelta(hours=i), float(i % 7), i) for i in range(40)] + [
        ("b", "x", T0 + datetime.timedelta(hours=i), i * 1e305, i) for i in range(5)
    ]
    samples = spark.createDataFrame(rows, "host_id string, metric string, ts timestamp_ntz, value double, seq long")
    want = {r.host_id: r for r in A.trend(samples).collect()}
    monkeypatch.setattr(A, "IN_ORDER", 10)
    got = {r.host_id: r for r in A.trend(samples).collect()}
    assert math.isclose(got["a"].slope, want["a"].slope, rel_tol=1e-12) and math.isclose(got["b"].slope, 1e305, rel_tol=1e-12)
    assert math.isclose(want["b"].slope, 1e305, rel_tol=1e-12) and want["b"].direction == "up"
