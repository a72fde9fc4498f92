"""Long series in blocks, and fleets of many buckets, against their plain versions and plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gaugework.operators import aggregates as A
from gaugework.operators import alerts as L
from gaugework.operators import capacity as P
from gaugework.operators import chunks as C
from gaugework.operators import segments as G
from gaugework.operators import windows as W

T0 = datetime.datetime(2024, 1, 1)
SAMPLES = "host_id string, metric string, ts timestamp_ntz, value double, seq long"


@pytest.fixture(scope="module")
def samples(spark):
    """One hot series, a few short ones, one of the null host; gaps, equal times, nulls in values."""
    rng, rows = random.Random(6), []
    for host, n in (("hot", 400), ("b", 9), ("c", 1), (None, 60)):
        t = T0
        for _ in range(n):
            t += datetime.timedelta(seconds=rng.choice([0, 1, 60, 60, 3600, 90_000]))
            rows.append((host, "m", t, rng.choice([None, rng.randrange(100) / 4, 5.0]), len(rows)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SAMPLES).repartition(3)


def rows_of(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("split", [7, 50])
def test_same_rows_as_one_window(spark, samples, split):
    clean = samples.where("value is not null")
    assert rows_of(A.with_deltas(samples, split=split)) == rows_of(A.with_deltas(samples, split=None))
    assert rows_of(G.with_rank(samples, ("host_id", "metric"), split)) == rows_of(G.with_rank(samples, ("host_id", "metric"), None))
    assert rows_of(W.sliding_stats(clean, 6, 4000, split=split)) == rows_of(W.sliding_stats(clean, 6, 4000, split=None))
    assert rows_of(W.counter_rates(clean, split=split)) == rows_of(W.counter_rates(clean, split=None))
    assert rows_of(C.delta_profile(clean, split)) == rows_of(C.delta_profile(clean, None))
    assert rows_of(A.trend(clean, split=split)) == rows_of(A.trend(clean, split=None))
    assert rows_of(A.aggregate(clean, split=split)) == rows_of(A.aggregate(clean, split=None))


@pytest.mark.parametrize("split", [7, None])
def test_carried_over_blocks(spark, samples, split):
    held = samples.collect()
    asked = [(h, "m", T0 + datetime.timedelta(hours=k), ) for h in ("hot", "b", "none") for k in range(0, 2600, 50)]
    got = W.latest_as_of(spark.createDataFrame(asked, "host_id string, metric string, ts timestamp_ntz"), samples, split).collect()
    for r in got:
        before = [s for s in held if s.host_id == r.host_id and s.ts <= r.ts]
        last = max(before, key=lambda s: (s.ts, s.seq), default=None)
        assert (r.value, r.at) == ((last.value, last.ts) if last else (None, None))  # one sample's value and time, null or not
    assert len(got) == len(asked)
    checks = samples.select("host_id", "ts", "seq", F.when(F.col("value").isNotNull(), F.col("value") < 20).alias("ok"))
    state, want = {}, {}
    for r in sorted(checks.collect(), key=lambda r: (r.ts, r.seq)):
        if r.ok is not None:
            state[r.host_id] = 0 if r.ok else state.get(r.host_id, 0) + 1
            want[r.seq] = state[r.host_id]
    got = {r.seq: r.failures for r in W.consecutive_failures(checks, 3, split=split).collect()}
    assert got == want


def test_one_series_is_many_tasks(spark):
    """Half a million points of one series: the window's work is dealt over tasks."""
    ts = (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 5)).alias("ts")
    one = spark.range(500_000).select(F.lit("h").alias("host_id"), F.lit("m").alias("metric"), ts, F.col("id").cast("double").alias("value"), F.col("id").alias("seq"))
    got = A.with_deltas(one, split=20_000).withColumn("task", F.spark_partition_id())
    assert got.groupBy("task").count().count() > 1
    assert got.where("prev = value - 1").count() == 499_999


@pytest.mark.parametrize("most", [1, 1000])
def test_decisions_by_doubling(spark, most):
    rng, rows, want = random.Random(9), [], []
    for fleet, n in (("a", 300), ("b", 3), (None, 40), ("idle", 5)):
        t, last = T0, None
        for _ in range(n):
            t += datetime.timedelta(seconds=rng.choice([1, 10, 10, 200, 5000, 4096 * 70]))
            action = "none" if fleet == "idle" else rng.choice(["none", "scale_up", "scale_down"])
            rows.append((fleet, t, action, "r" if action != "none" else "", 7, 6))
            act = action != "none" and (last is None or (t - last).total_seconds() >= 60)
            last = t if act else last
            want.append((fleet, t, action if act else "none", "r" if act else "", 7 if act else 6))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "fleet string, ts timestamp_ntz, action string, reason string, target long, hosts long")
    got = P.scaling_decisions(df, 60, ("fleet",), most)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    alone = P.scaling_decisions(df.where("fleet = 'a'").drop("fleet"), 60, (), most)
    assert sorted(map(tuple, alone.collect())) == sorted(w[1:] for w in want if w[0] == "a")
    assert P.scaling_decisions(df, 0, ("fleet",)).where("action <> 'none'").count() == df.where("action <> 'none'").count()
    assert P.scaling_decisions(df.where("false"), 60, ("fleet",), most).count() == 0


@pytest.mark.parametrize("split", [7, 50, None])
def test_sustained_runs_over_blocks(spark, samples, split):
    """Runs against a plain loop: over block ends, at the start and the end of a series, of one series in one block and many."""
    rules = spark.createDataFrame([("r", "m", ">", 4.0, "warning", 120, True), ("s", "m", "<", 20.0, "warning", 0, True), ("all", "m", ">=", 0.0, "info", 60, True)], L.RULES)
    rows = {}
    for r in samples.collect():
        rows.setdefault(r.host_id, []).append((r.ts, r.seq, r.value))
    want = []
    for host, own in rows.items():
        for rule, least, test in (("r", 120, lambda v: v > 4), ("s", 0, lambda v: v < 20), ("all", 60, lambda v: v >= 0)):
            run = []
            for t, _, v in [*sorted(own), (None, None, None)]:
                hit = v is not None and test(v)
                if hit:
                    run.append(t)
                    continue
                if run and (run[-1] - run[0]).total_seconds() >= least:
                    want.append((str(host), rule, str(run[0]), str(run[-1]), len(run), t is not None))
                run = []
    got = [(str(r.host_id), r.rule_id, str(r.start_ts), str(r.end_ts), r.n, r.resolved) for r in L.sustained_alerts(samples, rules, split).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20
