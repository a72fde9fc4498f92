"""Streams over several batches against their batch twins."""

import datetime
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugework.model import resources_of, samples
from gaugework.operators import alerts as L
from gaugework.operators import topk as K
from gaugework.operators import windows as W
from gaugework.operators.aggregates import bucket_stats
from gaugework.plans.streams import finished, finished_sink
from gaugework.streaming import queries as Q
from gaugework.streaming import stateful as T


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    """Samples in four files, one after the other in time."""
    folder = tmp_path_factory.mktemp("parts")
    rows = samples(spark, sf_dir).where("value is not null")
    cuts = rows.approxQuantile("seq", [0.25, 0.5, 0.75], 0.0)
    bounds = [-1, *cuts, 1 << 60]
    for k, (a, z) in enumerate(zip(bounds, bounds[1:])):
        rows.where((F.col("seq") > a) & (F.col("seq") <= z)).coalesce(1).write.parquet(f"{folder}/{k}")
        time.sleep(1.1)  # files are taken in the order of their times
    return str(folder), rows


def stream(spark, parts):
    folder, rows = parts
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def same(a, b, *columns):
    key = lambda df: sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else str(r[c]) for c in columns) for r in df.collect())
    assert key(a) == key(b)


def test_sliding(spark, parts):
    got = finished(T.stream_sliding_stats(stream(spark, parts), 5, 10_000_000))
    same(got, W.sliding_stats(parts[1], 5, 10_000_000), "host_id", "metric", "ts", "count", "avg", "std_dev")


def test_adaptive_window_stays_in_its_bounds(spark, parts):
    sizes = {r["size"] for r in finished(T.stream_sliding_stats(stream(spark, parts), 4, 10_000_000, (2, 9))).collect()}
    assert len(sizes) > 1 and min(sizes) >= 2 and max(sizes) <= 9


def test_earliest_alert_for_any_order_of_arrival(spark, parts, tmp_path):
    """Later alerts of an hour come in an earlier file: the earliest still is the one that is sent, whole."""
    alerts = parts[1].where("value > 20").select("host_id", "metric", "ts", "value", "seq")
    late = F.xxhash64("seq") % 3 == 0
    for k, rows in enumerate((alerts.where(~late), alerts.where(late))):
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(1.1)
    given = spark.readStream.schema(alerts.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = finished(T.stream_earliest_alerts(given, "400 days"))
    assert got.count() == 0  # no hour is over yet
    got = finished(T.stream_earliest_alerts(spark.readStream.schema(alerts.schema).parquet(f"{tmp_path}/in/*")))
    want = L.dedup_alerts(alerts.withColumn("value", F.col("value")))
    keys = ("host_id", "metric", "ts", "value")
    mark = alerts.agg((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9 - 1 / 6).alias("h")).first().h
    over = lambda df: df.where(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) + 1 <= mark)
    same(got, over(want), *keys)


def test_sustained(spark, parts):
    rules = L.default_rules(spark).withColumn("duration_s", F.lit(3600).cast("long"))
    got = finished(T.stream_sustained_alerts(L.matched(resources_of(stream(spark, parts)), rules)))
    runs = L.sustained_alerts(resources_of(parts[1]), rules)
    assert got.where("status = 'firing'").count() == runs.count() > 0
    assert got.where("status = 'resolved'").count() == runs.where("resolved").count()


def test_liveness(spark, parts):
    got = finished(T.stream_liveness(stream(spark, parts), 86_400)).collect()
    last = {}
    for r in sorted(got, key=lambda r: (r.host_id, r.ts)):
        assert last.get(r.host_id, "healthy") != r.state
        last[r.host_id] = r.state
    seen = {}
    for h, ts in sorted((r.host_id, r.ts) for r in parts[1].select("host_id", "ts").collect()):
        seen.setdefault(h, []).append(ts)
    gaps = sum((b - a).total_seconds() > 86_400 for t in seen.values() for a, b in zip(t, t[1:]))
    assert sum(r.state == "healthy" for r in got) == gaps


def test_topk(spark, parts, tmp_path):
    finished_sink(stream(spark, parts), Q.topk_sink(f"{tmp_path}/t", 5, 86_400))
    same(spark.read.parquet(f"{tmp_path}/t/top"), K.topk_hosts(parts[1], 5, 86_400), "metric", "rank", "host_id", "value")
    forever = 10**9
    same(
        T.merged_tops(finished(T.stream_topk(stream(spark, parts), 5, forever, buckets=3)), 5), K.topk_hosts(parts[1], 5, forever), "metric", "rank",
        "host_id", "value"
    )
    short = finished(T.stream_topk(stream(spark, parts), 5, 86_400, buckets=3))
    gone = {(r.metric, r.host_id) for r in short.where("kind = 'expire'").collect()}
    top = T.merged_tops(short, 5).collect()
    assert gone and top and all(1 <= r["rank"] <= 5 for r in top)


def test_merged_tops(spark):
    rows = [
        ("m", 0, 1, "update", "a", 9.0), ("m", 0, 2, "update", "b", 8.0), ("m", 0, 2, "update", "c", 7.0), ("m", 0, 3, "expire", "b", 8.0),
        ("m", 1, 4, "update", "d", 8.0), ("n", 1, 1, "update", "e", 1.0)
    ]
    top = T.merged_tops(spark.createDataFrame(rows, "metric string, bucket long, turn long, kind string, host_id string, value double"), 2)
    assert sorted((r.metric, r["rank"], r.host_id) for r in top.collect()) == [("m", 1, "d"), ("m", 2, "c"), ("n", 1, "e")]


def test_sliding_windows_plain():
    """Window sizes and frames of one key over several batches against a plain loop, late rows and adaptive sizes included."""
    rng = np.random.default_rng(3)
    for adaptive in (None, (2, 9)):
        own, state = T.Sliding(4, 300, adaptive), {}
        keep = lambda name: type(
            "State", (),
            {
                "exists": lambda _: name in state, "get": lambda _: state[name], "put": lambda _, x: state.update({name: x}), "update": lambda _,
                x: state.update({name: x})
            }
        )()
        own.points, own.limit = keep("points"), keep("limit")
        held, size, resized, clock, seq = [], 4, 0, 0, 0
        for _ in range(5):
            t = np.sort(rng.integers(0, 4000, 30)) * 1000 + 1_700_000_000_000
            rows = pd.DataFrame({"ts": pd.to_datetime(t, unit="ms"), "seq": range(seq, seq + 30), "value": rng.random(30)})
            seq += 30
            (got,) = own.handleInputRows(("h", "m"), iter([rows]), None)
            for k in range(30):
                clock = max(clock, int(t[k]))
                held = [p for p in [*held, (clock, rows["value"][k])][-size:] if p[0] >= clock - 300_000]
                v = np.array([x for _, x in held])
                want = (len(v), v.sum(), v.mean(), v.min(), v.max(), v.std(), size)
                assert np.allclose(got.iloc[k][["count", "sum", "avg", "min", "max", "std_dev", "size"]].astype(float), want)
                if adaptive and clock - resized >= 60_000:
                    full = len(held) / size
                    new = min(9, int(size * 1.5)) if full > 0.8 else max(2, int(size * 0.8)) if full < 0.3 else size
                    size, resized = (new, clock) if new != size else (size, resized)


def test_buckets(spark, parts):
    got = finished(Q.stream_bucket_stats(stream(spark, parts), "1 day"))
    end = parts[1].agg(F.max("ts")).first()[0] - datetime.timedelta(minutes=10)
    same(
        got, bucket_stats(parts[1], "1 day").where(F.col("bucket") <= F.lit(end - datetime.timedelta(days=1))), "host_id", "metric", "bucket",
        "count", "avg"
    )


def test_dedup(spark, parts):
    alerts = stream(spark, parts).where("value > 20")
    got = finished(Q.stream_dedup_alerts(alerts))
    want = L.dedup_alerts(parts[1].where("value > 20"))
    assert got.count() == want.count()


def test_anomalies_after_each_batch_and_a_restart(spark, parts, tmp_path):
    """The last word on each series, over four batches in two runs, against all rows at once; with and without a history."""
    folder, rows = parts
    old = spark.read.schema(rows.schema).parquet(f"{folder}/0")
    seqs = lambda df: {r.seq for r in df.select("seq").collect()}
    for history, given in ((None, "0123"), (old, "123")):
        out = f"{tmp_path}/{len(given)}"
        for k in given[:2], given:
            read = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/[{k}]")
            found = T.stream_anomalies(read, 12, 1.5, 5, history, "400 days")
            found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
        got = {(r.host_id, r.metric, r.ts, round(r["last"], 6), r.n, round(r.score, 6)) for r in spark.read.parquet(out).collect()}
        want, seen = set(), old if history is not None else old.limit(0)
        for k in given:
            new = spark.read.schema(rows.schema).parquet(f"{folder}/{k}")
            seen = seen.unionByName(new)
            own, series = {}, {(r.host_id, r.metric) for r in new.collect()}
            for r in seen.collect():
                own.setdefault((r.host_id, r.metric), []).append((r.ts, r.seq, r.value))
            for key in series:
                last = sorted(own[key])[-12:]
                v = np.array([x for *_, x in last])
                z = abs(v[-1] - v.mean()) / v.std() if v.std() > 0 else 0
                if len(v) >= 5 and z > 1.5:
                    want.add((*key, last[-1][0], round(v[-1], 6), len(v), round(z, 6)))
        assert got == want and want and seqs(seen) == seqs(rows)


def test_sustained_plain():
    """Runs over several batches against a plain loop, equal times and null breaches included."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        own, state = T.Sustained(), {}
        own.run = type(
            "State", (), {"exists": lambda _: "x" in state, "get": lambda _: state["x"], "update": lambda _, x: state.update(x=x), "clear": lambda _: state.pop("x", None)}
        )()
        start, fired, clock = None, False, 0
        for _ in range(4):
            n = int(rng.integers(0, 12))
            t = clock + np.cumsum(rng.integers(0, 4, n))
            clock = int(t[-1]) if n else clock
            breach = [None if x < 0.05 else bool(x < 0.75) for x in rng.random(n)]
            want = []
            for s, b in zip(t.tolist(), breach):
                if not b:
                    if fired:
                        want.append((s, "resolved"))
                    start, fired = None, False
                    continue
                start = s if start is None else start
                if not fired and s - start >= 5:
                    want.append((s, "firing"))
                    fired = True
            rows = pd.DataFrame({"ts": pd.to_datetime(t, unit="s"), "seq": range(n), "breach": pd.Series(breach, dtype=object), "duration_s": [5] * n})
            got = [(int(r.ts.timestamp()), r.status) for f in own.handleInputRows(("h", "r"), iter([rows] if n else []), None) for r in f.itertuples()]
            assert got == want
            assert state.get("x") == (None if start is None else (start * 1000, fired))


def test_topk_plain():
    """Tops and expiries of one bucket over many batches against all hosts sorted anew; how often all hosts are gone through."""
    rng = np.random.default_rng(9)

    class Map(dict):
        containsKey, getValue, removeKey = dict.__contains__, dict.__getitem__, dict.pop
        iterator = dict.items
        updateValue = dict.__setitem__

    class Kept:
        def __init__(self):
            self.x = None

        exists, get = lambda self: self.x is not None, lambda self: self.x

        def put(self, x):
            self.x = x

        def clear(self):
            self.x = None

        update = put

    for ttl, hosts, spread in ((50, 40, 1), (10**6, 40, 1), (30, 6, 4), (200, 300, 0)):
        own, timers, walks = T.TopK(4, ttl), [], 0
        own.hosts, own.best, own.turn = Map(), Kept(), Kept()
        own.handle = type("Handle", (), {"registerTimer": lambda _, t: timers.append(t), "deleteTimer": lambda _, t: timers.remove(t)})()
        walked = own._walked

        def counted():
            nonlocal walks
            walks += 1
            return walked()

        own._walked = counted
        clock, last, top = 0, {}, []
        for batch in range(80):
            n = int(rng.integers(1, 9))
            t = np.maximum(clock + rng.integers(-3, 6, n), 0)
            rows = pd.DataFrame({
                "ts": pd.to_datetime(t, unit="s"), "seq": range(n), "host_id": [f"h{x}" for x in rng.integers(0, hosts, n)],
                "value": rng.integers(0, 10, n) + spread * rng.random(n)
            })
            out = list(own.handleInputRows(("m", 0), iter([rows]), None))
            for r in rows.sort_values(["ts", "seq"]).itertuples():
                if r.host_id not in last or last[r.host_id][0] <= T._ms(r.ts):
                    last[r.host_id] = (T._ms(r.ts), r.value)
            ranks = lambda: [h for _, h in sorted((-v, h) for h, (_, v) in last.items())][:4]
            assert [h for f in out for h in f["host_id"]] == ranks()
            clock = max(clock, int(t.max()))
            mark = (clock - 4) * 1000
            while timers and min(timers) <= mark:
                due = min(timers)
                timers.remove(due)
                info, mark_of = type("I", (), {"getExpiryTimeInMs": lambda _: due})(), type("V", (), {"getCurrentWatermarkInMs": lambda _: mark})()
                got = [(r.kind, r.host_id) for f in own.handleExpiredTimer(("m", 0), mark_of, info) for r in f.itertuples()]
                gone = {h for h, (s, _) in last.items() if s + ttl * 1000 <= mark}
                assert {h for kind, h in got if kind == "expire"} == gone
                for h in gone:
                    del last[h]
                assert [h for kind, h in got if kind == "update"] == (ranks() if gone else [])
            assert all(s + ttl * 1000 > mark for s, _ in last.values()) and len(timers) == bool(last)
        assert ttl < 10**6 or walks < 40
