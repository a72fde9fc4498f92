"""Small inputs with known results."""

import datetime
import math
import zlib

import pytest
from pyspark.sql import functions as F

from gaugework.functions import columns as C
from gaugework.functions import vectors as V
from gaugework.operators import aggregates as A
from gaugework.operators import alerts as L
from gaugework.operators import capacity as P
from gaugework.operators import changelog as G
from gaugework.operators import chunks as Z
from gaugework.operators import filters as O
from gaugework.operators import hosts as H
from gaugework.operators import members as N
from gaugework.operators import rules as U
from gaugework.operators import shards as D
from gaugework.operators import topk as K
from gaugework.operators import windows as W
from gaugework.sources import envelopes as E
from gaugework.sources import hosts as J
from gaugework.sources import kafka, procfs
from gaugework.sources import samples as S

T0 = datetime.datetime(2024, 3, 4, 10, 0)
SAMPLES = "host_id string, metric string, ts timestamp_ntz, value double, unit string, seq long"


def at(s):
    return T0 + datetime.timedelta(seconds=s)


def series(spark, values, step=60, host="h", metric="cpu_usage"):
    return spark.createDataFrame([(host, metric, at(i * step), float(v), "", i) for i, v in enumerate(values)], SAMPLES)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_aggregate_scopes(spark):
    s = spark.createDataFrame([("h", m, T0, v, "", 0) for m, v in (("cpu_usage", 45.5), ("memory_usage", 1024.0), ("disk_usage", 85.0))], SAMPLES)
    assert rows(A.aggregate(s, ("avg",), "cpu_usage"), "avg") == [(45.5,)]
    (r,) = A.aggregate(s, ("avg", "count"), "cpu_usage", scope="record").collect()
    assert round(r["avg"], 6) == 384.833333 and r["count"] == 3
    with pytest.raises(ValueError):
        A.aggregate(s, ("median?",))
    A.register_aggregator("spread", lambda v: F.max(v) - F.min(v))
    assert rows(A.aggregate(s, ("spread", "p50")), "spread") == [(0.0,)] * 3


def test_trend(spark):
    s = series(spark, [40 + i for i in range(15)])
    (r,) = A.trend(O.time_range(s, T0, at(3600), "neither")).collect()
    assert (r.n, r.direction) == (14, "up") and [round(x, 6) for x in (r.slope, r.correlation, r.prediction, r.confidence)] == [1, 1, 68, 100]
    (r,) = A.trend(s).collect()
    assert round(r.prediction, 6) == 69
    (r,) = A.trend(series(spark, [5, 5, 5])).collect()
    assert (r.slope, r.correlation, r.direction) == (0, 1, "stable")
    assert A.trend(series(spark, [5])).count() == 0


def test_anomaly(spark):
    s = series(spark, [45 + i % 5 for i in range(25)] + [95])
    (r,) = A.anomaly(O.time_range(s, T0, None, "neither")).collect()
    assert (r.n, r["mean"], r.is_anomaly) == (25, 49.0, True) and round(r.stddev, 6) == 9.486833 and round(r.score, 6) == 4.848826
    (r,) = A.anomaly(s).collect()
    assert round(r.score, 6) == 4.944514
    (r,) = A.anomaly(series(spark, [3] * 12)).collect()
    assert (r.is_anomaly, r.score) == (False, 0.0)
    assert A.anomaly(series(spark, range(9))).count() == 0


def one_each(spark, values, metric="cpu_usage"):
    return spark.createDataFrame([(h, metric, at(i), float(v), "", i) for i, (h, v) in enumerate(values)], SAMPLES)


def test_topk(spark):
    s = one_each(spark, [("host-1", 85), ("host-2", 45), ("host-3", 92), ("host-4", 38), ("host-5", 76)])
    assert rows(K.topk_hosts(s, 3), "rank", "host_id", "value") == [(1, "host-3", 92), (2, "host-1", 85), (3, "host-5", 76)]
    s = one_each(
        spark, [("host1", 100.5), ("host2", 200.3), ("host3", 150.7), ("host4", 300.1), ("host5", 250.9), ("host6", 180.2), ("host7", 350.8)]
    )
    assert [h for _, h in rows(K.topk_hosts(s, 5), "rank", "host_id")] == ["host7", "host4", "host5", "host2", "host6"]
    assert rows(K.topk_evictions(s, at(4), at(6), 5), "host_id") == [("host1",), ("host3",)]
    s = one_each(spark, [("old", 99), ("b", 5), ("a", 5)]).withColumn(
        "ts", F.when(F.col("host_id") == "old", F.col("ts") - F.expr("INTERVAL 2 HOURS")).otherwise(F.col("ts"))
    )
    assert [h for _, h in rows(K.topk_hosts(s), "rank", "host_id")] == ["a", "b"]


def test_alerts(spark):
    (r,) = L.evaluate_alerts(series(spark, [95]), L.default_rules(spark)).collect()
    assert r.rule_id == "cpu-high" and r.message == "cpu_usage > 95.00 (threshold: 80.00)" and r.status == "active"
    a = spark.createDataFrame([("h", "m", T0 + datetime.timedelta(minutes=m), 1.0, "", m) for m in (5, 55, 60)], SAMPLES)
    assert [t.minute for (t,) in rows(L.dedup_alerts(a), "ts")] == [5, 0]
    rule = spark.createDataFrame([("r", "cpu_usage", ">", 10.0, "warning", 120, True), ("off", "cpu_usage", ">", 0.0, "warning", 0, False)], L.RULES)
    assert rows(L.sustained_alerts(series(spark, [11, 12, 13, 5, 20, 21]), rule), "n", "resolved") == [(3, True)]


def test_sliding_window(spark):
    (r,) = W.sliding_stats(series(spark, range(50), 1), 100, 3600).where("seq = 49").collect()
    assert (r["count"], r.avg, r["median"], r.p90, r.p95, r.p99, r.last_value) == (50, 24.5, 24, 44, 46, 48, 49) and round(r.std_dev, 6) == 14.430870
    (r,) = W.sliding_stats(series(spark, range(50), 1), 100, 9).where("seq = 49").collect()
    assert (r["count"], r["min"]) == (10, 40)


def test_basic_stats_and_percent(spark):
    s = series(spark, range(1, 11))
    (r,) = A.basic_stats(s).collect()
    assert (r["sum"], r["mean"], r["min"], r["max"]) == (55, 5.5, 1, 10) and round(r.stddev, 6) == 2.872281
    (r,) = A.percentiles(s).collect()
    assert [round(r[f"p{p}"], 6) for p in (50, 90, 95, 99)] == [5.5, 9.1, 9.55, 9.91]
    df = spark.createDataFrame([(25.0,), (50.0,), (75.0,), (100.0,)], "v double")
    assert [x for (x,) in rows(df.select(C.to_percentage(F.col("v"), F.lit(100.0)).alias("p")), "p")] == [25, 50, 75, 100]
    odd = series(spark, [1, 2, math.nan, 4, math.inf, 6])
    assert rows(A.valid_count(odd), "valid", "total") == [(4, 6)]


def test_validation(spark):
    s = spark.createDataFrame([("h", m, T0, v, "", 0) for m, v in (("a", 1.0), ("b", 2.0), ("c", 0.0), ("", 1.0), ("d", -1.0))], SAMPLES)
    assert O.validate_samples(s).count() == 3
    hosts = spark.createDataFrame(
        [("a", "192.168.1.100", 1), ("", "10.0.0.1", 2), ("b", "", 3), ("c", "999.1.1.1", 4), ("d", "::1", 5), ("e", "fe80::1:2", 6)],
        "host_id string, ip string, ord int"
    )
    assert rows(O.validate_hosts(hosts), "host_id") == [("a",), ("d",), ("e",)]
    assert rows(O.validate_hosts(hosts, 2), "host_id") == [("a",), ("d",)]


def test_ring(spark):
    nodes = ["node1", "node2", "node3"]
    assert len(D.ring(nodes, 3)) == 9
    keys = spark.createDataFrame([(f"key{i}",) for i in range(1000)], "key string")
    got = {r.key: (r.crc, r.node) for r in D.assign_shards(keys, nodes, 3).collect()}
    assert len(got) == 1000 and all(c == zlib.crc32(k.encode()) for k, (c, _) in got.items())
    assert got["key0"] == (
        1532712134, "node2"
    ) and got["key1"] == (744252496, "node1") and got["key2"] == (3042260458, "node1") and got["key3"] == (3260155260, "node3")
    assert rows(D.shard_distribution(D.assign_shards(keys, nodes, 3), 3), "node", "keys") == [("node1", 299), ("node2", 390), ("node3", 311)]
    moved = D.rebalance(keys, nodes, nodes[:2], 3).collect()
    assert len(moved) == 311 and {r.node_before for r in moved} == {"node3"}
    assert all(len(set(r.nodes)) == 3 for r in D.assign_replicas(keys, nodes, 3, 3).collect())
    with pytest.raises(ValueError):
        D.assign_replicas(keys, nodes, 3, 4)


def test_membership_and_rules(spark):
    keys = spark.createDataFrame([("item1",), ("item2",), ("item3",), ("nonexistent",)], "k string")
    assert rows(N.membership(keys, keys.where("k like 'item%'"), "k"), "k", "found") == [
        ("item1", True), ("item2", True), ("item3", True), ("nonexistent", False)
    ]
    rules = spark.createDataFrame([("host-*", "any"), ("host-1*", "ones")], "prefix string, category string")
    key = spark.createDataFrame([("host-12",), ("web",), (None,)], "key string")
    assert {r.key: r.category for r in U.classify_by_prefix(key, rules).collect()} == {"host-12": "ones", "web": None, None: None}
    assert {r.key: r.category for r in O.exact_rule(key, rules).collect()} == {"host-12": None, "web": None, None: None}
    assert O.prefix_search(key, "", empty="none").count() == 0 and O.prefix_search(key, "").count() == 2


def test_chunks(spark):
    kinds = {
        "flat": [42] * 100, "step": [10] * 50 + [20] * 50, "wave": [100 + 10 * math.sin(0.1 * i) for i in range(100)],
        "saw": [100 + i % 17 / 2 for i in range(100)]
    }
    s = None
    for name, v in kinds.items():
        part = series(spark, v, 1, name)
        s = part if s is None else s.unionByName(part)
    back = Z.unpack_chunks(Z.pack_chunks(s, "1 minute"))
    assert rows(back, "host_id", "ts", "value") == rows(s, "host_id", "ts", "value")
    assert Z.pack_chunks(s.where("false")).count() == 0
    got = {r.host_id: r for r in Z.delta_profile(s).collect()}
    assert all((r.n, r.n_9, r.n_1) == (100, 1, 98) for r in got.values()) and got["flat"].repeated == 0.99
    ratio = {r.host_id: r.ratio for r in Z.compressibility(s).collect()}
    assert ratio["flat"] > ratio["step"] > 1.2 and ratio["flat"] > 10


def test_rates(spark):
    assert [round(x, 6) for (x,) in rows(A.aggregate(series(spark, [10, 15, 3, 8], 10), ("rate",)), "rate")] == [0.333333]
    assert rows(A.aggregate(series(spark, [10], 10), ("rate",)), "rate") == [(0.0,)] and rows(
        A.aggregate(series(spark, [1, 9], 0), ("rate",)), "rate"
    ) == [(0.0,)]
    assert [(r.rate, r["reset"]) for r in W.counter_rates(series(spark, [100, 250, 20], 10)).orderBy("seq").collect()] == [
        (15.0, False), (None, True)
    ]


def test_changelog(spark):
    log = [
        ("k", "INCREMENT", 5), ("k", "SET", 10), ("k", "INCREMENT", 5), ("k", "UPDATE", 7), ("k", "INCREMENT", 1), ("x", "UPDATE", 3),
        ("y", "SET", 1), ("y", "EXPIRE", 0)
    ]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(log)], "idx long, key string, op string, value long")
    assert rows(G.fold_changelog(df), "key", "value") == [("k", 8)]
    for cut in range(-1, len(log) + 1):
        assert rows(G.fold_changelog(G.log_compaction(df, cut)), "key", "value") == [("k", 8)]
    gone = spark.createDataFrame([(9, "k", "DELETE", 0), (10, "k", "UPDATE", 3)], df.schema)
    assert G.fold_changelog(df.unionByName(gone)).count() == 0


def test_cluster_health(spark):
    df = spark.createDataFrame([(n, i < n) for n in (2, 1, 0) for i in range(5)], "c int, active boolean")
    assert rows(A.cluster_health(df, ("c",)), "c", "status") == [(0, "unhealthy"), (1, "degraded"), (2, "healthy")]


def test_scaling(spark):
    df = spark.createDataFrame(
        [(at(i * 60), 5, 5, 60.0, 60.0, None, None, None) for i in range(8)],
        "ts timestamp_ntz, hosts long, healthy long, score double, forecast double, rule_action string, rule_reason string, rule_target long"
    )
    p = P.proposed(df, P.Scaling())
    assert set(rows(p, "action", "reason", "target")) == {("scale_down", "low_load", 4)}
    assert [x for _, x in rows(P.scaling_decisions(p, 300), "ts", "action")] == [
        "scale_down", "none", "none", "none", "none", "scale_down", "none", "none"
    ]
    assert P.load_score(
        spark.createDataFrame(
            [(50.0, 50.0, 50.0, 50.0, 10, 0), (50.0, 50.0, 50.0, 50.0, 1000, 1)],
            "cpu_usage double, memory_usage double, disk_usage double, network_usage double, connections long, hosts long"
        ),
        0.5
    ).select(F.round("score", 6)).collect() == [(100.0,), (1.0,)]


def test_canonical_names(spark):
    s = spark.createDataFrame(
        [("h", "network.bandwidth.eth0", T0, 1048576.0, "B/s", 0), ("h", "network.rx_bytes_avg.eth0", T0, 5.0, "B/s", 1)], SAMPLES
    )
    assert rows(O.canonicalise(s), "metric", "value", "unit", "instance") == [
        ("network.rx_bytes_avg.eth0", 5.0, "B/s", ""), ("network_traffic", 1.0, "MB/s", "eth0")
    ]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0], [1.0, 2.0]), ([], [])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = df.select(V.vec_dot(a, b), V.vec_add(a, b), V.vec_sum(a), V.vec_max(a), V.vec_min(a), V.vec_sub(a, b), V.vec_mul(a, b)).collect()
    assert [tuple(r) for r in got] == [
        (11.0, [4.0, 6.0], 3.0, 2.0, 1.0, [-2.0, -2.0], [3.0, 8.0]), (0.0, None, 1.0, 1.0, 1.0, None, None), (0.0, [], 0.0, 0.0, 0.0, [], [])
    ]


def test_envelopes_and_messages(spark):
    samples = spark.createDataFrame([("h", "cpu", T0, 1.5, "%", 0), ("h", "mem", T0, 2.0, "", 0), ("g", "cpu", at(5), 3.0, "%", 0)], SAMPLES)
    sent = E.build_envelopes(samples).select(
        F.to_json(F.struct("host_id", F.col("timestamp"), F.col("metrics"))).alias("payload"), F.lit(0).cast("long").alias("seq")
    )
    assert rows(E.explode_envelopes(sent), "host_id", "metric", "ts", "value", "unit") == rows(samples, "host_id", "metric", "ts", "value", "unit")
    bad = spark.createDataFrame([('{"host_id":"h","timestamp":1,"metrics":{"a":"x","b":"2"}}', 1)], "payload string, seq long")
    assert rows(E.explode_envelopes(bad), "metric", "value") == [("b", 2.0)]
    assert rows(E.explode_envelopes(bad, on_error="zero"), "metric", "value") == [("a", 0.0), ("b", 2.0)]
    m = spark.createDataFrame([(f'{{"host_id":"h{i}"}}', 0) for i in range(50)] + [("{oops", 0)], "payload string, retries int")
    assert sorted(r["count"] for r in E.dead_letters(m).groupBy("route").count().collect()) == [1, 50]
    assert kafka.encode_messages(E.build_envelopes(samples)).columns == ["key", "value"]


def test_nested_batch(spark):
    text = '{"host_id":"h%d","timestamp":1700000000,"metrics":[%s]}'
    each = ",".join(f'{{"name":"network_rx","value":"{k}"}}' for k in range(5))
    df = spark.createDataFrame([(text % (i, each), i) for i in range(10)], "payload string, seq long")
    assert E.explode_envelopes(df).groupBy("host_id").count().where("count = 5").count() == 10


def test_storage(spark, tmp_path):
    from gaugework.session import work_dir

    work_dir(spark, "any")
    s, path = series(spark, range(5), 40_000), f"{tmp_path}/samples"
    S.write_samples(s, path)
    S.write_samples(s.where("seq = 2").withColumn("value", F.lit(99.0)).withColumn("seq", F.lit(10).cast("long")), path)
    assert [v for _, v in rows(S.read_samples(spark, path), "ts", "value")] == [0, 1, 99, 3, 4]
    S.delete_points(spark, path, s.where("seq = 0"))
    assert S.read_samples(spark, path, ("h",), at(0), at(90_000)).count() == 2
    J.register_source("stored", lambda sp: S.read_samples(sp, path))
    assert J.read_source(spark, "stored").count() == 4
    with pytest.raises(ValueError):
        J.read_source(spark, "missing")


def test_snapshots(spark):
    files = {
        "stat": "cpu  10 1 5 100 2 0 1 0 0 0\ncpu0 10 1 5 100 2 0 1 0 0 0\nintr 77 1 2\nctxt 99\nprocs_running 3",
        "net_dev": "Inter-|   Receive\n face |bytes packets\n    lo: 1 1 0 0 0 0 0 0 1 1 0 0 0 0 0 0\n  eth0: 500 5 0 1 0 0 0 0 700 7 0 0 0 0 0 0",
        "buddyinfo": "Node 0, zone DMA 1 2 3\nNode 0, zone Normal 4 5 6",
        "mounts": "/dev/sda1 / ext4 rw\nproc /proc proc rw\ntmpfs /run tmpfs rw",
        "vmstat": "nr_free_pages 12\npswpin 3\nunknown 4",
        "numa_meminfo": "Node 0 MemTotal: 100 kB\nNode 0 MemFree: 40 kB",
    }
    df = spark.createDataFrame([("h", T0, f, c) for f, c in files.items()], "host_id string, ts timestamp_ntz, file string, content string")
    got = {r.metric: r.value for r in procfs.parse_host_snapshots(df).collect()}
    assert got["cpu.jiffies.total.idle"] == 100 and got["cpu.jiffies.cpu0.user"] == 10 and got["cpu.context_switches"] == 99 and got["cpu.interrupts"] == 77
    assert got["network.rx_bytes.eth0"] == 500 and got["network.tx_bytes.eth0"] == 700 and not any("lo" == k.split(".")[-1] for k in got)
    assert got["memory.free_pages"] == 84 and got["memory.vmstat_nr_free_pages"] == 12 and got["memory.swap_in"] == 3
    assert got["memory.numa_0.free"] == 40 and [k for k in got if k.startswith("disk.mount")] == ["disk.mount./"]


def test_hosts(spark):
    e = spark.createDataFrame(
        [("a", T0, 0, "n1", 10, {"x": "1"}), ("a", at(9), 1, "", 0, {"y": "2"}), ("a", at(5), 2, "n2", 20, {"x": "3"})],
        "host_id string, ts timestamp_ntz, seq long, hostname string, port int, tags map<string,string>"
    )
    (r,) = H.upsert_hosts(e, ("hostname",), ("port",), ("tags",)).collect()
    assert (r.hostname, r.port, r.tags, r.last_seen) == ("n2", 20, {"x": "3", "y": "2"}, at(9))
    s = series(spark, [1], host="h")
    assert rows(H.liveness(s, at(300)), "state") == [("healthy",)] and rows(H.liveness(s, at(301)), "state") == [("offline",)]
    water = spark.createDataFrame([("h", at(60))], "host_id string, last_ts timestamp_ntz")
    assert [t for (t,) in rows(H.incremental_pull(series(spark, range(4)), water, at(200)), "ts")] == [at(120), at(180)]
    assert H.incremental_pull(series(spark, range(4)), water.withColumn("last_ts", F.lit(at(180)).cast("timestamp_ntz")), at(200)).count() == 4


def test_order_of_rows_does_not_matter(spark, sf_dir):
    from gaugework.model import samples

    s = samples(spark, sf_dir)
    mixed = s.orderBy(F.xxhash64("seq"))
    for f in (A.aggregate, A.trend, W.latest, K.topk_hosts, lambda x: W.sliding_stats(x, 5, 10_000_000)):
        a, b = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f(x).collect()) for x in (s, mixed))
        assert a == b


def test_percentiles_of_groups_of_any_size(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    groups = {f"h{n}": np.round(rng.normal(size=n), 2) for n in (1, 2, 3, 5, 39, 500, 5000)} | {"same": np.full(700, 3.0), "two": np.repeat([1.0, 9.0], [990, 10])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(None, 1.0), (None, 2.0), ("null", None)]
    df = spark.createDataFrame(rows, "metric string, value double").repartition(4)
    points = (0, 1, 50, 90, 95, 99, 100)
    got = {r.metric: [r[f"p{p}"] for p in points] for r in A.percentiles(df, points).collect()}
    for k, vs in groups.items():
        assert np.allclose(got[k], np.percentile(vs, points)), k
    assert got[None] == [1.0, 1.01, 1.5, 1.9, 1.95, 1.99, 2.0] and got["null"] == [None] * 7
