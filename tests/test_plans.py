"""Plans that must stay as they are, and cases that the tables don't have."""

import datetime

from gaugework import registry
from gaugework.operators import capacity as P
from gaugework.operators import filters as O
from gaugework.operators import hosts as H
from gaugework.sources import envelopes as E
from gaugework.sources import kafka

QUERIES = registry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_scan_and_one_shuffle_at_most(spark, sf_dir):
    snapshots = plan(QUERIES["parse_host_snapshots"](spark, sf_dir))
    assert snapshots.count("FileScan") == 1 and "Exchange" not in snapshots
    envelopes = plan(QUERIES["explode_envelopes"](spark, sf_dir))
    assert "Exchange" not in envelopes and 1 <= envelopes.count("parseJson") <= 4, envelopes.count("parseJson")  # the payload once, and metrics that are text
    assert plan(QUERIES["fold_changelog"](spark, sf_dir)).count("FileScan") == 2


def test_sorted_history_is_sorted(spark, sf_dir):
    rows = QUERIES["sorted_history"](spark, sf_dir)
    got = [(r.host_id, r.metric, r.ts) for r in rows.collect()]
    assert got == sorted(got) and len(got) > 900


def test_overloaded_host_without_a_check(spark):
    checks = spark.createDataFrame([("a", 1, "ping", True), ("b", 1, "ping", False)], "host_id string, ord int, check string, ok boolean")
    over = spark.createDataFrame([("b", "cpu_usage"), ("c", "disk_usage")], "host_id string, reason string")
    got = {r.host_id: (r.state, r.message) for r in H.health_state(checks, over).collect()}
    assert got == {"a": ("healthy", None), "b": ("unhealthy", "high cpu_usage"), "c": ("unhealthy", "high disk_usage")}


def test_time_rules_and_decisions_of_two_fleets(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)  # a Monday
    rules = spark.createDataFrame(
        [(1, "noon", "12:00", "12:59", [1], 3, 9, "scale_up")],
        "ord int, name string, start_time string, end_time string, days array<int>, min_hosts long, max_hosts long, action string"
    )
    load = spark.createDataFrame([("x", at(12), 5), ("y", at(12), 9), ("y", at(13), 9)], "fleet string, ts timestamp_ntz, hosts long")
    got = {(r.fleet, r.ts.hour): (r.rule_action, r.rule_target) for r in P.time_rules(load, rules, ("fleet",)).collect()}
    assert got == {("x", 12): ("scale_up", 6), ("y", 12): ("scale_up", 9), ("y", 13): (None, None)}
    asked = spark.createDataFrame(
        [(f, at(h), "scale_up", "r", 7, 6) for f in "xy" for h in (1, 2, 3)],
        "fleet string, ts timestamp_ntz, action string, reason string, target long, hosts long"
    )
    got = sorted((r.fleet, r.ts.hour, r.action, r.target) for r in P.scaling_decisions(asked, 7200, ("fleet",)).collect())
    assert got == [(f, h, a, t) for f in "xy" for h, a, t in ((1, "scale_up", 7), (2, "none", 6), (3, "scale_up", 7))]


def test_prefixes_of_asked_lengths(spark):
    keys = spark.createDataFrame([("abc",), ("ab",), ("",), (None,)], "key string")
    asked = spark.createDataFrame([("",), ("ab",), ("abcd",), ("x",)], "prefix string")
    assert sorted((r.prefix, r.n, r.found) for r in O.prefix_exists(keys, asked).collect()) == [
        ("", 3, True), ("ab", 2, True), ("abcd", 0, False), ("x", 0, False)
    ]
    assert O.prefix_exists(keys, asked.where("false")).count() == 0


def test_messages_there_and_back(spark):
    rows = [
        ("h", "m.a", datetime.datetime(2024, 1, 1), 1.5, "u"), ("h", "m.b", datetime.datetime(2024, 1, 1), -2.0, ""),
        ("g", "m.a", datetime.datetime(2024, 1, 2), 0.0, "%")
    ]
    samples = spark.createDataFrame(rows, "host_id string, metric string, ts timestamp_ntz, value double, unit string")
    back = kafka.decode_messages(kafka.encode_messages(E.scrapes(samples)))
    assert sorted((r.host_id, r.metric, r.ts, r.value, r.unit) for r in back.collect()) == sorted(rows)


def test_odd_envelopes(spark):
    texts = [None, "", "[]", "1", "{}", '{"host_id":"h"}', '{"host_id":"h","timestamp":"x","metrics":{"a":1}}', '{"host_id":"","hostId":"i","timestamp":5,"metrics":{"a":1}}',
             '{"host_id":"h","timestamp":5,"metrics":{"a":"2.5","b":{"unit":"u"},"c":[1],"d":null}}', '{"host_id":"h","timestamp":"5","metrics":[{"name":"a","value":3},7,null]}']
    rows = spark.createDataFrame(list(enumerate(texts)), "seq long, payload string")
    got = sorted((r.seq, r.metric, r.value) for r in E.explode_envelopes(rows).collect())
    assert got == [(8, "a", 2.5), (9, "a", 3.0)]
    zero = sorted((r.seq, r.metric, r.value) for r in E.explode_envelopes(rows, on_error="zero").collect())
    assert (8, "b", 0.0) in zero and (9, "a", 3.0) in zero


def test_ring_of_many_nodes():
    import time

    from gaugework.operators import shards

    points = shards.ring([f"n{k}" for k in range(7)], 5)
    plain = [list(dict.fromkeys(n for _, n in points[k:] + points[:k]))[:3] for k in range(len(points))]
    assert shards.replica_lists(points, 3) == plain and shards.replica_lists(points[:1], 1) == [[points[0][1]]]
    began = time.time()
    lists = shards.replica_lists(shards.ring([f"n{k}" for k in range(1000)], 50), 3)
    assert time.time() - began < 2 and all(len(set(x)) == 3 for x in lists)


def test_maps_merge_with_null(spark):
    from pyspark.sql import functions as F

    from gaugework.functions.columns import merged_maps

    rows = spark.createDataFrame([({"a": "1"}, None), (None, {"b": "2"}), ({"a": "1", "c": "0"}, {"a": "3"}), (None, None)], "old map<string,string>, new map<string,string>")
    got = [r[0] for r in rows.select(merged_maps(F.col("old"), F.col("new"))).collect()]
    assert got == [{"a": "1"}, {"b": "2"}, {"c": "0", "a": "3"}, {}]


def test_a_session_without_settings(tmp_path):
    """A plain installation: no spark.checkpoint.dir, no other setting; and one with a folder without a scheme."""
    import os
    import subprocess
    import sys

    code = """
import sys
from pyspark.sql import SparkSession
from gaugework.session import shared_root, work_dir
b = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
spark = (b.config("spark.checkpoint.dir", sys.argv[1]) if len(sys.argv) > 1 else b).getOrCreate()
path = work_dir(spark, "any")
assert path.startswith("file:///"), path
spark.range(3).write.parquet(path)
assert spark.range(2).checkpoint().count() == 2 and shared_root(spark) == shared_root(spark)
print("fine", path)
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    for more in ([], [f"{tmp_path}/shared"]):
        done = subprocess.run([sys.executable, "-c", code, *more], env=env, capture_output=True, text=True, timeout=120)
        assert "fine" in done.stdout, done.stderr[-2000:]
        assert not more or f"file://{tmp_path}/shared/any-" in done.stdout
