"""Queries on alerts, hosts, capacity and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.model import changelog, hosts, messages, resources, samples, table
from gaugework.operators import aggregates as A
from gaugework.operators import alerts as L
from gaugework.operators import capacity as P
from gaugework.operators import changelog as G
from gaugework.operators import hosts as H
from gaugework.operators import shards as D
from gaugework.operators import topk as K
from gaugework.operators import windows as W
from gaugework.plans.filters import HOSTS
from gaugework.plans.series import END, bounds
from gaugework.plans.windows import LOAD
from gaugework.registry import query

RULES = "u(rule_id, metric, threshold, severity) AS (VALUES ('cpu-high', 'cpu_usage', 80.0, 'warning'), ('cpu-critical', 'cpu_usage', 95.0, 'critical'), ('memory-high', 'memory_usage', 85.0, 'warning'), ('memory-critical', 'memory_usage', 95.0, 'critical'), ('disk-high', 'disk_usage', 90.0, 'warning'))"
LATEST = "l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY host_id, metric ORDER BY ts DESC, seq DESC) = 1)"


@query(
    f"""WITH {{R}}, {LATEST}, {RULES} SELECT rule_id || '-' || host_id || '-' || CAST(floor(epoch(ts)) AS BIGINT) AS id, rule_id, host_id, metric, value, threshold::DOUBLE AS threshold, severity,
      format('{{:s}} > {{:.2f}} (threshold: {{:.2f}})', metric, value, threshold::DOUBLE) AS message, ts, 'active' AS status FROM l JOIN u USING (metric) WHERE value > threshold"""
)
def evaluate_alerts(spark, sf_dir):
    return L.evaluate_alerts(resources(spark, sf_dir), L.default_rules(spark))


@query(
    f"""WITH {{R}}, {RULES}, m AS (SELECT r.*, rule_id, value > threshold AS breach FROM r JOIN u USING (metric)), i AS (SELECT *, count(*) FILTER (NOT breach) OVER (PARTITION BY host_id, rule_id ORDER BY ts, seq) AS k FROM m),
    g AS (SELECT host_id, metric, rule_id, k, min(ts) FILTER (breach) AS start_ts, max(ts) FILTER (breach) AS end_ts, count(*) FILTER (breach) AS n FROM i GROUP BY ALL), z AS (SELECT host_id, rule_id, max(k) AS last FROM i GROUP BY ALL)
    SELECT host_id, metric, rule_id, start_ts, end_ts, n, k < last AS resolved FROM g JOIN z USING (host_id, rule_id) WHERE n > 0 AND end_ts - start_ts >= INTERVAL 1 DAY"""
)
def sustained_alerts(spark, sf_dir):
    return L.sustained_alerts(resources(spark, sf_dir), L.default_rules(spark).withColumn("duration_s", F.lit(86_400).cast("long")))


@query("WITH {S} SELECT host_id, metric, ts, value, '' AS unit, seq, host_id || ':' || metric || ':' || CAST(floor(epoch(ts) / 3600) AS BIGINT) AS key FROM s WHERE value > 20 QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts, seq) = 1")
def dedup_alerts(spark, sf_dir):
    return L.dedup_alerts(samples(spark, sf_dir).where("value > 20"))


OVER = "o AS (SELECT host_id, max(value) FILTER (metric = 'cpu_usage') AS cpu_usage, max(value) FILTER (metric = 'memory_usage') AS memory_usage, max(value) FILTER (metric = 'disk_usage') AS disk_usage FROM l GROUP BY ALL), w AS (SELECT *, CASE WHEN cpu_usage > 80 THEN 'cpu_usage' WHEN memory_usage > 85 THEN 'memory_usage' WHEN disk_usage > 90 THEN 'disk_usage' END AS reason FROM o WHERE reason IS NOT NULL)"


@query(f"WITH {{R}}, {LATEST}, {OVER} SELECT * FROM w")
def over_threshold_hosts(spark, sf_dir):
    return L.over_threshold_hosts(resources(spark, sf_dir))


def registrations(spark, sf_dir):
    """Events as registrations: now and then without a group, with ports of which some are 0, and one label each."""
    e = table(spark, sf_dir, "events")
    host = F.concat(F.lit("host-"), e["user_id"].cast("string")).alias("host_id")
    group = F.when(e["event_id"] % 3 == 0, "").otherwise(e["event_type"]).alias("group")
    return e.select(
        host, "ts", F.col("event_id").alias("seq"), group, (e["event_id"] % 5 * 1000).cast("int").alias("port"),
        F.create_map(e["event_type"], F.floor("value").cast("string")).alias("labels")
    )


@query(
    """WITH e AS (SELECT 'host-' || user_id AS host_id, ts, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS g, CAST(event_id % 5 * 1000 AS INTEGER) AS port, event_type, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS v FROM events),
    m AS (SELECT host_id, event_type, arg_max(v, (ts, seq)) AS v FROM e GROUP BY ALL), n AS (SELECT host_id, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS labels FROM m GROUP BY ALL),
    a AS (SELECT host_id, arg_max(g, (ts, seq)) FILTER (g <> '') AS "group", arg_max(port, (ts, seq)) FILTER (port > 0) AS port, max(ts) AS last_seen, 'healthy' AS state FROM e GROUP BY ALL)
    SELECT * FROM a JOIN n USING (host_id)"""
)
def upsert_hosts(spark, sf_dir):
    out = H.upsert_hosts(registrations(spark, sf_dir), ("group",), ("port",), ("labels",))
    labels = F.array_join(F.transform(F.map_entries("labels"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return out.withColumn("labels", labels)


LIVE = f"v AS (SELECT host_id, max(ts) AS last_ts FROM s WHERE ts <= TIMESTAMP '{END}' GROUP BY ALL)"


def until_end(spark, sf_dir):
    return samples(spark, sf_dir).where(F.col("ts") <= bounds()[1])


@query(f"WITH {{S}}, {LIVE} SELECT host_id, last_ts, CASE WHEN last_ts < TIMESTAMP '{END}' - INTERVAL 14400 SECOND THEN 'offline' ELSE 'healthy' END AS state FROM v")
def liveness(spark, sf_dir):
    return H.liveness(until_end(spark, sf_dir), bounds()[1], 14_400)


@query(f"WITH {{S}}, {LIVE} SELECT host_id, last_ts FROM v WHERE last_ts < TIMESTAMP '{END}' - INTERVAL 28800 SECOND")
def stale_hosts(spark, sf_dir):
    return H.stale_hosts(until_end(spark, sf_dir), bounds()[1], 14_400)


@query(
    f"""WITH {{S}}, {LIVE}, t AS (SELECT host_id, last_ts, CASE WHEN last_ts < TIMESTAMP '{END}' - INTERVAL 14400 SECOND THEN 'offline' WHEN host_id LIKE '%7' THEN 'unhealthy' ELSE 'healthy' END AS state FROM v),
    q AS (SELECT host_id, last_ts, state, CASE WHEN state = 'unhealthy' AND last_ts < TIMESTAMP '{END}' - INTERVAL 600 SECOND THEN 'unhealthy_timeout' WHEN state = 'offline' AND last_ts < TIMESTAMP '{END}' - INTERVAL 28800 SECOND THEN 'offline_timeout' END AS reason FROM t)
    SELECT * FROM q WHERE reason IS NOT NULL"""
)
def auto_remove(spark, sf_dir):
    states = H.liveness(until_end(spark, sf_dir), bounds()[1], 14_400)
    states = states.withColumn("state", F.when((F.col("state") == "healthy") & F.col("host_id").endswith("7"), "unhealthy").otherwise(F.col("state")))
    return H.auto_remove(states, bounds()[1], 600, 14_400)


@query(
    f"""WITH {{R}}, {LATEST}, {OVER}, c AS (SELECT host_id, seq, metric AS chk, value < 150 AS ok FROM l), f AS (SELECT host_id, arg_min(chk, seq) FILTER (NOT ok) AS failed FROM c GROUP BY ALL),
    m AS (SELECT f.host_id, coalesce('high ' || reason, 'failed ' || failed) AS message FROM f LEFT JOIN w USING (host_id)) SELECT host_id, CASE WHEN message IS NULL THEN 'healthy' ELSE 'unhealthy' END AS state, message FROM m"""
)
def health_state(spark, sf_dir):
    r = resources(spark, sf_dir)
    checks = W.latest(r).select("host_id", F.col("seq").alias("ord"), F.col("metric").alias("check"), (F.col("value") < 150).alias("ok"))
    return H.health_state(checks, L.over_threshold_hosts(r))


@query("WITH {S}, m AS (SELECT host_id, arg_max(metric = 'error', (ts, seq)) AS o FROM s WHERE metric IN ('error', 'signup') GROUP BY ALL) SELECT host_id, CASE WHEN o THEN 'maintenance' ELSE 'healthy' END AS state FROM m")
def maintenance(spark, sf_dir):
    s = samples(spark, sf_dir).where("metric in ('error', 'signup')")
    return H.maintenance(s.select("host_id", "ts", "seq", (F.col("metric") == "error").alias("on")))


STATES = f"t AS (SELECT host_id, CASE WHEN last_ts < TIMESTAMP '{END}' - INTERVAL 14400 SECOND THEN 'offline' WHEN host_id LIKE '%7' THEN 'unhealthy' WHEN host_id LIKE '%9' THEN 'maintenance' ELSE 'healthy' END AS state, CAST(substr(host_id, 6) AS BIGINT) AS load FROM v)"


def states(spark, sf_dir):
    rows = H.liveness(until_end(spark, sf_dir), bounds()[1], 14_400)
    state = F.when(F.col("state") == "offline", "offline").when(F.col("host_id").endswith("7"), "unhealthy").when(
        F.col("host_id").endswith("9"), "maintenance"
    ).otherwise("healthy")
    return rows.select("host_id", state.alias("state"), F.substr("host_id", F.lit(6)).cast("long").alias("load"))


@query(f"WITH {{S}}, {LIVE}, {STATES} SELECT count(*) AS total, {', '.join(f'count(*) FILTER (state = {n!r}) AS {n}' for n in ('healthy', 'unhealthy', 'offline', 'maintenance'))} FROM t")
def host_state_counts(spark, sf_dir):
    return A.state_counts(states(spark, sf_dir))


@query(f"WITH {{S}}, {LIVE}, {STATES}, {HOSTS}, c AS (SELECT zone, count(*) AS total, count(*) FILTER (state = 'healthy') AS active FROM t JOIN h USING (host_id) GROUP BY ALL) SELECT zone, total, active, CASE WHEN active = 0 THEN 'unhealthy' WHEN active < total // 2 THEN 'degraded' ELSE 'healthy' END AS status FROM c")
def cluster_health(spark, sf_dir):
    rows = states(spark, sf_dir).join(hosts(spark, sf_dir).select("host_id", "zone"), "host_id")
    return A.cluster_health(rows.withColumn("active", F.col("state") == "healthy"), ("zone",))


@query(f"WITH {{S}}, {LIVE}, {STATES}, k AS (SELECT host_id, load, row_number() OVER (ORDER BY load, host_id) AS n FROM t WHERE state = 'healthy') SELECT host_id, load FROM k WHERE n > 20")
def scale_down_candidates(spark, sf_dir):
    return K.scale_down_candidates(states(spark, sf_dir), 20)


TIME_RULES = (
    (1, "night", "00:00", "05:59", [0, 6], 3, 50, "scale_down"), (2, "noon", "12:00", "12:59", [1, 3, 5], 3, 1000, "scale_up"),
    (3, "hold", "12:00", "18:00", [1], 3, 50, "maintain")
)
TIME_RULES_SQL = f"y(ord, name, start_time, end_time, days, min_hosts, max_hosts, action) AS (VALUES {', '.join(map(str, TIME_RULES))})"
RULED = f"""{TIME_RULES_SQL}, k AS (SELECT ts, ord, action, 'time_based_rule:' || name AS reason, CASE WHEN action = 'scale_up' AND hosts < max_hosts THEN least(hosts + 1, max_hosts) WHEN action = 'scale_down' AND hosts > min_hosts THEN greatest(hosts - 1, min_hosts) ELSE hosts END AS target
      FROM l JOIN y ON list_contains(days, dayofweek(ts)) AND strftime(ts, '%H:%M') BETWEEN start_time AND end_time),
    a AS (SELECT ts, arg_min(action, ord) AS rule_action, arg_min(reason, ord) AS rule_reason, arg_min(target, ord) AS rule_target FROM k GROUP BY ALL)"""


def time_rule_table(spark):
    return spark.createDataFrame(
        TIME_RULES, "ord int, name string, start_time string, end_time string, days array<int>, min_hosts long, max_hosts long, action string"
    )


def scored(spark, sf_dir):
    load = load_of(spark, sf_dir)
    return P.time_rules(W.load_forecast(load).withColumn("healthy", F.col("hosts")), time_rule_table(spark))


def load_of(spark, sf_dir):
    return P.load_score(P.fleet_load(resources(spark, sf_dir), "6 hours"), 0.1, 100.0)


@query(f"WITH {{R}}, {LOAD}, {RULED} SELECT ts, hosts, rule_action, rule_reason, rule_target FROM l LEFT JOIN a USING (ts)")
def time_rules(spark, sf_dir):
    return scored(spark, sf_dir).select("ts", "hosts", "rule_action", "rule_reason", "rule_target")


PROPOSED = f"""{RULED}, f AS (SELECT *, greatest(score, avg(score) OVER (ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) AS load FROM l LEFT JOIN a USING (ts)),
    p AS (SELECT ts, hosts, CASE WHEN coalesce(rule_action, 'none') <> 'none' THEN rule_action WHEN hosts * 0.5 > 18 THEN 'scale_down' WHEN load < 75 AND hosts > 3 THEN 'scale_down' WHEN load > 50 AND hosts < 100 THEN 'scale_up' ELSE 'none' END AS action,
      CASE WHEN coalesce(rule_action, 'none') <> 'none' THEN rule_reason WHEN hosts * 0.5 > 18 THEN 'cost_optimization' WHEN load < 75 AND hosts > 3 THEN 'low_load' WHEN load > 50 AND hosts < 100 THEN 'high_load' ELSE '' END AS reason,
      CAST(CASE WHEN coalesce(rule_action, 'none') <> 'none' THEN rule_target WHEN hosts * 0.5 > 18 THEN hosts - 1 WHEN load < 75 AND hosts > 3 THEN greatest(hosts - 1, 3) WHEN load > 50 AND hosts < 100 THEN least(hosts + 1, 100) ELSE hosts END AS BIGINT) AS target FROM f)"""
SCALING = P.Scaling(scale=100.0, cost_per_hour=0.5, budget=18.0, cooldown_s=86_400)


@query(f"WITH {{R}}, {LOAD}, {PROPOSED} SELECT * FROM p")
def scaling_proposals(spark, sf_dir):
    return P.proposed(scored(spark, sf_dir), SCALING).select("ts", "hosts", "action", "reason", "target")


@query(
    f"""WITH RECURSIVE {{R}}, {LOAD}, {PROPOSED}, n AS (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM p), z AS (
      SELECT i, ts, hosts, action, reason, target, CASE WHEN action <> 'none' THEN ts END AS last FROM n WHERE i = 1
      UNION ALL SELECT n.i, n.ts, n.hosts, CASE WHEN n.ts < z.last + INTERVAL 1 DAY THEN 'none' ELSE n.action END, CASE WHEN n.ts < z.last + INTERVAL 1 DAY OR n.action = 'none' THEN '' ELSE n.reason END,
        CASE WHEN n.ts < z.last + INTERVAL 1 DAY OR n.action = 'none' THEN n.hosts ELSE n.target END, CASE WHEN n.ts < z.last + INTERVAL 1 DAY OR n.action = 'none' THEN z.last ELSE n.ts END FROM z JOIN n ON n.i = z.i + 1)
    SELECT ts, action, reason, target FROM z"""
)
def scaling_decisions(spark, sf_dir):
    rows = P.proposed(scored(spark, sf_dir), SCALING)
    return P.scaling_decisions(rows, SCALING.cooldown_s)


@query(f"WITH {{R}}, {LOAD} SELECT ts, hosts, hosts * 0.5 > 18 AS over_budget FROM l")
def cost_decision(spark, sf_dir):
    return load_of(spark, sf_dir).select("ts", "hosts", P.cost_decision(F.col("hosts"), SCALING).alias("over_budget"))


NODES = ("node1", "node2", "node3", "node4")

#: CRC-32 in SQL: the table of its 256 steps, and the fold of a text's bytes.
CRC_TABLE = "g AS (SELECT list(r ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END) AS r FROM range(256) x(i)))"


def crc_sql(text):
    codes = f"list_transform(range(length({text})), lambda j: CAST(ord(substr({text}, CAST(j + 1 AS BIGINT), 1)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda s, b: xor(s // 256, tab[CAST(xor(s % 256, b) + 1 AS INTEGER)])), 4294967295)"


def ring_sql(name, nodes):
    """The points of a ring, h and node, 50 a node."""
    return f"{name} AS (SELECT {crc_sql('p')} AS h, node FROM (SELECT CAST(i AS VARCHAR) || node AS p, node FROM range(50) x(i), (SELECT unnest({list(nodes)}) AS node)), g)"


def owner_sql(ring):
    """The node of column crc of k: of the first point from there on, else of the ring's first."""
    return f"k ASOF LEFT JOIN {ring} ON k.crc <= {ring}.h"


KEYS = f"k AS (SELECT key, seq, {crc_sql('key')} AS crc FROM (SELECT host_id || ':' || CAST(floor(epoch(ts)) AS BIGINT) AS key, seq FROM s), g)"
SHARDS = f"{{S}}, {CRC_TABLE}, {KEYS}, {ring_sql('ring', NODES)}, o AS (SELECT key, seq, crc, coalesce(node, (SELECT arg_min(node, h) FROM ring)) AS node FROM {owner_sql('ring')})"


def shard_keys(spark, sf_dir):
    s = samples(spark, sf_dir)
    return s.select(F.concat_ws(":", "host_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")).alias("key"), "seq")


@query(f"WITH {SHARDS} SELECT key, seq, crc, node FROM o")
def assign_shards(spark, sf_dir):
    return D.assign_shards(shard_keys(spark, sf_dir), NODES)


@query(
    f"""WITH {SHARDS}, w AS (SELECT p.h, q.node, min((q.h - p.h + 4294967296) % 4294967296) AS way FROM ring p, ring q GROUP BY ALL), n AS (SELECT h, string_agg(node, ',' ORDER BY way) AS nodes FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY way) <= 3) GROUP BY h),
    a AS (SELECT key, seq, crc, coalesce(ring.h, (SELECT min(h) FROM ring)) AS h FROM {owner_sql('ring')}) SELECT key, seq, crc, nodes FROM a JOIN n USING (h)"""
)
def assign_replicas(spark, sf_dir):
    return D.assign_replicas(shard_keys(spark, sf_dir), NODES, replicas=3).withColumn("nodes", F.array_join("nodes", ","))


@query(
    f"""WITH {SHARDS}, {ring_sql('less', NODES[:3])}, b AS (SELECT key, seq, coalesce(node, (SELECT arg_min(node, h) FROM less)) AS node_after FROM {owner_sql('less')})
    SELECT o.key, node AS node_before, node_after FROM o JOIN b USING (seq) WHERE node <> node_after"""
)
def rebalance(spark, sf_dir):
    return D.rebalance(shard_keys(spark, sf_dir), NODES, NODES[:3])


@query(f"WITH {SHARDS}, n AS (SELECT node, count(*) AS keys FROM o GROUP BY ALL) SELECT node, 50 AS points, keys, round(keys / avg(keys) OVER (), 9) AS skew FROM n")
def shard_distribution(spark, sf_dir):
    return D.shard_distribution(D.assign_shards(shard_keys(spark, sf_dir), NODES)).withColumn("skew", F.round("skew", 9))


FOLD = """c AS (SELECT event_id AS idx, 'k' || user_id AS key, CASE event_type WHEN 'signup' THEN 'SET' WHEN 'error' THEN 'DELETE' WHEN 'view' THEN 'UPDATE' WHEN 'click' THEN 'INCREMENT' ELSE 'SET' END AS op, CAST(floor(value) AS BIGINT) AS value FROM events),
    l AS (SELECT key, max(idx) FILTER (op IN ('SET', 'DELETE')) AS f FROM c GROUP BY ALL), t AS (SELECT c.* FROM c JOIN l USING (key) WHERE idx >= f),
    d AS (SELECT key FROM t WHERE op = 'DELETE'), u AS (SELECT key, max(idx) FILTER (op IN ('SET', 'UPDATE')) AS f FROM t WHERE key NOT IN (SELECT key FROM d) GROUP BY ALL)"""


@query(f"WITH {FOLD} SELECT t.key, CAST(sum(value) AS BIGINT) AS value FROM t JOIN u USING (key) WHERE idx >= u.f GROUP BY ALL")
def fold_changelog(spark, sf_dir):
    return G.fold_changelog(changelog(spark, sf_dir))


@query(f"WITH {FOLD} SELECT t.key, CAST(sum(value) AS BIGINT) AS value FROM t JOIN u USING (key) WHERE idx >= u.f GROUP BY ALL")
def fold_compacted_log(spark, sf_dir):
    log = changelog(spark, sf_dir)
    return G.fold_changelog(G.log_compaction(log, 5000))


@query(
    """WITH m AS (SELECT CASE WHEN event_type = 'error' THEN 'alerts' ELSE 'metrics' END AS topic, ts, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'processed' ELSE 'failed' END AS status FROM events)
    SELECT topic, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'failed') AS failed, max(ts) AS last_ts FROM m GROUP BY ALL"""
)
def topic_stats(spark, sf_dir):
    status = F.element_at(F.array(F.lit("pending"), F.lit("processed"), F.lit("failed")), (F.col("id") % 3 + 1).cast("int"))
    return A.topic_stats(messages(spark, sf_dir).withColumn("status", status))


@query(
    f"""WITH {{S}}, w AS (SELECT host_id, max(ts) AS last_ts FROM s WHERE ts <= TIMESTAMP '{END}' - INTERVAL 12 HOUR AND host_id NOT LIKE '%3' GROUP BY ALL),
    q AS (SELECT s.*, ts >= coalesce(last_ts + INTERVAL 1 SECOND, TIMESTAMP '{END}' - INTERVAL 3600 SECOND) AS new FROM s LEFT JOIN w USING (host_id) WHERE ts <= TIMESTAMP '{END}'),
    k AS (SELECT * FROM q WHERE new OR ts >= TIMESTAMP '{END}' - INTERVAL 86400 SECOND), z AS (SELECT *, bool_or(new) OVER (PARTITION BY host_id) AS a FROM k)
    SELECT host_id, metric, ts, value, '' AS unit, seq FROM z WHERE new OR NOT a"""
)
def incremental_pull(spark, sf_dir):
    s = samples(spark, sf_dir)
    water = s.where((F.col("ts") <= bounds()[1] - F.expr("INTERVAL 12 HOURS")) & ~F.col("host_id").endswith("3")).groupBy("host_id").agg(F.max("ts").alias("last_ts"))
    return H.incremental_pull(s, water, bounds()[1], 3600, 86_400)


