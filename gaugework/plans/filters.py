"""Queries on filters, derived metrics, keys and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions import columns as C
from gaugework.functions import vectors as V
from gaugework.model import hosts, samples, table
from gaugework.operators import filters as O
from gaugework.operators.aggregates import rule_stats as rule_stats_of
from gaugework.operators.rules import classify_by_prefix as classify
from gaugework.plans.series import END, START, bounds, rounded
from gaugework.registry import query

ALL = "host_id, metric, ts, value, '' AS unit, seq"


@query(f"WITH {{S}} SELECT {ALL} FROM s WHERE ts > TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'")
def time_range(spark, sf_dir):
    return O.time_range(samples(spark, sf_dir), *bounds(), "neither")


@query(f"WITH {{S}} SELECT {ALL} FROM s WHERE host_id = 'host-7' AND ts = (SELECT max(ts) FROM s WHERE host_id = 'host-7')")
def point_lookup(spark, sf_dir):
    s = samples(spark, sf_dir)
    last = s.where("host_id = 'host-7'").agg(F.max("ts")).first()[0]
    return O.point_lookup(s, "host-7", F.lit(last).cast("timestamp_ntz"))


@query(f"WITH {{S}} SELECT {ALL} FROM s WHERE metric IN ('click', 'view')")
def metric_filter(spark, sf_dir):
    return O.metric_filter(samples(spark, sf_dir), "click", "view")


@query(f"WITH {{S}} SELECT {ALL} FROM s WHERE host_id IN ('host-1', 'host-2')")
def host_filter(spark, sf_dir):
    return O.host_filter(samples(spark, sf_dir), "host-1", "host-2")


HOSTS = """h AS (SELECT 'host-' || c_custkey AS host_id, c_name AS hostname, concat_ws('.', '10', (c_custkey // 65536) % 256, (c_custkey // 256) % 256, c_custkey % 300) AS ip,
  c_mktsegment AS "group", n_name AS location, r_name AS zone, CAST(c_custkey % 16 + 1 AS INTEGER) AS cpu_count, c_custkey AS ord
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey IN (SELECT user_id FROM events))"""


@query(f"WITH {HOSTS} SELECT host_id, \"group\", location FROM h WHERE \"group\" = 'BUILDING' AND zone = 'ASIA'")
def hosts_by(spark, sf_dir):
    rows = hosts(spark, sf_dir).withColumn("tags", F.create_map(F.lit("zone"), F.col("zone")))
    return O.hosts_by(rows, group="BUILDING", tag=("zone", "ASIA")).select("host_id", "group", "location")


@query(f"WITH {HOSTS} SELECT host_id, ip FROM h WHERE ord % 300 <= 255 ORDER BY ord LIMIT 100")
def validate_hosts(spark, sf_dir):
    return O.validate_hosts(hosts(spark, sf_dir), 100).select("host_id", "ip")


NAMES = (
    "cpu.usage", "memory.usage", "network.bandwidth.eth0", "network.rx_bytes.eth0", "network.tx_bytes.eth0", "network.connections.tcp",
    "memory.total", "memory.used", "memory.free", "disk.usage./", "disk.total./", "disk.used./", "disk.free./", "network.rx_bytes_avg.eth0", "load"
)


def raw_names(spark, sf_dir):
    """Samples with names as agents give them, by order of arrival."""
    return samples(spark, sf_dir).withColumn("metric", F.element_at(F.array(*map(F.lit, NAMES)), (F.col("seq") % len(NAMES) + 1).cast("int")))


RAW = f"q AS (SELECT host_id, [{', '.join(repr(n) for n in NAMES)}][CAST(seq % {len(NAMES)} + 1 AS INTEGER)] AS metric, ts, value, seq FROM s)"


CANON = f"""{RAW}, c AS (SELECT host_id, ts, seq, CASE WHEN metric = 'cpu.usage' THEN 'cpu_usage' WHEN metric = 'memory.usage' THEN 'memory_usage' WHEN metric LIKE 'network.bandwidth.%' THEN 'network_traffic'
      WHEN metric LIKE 'network.rx\\_bytes.%' ESCAPE '\\' THEN 'network_rx' WHEN metric LIKE 'network.tx\\_bytes.%' ESCAPE '\\' THEN 'network_tx' WHEN metric LIKE 'network.connections.%' THEN 'network_connections'
      WHEN metric LIKE 'memory.%' THEN replace(metric, '.', '_') WHEN metric LIKE 'disk.%' THEN 'disk_' || split_part(metric, '.', 2) ELSE metric END AS metric,
      round(CASE WHEN metric LIKE 'network.bandwidth.%' OR metric IN ('memory.total', 'memory.used', 'memory.free') THEN value / 1048576 WHEN metric IN ('network.rx_bytes.eth0', 'network.tx_bytes.eth0') THEN value / 1024
      WHEN metric IN ('disk.total./', 'disk.used./', 'disk.free./') THEN value / 1073741824 ELSE value END, 12) AS value,
      CASE WHEN metric LIKE 'network.bandwidth.%' THEN 'MB/s' WHEN metric IN ('network.rx_bytes.eth0', 'network.tx_bytes.eth0') THEN 'KB/s' WHEN metric IN ('memory.total', 'memory.used', 'memory.free', 'disk.total./', 'disk.used./', 'disk.free./') THEN 'GB' ELSE '' END AS unit,
      CASE WHEN metric IN ('network.bandwidth.eth0', 'network.rx_bytes.eth0', 'network.tx_bytes.eth0') THEN 'eth0' WHEN metric = 'network.connections.tcp' THEN 'tcp' WHEN metric LIKE 'disk.%' THEN '/' ELSE '' END AS instance FROM q)"""


@query(f"WITH {{S}}, {CANON} SELECT host_id, seq, metric, value, unit, instance FROM c")
def canonicalise(spark, sf_dir):
    return rounded(O.canonicalise(raw_names(spark, sf_dir)).select("host_id", "seq", "metric", "value", "unit", "instance"), "value", places=12)


@query("WITH {S} SELECT host_id, metric, seq, value FROM (SELECT host_id, CASE WHEN seq % 10 = 0 THEN '' ELSE metric END AS metric, seq, CASE WHEN seq % 7 = 0 THEN -value ELSE value END AS value FROM s) WHERE metric <> '' AND value >= 0")
def validate_samples(spark, sf_dir):
    s = samples(spark, sf_dir)
    odd = s.withColumns({
        "metric": F.when(s["seq"] % 10 == 0, "").otherwise(s["metric"]), "value": F.when(s["seq"] % 7 == 0, -s["value"]).otherwise(s["value"])
    })
    return O.validate_samples(odd).select("host_id", "metric", "seq", "value")


RULES = (("host-1*", "ones"), ("host-12", "twelve"), ("host-*", "any"), ("host-3", "three"))
RULES_SQL = f"u(prefix, category) AS (VALUES {', '.join(map(str, RULES))})"


def rules(spark):
    return spark.createDataFrame(RULES, "prefix string, category string")


@query(f"WITH {{S}}, {RULES_SQL} SELECT DISTINCT host_id AS key, category FROM s LEFT JOIN u ON prefix = host_id")
def exact_rule(spark, sf_dir):
    return O.exact_rule(samples(spark, sf_dir).select(F.col("host_id").alias("key")).distinct(), rules(spark))


@query(f"WITH {{S}}, {RULES_SQL}, m AS (SELECT host_id, max_by(category, length(rtrim(prefix, '*'))) AS category FROM (SELECT DISTINCT host_id FROM s) JOIN u ON starts_with(host_id, rtrim(prefix, '*')) GROUP BY ALL) SELECT host_id AS key, category FROM m")
def classify_by_prefix(spark, sf_dir):
    return classify(samples(spark, sf_dir).select(F.col("host_id").alias("key")).distinct(), rules(spark))


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'http://th')")
def prefix_search(spark, sf_dir):
    return O.prefix_search(table(spark, sf_dir, "pages").select("page_id", "url"), "http://th", "url")


@query("WITH p(prefix) AS (VALUES ('small'), ('red w'), ('zzz')) SELECT prefix, count(p_name) AS n, count(p_name) > 0 AS found FROM p LEFT JOIN part ON starts_with(p_name, prefix) GROUP BY ALL")
def prefix_exists(spark, sf_dir):
    asked = spark.createDataFrame([("small",), ("red w",), ("zzz",)], "prefix string")
    return O.prefix_exists(table(spark, sf_dir, "part").select("p_name"), asked, "p_name")


@query("SELECT count(*) AS rules, CAST(max(length(p_type)) AS INTEGER) AS longest, count(DISTINCT substr(p_type, 1, 1)) AS first_chars FROM (SELECT DISTINCT p_type FROM part)")
def rule_stats(spark, sf_dir):
    return rule_stats_of(table(spark, sf_dir, "part").select(F.col("p_type").alias("prefix")).distinct())


@query("WITH {S} SELECT seq, CASE seq % 7 WHEN 0 THEN value > 50 WHEN 1 THEN value >= 50 WHEN 2 THEN value < 50 WHEN 3 THEN value <= 50 WHEN 4 THEN value = 50 WHEN 5 THEN value <> 50 ELSE false END AS hit FROM s")
def threshold_predicate(spark, sf_dir):
    op = F.element_at(F.array(*map(F.lit, [">", ">=", "<", "<=", "==", "!=", "~"])), (F.col("seq") % 7 + 1).cast("int"))
    return samples(spark, sf_dir).select("seq", C.threshold_predicate(F.col("value"), op, F.lit(50.0)).alias("hit"))


@query("WITH {S}, q AS (SELECT seq, CASE seq % 4 WHEN 0 THEN value * 10000 + 37 WHEN 1 THEN value * 100 + 0.3 WHEN 2 THEN (value + 0.003) / 100000 ELSE value END AS v FROM s) SELECT seq, CASE WHEN v >= 1e6 THEN format('{:.2f}M', v / 1e6) WHEN v >= 1e3 THEN format('{:.2f}K', v / 1e3) WHEN v > 0 AND v < 0.01 THEN format('{:.6f}', v) ELSE format('{:.4f}', v) END AS shown FROM q")
def si_format(spark, sf_dir):
    v = F.when(F.col("seq") % 4 == 0, F.col("value") * 10000 + 37).when(F.col("seq") % 4 == 1, F.col("value") * 100 + 0.3).when(
        F.col("seq") % 4 == 2, (F.col("value") + 0.003) / 100000
    ).otherwise(F.col("value"))
    rows = samples(spark, sf_dir).select("seq", v.alias("v"))
    return rows.select("seq", C.si_format(F.col("v")).alias("shown"))


GAUGES = (
    "memory_usage", "memory_total", "memory_used", "memory_available", "disk_total", "disk_free", "network_traffic", "network_rx", "network_tx",
    "swap_total", "swap_free"
)


def scrapes(spark, sf_dir):
    """Samples as gauges, a host's day as one scrape: the last of each gauge counts by its arrival."""
    name = F.element_at(F.array(*map(F.lit, GAUGES)), (F.col("seq") % len(GAUGES) + 1).cast("int"))
    return samples(spark, sf_dir).select("host_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), name.alias("metric"), "value")


G = f"g AS (SELECT host_id, date_trunc('day', ts)::TIMESTAMP AS ts, [{', '.join(repr(n) for n in GAUGES)}][CAST(seq % {len(GAUGES)} + 1 AS INTEGER)] AS metric, value FROM s)"
P = "p AS (SELECT host_id, ts, " + ", ".join(f"max(value) FILTER (metric = '{g}') AS {g}" for g in GAUGES) + " FROM g GROUP BY ALL)"


@query(
    f"""WITH {{S}}, {G}, {P}, q AS (SELECT *, coalesce(memory_used, memory_total - memory_available) AS used, swap_total - swap_free AS swap FROM p)
    SELECT host_id, ts, round(coalesce(memory_usage, CASE WHEN memory_total > 0 THEN used / memory_total * 100 END), 6) AS memory_usage, round(used, 6) AS memory_used, round(swap, 6) AS swap_used,
      round(CASE WHEN swap_total > 0 THEN swap / swap_total * 100 END, 6) AS swap_usage FROM q"""
)
def memory_usage_fallback(spark, sf_dir):
    return rounded(O.memory_usage_fallback(scrapes(spark, sf_dir)), "memory_usage", "memory_used", "swap_used", "swap_usage")


@query(f"WITH {{S}}, {G}, {P} SELECT host_id, ts, round(disk_total - disk_free, 6) AS disk_used, round(CASE WHEN disk_total = 0 THEN 0 ELSE (disk_total - disk_free) / disk_total * 100 END, 6) AS disk_usage FROM p")
def disk_usage(spark, sf_dir):
    return rounded(O.disk_usage(scrapes(spark, sf_dir)), "disk_used", "disk_usage")


@query(
    f"""WITH {{S}}, {G} SELECT host_id, ts, round(coalesce(sum(value) FILTER (metric = 'network_traffic'),
      (coalesce(sum(value) FILTER (metric = 'network_rx'), 0) + coalesce(sum(value) FILTER (metric = 'network_tx'), 0)) / 1024), 6) AS network_total FROM g GROUP BY ALL"""
)
def network_total(spark, sf_dir):
    return rounded(O.network_total(scrapes(spark, sf_dir)), "network_total")


@query("WITH {S} SELECT seq, host_id || ':' || metric || ':' || CAST(floor(epoch(ts) / 3600) AS BIGINT) AS alert_key, 'metrics:' || host_id || ':' || CAST(floor(epoch(ts)) AS BIGINT) AS storage_key, host_id AS key_host, CAST(floor(epoch(ts)) AS BIGINT) AS key_ts, round(value / 500 * 100, 6) AS percentage FROM s")
def keys_and_units(spark, sf_dir):
    s = samples(spark, sf_dir)
    rows = s.select(
        "seq", C.alert_key(s["host_id"], s["metric"], s["ts"]).alias("alert_key"), C.storage_key(s["host_id"], s["ts"]).alias("storage_key"),
        F.round(C.to_percentage(s["value"], F.lit(500.0)), 6).alias("percentage")
    )
    host, ts = C.storage_key_parts(F.col("storage_key"))
    return rows.withColumns({"key_host": host, "key_ts": ts})


@query("WITH {S} SELECT seq, make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS parsed FROM s")
def rfc3339_times(spark, sf_dir):
    text = samples(spark, sf_dir).select("seq", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("t"))
    return text.select("seq", C.rfc3339(F.col("t")).cast("timestamp_ntz").alias("parsed"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"a\":\"1\",\"k\":\"' || CAST(json_extract(props, '$.k') AS VARCHAR) || '\"}' AS merged FROM events")
def json_and_maps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("k"), F.lit("0"))
    new = F.create_map(F.lit("k"), F.col("p.k").cast("string"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json(C.merged_maps(old, new)).alias("merged"))


def vector_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.select("vec_id", F.col("embedding").alias("a")).join(b, "vec_id")


PAIRS = "WITH v AS (SELECT x.vec_id, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"


@query(
    f"""{PAIRS}, z AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y, generate_subscripts(a, 1) - 1 AS pos FROM v)
    SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST(x + y AS DOUBLE) AS added, CAST(x - y AS DOUBLE) AS subtracted, CAST(x * y AS DOUBLE) AS multiplied FROM z"""
)
def vector_elementwise(spark, sf_dir):
    p, a, b = vector_pairs(spark, sf_dir), F.col("a"), F.col("b")
    made = {"added": V.vec_add(a, b), "subtracted": V.vec_sub(a, b), "multiplied": V.vec_mul(a, b)}
    each = p.select("vec_id", F.posexplode(F.arrays_zip(*(c.alias(n) for n, c in made.items()))))
    return each.select("vec_id", "pos", *(F.col(f"col.{n}").cast("double").alias(n) for n in made))


@query(f"{PAIRS}, z AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y FROM v) SELECT vec_id, round(sum(x::DOUBLE * y::DOUBLE), 4) AS dot FROM z GROUP BY ALL")
def vector_dot(spark, sf_dir):
    return vector_pairs(spark, sf_dir).select("vec_id", F.round(V.vec_dot(F.col("a"), F.col("b")), 4).alias("dot"))


@query("WITH z AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, round(sum(x), 4) AS total, round(max(x), 6) AS most, round(min(x), 6) AS least FROM z GROUP BY ALL")
def vector_reductions(spark, sf_dir):
    a = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(V.vec_sum(a), 4).alias("total"), F.round(V.vec_max(a), 6).alias("most"), F.round(V.vec_min(a), 6).alias("least")
    )
