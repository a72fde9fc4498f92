"""Queries on windows: sliding statistics, rates, forecasts, changes; and on the shape of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.model import SERIES, counters, resources, samples
from gaugework.operators import chunks as Z
from gaugework.operators import windows as W
from gaugework.operators.capacity import fleet_load, load_score
from gaugework.operators.filters import keep_last_n as last_n
from gaugework.plans.series import rounded
from gaugework.registry import query

STAT_COLUMNS = ("sum", "avg", "std_dev", "variance", "rate")


@query(
    """WITH {S}, f AS (SELECT *, list({'t': epoch_us(ts) / 1e6, 'v': value}) OVER (PARTITION BY host_id, metric ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS frame FROM s),
    g AS (SELECT *, list_filter(frame, lambda x: x.t >= epoch_us(ts) / 1e6 - 604800) AS kept FROM f), h AS (SELECT *, list_transform(kept, lambda x: x.v) AS v, len(kept) AS n FROM g),
    k AS (SELECT *, list_sort(v) AS o, list_sum(v) / n AS mean, kept[n].t - kept[1].t AS span FROM h)
    SELECT host_id, metric, ts, seq, CAST(n AS BIGINT) AS count, round(list_sum(v), 6) AS sum, round(mean, 6) AS avg, list_min(v) AS min, list_max(v) AS max,
      round(CASE WHEN n >= 2 THEN sqrt(list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) / n) ELSE 0 END, 6) AS std_dev,
      round(CASE WHEN n >= 2 THEN list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) / n ELSE 0 END, 6) AS variance,
      o[1 + (n - 1) * 50 // 100] AS median, o[1 + (n - 1) * 90 // 100] AS p90, o[1 + (n - 1) * 95 // 100] AS p95, o[1 + (n - 1) * 99 // 100] AS p99,
      round(CASE WHEN n >= 2 AND span > 0 THEN (kept[n].v - kept[1].v) / span ELSE 0 END, 6) AS rate, value AS last_value FROM k"""
)
def sliding_stats(spark, sf_dir):
    return rounded(W.sliding_stats(samples(spark, sf_dir), 10, 604_800), *STAT_COLUMNS)


C = """n AS (SELECT *, row_number() OVER (PARTITION BY host_id, metric ORDER BY ts, seq) AS i FROM s),
    c AS (SELECT host_id, metric, ts, seq, round(sum(value) OVER (PARTITION BY host_id, metric, i // 7 ORDER BY ts, seq), 2) AS value FROM n),
    d AS (SELECT *, lag(value) OVER w AS p, lag(ts) OVER w AS pt FROM c WINDOW w AS (PARTITION BY host_id, metric ORDER BY ts, seq)),
    e AS (SELECT host_id, metric, ts, seq, value < p AS reset, CASE WHEN value >= p THEN (value - p) / ((epoch_us(ts) - epoch_us(pt)) / 1e6) END AS rate FROM d WHERE pt IS NOT NULL)"""


@query(f"WITH {{S}}, {C} SELECT host_id, metric, ts, seq, round(rate, 8) AS rate, reset FROM e")
def counter_rates(spark, sf_dir):
    return rounded(W.counter_rates(counters(spark, sf_dir)), "rate", places=8)


@query(
    f"""WITH {{S}}, {C}, f AS (SELECT *, list({{'t': epoch_us(ts) / 1e6, 'v': rate}}) OVER (PARTITION BY host_id, metric ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS frame FROM e WHERE rate IS NOT NULL)
    SELECT host_id, metric, ts, seq, round(list_avg(list_transform(list_filter(frame, lambda x: x.t >= epoch_us(ts) / 1e6 - 604800), lambda x: x.v)), 8) AS avg FROM f"""
)
def bandwidth_avg(spark, sf_dir):
    return rounded(W.bandwidth_avg(counters(spark, sf_dir), 10, 604_800), "avg", places=8)


@query(
    """WITH j AS (SELECT 'host-' || user_id AS host_id, CAST(user_id % 4 AS BIGINT) AS core, ts, sum(CASE WHEN event_type = 'click' THEN floor(value) ELSE 0 END) OVER w AS idle, sum(floor(value)) OVER w AS total
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    d AS (SELECT *, idle - lag(idle) OVER v AS di, total - lag(total) OVER v AS dt FROM j WINDOW v AS (PARTITION BY host_id, core ORDER BY ts))
    SELECT host_id, core, ts, round(CASE WHEN dt = 0 THEN 0 ELSE 100 * (1 - di / dt) END, 6) AS usage FROM d WHERE dt IS NOT NULL"""
)
def cpu_usage(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("host_id").orderBy("ts", "seq")
    s = samples(spark, sf_dir).withColumn("v", F.floor("value").cast("double"))
    idle = F.sum(F.when(F.col("metric") == "click", F.col("v")).otherwise(0.0)).over(w)
    core = F.substr("host_id", F.lit(6)).cast("long") % 4
    return rounded(W.cpu_usage(s.select("host_id", core.alias("core"), "ts", idle.alias("idle"), F.sum("v").over(w).alias("total"))), "usage")


@query("WITH {S} SELECT host_id, metric, ts, value, '' AS unit, seq FROM s QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY ts DESC, seq DESC) <= 20")
def keep_last_n(spark, sf_dir):
    return last_n(samples(spark, sf_dir), 20)


@query("WITH {S} SELECT host_id, metric, ts, value, seq FROM s QUALIFY row_number() OVER (PARTITION BY host_id, metric ORDER BY ts DESC, seq DESC) = 1")
def latest(spark, sf_dir):
    return W.latest(samples(spark, sf_dir))


@query(
    """WITH {S}, q AS (SELECT DISTINCT host_id, metric, date_trunc('day', ts)::TIMESTAMP AS ts FROM s)
    SELECT q.host_id, q.metric, q.ts, s.value, s.ts AS at FROM q ASOF LEFT JOIN s ON q.host_id = s.host_id AND q.metric = s.metric AND q.ts >= s.ts"""
)
def latest_as_of(spark, sf_dir):
    s = samples(spark, sf_dir)
    return W.latest_as_of(s.select(*SERIES, F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).distinct(), s)


LOAD = """b AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, coalesce(avg(value) FILTER (metric = 'cpu_usage'), 0) AS cpu_usage, coalesce(avg(value) FILTER (metric = 'memory_usage'), 0) AS memory_usage,
      coalesce(avg(value) FILTER (metric = 'disk_usage'), 0) AS disk_usage, coalesce(avg(value) FILTER (metric = 'network_usage'), 0) AS network_usage,
      coalesce(CAST(sum(floor(value)) FILTER (metric = 'connections') AS BIGINT), 0) AS connections, count(DISTINCT host_id) AS hosts FROM r GROUP BY ALL),
    l AS (SELECT *, least((cpu_usage / 100 * 0.3 + memory_usage / 100 * 0.3 + disk_usage / 100 * 0.2 + network_usage / 100 * 0.2 + connections / (hosts * 1000) * 0.1) * 100, 100) AS score FROM b)"""


@query(f"WITH {{R}}, {LOAD} SELECT ts, hosts, connections, round(score, 6) AS score FROM l")
def load_score_backtest(spark, sf_dir):
    return rounded(load_score(fleet_load(resources(spark, sf_dir), "6 hours"), 0.1, 100.0).select("ts", "hosts", "connections", "score"), "score")


@query(f"WITH {{R}}, {LOAD} SELECT ts, round(score, 6) AS score, round(avg(score) OVER (ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS forecast FROM l")
def load_forecast(spark, sf_dir):
    scores = load_score(fleet_load(resources(spark, sf_dir), "6 hours"), 0.1, 100.0).select("ts", "score")
    return rounded(W.load_forecast(scores), "score", "forecast")


@query(
    """WITH {S}, t AS (SELECT host_id, ts, seq, CASE WHEN value > 100 THEN 'unhealthy' ELSE 'healthy' END AS state FROM s), d AS (SELECT *, lag(state) OVER (PARTITION BY host_id ORDER BY ts, seq) AS old_state FROM t)
    SELECT host_id, ts, old_state, state AS new_state FROM d WHERE old_state <> state"""
)
def state_changes(spark, sf_dir):
    s = samples(spark, sf_dir)
    return W.state_changes(s.select("host_id", "ts", "seq", F.when(s["value"] > 100, "unhealthy").otherwise("healthy").alias("state")))


@query(
    """WITH {S}, t AS (SELECT host_id, ts, seq, value < 60 AS ok FROM s), i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY host_id ORDER BY ts, seq) AS k FROM t),
    f AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY host_id, k ORDER BY ts, seq) AS failures FROM i)
    SELECT host_id, ts, seq, failures, CASE WHEN failures >= 3 THEN 'offline' ELSE 'online' END AS status FROM f"""
)
def consecutive_failures(spark, sf_dir):
    s = samples(spark, sf_dir)
    return W.consecutive_failures(s.select("host_id", "ts", "seq", (s["value"] < 60).alias("ok")))


D = """t AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t, lag(value) OVER w AS p FROM s WINDOW w AS (PARTITION BY host_id, metric ORDER BY ts, seq)),
    u AS (SELECT *, t - lag(t) OVER w AS step FROM t WINDOW w AS (PARTITION BY host_id, metric ORDER BY ts, seq)),
    v AS (SELECT *, CASE WHEN step IS NOT NULL THEN step - coalesce(lag(step) OVER w, 0) END AS dod FROM u WINDOW w AS (PARTITION BY host_id, metric ORDER BY ts, seq)),
    x AS (SELECT *, CASE WHEN dod IS NULL THEN 64 WHEN dod = 0 THEN 1 WHEN dod BETWEEN -63 AND 64 THEN 9 WHEN dod BETWEEN -255 AND 256 THEN 12 WHEN dod BETWEEN -2047 AND 2048 THEN 16 ELSE 68 END AS bits FROM v)"""


@query(
    f"""WITH {{S}}, {D} SELECT host_id, metric, count(*) AS n, {', '.join(f'count(*) FILTER (dod IS NOT NULL AND bits = {n}) AS n_{n}' for n in (1, 9, 12, 16, 68))},
      CAST(sum(bits) AS BIGINT) AS time_bits, round(count(*) FILTER (value = p) / count(*), 6) AS repeated FROM x GROUP BY ALL"""
)
def delta_profile(spark, sf_dir):
    return rounded(Z.delta_profile(samples(spark, sf_dir)), "repeated")


DW = D.replace("PARTITION BY host_id, metric", "PARTITION BY host_id, metric, w").replace("FROM s WINDOW", "FROM b WINDOW")
PRESSED = f"""b AS (SELECT *, time_bucket(INTERVAL 10 DAY, ts, TIMESTAMP '1970-01-01') AS w FROM s), {DW},
    y AS (SELECT *, bits + CASE WHEN p IS NULL THEN 64 WHEN p = value THEN 1 ELSE 14 + length(trim(xor(CAST(value AS BIT), CAST(p AS BIT))::VARCHAR, '0')) END AS point_bits FROM x),
    z AS (SELECT host_id, metric, w AS "window", count(*) AS n, CAST(ceil(sum(point_bits) / 8) AS BIGINT) AS bytes FROM y GROUP BY ALL), c AS (SELECT *, n * 16 / bytes AS ratio FROM z WHERE n >= 4 AND n * 16 / bytes >= 1.0)"""


@query(f"WITH {{S}}, {PRESSED} SELECT host_id, metric, \"window\", n, bytes, ratio FROM c")
def compressibility(spark, sf_dir):
    return Z.compressibility(samples(spark, sf_dir), "10 days", 4, 1.0)


@query(
    f"""WITH {{S}}, {PRESSED} SELECT count(*) AS windows, CAST(sum(n * 16) AS BIGINT) AS original_bytes, CAST(sum(bytes) AS BIGINT) AS compressed_bytes, round(avg(ratio), 9) AS avg_ratio,
      round(1 - sum(bytes) / sum(n * 16), 9) AS savings FROM c"""
)
def compression_stats(spark, sf_dir):
    stats = Z.compression_stats(Z.compressibility(samples(spark, sf_dir), "10 days", 4, 1.0))
    return stats.withColumns({c: F.round(c, 9) for c in ("avg_ratio", "savings")})


@query("WITH {S} SELECT host_id, metric, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window, count(*)::INT AS n FROM s GROUP BY ALL")
def pack_chunks(spark, sf_dir):
    return Z.pack_chunks(samples(spark, sf_dir), "1 day").select("host_id", "metric", "window", "n")


@query("WITH {S} SELECT host_id, metric, ts, seq, value FROM s")
def unpack_chunks(spark, sf_dir):
    return Z.unpack_chunks(Z.pack_chunks(samples(spark, sf_dir), "1 day"))
