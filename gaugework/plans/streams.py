"""Queries that run a stream over the events table to its end (availableNow), write to a folder and read it again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.model import resources_of, samples, samples_of, table
from gaugework.operators import alerts as L
from gaugework.plans.series import rounded
from gaugework.plans.storage import payloads, sent
from gaugework.registry import query
from gaugework.session import work_dir
from gaugework.sources import kafka
from gaugework.sources import messages as M
from gaugework.sources import samples as stored
from gaugework.streaming import queries as Q
from gaugework.streaming import stateful as T

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file or folder by a pattern, as streams read no single file by its name."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")


def finished(stream: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream to its end; what it wrote, with times without a zone as in batch plans."""
    spark, out = stream.sparkSession, work_dir(stream.sparkSession, "stream")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream.writeStream.format("parquet").option(
        "checkpointLocation", f"{out}-state"
    ).option("path", out).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(out)
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in rows.dtypes if kind == "timestamp"})


def finished_sink(stream: DataFrame, sink: Callable[[DataFrame, int], None]) -> None:
    state = work_dir(stream.sparkSession, "stream")
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


@query(
    """WITH {S}, w AS (SELECT host_id, metric, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS bucket, count(value) AS count, round(sum(value), 6) AS sum, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM s GROUP BY ALL)
    SELECT * FROM w WHERE bucket + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM s)"""
)
def stream_bucket_stats(spark, sf_dir):
    return rounded(finished(Q.stream_bucket_stats(samples_of(events_stream(spark, sf_dir)), "1 day")), "sum", "avg")


@query("WITH {S} SELECT DISTINCT host_id, metric, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, true AS of_the_hour, true AS is_an_alert FROM s WHERE value > 20")
def stream_dedup_alerts(spark, sf_dir):
    """Which alert of an hour survives depends on their arrival; it must be one of them, as it was."""
    kept = finished(Q.stream_dedup_alerts(samples_of(events_stream(spark, sf_dir)).where("value > 20")))
    given = samples(spark, sf_dir).where("value > 20").select("seq", *(F.col(c).alias(f"own_{c}") for c in ("host_id", "metric", "ts", "value")))
    same = F.coalesce(
        (F.col("host_id") == F.col("own_host_id")) & (F.col("metric") == F.col("own_metric")) & (F.col("ts") == F.col("own_ts")) & (F.col("value") == F.col("own_value")),
        F.lit(False)
    )
    own = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) == F.col("hour")
    return kept.join(given, "seq", "left").select("host_id", "metric", "hour", own.alias("of_the_hour"), same.alias("is_an_alert"))


@query(
    """WITH {S}, a AS (SELECT *, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour FROM s WHERE value > 20), m AS (SELECT max(epoch_ms(ts)) - 600000 AS mark FROM a)
    SELECT host_id, metric, hour, ts, value, seq FROM a, m WHERE (hour + 1) * 3600000 <= mark QUALIFY row_number() OVER (PARTITION BY host_id, metric, hour ORDER BY ts, seq) = 1"""
)
def stream_earliest_alerts(spark, sf_dir):
    return finished(Q.stream_earliest_alerts(samples_of(events_stream(spark, sf_dir)).where("value > 20")))


@query(
    """WITH {S}, l AS (SELECT host_id, metric, max(ts) AS ts, arg_max(value, (ts, seq)) AS value FROM s GROUP BY ALL)
    SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY value DESC, host_id) AS rank, host_id, value FROM l WHERE epoch_ms(ts) + 86400000 > (SELECT epoch_ms(max(ts)) - 600000 FROM s) QUALIFY rank <= 10"""
)
def stream_topk(spark, sf_dir):
    return T.merged_tops(finished(T.stream_topk(samples_of(events_stream(spark, sf_dir)), 10, 86_400)), 10)


@query(
    """WITH {S}, l AS (SELECT host_id, metric, max(ts) AS ts, arg_max(value, (ts, seq)) AS value FROM s GROUP BY ALL), v AS (SELECT *, max(ts) OVER (PARTITION BY metric) AS m FROM l)
    SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY value DESC, host_id) AS rank, host_id, value FROM v WHERE ts >= m - INTERVAL 1 DAY QUALIFY rank <= 10"""
)
def stream_topk_table(spark, sf_dir):
    out = work_dir(spark, "topk")
    finished_sink(samples_of(events_stream(spark, sf_dir)), Q.topk_sink(out, 10, 86_400))
    return spark.read.parquet(f"{out}/top")


@query(
    """WITH {S}, d AS (SELECT host_id, ts, lag(ts) OVER (PARTITION BY host_id ORDER BY ts, seq) AS p FROM s), g AS (SELECT * FROM d WHERE epoch_ms(ts) - epoch_ms(p) > 28800000),
    l AS (SELECT host_id, max(ts) AS t FROM s GROUP BY ALL)
    SELECT host_id, date_trunc('millisecond', p)::TIMESTAMP + INTERVAL 8 HOUR AS ts, 'offline' AS state FROM g UNION ALL SELECT host_id, date_trunc('millisecond', ts)::TIMESTAMP, 'healthy' FROM g
    UNION ALL SELECT host_id, date_trunc('millisecond', t)::TIMESTAMP + INTERVAL 8 HOUR, 'offline' FROM l WHERE epoch_ms(t) + 28800000 <= (SELECT epoch_ms(max(ts)) - 600000 FROM s)"""
)
def stream_liveness(spark, sf_dir):
    return finished(T.stream_liveness(samples_of(events_stream(spark, sf_dir)), 28_800))


@query(
    """WITH {R}, u(rule_id, metric, threshold) AS (VALUES ('cpu-high', 'cpu_usage', 80.0), ('cpu-critical', 'cpu_usage', 95.0), ('memory-high', 'memory_usage', 85.0), ('memory-critical', 'memory_usage', 95.0), ('disk-high', 'disk_usage', 90.0)),
    m AS (SELECT r.*, rule_id, value > threshold AS breach FROM r JOIN u USING (metric)), i AS (SELECT *, count(*) FILTER (NOT breach) OVER (PARTITION BY host_id, rule_id ORDER BY ts, seq) AS k FROM m),
    b AS (SELECT *, min(ts) FILTER (breach) OVER (PARTITION BY host_id, rule_id, k) AS start FROM i), f AS (SELECT host_id, rule_id, k, min(ts) AS ts FROM b WHERE breach AND epoch_ms(ts) - epoch_ms(start) >= 86400000 GROUP BY ALL)
    SELECT host_id, rule_id, date_trunc('millisecond', ts)::TIMESTAMP AS ts, 'firing' AS status FROM f
    UNION ALL SELECT f.host_id, f.rule_id, date_trunc('millisecond', min(i.ts))::TIMESTAMP, 'resolved' FROM f JOIN i ON f.host_id = i.host_id AND f.rule_id = i.rule_id AND i.k = f.k + 1 AND NOT i.breach GROUP BY f.host_id, f.rule_id, f.k"""
)
def stream_sustained_alerts(spark, sf_dir):
    rules = L.default_rules(spark).withColumn("duration_s", F.lit(86_400).cast("long"))
    return finished(T.stream_sustained_alerts(L.matched(resources_of(samples_of(events_stream(spark, sf_dir))), rules)))


@query(
    """WITH {S}, f AS (SELECT *, list({'t': epoch_ms(ts), 'v': value}) OVER (PARTITION BY host_id, metric ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS frame FROM s),
    h AS (SELECT *, list_transform(list_filter(frame, lambda x: x.t >= epoch_ms(ts) - 604800000), lambda x: x.v) AS v FROM f)
    SELECT host_id, metric, ts, CAST(len(v) AS BIGINT) AS count, round(list_sum(v), 6) AS sum, round(list_avg(v), 6) AS avg, list_min(v) AS min, list_max(v) AS max, round(list_stddev_pop(v), 6) AS std_dev, CAST(10 AS BIGINT) AS size FROM h"""
)
def stream_sliding_stats(spark, sf_dir):
    return rounded(finished(T.stream_sliding_stats(samples_of(events_stream(spark, sf_dir)), 10, 604_800)), "sum", "avg", "std_dev")


@query("WITH {S} SELECT host_id, metric, date_trunc('second', ts)::TIMESTAMP AS ts, value, CASE seq % 4 WHEN 0 THEN 'u' WHEN 1 THEN '%' ELSE '' END AS unit, seq FROM s WHERE seq % 4 <> 3")
def stream_ingest(spark, sf_dir):
    path, dead, source = (work_dir(spark, n) for n in ("ingested", "dead", "messages"))
    payloads(spark, sf_dir).withColumn("retries", F.lit(0)).write.parquet(source)
    stream = spark.readStream.schema("seq long, payload string, retries int").parquet(source)
    finished_sink(stream, Q.ingest_sink(path, dead))
    return stored.read_samples(spark, path)


@query("WITH {S} SELECT host_id, 'metrics' AS type, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, host_id AS of, metric AS name, value, '' AS unit FROM s")
def stream_live_push(spark, sf_dir):
    out = work_dir(spark, "pushed")
    finished_sink(samples_of(events_stream(spark, sf_dir)), Q.push_sink(lambda rows, k: rows.write.mode("overwrite").parquet(f"{out}/batch={k}")))
    return sent(spark.read.parquet(out))


@query(
    """WITH {S}, t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY host_id, metric ORDER BY ts DESC, seq DESC) <= 100),
    a AS (SELECT host_id, metric, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd, arg_max(value, (ts, seq)) AS last FROM t GROUP BY ALL HAVING count(*) >= 10)
    SELECT host_id, metric, n, last, round(abs(last - mean) / sd, 6) AS score FROM a WHERE sd > 0 AND abs(last - mean) / sd > 2"""
)
def stream_anomaly(spark, sf_dir):
    state, out = work_dir(spark, "tail"), work_dir(spark, "anomalies")
    finished_sink(samples_of(events_stream(spark, sf_dir)), Q.anomaly_sink(state, out, 100, 2.0))
    return rounded(spark.read.parquet(out).select("host_id", "metric", "n", "last", "score"), "score")


@query(
    """WITH {S}, t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY host_id, metric ORDER BY ts DESC, seq DESC) <= 100),
    a AS (SELECT host_id, metric, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd, max(ts) AS ts, arg_max(value, (ts, seq)) AS last FROM t GROUP BY ALL HAVING count(*) >= 10)
    SELECT host_id, metric, ts, n, last, round(abs(last - mean) / sd, 6) AS score FROM a WHERE sd > 0 AND abs(last - mean) / sd > 2
    AND (host_id, metric) IN (SELECT (host_id, metric) FROM s WHERE seq % 2 = 1)"""
)
def stream_anomalies(spark, sf_dir):
    """Odd samples as a stream, even ones as the history that its state starts from."""
    new = samples_of(events_stream(spark, sf_dir)).where("seq % 2 = 1")
    found = T.stream_anomalies(new, 100, 2.0, history=samples(spark, sf_dir).where("seq % 2 = 0"))
    return rounded(finished(found).select("host_id", "metric", "ts", "n", "last", "score"), "score")


@query("SELECT CASE WHEN event_type = 'error' THEN 'alerts' ELSE 'metrics' END AS topic, event_id, user_id, event_type, ts, value, props FROM events")
def route_topics(spark, sf_dir):
    out = work_dir(spark, "topics")
    keep = lambda name: lambda rows, k: rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={k}")
    handlers = {t: keep(t) for t in ("metrics", "alerts")}
    topic = F.when(F.col("event_type") == "error", "alerts").otherwise("metrics")
    finished_sink(events_stream(spark, sf_dir).withColumn("topic", topic), lambda rows, k: kafka.route_topics(rows, k, handlers))
    return spark.read.parquet(f"{out}/metrics").unionByName(spark.read.parquet(f"{out}/alerts")).drop("batch")


@query("WITH {S} SELECT host_id, metric, date_trunc('second', ts)::TIMESTAMP AS ts, value, CASE seq % 4 WHEN 0 THEN 'u' WHEN 1 THEN '%' ELSE '' END AS unit, seq FROM s WHERE seq % 4 <> 3")
def kafka_messages(spark, sf_dir):
    """Rows as the Kafka source gives them (value as bytes, offset), decoded."""
    rows = payloads(spark, sf_dir).select(F.col("payload").cast("binary").alias("value"), F.col("seq").alias("offset"))
    return kafka.decode_messages(rows).drop("tags")




@query("WITH {S} SELECT host_id, metric, date_trunc('second', ts)::TIMESTAMP AS ts, value, CASE seq % 4 WHEN 0 THEN 'u' WHEN 1 THEN '%' ELSE '' END AS unit FROM s WHERE seq % 4 <> 3")
def message_log(spark, sf_dir):
    """Envelopes published to a topic in two batches, by host, and read by a stream that is stopped and started between them."""
    path, out = work_dir(spark, "topics"), work_dir(spark, "stream")
    given = payloads(spark, sf_dir).select(
        F.coalesce(F.get_json_object("payload", "$.host_id"), F.get_json_object("payload", "$.hostId")).alias("key"), F.col("payload").alias("value"), "seq"
    )
    M.create_topic(spark, path, "metrics", 8)
    for part in (0, 1):
        M.publish(given.where(F.floor(F.col("seq") / 100) % 2 == part), path, "metrics", "events", part)
        rows = kafka.decode_messages(M.stream_messages(spark, path, "metrics", "earliest")).drop("tags", "seq")
        rows.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)
