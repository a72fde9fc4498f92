"""Queries on series: aggregates, buckets, trends, anomalies, top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.model import samples, table
from gaugework.operators import aggregates as A
from gaugework.operators import members as N
from gaugework.operators import rollups as R
from gaugework.operators import topk as K
from gaugework.registry import query
from gaugework.session import work_dir
from gaugework.sources.store import Store

START, END = "2024-01-05 00:00:00", "2024-01-20 00:00:00"


def bounds():
    return F.lit(START).cast("timestamp_ntz"), F.lit(END).cast("timestamp_ntz")


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


def signed(df, *columns, places=6):
    """Rounded, where what is below zero and rounds to it stays a negative zero, as in SQL."""
    return df.withColumns({c: F.when((F.round(c, places) == 0) & (F.col(c) < 0), F.lit(-0.0)).otherwise(F.round(c, places)) for c in columns})


@query(
    """WITH {S}, d AS (SELECT *, lag(value) OVER w AS prev FROM s WINDOW w AS (PARTITION BY host_id, metric ORDER BY ts, seq))
    SELECT host_id, metric, round(avg(value), 6) AS avg, round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max, count(value) AS count,
      round(CASE WHEN max(ts) > min(ts) THEN sum(CASE WHEN value > prev THEN value - prev ELSE 0 END) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) ELSE 0 END, 6) AS rate,
      round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_pop(value), 6) AS stddev
    FROM d GROUP BY ALL"""
)
def aggregate(spark, sf_dir):
    return rounded(A.aggregate(samples(spark, sf_dir)), "avg", "sum", "rate", "p95", "stddev")


def _one(kind, sql):
    def run(spark, sf_dir):
        return A.aggregate(samples(spark, sf_dir), (kind,)).select("host_id", "metric", F.round(F.col(kind).cast("double"), 6).alias("value"))

    run.__name__ = f"aggregate_{kind}"
    query(f"WITH {{S}} SELECT host_id, metric, round(CAST({sql} AS DOUBLE), 6) AS value FROM s GROUP BY ALL")(run)


for _kind, _sql in {
    "avg": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "count": "count(value)", "p95": "quantile_cont(value, 0.95)",
    "p50": "quantile_cont(value, 0.5)", "stddev": "stddev_pop(value)"
}.items():
    _one(_kind, _sql)


@query(
    """WITH {S}, d AS (SELECT *, lag(value) OVER w AS prev FROM s WINDOW w AS (PARTITION BY host_id, metric ORDER BY ts, seq))
    SELECT host_id, metric, round(CASE WHEN max(ts) > min(ts) THEN sum(CASE WHEN value > prev THEN value - prev ELSE 0 END) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) ELSE 0 END, 6) AS value
    FROM d GROUP BY ALL"""
)
def aggregate_rate(spark, sf_dir):
    return A.aggregate(samples(spark, sf_dir), ("rate",)).select("host_id", "metric", F.round("rate", 6).alias("value"))


@query(
    f"""WITH {{S}} SELECT host_id, round(avg(value), 6) AS avg, count(value) AS count FROM s
    WHERE ts > TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'
      AND (host_id, ts) IN (SELECT (host_id, ts) FROM s WHERE metric = 'click') GROUP BY ALL"""
)
def aggregate_record_scope(spark, sf_dir):
    return rounded(A.aggregate(samples(spark, sf_dir), ("avg", "count"), "click", *bounds(), "neither", "record"), "avg")


@query("WITH {S} SELECT host_id, metric, count(value) AS count, round(sum(value), 6) AS sum, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM s GROUP BY ALL")
def range_stats(spark, sf_dir):
    return rounded(A.range_stats(samples(spark, sf_dir)), "sum", "avg")


@query(
    """WITH {S} SELECT host_id, metric, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket, count(value) AS count, round(sum(value), 6) AS sum,
      round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM s GROUP BY ALL"""
)
def bucket_stats(spark, sf_dir):
    return rounded(A.bucket_stats(samples(spark, sf_dir), "6 hours"), "sum", "avg")


HOSTS_SQL = """WITH {S}, e AS (SELECT host_id, metric, count(value) AS count, sum(value) AS sum, avg(value) AS avg, min(value) AS min, max(value) AS max FROM s GROUP BY ALL),
    h AS (SELECT host_id, count(DISTINCT ts) AS records, min(ts) AS earliest, max(ts) AS latest FROM s GROUP BY ALL)
    SELECT host_id, metric, count, round(sum, 6) AS sum, round(avg, 6) AS avg, min, max, records, earliest, latest FROM e JOIN h USING (host_id)"""


@query("WITH {S} SELECT host_id, metric, round(max(value) - min(value), 6) AS spread, count(value) AS count FROM s GROUP BY ALL")
def registered_aggregate(spark, sf_dir):
    A.register_aggregator("spread", lambda v: F.max(v) - F.min(v))
    return rounded(A.aggregate(samples(spark, sf_dir), ("spread", "count")), "spread")


@query(HOSTS_SQL)
def host_statistics(spark, sf_dir):
    return rounded(A.host_statistics(samples(spark, sf_dir)), "sum", "avg")


@query(f"SELECT host_id, records, metric, count, sum, avg, min, max FROM ({HOSTS_SQL})")
def host_statistics_map(spark, sf_dir):
    """The map, read from its JSON again."""
    kind = "map<string,struct<count:bigint,sum:double,avg:double,min:double,max:double>>"
    m = A.host_statistics_map(samples(spark, sf_dir)).select("host_id", "records", F.explode(F.from_json("metrics", kind)).alias("metric", "s"))
    return rounded(m.select("host_id", "records", "metric", "s.*"), "sum", "avg")


@query(
    """WITH {S}, x AS (SELECT *, row_number() OVER (PARTITION BY host_id, metric ORDER BY ts, seq) - 1 AS i FROM s),
    a AS (SELECT host_id, metric, count(*) AS n, regr_slope(value, i) AS slope, corr(value, i) AS r, stddev_pop(value) AS sd, max_by(value, i) AS last FROM x GROUP BY ALL HAVING count(*) >= 2),
    b AS (SELECT *, CASE WHEN sd = 0 THEN 0 ELSE slope END AS k, CASE WHEN sd = 0 THEN 1 ELSE r END AS c FROM a)
    SELECT host_id, metric, n, round(k, 6) AS slope, round(c, 6) AS correlation, CASE WHEN k > 0.1 THEN 'up' WHEN k < -0.1 THEN 'down' ELSE 'stable' END AS direction,
      round(last + k * n, 6) AS prediction, round(abs(c) * 100, 6) AS confidence FROM b"""
)
def trend(spark, sf_dir):
    return signed(A.trend(samples(spark, sf_dir)), "slope", "correlation", "prediction", "confidence")


@query(
    """WITH {S}, a AS (SELECT host_id, metric, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd, arg_max(value, (ts, seq)) AS last FROM s GROUP BY ALL HAVING count(*) >= 10),
    b AS (SELECT *, CASE WHEN sd > 0 THEN abs(last - mean) / sd ELSE 0 END AS z FROM a)
    SELECT host_id, metric, n, round(mean, 6) AS mean, round(sd, 6) AS stddev, last, round(z, 6) AS score, z > 3 AS is_anomaly FROM b"""
)
def anomaly(spark, sf_dir):
    return rounded(A.anomaly(samples(spark, sf_dir)), "mean", "stddev", "score")


@query("WITH {S} SELECT metric, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS stddev FROM s GROUP BY ALL")
def basic_stats(spark, sf_dir):
    return rounded(rounded(A.basic_stats(samples(spark, sf_dir)), "sum", places=4), "mean", "stddev")


@query(
    """WITH {S} SELECT metric, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95,
      round(quantile_cont(value, 0.99), 6) AS p99 FROM s GROUP BY ALL"""
)
def percentiles(spark, sf_dir):
    return rounded(A.percentiles(samples(spark, sf_dir)), "p50", "p90", "p95", "p99")


@query("WITH {S}, q AS (SELECT metric, CASE WHEN seq % 11 = 0 THEN 'nan'::DOUBLE WHEN seq % 13 = 0 THEN 'inf'::DOUBLE ELSE value END AS v FROM s) SELECT metric, count(*) FILTER (isfinite(v)) AS valid, count(*) AS total FROM q GROUP BY ALL")
def valid_count(spark, sf_dir):
    odd = F.when(F.col("seq") % 11 == 0, float("nan")).when(F.col("seq") % 13 == 0, float("inf")).otherwise(F.col("value"))
    return A.valid_count(samples(spark, sf_dir).withColumn("value", odd))


@query(
    """WITH {S} SELECT host_id, metric, count(value) AS count, round(sum(value), 6) AS sum, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max,
      round(stddev_pop(value), 6) AS stddev, true AS p95_near FROM s GROUP BY ALL"""
)
def rollup_stats(spark, sf_dir):
    """All days of every series from stored rollups; p95 is held against the shares of the series' values below and up to it."""
    store, path, s = Store(spark, work_dir(spark, "samples")), work_dir(spark, "rollups"), samples(spark, sf_dir)
    store.upsert(s)
    R.refresh(store, path)
    got = rounded(R.merged_stats(R.read_rollups(spark, path), points=(95,)), "sum", "avg", "stddev")
    each = s.join(got.select("host_id", "metric", "p95", "count"), ["host_id", "metric"]).groupBy("host_id", "metric")
    near = each.agg(
        ((F.count_if(F.col("value") < F.col("p95")) <= 0.97 * F.max("count") + 1) & (F.count_if(F.col("value") <= F.col("p95")) >= 0.93 * F.max("count") - 1)).alias("p95_near")
    )
    return got.drop("p95", "last").join(near, ["host_id", "metric"])


@query("WITH {S} SELECT metric, true AS near FROM s GROUP BY ALL")
def rollup_hosts(spark, sf_dir):
    """Numbers of hosts from sketches, within five of a hundred of the exact ones."""
    s = samples(spark, sf_dir)
    got = R.host_counts(R.host_rollup(s)).join(A.metric_names(s).withColumnRenamed("series", "exact"), "metric")
    return got.select("metric", (F.abs(F.col("series") - F.col("exact")) <= 0.05 * F.col("exact") + 1).alias("near"))


@query("WITH {S} SELECT metric, count(DISTINCT host_id) AS series FROM s GROUP BY ALL")
def metric_names(spark, sf_dir):
    return A.metric_names(samples(spark, sf_dir))


LAST = "l AS (SELECT host_id, metric, max(ts) AS ts, arg_max(value, (ts, seq)) AS value FROM s GROUP BY ALL)"


@query(
    f"""WITH {{S}}, l AS (SELECT host_id, metric, max(ts) AS t, count(*) AS n FROM s GROUP BY ALL)
    SELECT metric, CAST(sum(n) AS BIGINT) AS updates, CAST(least(count(*) FILTER (t >= TIMESTAMP '{END}' - INTERVAL 7200 SECOND), 10) AS BIGINT) AS items, max(t) AS last_update,
      10 AS k, 7200 AS ttl_s FROM l GROUP BY ALL"""
)
def topk_stats(spark, sf_dir):
    return A.topk_stats(samples(spark, sf_dir), bounds()[1], 10, 7200)


@query("WITH {S}, m AS (SELECT DISTINCT host_id FROM s WHERE metric = 'error' AND value > 200), a AS (SELECT DISTINCT host_id FROM s) SELECT host_id, host_id IN (SELECT host_id FROM m) AS found, round((1 - exp(-7.0 * (SELECT count(*) FROM m) / 1000)) ** 7, 6) AS fp_estimate FROM a")
def membership(spark, sf_dir):
    s = samples(spark, sf_dir)
    return rounded(N.membership(s.select("host_id").distinct(), s.where("metric = 'error' and value > 200"), "host_id", 1000, 7), "fp_estimate")


RANKED = "SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY value DESC, host_id) AS rank, host_id, value"


def live(end, ttl=86_400):
    return f"WITH {{S}}, w AS (SELECT * FROM s WHERE ts <= TIMESTAMP '{end}'), l AS (SELECT host_id, metric, max(ts) AS ts, arg_max(value, (ts, seq)) AS value FROM w GROUP BY ALL), t AS ({RANKED} FROM l WHERE ts >= TIMESTAMP '{end}' - INTERVAL {ttl} SECOND)"


@query(f"{live(END)} SELECT * FROM t WHERE rank <= 10")
def topk_hosts(spark, sf_dir):
    return K.topk_hosts(samples(spark, sf_dir), 10, 86_400, bounds()[1])


@query(live(END).replace("WHERE ts <=", f"WHERE ts >= TIMESTAMP '{START}' AND ts <=") + " SELECT * FROM t WHERE rank <= 5")
def topk_in_range(spark, sf_dir):
    return K.topk_in_range(samples(spark, sf_dir), *bounds(), 5, 86_400)


@query(f"{live(END)} SELECT * FROM t WHERE rank <= 10 AND value < 100")
def topk_filtered(spark, sf_dir):
    return K.topk_filtered(samples(spark, sf_dir), F.col("value") < 100, k=10, ttl_s=86_400, as_of=bounds()[1])


@query(f"{live(END)}, u AS (SELECT * FROM t WHERE rank <= 10), a AS (SELECT DISTINCT metric, host_id FROM s) SELECT metric, host_id, rank IS NOT NULL AS found, value FROM a LEFT JOIN u USING (metric, host_id)")
def topk_contains(spark, sf_dir):
    s = samples(spark, sf_dir)
    return K.topk_contains(s, s.select("metric", "host_id").distinct(), k=10, ttl_s=86_400, as_of=bounds()[1])


@query(
    f"""WITH {{S}}, a AS ({live(START).replace('WITH {S}, ', 'WITH ')} SELECT * FROM t WHERE rank <= 10), b AS ({live(END).replace('WITH {S}, ', 'WITH ')} SELECT * FROM t WHERE rank <= 10)
    SELECT metric, host_id, value FROM a WHERE (metric, host_id) NOT IN (SELECT (metric, host_id) FROM b)"""
)
def topk_evictions(spark, sf_dir):
    return K.topk_evictions(samples(spark, sf_dir), *bounds(), 10, 86_400)


@query(f"{live(END)} SELECT * FROM t WHERE rank <= 3")
def topk_resize(spark, sf_dir):
    return K.topk_resize(K.topk_hosts(samples(spark, sf_dir), 10, 86_400, bounds()[1]), 3)


@query("WITH {S} SELECT host_id, metric, ts, value, '' AS unit, seq FROM s")
def sorted_history(spark, sf_dir):
    return K.sorted_history(samples(spark, sf_dir))


@query(
    """SELECT 'supp-' || l_suppkey AS host_id, l_returnflag AS metric, time_bucket(INTERVAL 30 DAY, l_shipdate, TIMESTAMP '1970-01-01') AS bucket, count(l_extendedprice) AS count,
      round(sum(l_extendedprice), 2) AS sum, round(avg(l_extendedprice), 6) AS avg, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY ALL"""
)
def bucket_stats_lineitem(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    s = l.select(
        F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")).alias("host_id"), F.col("l_returnflag").alias("metric"),
        F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("value")
    )
    return rounded(rounded(A.bucket_stats(s, "30 days"), "sum", places=2), "avg")

