"""Threshold alerts: rules on the last sample of each series, sustained breaches, one alert an hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugework.functions.columns import alert_key, alert_message, threshold_predicate
from gaugework.operators.segments import SPLIT, carried, long_series, over_series, parted, with_rank
from gaugework.operators.windows import latest

#: Rule id, metric, condition, threshold, severity.
DEFAULT_RULES = (
    ("cpu-high", "cpu_usage", ">", 80.0, "warning"),
    ("cpu-critical", "cpu_usage", ">", 95.0, "critical"),
    ("memory-high", "memory_usage", ">", 85.0, "warning"),
    ("memory-critical", "memory_usage", ">", 95.0, "critical"),
    ("disk-high", "disk_usage", ">", 90.0, "warning"),
)
RULES = "rule_id string, metric string, condition string, threshold double, severity string, duration_s long, enabled boolean"
#: Load thresholds in percent, in the order in which the first reason wins.
LOAD_LIMITS = (("cpu_usage", 80.0), ("memory_usage", 85.0), ("disk_usage", 90.0))


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, 0, True) for r in DEFAULT_RULES], RULES)


def matched(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Samples with each enabled rule of their metric, and whether they breach it."""
    rules = rules.where("enabled").drop("enabled")
    return samples.join(rules, "metric").withColumn("breach", threshold_predicate(F.col("value"), F.col("condition"), F.col("threshold")))


def evaluate_alerts(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts of the last sample of each series."""
    hit = matched(latest(samples), rules).where("breach")
    message = alert_message(F.col("metric"), F.col("condition"), F.col("value"), F.col("threshold"))
    name = F.concat_ws("-", "rule_id", "host_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))
    return hit.select(
        name.alias("id"), "rule_id", "host_id", "metric", "value", "threshold", "severity", message.alias("message"), "ts",
        F.lit("active").alias("status")
    )


def sustained_alerts(samples: DataFrame, rules: DataFrame, split: int | None = SPLIT) -> DataFrame:
    """Runs of breaching samples of a series and rule that last at least the rule's duration: start, end, whether they ended.

    A run's rows have the same last calm row before them, and so has the calm row that ends it: one group a run. Series of over
    ``split`` rows are gone through in blocks. Rows of equal time and arrival are in any order.
    """
    keys, rows = ("host_id", "rule_id"), matched(samples, rules)
    long = long_series(rows, keys, split)
    if long is None:
        rows = _runs(rows, keys, None)
    else:
        rest, big = parted(rows, keys, long)
        rows = _runs(rest, keys, None).unionByName(_runs(big, keys, split))
    at = F.when(F.col("breach"), F.col("ts"))
    runs = rows.groupBy("host_id", "metric", "rule_id", "duration_s", "_upto").agg(
        F.min(at).alias("start_ts"), F.max(at).alias("end_ts"), F.count_if("breach").alias("n"), (F.count_if(~F.col("breach")) > 0).alias("resolved")
    ).where("n > 0")
    long_enough = F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp")) >= F.col("duration_s") * 1_000_000
    return runs.where(long_enough).select("host_id", "metric", "rule_id", "start_ts", "end_ts", "n", "resolved")


def _runs(rows: DataFrame, keys: tuple[str, ...], split: int | None) -> DataFrame:
    """With _upto: the place of the last calm row before each row."""
    rows = with_rank(rows, keys, split).withColumnRenamed("_rank", "_place")
    calm = F.when(~F.col("breach"), F.col("_place"))
    rows = over_series(rows, keys, 1, split, lambda r, w: r.withColumn("_calm", F.lag(calm).over(w)), ("_place",))
    return carried(rows, keys, split, "_calm", F.max, ("_place",))


def dedup_alerts(alerts: DataFrame) -> DataFrame:
    """The first alert of each host, metric and hour."""
    w = Window.partitionBy("key").orderBy("ts", "seq")
    rows = alerts.withColumn("key", alert_key(F.col("host_id"), F.col("metric"), F.col("ts")))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def over_threshold_hosts(samples: DataFrame, limits: tuple[tuple[str, float], ...] = LOAD_LIMITS) -> DataFrame:
    """Hosts whose last load is over a limit, with the first reason."""
    last = latest(samples.where(F.col("metric").isin([m for m, _ in limits])))
    load = last.groupBy("host_id").agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m, _ in limits))
    reason = F.lit(None).cast("string")
    for m, most in reversed(limits):
        reason = F.when(F.col(m) > most, m).otherwise(reason)
    return load.withColumn("reason", reason).where("reason is not null")

