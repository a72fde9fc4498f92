"""Top hosts of each metric by their last value within a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.operators.filters import time_range
from gaugework.operators.windows import latest


def topk_hosts(samples: DataFrame, k: int = 10, ttl_s: int = 3600, as_of=None) -> DataFrame:
    """metric, rank, host_id, value: by value, then by host. One row a host reaches the ranking. as_of: the last sample's time."""
    last = latest(time_range(samples, end=as_of))
    if as_of is None:
        last = last.join(samples.groupBy("metric").agg(F.max("ts").alias("now")), "metric")
    else:
        last = last.withColumn("now", F.lit(as_of))
    live = last.where(F.col("ts") >= F.col("now") - F.make_dt_interval(secs=F.lit(ttl_s)))
    w = Window.partitionBy("metric").orderBy(F.desc("value"), "host_id")
    top = live.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)  # the bare number: Spark then cuts to k before it shuffles
    return top.select("metric", F.col("rank").cast("long").alias("rank"), "host_id", "value")


def topk_in_range(samples: DataFrame, start, end, k: int = 10, ttl_s: int = 3600) -> DataFrame:
    return topk_hosts(time_range(samples, start, end), k, ttl_s, end)


def topk_filtered(samples: DataFrame, predicate, **options) -> DataFrame:
    """The predicate filters after the cut."""
    return topk_hosts(samples, **options).where(predicate)


def topk_contains(samples: DataFrame, asked: DataFrame, **options) -> DataFrame:
    """``asked``: metric, host_id. Whether each is among the top, and with which value."""
    top = topk_hosts(samples, **options)
    return asked.join(top, ["metric", "host_id"], "left").select("metric", "host_id", F.col("rank").isNotNull().alias("found"), "value")


def topk_evictions(samples: DataFrame, before, after, k: int = 10, ttl_s: int = 3600) -> DataFrame:
    """Hosts in the top at the first time that aren't at the second, with the value that they had."""
    old, new = (topk_hosts(samples, k, ttl_s, t) for t in (before, after))
    return old.join(new, ["metric", "host_id"], "left_anti").select("metric", "host_id", "value")


def topk_resize(top: DataFrame, k: int) -> DataFrame:
    """A top list cut to its k largest."""
    return top.where(F.col("rank") <= k)


def scale_down_candidates(hosts: DataFrame, target: int, by: str = "load") -> DataFrame:
    """Healthy hosts beyond the target count in the order of ``by``: the target first ones are a top-n; all others go."""
    healthy = hosts.where(F.col("state") == "healthy")
    kept = healthy.orderBy(by, "host_id").limit(target).select("host_id")
    return healthy.join(kept, "host_id", "left_anti").select("host_id", by)


def sorted_history(samples: DataFrame) -> DataFrame:
    return samples.orderBy("host_id", "metric", "ts", "seq")
