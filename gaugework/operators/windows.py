"""Window operators: sliding statistics, rates of counters, state changes, runs of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.model import SERIES
from gaugework.operators.aggregates import seconds_between, with_deltas
from gaugework.operators.segments import SPLIT, carried, over_series, with_rank


def percentile_lower(ordered: Column, p: int) -> Column:
    """The element at (n - 1) * p / 100, rounded down, of a sorted array."""
    return F.element_at(ordered, (F.floor((F.size(ordered) - 1) * p / 100) + 1).cast("int"))


def sliding_stats(samples: DataFrame, size: int, max_age_s: int, keys: tuple[str, ...] = SERIES, split: int | None = SPLIT) -> DataFrame:
    """At every sample, over the last ``size`` ones that are no older than max_age_s: count to percentiles, rate and last.

    The frame is an array of at most ``size`` structs, so both limits hold at once.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    frame = lambda w: F.collect_list(F.struct(at.alias("t"), F.col("value").alias("v"))).over(w.rowsBetween(-(size - 1), 0))
    rows = over_series(samples, keys, size - 1, split, lambda r, w: r.withColumn("frame", F.filter(frame(w), lambda x: x["t"] >= at - max_age_s * 1_000_000)))
    v = F.transform("frame", lambda x: x["v"])
    n = F.size("frame")
    rows = rows.withColumns({"v": v, "n": n}).withColumns({"total": F.aggregate("v", F.lit(0.0), lambda s, x: s + x), "ordered": F.array_sort("v")})
    mean = F.col("total") / F.col("n")
    variance = F.when(F.col("n") >= 2, F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.col("n")).otherwise(0.0)
    first, last = F.element_at("frame", 1), F.element_at("frame", -1)
    span = (last["t"] - first["t"]) / 1e6
    rate = F.when((F.col("n") >= 2) & (span > 0), (last["v"] - first["v"]) / span).otherwise(0.0)
    return rows.select(
        *keys, "ts", "seq", F.col("n").cast("long").alias("count"), F.col("total").alias("sum"), mean.alias("avg"), F.array_min("v").alias("min"), F.array_max("v").alias("max"),
        F.sqrt(variance).alias("std_dev"), variance.alias("variance"), percentile_lower(F.col("ordered"), 50).alias("median"),
        *(percentile_lower(F.col("ordered"), p).alias(f"p{p}") for p in (90, 95, 99)), rate.alias("rate"), last["v"].alias("last_value"),
    )


def counter_rates(counters: DataFrame, keys: tuple[str, ...] = SERIES, split: int | None = SPLIT) -> DataFrame:
    """Growth a second since the sample before, the first left out; a smaller value is a reset and has no rate."""
    rows = with_deltas(counters, keys, split).where(F.col("prev_ts").isNotNull())
    span = seconds_between(F.col("prev_ts"), F.col("ts"))
    reset = F.col("value") < F.col("prev")
    rate = F.when(~reset, (F.col("value") - F.col("prev")) / F.when(span > 0, span).otherwise(1.0))
    return rows.select(*keys, "ts", "seq", rate.alias("rate"), reset.alias("reset"))


def bandwidth_avg(counters: DataFrame, size: int = 10, max_age_s: int = 60) -> DataFrame:
    """The mean of a counter's last rates."""
    rates = counter_rates(counters).where(F.col("rate").isNotNull()).withColumnRenamed("rate", "value")
    return sliding_stats(rates, size, max_age_s).select(*SERIES, "ts", "seq", "avg")


def cpu_usage(jiffies: DataFrame) -> DataFrame:
    """``jiffies``: host_id, core, ts, idle, total (counters). Percent busy since the scrape before; 0 without a change."""
    w = Window.partitionBy("host_id", "core").orderBy("ts")
    idle, total = (F.col(c) - F.lag(c).over(w) for c in ("idle", "total"))
    rows = jiffies.withColumns({"d_idle": idle, "d_total": total}).where(F.col("d_total").isNotNull())
    return rows.select(
        "host_id", "core", "ts", F.when(F.col("d_total") == 0, 0.0).otherwise(100 * (1 - F.col("d_idle") / F.col("d_total"))).alias("usage")
    )


def latest(samples: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """The last sample of each series by time, then by arrival."""
    last = samples.groupBy(*keys).agg(F.max_by(F.struct("ts", "value", "seq"), F.struct("ts", "seq")).alias("x"))
    return last.select(*keys, "x.ts", "x.value", "x.seq")


def load_forecast(scores: DataFrame, keys: tuple[str, ...] = (), rows: int = 100) -> DataFrame:
    """``scores``: ts, score, one row a time bucket. The mean of the last scores up to each."""
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(-(rows - 1), 0)
    return scores.withColumn("forecast", F.coalesce(F.avg("score").over(w), F.lit(0.0)))


def state_changes(states: DataFrame, keys: tuple[str, ...] = ("host_id",)) -> DataFrame:
    """``states``: ts, seq, state. Rows whose state differs from the one before, with both."""
    w = Window.partitionBy(*keys).orderBy("ts", "seq")
    rows = states.withColumn("old_state", F.lag("state").over(w))
    return rows.where(F.col("old_state") != F.col("state")).select(*keys, "ts", "old_state", F.col("state").alias("new_state"))


def consecutive_failures(checks: DataFrame, max_retries: int = 3, keys: tuple[str, ...] = ("host_id",), split: int | None = SPLIT) -> DataFrame:
    """``checks``: ts, seq, ok. Failures in a row up to each check; offline from max_retries on. A check without a result
    (null) neither counts nor ends a run: such checks are left out of the counting."""
    known, order = checks.where("ok is not null"), ("ts", "seq")
    rows = with_rank(known, keys, split).withColumn("_good", F.when(F.col("ok"), F.col("_rank"))).withColumnRenamed("_rank", "_place")
    rows = carried(rows, keys, split, "_good", F.max, order)
    rows = rows.withColumn("failures", F.col("_place") - F.coalesce("_upto", F.lit(-1).cast("long")))
    return rows.select(*keys, "ts", "seq", "failures", F.when(F.col("failures") >= max_retries, "offline").otherwise("online").alias("status"))


def latest_as_of(requests: DataFrame, samples: DataFrame, split: int | None = SPLIT) -> DataFrame:
    """For each request (host_id, metric, ts) the last sample not after it, its value (which may be null) and its time: both
    kinds of rows in one ordered run a series."""
    sample = F.struct("value", F.col("ts").alias("at"))
    given = samples.select(*SERIES, "ts", "seq", sample.alias("_sample"), F.lit(0).alias("_kind"))
    asked = requests.select(*SERIES, "ts", F.lit(None).cast("long").alias("seq"), F.lit(None).alias("_sample"), F.lit(1).alias("_kind"))
    rows = carried(given.unionByName(asked), SERIES, split, "_sample", lambda c: F.last(c, ignorenulls=True), ("ts", "_kind", "seq"))
    return rows.where("_kind = 1").select(*SERIES, "ts", "_upto.value", "_upto.at")
