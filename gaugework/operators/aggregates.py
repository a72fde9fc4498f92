"""Aggregates of series: partial aggregation before the shuffle, one shuffle by series."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.model import SERIES
from gaugework.operators.filters import is_finite, metric_filter, time_range
from gaugework.operators.segments import SPLIT, over_series, same, with_rank

#: Name -> aggregate of a value column; register_aggregator adds to it. rate works on the deltas that with_deltas adds.
AGGREGATORS: dict[str, Callable[[Column], Column]] = {
    "avg": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "stddev": F.stddev_pop,
    "p95": lambda v: F.percentile(v, F.lit(0.95)),
}


def register_aggregator(name: str, make: Callable[[Column], Column]) -> None:
    AGGREGATORS[name] = make


def with_deltas(samples: DataFrame, keys: tuple[str, ...] = SERIES, split: int | None = SPLIT) -> DataFrame:
    """Each sample with the value and time of the one before it in its series; series of more than ``split`` rows in blocks."""
    add = lambda rows, w: rows.withColumns({"prev": F.lag("value").over(w), "prev_ts": F.lag("ts").over(w)})
    return over_series(samples, keys, 1, split, add)


def seconds_between(start: Column, end: Column) -> Column:
    """Exact to the microsecond, however far from 1970."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def positive_rate() -> Column:
    """Of rows with deltas: the sum of growth over the span in seconds, so that resets don't count; 0 without a span."""
    grown = F.sum(F.when(F.col("value") > F.col("prev"), F.col("value") - F.col("prev")).otherwise(0.0))
    span = seconds_between(F.min("ts"), F.max("ts"))
    return F.when(span > 0, grown / span).otherwise(0.0)


def aggregate(
    samples: DataFrame, kinds: tuple[str, ...] = ("avg", "sum", "min", "max", "count", "rate", "p95", "stddev"), metric: str | None = None,
    start=None, end=None, closed: str = "both", scope: str = "metric", exact: bool = True, split: int | None = SPLIT
) -> DataFrame:
    """All the kinds for every series at once (for every host, if scope is record: over all metrics of the records).

    Exact percentiles keep a group's distinct values in memory; with exact=False they are approximate and keep a summary.
    """
    if unknown := [k for k in kinds if k not in AGGREGATORS and k != "rate" and not _percent(k)]:
        raise ValueError(f"unknown aggregates: {', '.join(unknown)}")
    rows = time_range(samples, start, end, closed)
    rows = rows if metric is None else metric_filter(rows, metric, scope=scope)
    keys = SERIES if scope == "metric" else ("host_id",)
    rows = with_deltas(rows, keys, split) if "rate" in kinds else rows

    def of(kind: str) -> Column:
        if kind == "rate":
            return positive_rate()
        if kind in AGGREGATORS and (exact or _percent(kind) is None):
            return AGGREGATORS[kind](F.col("value"))
        share = F.lit(_percent(kind) / 100)
        return F.percentile("value", share) if exact else F.percentile_approx("value", share, 10_000)

    made = [of(k) for k in kinds]
    return rows.groupBy(*keys).agg(*(c.alias(k) for c, k in zip(made, kinds, strict=True)))


def _percent(kind: str) -> float | None:
    return float(kind[1:]) if kind[:1] == "p" and kind[1:].replace(".", "", 1).isdigit() else None


STATS = ("count", "sum", "avg", "min", "max")


def range_stats(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*SERIES).agg(*(AGGREGATORS[k](F.col("value")).alias(k) for k in STATS))


def bucket_stats(samples: DataFrame, interval: str) -> DataFrame:
    """The same for every interval from 1970 on; bucket is its start."""
    rows = samples.groupBy(*SERIES, F.window("ts", interval).alias("w")).agg(*(AGGREGATORS[k](F.col("value")).alias(k) for k in STATS))
    return rows.select(*SERIES, F.col("w.start").alias("bucket"), *STATS)


def host_statistics(samples: DataFrame) -> DataFrame:
    """Per host and metric the statistics, with the host's records (scrapes), first and last time."""
    each = samples.groupBy(*SERIES).agg(*(AGGREGATORS[k](F.col("value")).alias(k) for k in STATS))
    host = samples.groupBy("host_id").agg(F.count_distinct("ts").alias("records"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))
    return each.join(host, "host_id")


def host_statistics_map(samples: DataFrame) -> DataFrame:
    """One row a host with a map metric -> statistics, as JSON."""
    s = host_statistics(samples)
    entry = F.struct(F.col("metric"), F.struct(*STATS))
    return s.groupBy("host_id", "records").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("metrics"))


def state_counts(hosts: DataFrame, states: tuple[str, ...] = ("healthy", "unhealthy", "offline", "maintenance")) -> DataFrame:
    return hosts.agg(F.count("*").alias("total"), *(F.count_if(F.col("state") == s).alias(s) for s in states))


def cluster_health(nodes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``nodes``: active. Unhealthy without an active node, degraded with less than half (whole division), else healthy."""
    c = nodes.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("active").alias("active"))
    state = F.when(F.col("active") == 0, "unhealthy").when(F.col("active") < F.floor(F.col("total") / 2), "degraded").otherwise("healthy")
    return c.withColumn("status", state)


def topic_stats(messages: DataFrame) -> DataFrame:
    """``messages``: topic, ts, status. Rows by topic: counts by status, and the last time."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processed", "failed")]
    return messages.groupBy("topic").agg(F.count("*").alias("total"), *counts, F.max("ts").alias("last_ts"))


#: Points of a series up to which trend() keeps them, to add their products in order.
IN_ORDER = 10_000


def _multiplied_and_added(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with one rounding, for an ``a`` of at most 26 bits: b in two halves, and what the sum has lost added at the end."""
    wide = b * float(2**27 + 1)
    high = wide - (wide - b)
    most, least = a * high, a * (b - high)
    total = c + most
    back = total - c
    lost = (c - (total - back)) + (most - back)
    return total + (lost + least)


def covariance_in_order(points: Column) -> Column:
    """Of the population, over an array of (x, value) in order: each product is added with one rounding. So it doesn't hang on how
    rows were grouped, and where a slope is just at a limit it falls on the side where SQL engines that fuse the two have it."""

    def step(s: Column, p: Column) -> Column:
        n, dx = s["n"] + 1, p["x"] - s["mx"]
        my = s["my"] + (p["value"] - s["my"]) / n
        return F.struct(n.alias("n"), (s["mx"] + dx / n).alias("mx"), my.alias("my"), _multiplied_and_added(dx, p["value"] - my, s["c"]).alias("c"))

    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("n", "mx", "my", "c")))
    return F.aggregate(points, zero, step, lambda s: s["c"] / F.nullif(s["n"], F.lit(0.0)))


def trend(samples: DataFrame, flat: float = 0.1, split: int | None = SPLIT) -> DataFrame:
    """Least squares over the points in order: slope, correlation, direction, prediction, confidence; two points or more. A point
    without a value has a place in the order, and no part in the rest."""
    rows = with_rank(samples, SERIES, split).withColumn("x", F.when(F.col("value").isNotNull(), F.col("_rank").cast("double")))
    point = F.when((F.col("_rank") < IN_ORDER) & F.col("value").isNotNull(), F.struct("x", F.col("value").cast("double").alias("value")))
    a = rows.groupBy(*SERIES).agg(
        F.count("*").alias("n"), F.covar_pop("x", "value").alias("both"), F.var_pop("x").alias("square"), F.stddev_pop("value").alias("spread"),
        F.max_by("value", "x").alias("last"), F.array_sort(F.collect_list(point)).alias("points")
    ).where("n >= 2")
    # values too great to be cut in halves give no number
    exact = F.when(F.col("n") <= IN_ORDER, F.nanvl(covariance_in_order(F.col("points")), F.col("both"))).otherwise(F.col("both"))
    a = a.withColumn("both", exact).drop("points")
    r = F.when(F.col("spread") == 0, 1.0).otherwise(F.col("both") / F.nullif(F.sqrt("square") * F.col("spread"), F.lit(0.0)))
    slope = F.when(F.col("spread") == 0, 0.0).otherwise(F.col("both") / F.nullif(F.col("square"), F.lit(0.0)))
    direction = F.when(slope > flat, "up").when(slope < -flat, "down").otherwise("stable")
    return a.select(
        *SERIES, "n", slope.alias("slope"), r.alias("correlation"), direction.alias("direction"),
        (F.col("last") + slope * F.col("n")).alias("prediction"), (F.abs(r) * 100).alias("confidence")
    )


def anomaly(samples: DataFrame, threshold: float = 3.0, least: int = 10) -> DataFrame:
    """z-score of the last point against all of its series; ``least`` points or more."""
    a = samples.groupBy(*SERIES).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stddev"),
        F.max_by("value", F.struct("ts", "seq")).alias("last")
    ).where(F.col("n") >= least)
    z = F.when(F.col("stddev") > 0, F.abs(F.col("last") - F.col("mean")) / F.col("stddev")).otherwise(0.0)
    return a.select(*SERIES, "n", "mean", "stddev", "last", z.alias("score"), (z > threshold).alias("is_anomaly"))


def basic_stats(samples: DataFrame, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    v = F.col("value")
    return samples.groupBy(*keys).agg(
        F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("stddev")
    )


def percentiles(
    samples: DataFrame, points: tuple[int, ...] = (50, 90, 95, 99), keys: tuple[str, ...] = ("metric",), exact: bool = True, accuracy: int = 1000
) -> DataFrame:
    """Columns p50 and so on, with linear interpolation. Approximate ones need memory by their accuracy alone.

    Exact ones bracket each rank first: approximate quantiles two errors below and above it hold the wanted values between
    them for certain, but for one rank at the ends, which is the first or last value of what lies beside the bracket. One pass
    counts the values in brackets (four thousandths of a group's) by value, and what lies between brackets as one row with its
    extremes; summed in order, these give the ranks. So no group is one task's memory.
    """
    if not exact:
        made = F.percentile_approx("value", F.array(*(F.lit(p / 100) for p in points)), 10_000)
        return samples.groupBy(*keys).agg(made.alias("p")).select(*keys, *(F.col("p")[i].alias(f"p{p}") for i, p in enumerate(points)))
    of = lambda a: [F.col(f"{a}.{k}").alias(k) for k in keys]
    ends = [min(1.0, max(0.0, p / 100 + side * 2 / accuracy)) for p in points for side in (-1, 1)]
    cuts = samples.groupBy(*keys).agg(F.percentile_approx("value", F.array(*map(F.lit, ends)), accuracy).alias("cuts"))
    # the smallest and greatest rank can lie beyond an approximate end: these brackets are open
    low = [F.lit(float("-inf")) if ends[2 * i] == 0.0 else F.col("cuts")[2 * i] for i in range(len(points))]
    high = [F.lit(float("nan")) if ends[2 * i + 1] == 1.0 else F.col("cuts")[2 * i + 1] for i in range(len(points))]
    v = F.col("value")
    rows = samples.where("value is not null").alias("a").join(cuts.alias("b"), same("a", "b", keys)).select(*of("a"), "value", "cuts")
    inside = reduce(Column.__or__, ((v >= a) & (v <= z) for a, z in zip(low, high, strict=True)))
    zone = reduce(Column.__add__, ((v >= a).cast("int") + (v > z).cast("int") for a, z in zip(low, high, strict=True)))
    counts = rows.groupBy(*keys, zone.alias("zone"), F.when(inside, v).alias("own")).agg(
        F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")
    )
    group = Window.partitionBy(*keys)
    ranked = counts.withColumns({"end": F.sum("n").over(group.orderBy("least")), "total": F.sum("n").over(group)})
    x = [F.lit(p / 100) * (F.col("total") - 1) for p in points]

    def at(rank: Column) -> Column:
        first = F.col("end") - F.col("n")
        return F.max(F.when((rank >= first) & (rank < F.col("end")), F.when(rank == first, F.col("least")).otherwise(F.col("most"))))

    made = ranked.groupBy(*keys).agg(*(
        (at(F.floor(r)) + (at(F.ceil(r)) - at(F.floor(r))) * (F.max(r) - F.floor(F.max(r)))).alias(f"p{p}") for p, r in zip(points, x, strict=True)
    ))
    return cuts.alias("a").join(made.alias("b"), same("a", "b", keys), "left").select(*of("a"), *(f"b.p{p}" for p in points))


def valid_count(samples: DataFrame, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    return samples.groupBy(*keys).agg(F.count_if(is_finite(F.col("value"))).alias("valid"), F.count("*").alias("total"))


def metric_names(samples: DataFrame, exact: bool = True) -> DataFrame:
    """Metrics seen and their numbers of hosts."""
    count = F.count_distinct if exact else F.approx_count_distinct
    return samples.groupBy("metric").agg(count("host_id").alias("series"))


def topk_stats(samples: DataFrame, as_of, k: int = 10, ttl_s: int = 3600) -> DataFrame:
    """Per metric: updates, hosts whose last sample is within the TTL (k at most), k, ttl and the last update."""
    last = samples.groupBy(*SERIES).agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    live = F.count_if(F.col("last_ts") >= F.lit(as_of) - F.make_dt_interval(secs=F.lit(ttl_s)))
    return last.groupBy("metric").agg(
        F.sum("n").alias("updates"), F.least(live, F.lit(k)).alias("items"), F.max("last_ts").alias("last_update")
    ).withColumns({"k": F.lit(k), "ttl_s": F.lit(ttl_s)})


def rule_stats(rules: DataFrame) -> DataFrame:
    p = F.col("prefix")
    return rules.agg(
        F.count("*").alias("rules"), F.max(F.length(p)).alias("longest"), F.count_distinct(F.substr(p, F.lit(1), F.lit(1))).alias("first_chars")
    )
