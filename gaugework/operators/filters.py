"""Projections, filters and derived metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, first match wins: (exact name or prefix, whether it is a prefix, new name, divisor, unit or None to keep it).
CANONICAL = (
    ("cpu.usage", False, "cpu_usage", 1, None),
    ("memory.usage", False, "memory_usage", 1, None),
    ("network.bandwidth.", True, "network_traffic", 1024**2, "MB/s"),
    ("network.rx_bytes.", True, "network_rx", 1024, "KB/s"),
    ("network.tx_bytes.", True, "network_tx", 1024, "KB/s"),
    ("network.connections.", True, "network_connections", 1, None),
    ("memory.total", True, "memory_total", 1024**2, "GB"),
    ("memory.used", True, "memory_used", 1024**2, "GB"),
    ("memory.free", True, "memory_free", 1024**2, "GB"),
    ("disk.usage.", True, "disk_usage", 1, None),
    ("disk.total.", True, "disk_total", 1024**3, "GB"),
    ("disk.used.", True, "disk_used", 1024**3, "GB"),
    ("disk.free.", True, "disk_free", 1024**3, "GB"),
)
IPV4 = r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
IPV6 = r"^(([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=.*::)(?!.*::.*::)([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4})$"


def time_range(rows: DataFrame, start=None, end=None, closed: str = "both", ts: str = "ts") -> DataFrame:
    """Rows between start and end; closed is both, neither, left or right."""
    if closed not in ("both", "neither", "left", "right"):
        raise ValueError(f"closed: {closed}")
    at = F.col(ts)
    if start is not None:
        rows = rows.where(at >= start if closed in ("both", "left") else at > start)
    if end is not None:
        rows = rows.where(at <= end if closed in ("both", "right") else at < end)
    return rows


def point_lookup(samples: DataFrame, host_id: str, ts) -> DataFrame:
    return samples.where((F.col("host_id") == host_id) & (F.col("ts") == ts))


def metric_filter(samples: DataFrame, *metrics: str, scope: str = "metric") -> DataFrame:
    """Samples of the metrics; scope record: all samples of scrapes (host, ts) in which one of them is."""
    own = samples.where(F.col("metric").isin(*metrics))
    return own if scope == "metric" else samples.join(own.select("host_id", "ts").distinct(), ["host_id", "ts"], "left_semi")


def host_filter(samples: DataFrame, *hosts: str) -> DataFrame:
    """Samples of the hosts; of all, if none is named."""
    return samples.where(F.col("host_id").isin(*hosts)) if hosts else samples


def hosts_by(
    hosts: DataFrame, state: str | None = None, group: str | None = None, tag: tuple[str, str] | None = None, host_id: str | None = None
) -> DataFrame:
    """Hosts by state, group, one tag (key, value) of a map column tags, or id; what is None doesn't matter."""
    for column, value in (("state", state), ("group", group), ("host_id", host_id)):
        hosts = hosts if value is None else hosts.where(F.col(column) == value)
    return hosts if tag is None else hosts.where(F.col("tags")[tag[0]] == tag[1])


def valid_ip(ip: Column) -> Column:
    return ip.rlike(IPV4) | ip.rlike(IPV6)


def validate_hosts(hosts: DataFrame, max_hosts: int | None = None) -> DataFrame:
    """Hosts with an id and a valid ip; of those, the first max_hosts by ord (the order of registration).

    The cut is a top-n by one number, so that tasks keep max_hosts rows each.
    """
    good = hosts.where((F.coalesce("host_id", F.lit("")) != "") & valid_ip(F.coalesce("ip", F.lit(""))))
    return good if max_hosts is None else good.orderBy("ord").limit(max_hosts)


def canonicalise(samples: DataFrame) -> DataFrame:
    """Renames and converts by CANONICAL; instance is what follows a prefix."""
    name, value, unit, instance = F.col("metric"), F.col("value"), F.col("unit"), F.lit("")
    for old, prefix, new, divisor, own in reversed(CANONICAL):
        hit = F.col("metric").startswith(old) if prefix else F.col("metric") == old
        name = F.when(hit, new).otherwise(name)
        value = F.when(hit, F.col("value") / divisor).otherwise(value)
        unit = F.when(hit, own).otherwise(unit) if own else F.when(hit, F.col("unit")).otherwise(unit)
        if prefix:
            instance = F.when(hit, F.ltrim(F.substr("metric", F.lit(len(old) + 1)), F.lit("."))).otherwise(instance)
    return samples.withColumns({"metric": name, "value": value, "unit": unit, "instance": instance})


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def validate_samples(samples: DataFrame) -> DataFrame:
    """Samples with a name and a finite value of 0 or more."""
    return samples.where((F.coalesce("metric", F.lit("")) != "") & is_finite(F.col("value")) & (F.col("value") >= 0))


def exact_rule(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """Each key with the category of the rule of exactly this name, or null. ``rules``: prefix, category."""
    return keys.join(rules.select(F.col("prefix").alias("key"), "category"), "key", "left")


def prefix_search(keys: DataFrame, prefix: str, column: str = "key", empty: str = "all") -> DataFrame:
    """Keys that begin with the prefix; an empty one finds all keys, or none."""
    if not prefix and empty == "none":
        return keys.where(F.lit(False))
    return keys.where(F.col(column).startswith(prefix))


def prefixes_of(keys: DataFrame, prefixes: DataFrame, column: str = "key") -> DataFrame:
    """Each key with each of its prefixes of a length that one of the ``prefixes`` (column prefix) has, so that prefix
    matches become equality joins. The distinct lengths, no more than the longest prefix has characters, go to the driver."""
    lengths = sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect() if r[0] is not None)
    fits = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(column))
    return keys.select("*", F.explode(fits).alias("_n")).withColumn("prefix", F.substr(F.col(column), F.lit(1), F.col("_n"))).drop("_n")


def prefix_exists(keys: DataFrame, prefixes: DataFrame, column: str = "key") -> DataFrame:
    """For each prefix (a row each) the number of rows whose key begins with it, and whether there is one."""
    asked = prefixes.select("prefix").distinct()
    met = prefixes_of(keys.select(column), asked, column).join(asked, "prefix")
    hits = asked.join(met.groupBy("prefix").agg(F.count("*").alias("n")), "prefix", "left")
    return hits.select("prefix", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("found"))


def pivoted(samples: DataFrame, *metrics: str, keys: tuple[str, ...] = ("host_id", "ts")) -> DataFrame:
    """One row a scrape with a column for each of the metrics."""
    return samples.groupBy(*keys).agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics))


def memory_usage_fallback(samples: DataFrame) -> DataFrame:
    """memory_usage as measured, else used / total * 100; used as measured, else total - available; the same of swap."""
    p = pivoted(samples, "memory_usage", "memory_total", "memory_used", "memory_available", "swap_total", "swap_free")
    used = F.coalesce("memory_used", F.col("memory_total") - F.col("memory_available"))
    swap = F.col("swap_total") - F.col("swap_free")
    share = lambda a, b: F.when(b > 0, a / b * 100)
    return p.select(
        "host_id", "ts", F.coalesce("memory_usage", share(used, F.col("memory_total"))).alias("memory_usage"), used.alias("memory_used"),
        swap.alias("swap_used"), share(swap, F.col("swap_total")).alias("swap_usage")
    )


def disk_usage(samples: DataFrame) -> DataFrame:
    p = pivoted(samples, "disk_total", "disk_free")
    used = F.col("disk_total") - F.col("disk_free")
    return p.select(
        "host_id", "ts", used.alias("disk_used"),
        F.when(F.col("disk_total") == 0, 0.0).otherwise(used / F.col("disk_total") * 100).alias("disk_usage")
    )


def network_total(samples: DataFrame) -> DataFrame:
    """Traffic of all interfaces in MB/s, else received plus sent (KB/s) / 1024."""
    of = lambda m: F.sum(F.when(F.col("metric") == m, F.col("value")))
    both = (F.coalesce(of("network_rx"), F.lit(0.0)) + F.coalesce(of("network_tx"), F.lit(0.0))) / 1024
    return samples.groupBy("host_id", "ts").agg(F.coalesce(of("network_traffic"), both).alias("network_total"))


def keep_last_n(samples: DataFrame, n: int, keys: tuple[str, ...] = ("host_id",)) -> DataFrame:
    """The n latest rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("seq"))
    return samples.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
