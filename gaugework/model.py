"""The data model: long samples, and how the driver's tables stand for hosts, counters, logs and messages.

samples: host_id, metric, ts, value, unit, seq (order of arrival). Time stamps stay without a zone in batch plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES = ("host_id", "metric")

#: Which resource an event type of the driver's table stands for.
RESOURCES = {"click": "cpu_usage", "view": "memory_usage", "purchase": "disk_usage", "signup": "network_usage", "error": "connections"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_of(table(spark, sf_dir, "events"))


def samples_of(e: DataFrame) -> DataFrame:
    """Events, of a table or a stream, as samples: a user is a host, an event type is a metric."""
    return e.select(
        F.concat(F.lit("host-"), e["user_id"].cast("string")).alias("host_id"), e["event_type"].alias("metric"), "ts", "value",
        F.lit("").alias("unit"), e["event_id"].alias("seq")
    )


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources_of(samples(spark, sf_dir))


def resources_of(rows: DataFrame) -> DataFrame:
    """Samples with the names that alert rules and capacity formulas use."""
    name = F.element_at(F.create_map(*(F.lit(x) for pair in RESOURCES.items() for x in pair)), F.col("metric"))
    return rows.withColumn("metric", name)


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growing counters with a reset at every seventh point of a series."""
    from pyspark.sql import Window

    w = Window.partitionBy(*SERIES).orderBy("ts", "seq")
    s = samples(spark, sf_dir).withColumn("n", F.row_number().over(w))
    life = Window.partitionBy(*SERIES, F.floor(F.col("n") / 7)).orderBy("ts", "seq")
    return s.withColumn("value", F.round(F.sum("value").over(life), 2)).drop("n")


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that have events, as host records: id, hostname, ip, group, location, capacity."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    seen = table(spark, sf_dir, "events").select("user_id").distinct()
    c = c.join(seen, c["c_custkey"] == seen["user_id"], "left_semi")
    rows = c.join(
        F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]
    ).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # 25 nations and 5 regions by definition
    ip = F.concat_ws(
        ".", F.lit("10"), (F.col("c_custkey") / 65536 % 256).cast("int"), (F.col("c_custkey") / 256 % 256).cast("int"),
        (F.col("c_custkey") % 300).cast("int")
    )
    return rows.select(
        F.concat(F.lit("host-"), F.col("c_custkey").cast("string")).alias("host_id"), F.col("c_name").alias("hostname"), ip.alias("ip"),
        F.col("c_mktsegment").alias("group"), F.col("n_name").alias("location"), F.col("r_name").alias("zone"),
        (F.col("c_custkey") % 16 + 1).cast("int").alias("cpu_count"), F.col("c_custkey").alias("ord")
    )


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a command log: idx, key, op, value."""
    ops = {"signup": "SET", "error": "DELETE", "view": "UPDATE", "click": "INCREMENT", "purchase": "SET"}
    op = F.element_at(F.create_map(*(F.lit(x) for pair in ops.items() for x in pair)), F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"), F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), op.alias("op"),
        F.floor("value").alias("value")
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as queue messages: topic, payload (JSON, every ninth cut short), ts, retries."""
    e = table(spark, sf_dir, "events")
    whole = F.concat(
        F.lit('{"host_id":"host-'), e["user_id"].cast("string"), F.lit('","value":'), e["value"].cast("decimal(18,2)").cast("string"), F.lit("}")
    )
    cut = F.when(e["event_id"] % 9 == 0, F.lit('{"host_id":')).otherwise(whole)
    topic = F.when(e["event_type"] == "error", "alerts").otherwise("metrics")
    return e.select(e["event_id"].alias("id"), topic.alias("topic"), cut.alias("payload"), e["ts"], (e["event_id"] % 5).cast("int").alias("retries"))
