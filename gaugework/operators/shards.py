"""Assignment of keys to nodes on a ring of CRC-32 points."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOP = 1 << 32


def ring(nodes: Sequence[str], virtual: int) -> list[tuple[int, str]]:
    """Points in order; a node has ``virtual`` of them, at the CRC-32 of their number and its name."""
    return sorted((zlib.crc32(f"{i}{n}".encode()), n) for n in nodes for i in range(virtual))


def replica_lists(points: list[tuple[int, str]], replicas: int) -> list[list[str]]:
    """For each point the first distinct nodes from it on, clockwise."""
    out, after = [], []
    for k in range(2 * len(points) - 1, -1, -1):  # twice round, backwards: a point's list is its node and those of the next point's
        node = points[k % len(points)][1]
        after = [node, *(n for n in after if n != node)][:replicas]
        if k < len(points):
            out.append(after)
    return out[::-1]


def intervals(spark: SparkSession, nodes: Sequence[str], virtual: int, replicas: int) -> DataFrame:
    """byte, lo, hi, nodes: the ring's intervals (lo, hi], a row for each high byte that they touch, so that keys join by byte."""
    if not 0 < replicas <= len(set(nodes)):
        raise ValueError(f"{replicas} replicas on {len(set(nodes))} nodes")
    points = ring(nodes, virtual)
    lists = replica_lists(points, replicas)
    rows, before = [], -1
    for (h, _), names in zip(points, lists, strict=True):
        rows.append((before, h, names))
        before = h
    rows.append((before, TOP - 1, lists[0]))  # past the last point: the first
    each = [(b, lo, hi, names) for lo, hi, names in rows for b in range((lo + 1) >> 24, (hi >> 24) + 1) if lo < hi]
    return spark.createDataFrame(each, "byte int, lo long, hi long, nodes array<string>")


def assign_replicas(keys: DataFrame, nodes: Sequence[str], virtual: int = 50, replicas: int = 1, column: str = "key") -> DataFrame:
    """Keys with crc and nodes (the replicas in order)."""
    hashed = keys.withColumn("crc", F.crc32(F.col(column).cast("binary"))).withColumn("byte", F.shiftright("crc", 24).cast("int"))
    rows = hashed.join(
        intervals(keys.sparkSession, nodes, virtual, replicas), "byte"
    ).where((F.col("crc") > F.col("lo")) & (F.col("crc") <= F.col("hi")))
    return rows.drop("byte", "lo", "hi")


def assign_shards(keys: DataFrame, nodes: Sequence[str], virtual: int = 50, column: str = "key") -> DataFrame:
    return assign_replicas(keys, nodes, virtual, 1, column).withColumn("node", F.col("nodes")[0]).drop("nodes")


def rebalance(keys: DataFrame, before: Sequence[str], after: Sequence[str], virtual: int = 50, column: str = "key") -> DataFrame:
    """Keys that move between two sets of nodes."""
    old = assign_shards(keys, before, virtual, column).withColumnRenamed("node", "node_before")
    both = assign_shards(old.drop("crc"), after, virtual, column).withColumnRenamed("node", "node_after")
    return both.where("node_before <> node_after").select(column, "node_before", "node_after")


def shard_distribution(assigned: DataFrame, virtual: int = 50) -> DataFrame:
    """Keys and ring points of each node, and its keys as a share of the mean."""
    n = assigned.groupBy("node").agg(F.count("*").alias("keys"))
    return n.select(
        "node", F.lit(virtual).alias("points"), "keys", (F.col("keys") / F.avg("keys").over(Window.partitionBy())).alias("skew")
    )  # a row a node
