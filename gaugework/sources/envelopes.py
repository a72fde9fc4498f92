"""Envelopes: one JSON document a scrape of a host, in the shapes that agents send, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.operators.filters import canonicalise


def time_of(text: Column) -> Column:
    """RFC 3339 text or seconds since 1970, as a time stamp without a zone in UTC."""
    return F.coalesce(F.timestamp_seconds(text.try_cast("bigint")), F.try_to_timestamp(text)).cast("timestamp_ntz")


def number(text: Column, on_error: str = "skip") -> Column:
    """A number from text; what is none is null, or 0 if on_error is zero."""
    value = text.try_cast("double")
    return F.coalesce(value, F.lit(0.0)) if on_error == "zero" else value


def explode_envelopes(rows: DataFrame, payload: str = "payload", on_error: str = "skip") -> DataFrame:
    """Long samples with seq, of rows with a payload and seq. Metrics without a name or value go, and tags with an empty key or value.

    A payload is parsed once, into a variant; rows that are no envelope explode to one empty metric, which goes with the
    others (a filter before would parse again).
    """
    at = lambda path, kind: F.try_variant_get("_e", path, kind)
    host = F.coalesce(at("$.host_id", "string"), at("$.hostId", "string"))
    listed = lambda v, path: F.transform(
        F.try_variant_get(v, path, "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value"))
    )
    keyed = lambda v, path: F.map_entries(F.try_variant_get(v, path, "map<string,variant>"))
    inner = F.try_parse_json(at("$.metrics", "string"))  # metrics as JSON text in the JSON
    metrics = F.coalesce(listed(F.col("_e"), "$.metrics"), keyed(F.col("_e"), "$.metrics"), listed(inner, "$"), keyed(inner, "$"))
    tags = F.map_filter(at("$.tags", "map<string,string>"), lambda k, v: (k != "") & (F.coalesce(v, F.lit("")) != ""))
    # a generator between, or the optimiser would write the parsing into each of the looks at its result
    e = rows.select("seq", F.explode(F.array(F.try_parse_json(F.col(payload).cast("string")))).alias("_e"))
    e = e.select(host.alias("host_id"), time_of(at("$.timestamp", "string")).alias("ts"), "seq", tags.alias("tags"), metrics.alias("metrics"))
    each = e.select("host_id", "ts", "seq", "tags", F.explode_outer("metrics").alias("m"))
    part = lambda path: F.try_variant_get("m.value", path, "string")
    out = each.select(
        "host_id", F.coalesce("m.key", part("$.name")).alias("metric"), "ts", number(F.coalesce(part("$.value"), part("$")), on_error).alias("value"),
        F.coalesce(part("$.unit"), F.lit("")).alias("unit"), "seq", "tags"
    )
    return out.where((F.coalesce("metric", F.lit("")) != "") & F.col("value").isNotNull() & F.col("ts").isNotNull() & (F.coalesce(
        "host_id", F.lit("")
    ) != ""))


def scrapes(samples: DataFrame) -> DataFrame:
    """One row a scrape: host_id, timestamp in seconds, and its metrics by name."""
    metric = F.struct(F.col("metric").alias("name"), "value", "unit")
    rows = samples.groupBy("host_id", "ts").agg(F.array_sort(F.collect_list(metric)).alias("metrics"))  # the metrics of one scrape
    return rows.select("host_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), "metrics")


def build_envelopes(samples: DataFrame) -> DataFrame:
    """scrapes() with the metrics as JSON."""
    return scrapes(samples).withColumn("metrics", F.to_json("metrics"))


def live_messages(samples: DataFrame) -> DataFrame:
    """host_id, and the canonical envelope as a message of type metrics."""
    data = F.struct("host_id", "timestamp", "metrics")
    return scrapes(canonicalise(samples)).select("host_id", F.to_json(F.struct(F.lit("metrics").alias("type"), data.alias("data"))).alias("message"))


def dead_letters(messages: DataFrame, max_retries: int = 3) -> DataFrame:
    """Messages with route: dead if the payload is no JSON object with a host or the next try is one too many, retry if
    a status column says failed, else done. retries counts the next try."""
    host = F.coalesce(F.get_json_object("payload", "$.host_id"), F.get_json_object("payload", "$.hostId"))
    failed = F.col("status") == "failed" if "status" in messages.columns else F.lit(False)
    route = F.when(host.isNull(), "dead").when(failed & (F.col("retries") + 1 > max_retries), "dead").when(failed, "retry").otherwise("done")
    return messages.withColumn("route", route).withColumn("retries", F.col("retries") + F.when(failed, 1).otherwise(0))
