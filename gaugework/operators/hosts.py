"""Host records and their life: registration, liveness, removal, health, maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_hosts(
    events: DataFrame, texts: tuple[str, ...] = ("hostname", "ip", "group"), numbers: tuple[str, ...] = ("port",), maps: tuple[str, ...] = ()
) -> DataFrame:
    """``events``: host_id, ts, seq and those columns. The last non-empty text and positive number win; maps merge, later keys win.

    Each column is an aggregate of its own, so a host with very many events needs no more than its current record.
    """
    at = F.struct("ts", "seq")
    last = lambda c, ok: F.max_by(F.when(ok, F.col(c)), F.when(ok, at)).alias(c)
    made = [*(last(c, F.coalesce(F.col(c), F.lit("")) != "") for c in texts), *(last(c, F.col(c) > 0) for c in numbers)]
    out = events.groupBy("host_id").agg(*made, F.max("ts").alias("last_seen"), F.lit("healthy").alias("state"))
    for c in maps:
        entry = events.select("host_id", at.alias("_at"), F.explode(c)).groupBy("host_id", "key").agg(F.max_by("value", "_at").alias("value"))
        merged = entry.groupBy("host_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(c))  # one entry a key
        out = out.join(merged, "host_id", "left")
    return out


def last_heartbeats(samples: DataFrame) -> DataFrame:
    return samples.groupBy("host_id").agg(F.max("ts").alias("last_ts"))


def liveness(samples: DataFrame, as_of, offline_timeout_s: int = 300) -> DataFrame:
    """offline once the last heartbeat is older than the timeout, else healthy."""
    silent = F.col("last_ts") < F.lit(as_of) - F.make_dt_interval(secs=F.lit(offline_timeout_s))
    return last_heartbeats(samples).withColumn("state", F.when(silent, "offline").otherwise("healthy"))


def stale_hosts(samples: DataFrame, as_of, offline_timeout_s: int = 300) -> DataFrame:
    """Hosts to remove: silent for twice the timeout."""
    return liveness(samples, as_of, 2 * offline_timeout_s).where("state = 'offline'").select("host_id", "last_ts")


def auto_remove(states: DataFrame, as_of, unhealthy_timeout_s: int = 600, offline_timeout_s: int = 1200) -> DataFrame:
    """``states``: host_id, state, last_ts. Hosts to remove, with the reason: unhealthy too long, or offline twice its timeout."""
    older = lambda s: F.col("last_ts") < F.lit(as_of) - F.make_dt_interval(secs=F.lit(s))
    reason = F.when(
        (F.col("state") == "unhealthy") & older(unhealthy_timeout_s), "unhealthy_timeout"
    ).when((F.col("state") == "offline") & older(2 * offline_timeout_s), "offline_timeout")
    return states.withColumn("reason", reason).where("reason is not null")


def health_state(checks: DataFrame, over: DataFrame) -> DataFrame:
    """``checks``: host_id, ord, check, ok; ``over``: host_id, reason. Unhealthy by load (its reason goes first) or by the first failing check."""
    c = checks.groupBy("host_id").agg(F.min_by(F.when(~F.col("ok"), F.col("check")), F.when(~F.col("ok"), F.col("ord"))).alias("failed"))
    rows = c.join(over.select("host_id", "reason"), "host_id", "full")  # an overloaded host may have no check
    message = F.coalesce(F.concat(F.lit("high "), "reason"), F.concat(F.lit("failed "), "failed"))
    return rows.select("host_id", F.when(message.isNull(), "healthy").otherwise("unhealthy").alias("state"), message.alias("message"))


def maintenance(events: DataFrame) -> DataFrame:
    """``events``: host_id, ts, seq, on. The last one decides."""
    last = events.groupBy("host_id").agg(F.max_by("on", F.struct("ts", "seq")).alias("on"))
    return last.select("host_id", F.when(F.col("on"), "maintenance").otherwise("healthy").alias("state"))


def incremental_pull(samples: DataFrame, high_water: DataFrame, as_of, first_s: int = 30, fallback_s: int = 300) -> DataFrame:
    """``high_water``: host_id, last_ts. Per host the rows from a second after last_ts on; without one, of the last first_s
    seconds; a host with nothing new gets its rows of the last fallback_s seconds."""
    now = F.lit(as_of)
    ago = lambda s: now - F.make_dt_interval(secs=F.lit(s))
    rows = samples.where(F.col("ts") <= now).join(high_water, "host_id", "left")
    start = F.coalesce(F.col("last_ts") + F.make_dt_interval(secs=F.lit(1)), ago(first_s))
    rows = rows.withColumn("new", F.col("ts") >= start).where(F.col("new") | (F.col("ts") >= ago(fallback_s)))
    any_new = F.max("new").over(Window.partitionBy("host_id"))
    return rows.withColumn("any_new", any_new).where(F.col("new") | ~F.col("any_new")).drop("last_ts", "new", "any_new")
