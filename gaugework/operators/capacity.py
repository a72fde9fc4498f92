"""Fleet load, its forecast, and scaling decisions, as a back-test over time buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.operators.segments import same
from gaugework.session import shared_root

#: Resource weights; the custom weight is for connections.
WEIGHTS = {"cpu_usage": 0.3, "memory_usage": 0.3, "disk_usage": 0.2, "network_usage": 0.2}


@dataclass(frozen=True)
class Scaling:
    up: float = 50.0
    down: float = 75.0
    min_hosts: int = 3
    max_hosts: int = 100
    step: int = 1
    cooldown_s: int = 300
    scale: float = 1.0
    cost_per_hour: float | None = None
    budget: float | None = None


def fleet_load(samples: DataFrame, interval: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Means of the resources, connections, and hosts with samples, per time bucket."""
    means = [F.coalesce(F.avg(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0)).alias(m) for m in WEIGHTS]
    connections = F.coalesce(F.sum(F.when(F.col("metric") == "connections", F.floor("value"))), F.lit(0)).alias("connections")
    rows = samples.groupBy(*keys, F.window("ts", interval).alias("w")).agg(*means, connections, F.count_distinct("host_id").alias("hosts"))
    return rows.select(*keys, F.col("w.start").alias("ts"), *WEIGHTS, "connections", "hosts")


def load_score(load: DataFrame, custom: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Weighted use, plus connections a thousand per healthy host; 100 at most, and 100 without a healthy host."""
    score = sum((F.col(m) / 100 * w for m, w in WEIGHTS.items()), F.lit(0.0)) + F.col("connections") / (F.col("hosts") * 1000) * custom
    return load.withColumn("score", F.when(F.col("hosts") == 0, 100.0).otherwise(F.least(score * scale, F.lit(100.0))))


def time_rules(decisions: DataFrame, rules: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``rules``: ord, name, start_time, end_time, days (0 is Sunday), min_hosts, max_hosts, action. The first that fits the
    bucket's weekday and minute, as rule_action, rule_reason and rule_target (null: none). keys: of fleets with buckets of their own."""
    day = (F.dayofweek("ts") - 1).cast("int")
    minute = F.date_format("ts", "HH:mm")
    each = rules.withColumn("day", F.explode("days")).drop("days")
    target = (
        F.when((F.col("action") == "scale_up") & (F.col("hosts") < F.col("max_hosts")), F.least(F.col("hosts") + 1, "max_hosts"))
        .when((F.col("action") == "scale_down") & (F.col("hosts") > F.col("min_hosts")), F.greatest(F.col("hosts") - 1, "min_hosts"))
        .otherwise(F.col("hosts"))
    )
    keyed = decisions.withColumns({"day": day, "minute": minute})
    hit = keyed.join(each, "day").where((F.col("minute") >= F.col("start_time")) & (F.col("minute") <= F.col("end_time")))
    first = hit.groupBy(*keys, "ts").agg(F.min_by(
        F.struct(F.col("action").alias("a"), F.concat(F.lit("time_based_rule:"), "name").alias("r"), target.alias("t")), "ord"
    ).alias("x"))
    first = first.select(*keys, "ts", F.col("x.a").alias("rule_action"), F.col("x.r").alias("rule_reason"), F.col("x.t").alias("rule_target"))
    return decisions.join(first, [*keys, "ts"], "left")


def cost_decision(hosts: Column, c: Scaling) -> Column:
    """Whether the hosts cost more than the budget."""
    return F.lit(False) if c.budget is None or c.cost_per_hour is None else hosts * c.cost_per_hour > c.budget


def proposed(scored: DataFrame, c: Scaling) -> DataFrame:
    """``scored``: ts, hosts, healthy, score, forecast and rule columns. What each bucket would decide, without the cooldown."""
    load, n = F.greatest("score", "forecast"), F.col("hosts")
    up = (load > c.up) & (n < c.max_hosts)
    down = (load < c.down) & (n > c.min_hosts) & (F.col("healthy") > c.min_hosts)
    ruled = F.coalesce(F.col("rule_action"), F.lit("none")) != "none"
    cost = cost_decision(n, c)
    pick = lambda rule, saving, less, more, none: F.when(ruled, rule).when(cost, saving).when(down, less).when(up, more).otherwise(none)
    return scored.select(
        "*",
        pick(F.col("rule_action"), F.lit("scale_down"), F.lit("scale_down"), F.lit("scale_up"), F.lit("none")).alias("action"),
        pick(F.col("rule_reason"), F.lit("cost_optimization"), F.lit("low_load"), F.lit("high_load"), F.lit("")).alias("reason"),
        pick(
            F.col("rule_target"), n - 1, F.greatest(n - c.step, F.lit(c.min_hosts)), F.least(n + c.step, F.lit(c.max_hosts)), n
        ).cast("long").alias("target"),
    )


def _next_after(wanted: DataFrame, cooldown: int, keys: tuple[str, ...]) -> DataFrame:
    """``wanted``: keys, t. With next: the first wanted time at or past t + cooldown. Times are dealt by slots as long as the
    cooldown: it lies in the slot of t + cooldown or in the first later slot with any time, of 4,096 slots at a look."""
    slot = lambda c: F.floor(c / cooldown)
    asked = wanted.select(*keys, (F.col("t") + cooldown).alias("at"), F.col("t").alias("from"), F.lit(None).cast("long").alias("own"))
    given = wanted.select(*keys, F.col("t").alias("at"), F.lit(None).cast("long").alias("from"), F.col("t").alias("own"))
    both = asked.unionByName(given).withColumn("slot", slot(F.col("at")))
    here = Window.partitionBy(*keys, "slot").orderBy("at", F.col("own").isNotNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.withColumn("near", F.first("own", ignorenulls=True).over(here))
    slots = both.groupBy(*keys, "slot").agg(F.min("own").alias("first")).withColumn("many", F.floor(F.col("slot") / 4096))
    ahead = lambda w: w.rowsBetween(1, Window.unboundedFollowing)
    slots = slots.withColumn("later", F.first("first", ignorenulls=True).over(ahead(Window.partitionBy(*keys, "many").orderBy("slot"))))
    above = slots.groupBy(*keys, "many").agg(F.min("first").alias("first"))
    above = above.withColumn("far", F.first("first", ignorenulls=True).over(ahead(Window.partitionBy(*keys).orderBy("many"))))
    slots = slots.alias("x").join(above.alias("y"), same("x", "y", (*keys, "many"))).select(
        *(F.col(f"x.{k}").alias(k) for k in keys), "x.slot", F.coalesce("x.later", "y.far").alias("later")
    )
    rows = found.where(F.col("from").isNotNull()).alias("x").join(slots.alias("y"), same("x", "y", (*keys, "slot")))
    return rows.select(*(F.col(f"x.{k}").alias(k) for k in keys), F.col("x.from").alias("t"), F.coalesce("x.near", "y.later").alias("next"))


def decided(wanted: DataFrame, cooldown: int, keys: tuple[str, ...], most: int = 1000) -> DataFrame:
    """``wanted``: keys, t (distinct). Those that are decided: the first, and of each decision the first past its cooldown.

    Fleets of up to ``most`` proposals are folded in order. Of larger ones every proposal points to its next; what pointers reach
    from the first is found by doubling: the decisions up to the 2^k-th and pointers of 2^k steps give those up to the 2^(k+1)-th.
    """
    each = wanted.groupBy(*keys).agg(F.count("*").alias("n"))
    large = each.where(F.col("n") > most).select(*keys)
    over = same("x", "y", keys) if keys else F.lit(True)
    mark = lambda rows, how: rows.alias("x").join(large.alias("y"), over, how)
    small = mark(wanted, "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("ts"))  # ``most`` times at most
    step = lambda s, t: F.when((F.size(s) == 0) | (t - F.element_at(s, -1) >= cooldown), F.concat(s, F.array(t))).otherwise(s)
    out = small.select(*keys, F.explode(F.aggregate("ts", F.array().cast("array<bigint>"), step)).alias("t"))
    if large.isEmpty():
        return out
    rows = mark(wanted, "left_semi").checkpoint()
    reached = rows.groupBy(*keys).agg(F.min("t").alias("t"))
    jump = _next_after(rows, cooldown, keys).where("next is not null").checkpoint()
    of = lambda a, columns: [*(F.col(f"{a}.{k}").alias(k) for k in keys), *columns]
    while True:
        more = reached.alias("x").join(jump.alias("y"), over & (F.col("x.t") == F.col("y.t"))).select(*of("x", [F.col("y.next").alias("t")])).checkpoint()
        if more.isEmpty():
            return out.unionByName(reached)
        reached = reached.unionByName(more).checkpoint()
        jump = jump.alias("x").join(jump.alias("y"), over & (F.col("x.next") == F.col("y.t"))).select(*of("x", [F.col("x.t"), F.col("y.next")])).checkpoint()


def scaling_decisions(decisions: DataFrame, cooldown_s: int, keys: tuple[str, ...] = (), most: int = 1000) -> DataFrame:
    """The proposals in order, those within the cooldown after a decision set to none. Of two proposals of one time the first by
    action, reason and target counts. Fleets (by keys) are independent of each other."""
    if decisions.sparkSession.sparkContext.getCheckpointDir() is None:
        shared_root(decisions.sparkSession)
    rows = decisions.select(*keys, "ts", "action", "reason", "target", "hosts")
    time = F.unix_micros(F.col("ts").cast("timestamp"))
    first = F.row_number().over(Window.partitionBy(*keys, "ts").orderBy(F.col("action") == "none", "action", "reason", "target")) == 1
    rows = rows.withColumns({"t": time, "wanted": (F.col("action") != "none") & first}).checkpoint()  # a row a time bucket, read thrice
    wanted = rows.where("wanted").select(*keys, "t")
    act = wanted if cooldown_s <= 0 else decided(wanted, cooldown_s * 1_000_000, keys, most)
    over = same("x", "y", (*keys, "t"))
    both = rows.alias("x").join(act.withColumn("_act", F.lit(True)).alias("y"), over, "left").select("x.*", F.coalesce("y._act", F.lit(False)).alias("_act"))
    act = F.col("_act") & F.col("wanted")
    return both.select(
        *keys, "ts", F.when(act, F.col("action")).otherwise("none").alias("action"), F.when(act, F.col("reason")).otherwise("").alias("reason"),
        F.when(act, F.col("target")).otherwise(F.col("hosts")).alias("target")
    )
