"""Folding a log of commands into the state of its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_changelog(log: DataFrame) -> DataFrame:
    """``log``: idx, key, op (SET, DELETE, UPDATE, INCREMENT, EXPIRE), value. key and value of all keys that are there at the end.

    A key is there if its last SET, DELETE or EXPIRE is a SET. From then on it stays, so the last SET or UPDATE of all
    gives a value, and the INCREMENTs after it add to that: one aggregate of the log, and one of its INCREMENTs.
    """
    idx, op = F.col("idx"), F.col("op")
    reset, gives = op.isin("SET", "DELETE", "EXPIRE"), op.isin("SET", "UPDATE")
    last = log.groupBy("key").agg(
        F.max_by(F.when(reset, op), F.when(reset, idx)).alias("how"), F.max(F.when(gives, idx)).alias("at"), F.max_by(
            F.when(gives, F.col("value")), F.when(gives, idx)
        ).alias("base")
    )
    there = last.where("how = 'SET'").select("key", "at", "base").alias("t")
    more = log.where(op == "INCREMENT").select("key", "idx", F.col("value").alias("more")).alias("m")
    both = there.join(more, (F.col("t.key") == F.col("m.key")) & (F.col("m.idx") > F.col("t.at")), "left")
    return both.groupBy("t.key", "base").agg(F.coalesce(F.sum("more"), F.lit(0)).alias("more")).select(
        "key", (F.col("base") + F.col("more")).alias("value")
    )


def log_compaction(log: DataFrame, snapshot_idx: int) -> DataFrame:
    """A log that folds to the same state: the state at the index as SETs, then the later commands."""
    snapshot = fold_changelog(log.where(F.col("idx") <= snapshot_idx))
    rows = snapshot.select(F.lit(snapshot_idx).cast("long").alias("idx"), "key", F.lit("SET").alias("op"), "value")
    return rows.unionByName(log.where(F.col("idx") > snapshot_idx).select("idx", "key", "op", "value"))
