"""Classification of keys by the longest prefix rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.operators.filters import prefixes_of


def classify_by_prefix(keys: DataFrame, rules: DataFrame, column: str = "key", case_sensitive: bool = True) -> DataFrame:
    """Each row with the category of its longest rule, or null. A rule ``x*`` is the prefix x; other rules are prefixes too.

    Keys meet rules by equality on their prefixes of the lengths that rules have; distinct keys alone are spread out.
    """
    fold = (lambda c: c) if case_sensitive else F.lower
    p = fold(F.regexp_replace("prefix", r"\*$", ""))
    rules = rules.select(p.alias("prefix"), "category")
    each = prefixes_of(keys.select(fold(F.col(column)).alias("_key")).where("_key is not null").distinct(), rules, "_key")
    best = each.join(rules, "prefix").groupBy("_key").agg(F.max_by("category", F.length("prefix")).alias("category"))
    return keys.withColumn("_key", fold(F.col(column))).join(best, "_key", "left").drop("_key")
