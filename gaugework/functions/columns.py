"""Keys, predicates, messages and display forms as column expressions."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}


def threshold_predicate(value: Column, condition: Column, threshold: Column) -> Column:
    """value <condition> threshold; an unknown condition is false."""
    out = F.lit(False)
    for name, op in COMPARISONS.items():
        out = F.when(condition == name, op(value, threshold)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def hour_of(ts: Column) -> Column:
    """Whole hours since 1970 of a time stamp with or without a zone (the session's is UTC)."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 3600)


def alert_key(host: Column, metric: Column, ts: Column) -> Column:
    return F.concat_ws(":", host, metric, hour_of(ts).cast("string"))


def storage_key(host: Column, ts: Column) -> Column:
    return F.concat_ws(":", F.lit("metrics"), host, F.unix_seconds(ts.cast("timestamp")).cast("string"))


def storage_key_parts(key: Column) -> tuple[Column, Column]:
    parts = F.split(key, ":")
    return F.element_at(parts, 2), F.element_at(parts, 3).cast("long")


def alert_message(metric: Column, condition: Column, value: Column, threshold: Column) -> Column:
    return F.format_string("%s %s %.2f (threshold: %.2f)", metric, condition, value, threshold)


def si_format(value: Column) -> Column:
    """M and K with two decimals, six decimals below 0.01, else four."""
    return (
        F.when(value >= 1e6, F.format_string("%.2fM", value / 1e6))
        .when(value >= 1e3, F.format_string("%.2fK", value / 1e3))
        .when((value > 0) & (value < 0.01), F.format_string("%.6f", value))
        .otherwise(F.format_string("%.4f", value))
    )


def to_percentage(value: Column, most: Column) -> Column:
    """A share of most in percent; null where most is 0."""
    return value / F.nullif(most, F.lit(0.0)) * 100


def rfc3339(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))


def merged_maps(old: Column, new: Column) -> Column:
    """Both maps; the new one's values win, and a null one has none."""
    new = F.coalesce(new, F.create_map())
    return F.map_concat(F.map_filter(F.coalesce(old, F.create_map()), lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
