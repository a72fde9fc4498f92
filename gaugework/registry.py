"""Name -> query and name -> oracle SQL of the library's own operators; the modules of plans fill them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PLANS = ("series", "filters", "windows", "fleet", "storage", "streams")

#: Samples and resources as models.samples and models.resources give them, for the oracle's WITH clause.
S = "s AS (SELECT 'host-' || user_id AS host_id, event_type AS metric, ts, value, event_id AS seq FROM events)"
R = (
    "r AS (SELECT 'host-' || user_id AS host_id, CASE event_type WHEN 'click' THEN 'cpu_usage' WHEN 'view' THEN 'memory_usage' "
    "WHEN 'purchase' THEN 'disk_usage' WHEN 'signup' THEN 'network_usage' ELSE 'connections' END AS metric, ts, value, event_id AS seq FROM events)"
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its function's name, with its SQL; {S} and {R} stand for the CTEs above."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{S}", S).replace("{R}", R)
        return f

    return add


def _loaded() -> None:
    for name in PLANS:
        importlib.import_module(f"gaugework.plans.{name}")


def queries() -> dict[str, Query]:
    _loaded()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(ORACLES)
