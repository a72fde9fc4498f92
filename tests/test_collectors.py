"""Collectors: filters reach them, whatever they give is cut, parts become tasks."""

import datetime
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugework.sources import collectors as C

DAY = datetime.datetime(2024, 1, 1)


class Days(C.Collector):
    """A row for each of 5 hosts and 2 metrics in each of 10 days; notes what is asked of it in a folder."""

    name = "days_of_tests"

    def parts(self, wanted):
        parts = [d for d in range(10) if wanted.may_hold(DAY + datetime.timedelta(d), DAY + datetime.timedelta(d))]
        with open(f"{self.options['notes']}/{len(os.listdir(self.options['notes']))}", "w") as f:
            json.dump({"hosts": sorted(wanted.hosts) if wanted.hosts is not None else None, "parts": parts}, f)
        return [{"day": d} for d in parts]

    def read(self, part, wanted):
        rows = [(h, m, part["day"]) for h in range(5) for m in range(2)]
        yield pa.RecordBatch.from_pydict({
            "seq": [d * 10 + h * 2 + m for h, m, d in rows], "host_id": [None if h == 4 else f"h{h}" for h, *_ in rows], "metric": [f"m{m}" for _, m, _ in rows],
            "ts": [None if d == 9 and m == 1 else DAY + datetime.timedelta(d) for _, m, d in rows], "value": [float(h) for h, *_ in rows],
            "unit": [""] * len(rows)
        }, pa.schema([(n, C.ROWS.field(n).type) for n in ("seq", "host_id", "metric", "ts", "value", "unit")]))


@pytest.fixture
def read(spark, tmp_path):
    C.register_collector(spark, Days)
    yield lambda: C.collected(spark, "days_of_tests", notes=str(tmp_path))
    spark.conf.unset(C.PUSH)


def asked(tmp_path):
    return json.load(open(f"{tmp_path}/{max(os.listdir(tmp_path), key=int)}"))


AT = lambda d: F.lit(DAY + datetime.timedelta(d)).cast("timestamp_ntz")
CASES = {
    "all": (lambda: F.lit(True), None, range(10)),
    "host": (lambda: F.col("host_id") == "h1", ["h1"], range(10)),
    "hosts": (lambda: F.col("host_id").isin("h1", "h3", "other") & (F.col("metric") == "m0"), ["h1", "h3", "other"], range(10)),
    "two": (lambda: F.col("host_id").isin("h1", "h3") & (F.col("host_id") != "h1"), ["h1", "h3"], range(10)),
    "from": (lambda: F.col("ts") >= AT(6), None, range(6, 10)),
    "past": (lambda: F.col("ts") > AT(6), None, range(7, 10)),
    "between": (lambda: F.col("ts").between(AT(2), AT(4)) & (F.col("host_id") == "h2"), ["h2"], range(2, 5)),
    "before": (lambda: (F.col("ts") < AT(2)) & (F.col("value") > 1), None, range(2)),
    "at": (lambda: F.col("ts") == AT(3), None, [3]),
    "not null": (lambda: F.col("host_id").isNotNull(), None, range(10)),
    "null": (lambda: F.col("ts").isNull(), None, range(10)),
    "either": (lambda: (F.col("ts") < AT(2)) | (F.col("host_id") == "h1"), None, range(10)),
}


@pytest.mark.parametrize("case", CASES)
def test_filters(spark, read, tmp_path, case):
    """Results as without any push-down, and what reaches the collector."""
    made, hosts, parts = CASES[case]
    got = sorted(r.seq for r in read().where(made()).collect())
    assert asked(tmp_path) == {"hosts": hosts, "parts": list(parts)}
    plain = spark.createDataFrame(read().collect(), read().schema)
    assert got == sorted(r.seq for r in plain.where(made()).collect()) and (got or case == "none")


def test_nothing_can_match(read, tmp_path):
    assert read().where((F.col("host_id") == "h1") & (F.col("ts") > AT(4)) & (F.col("ts") < AT(3))).count() == 0
    assert read().where((F.col("ts") > AT(40))).count() == 0


def test_filters_are_on_the_plan(read):
    plan = read().where((F.col("host_id") == "h1") & (F.col("ts") >= AT(6)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "host_id" in text and "Filter (" not in text  # nothing is left for Spark to filter
    assert plan.rdd.getNumPartitions() == 4
