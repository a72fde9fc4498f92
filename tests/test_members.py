"""Membership: the exact flag with and without a filter before it, the filter against its formula, and where it stands in the plan."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugework.operators import members as N


@pytest.mark.parametrize("bits", [None, 64, 1000, 1001])
@pytest.mark.parametrize("widest", [0, N.WIDEST])
def test_flag_is_exact(spark, bits, widest):
    keys = [None, "", "k1", "k1", *(f"k{i}" for i in range(3000))]
    held = [None, "k1", "k1", "absent", *(f"k{i}" for i in range(0, 3000, 40))]
    candidates = spark.createDataFrame([(k, i, "x") for i, k in enumerate(keys)], "k string, n int, v string")
    members = spark.createDataFrame([(k, "y") for k in held], "k string, v string")
    out = N.membership(candidates, members, "k", bits, 7, widest)
    assert out.columns == ["k", "n", "v", "found", "fp_estimate"]
    got = Counter((r.k, r.n, r.v, r.found) for r in out.collect())
    assert got == Counter((k, i, "x", k is not None and k in held) for i, k in enumerate(keys))


def test_empty(spark):
    none = spark.createDataFrame([], "k long")
    some = spark.range(5).withColumnRenamed("id", "k")
    assert {(r.found, r.fp_estimate) for r in N.membership(some, none, "k").collect()} == {(False, 0.0)}
    assert N.membership(none, some, "k").count() == 0
    assert N.filter_report(none, some, "k").first().fp_measured is None


@pytest.mark.parametrize("bits", [None, 6000, 20_000])
def test_measured_rate_is_near_the_formula(spark, bits):
    members = spark.range(1000).selectExpr("id * 37 as k")
    r = N.filter_report(spark.range(100_000).withColumnRenamed("id", "k"), members, "k", bits).first()
    assert r.members == r.found == 1000 and r.candidates == 100_000 and r.passed >= 1000  # no member is refused
    assert abs(r.fp_measured - r.fp_estimate) < 0.1 * r.fp_estimate + 0.002
    assert bits or r.fp_estimate < 0.01


def test_refused_keys_are_not_shuffled(spark):
    members = spark.range(1000).selectExpr("id * 37 as k")
    candidates = spark.range(100_000).withColumnRenamed("id", "k")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = N.membership(candidates, members, "k")
        assert out.where("found").count() == 1000
        text = out._jdf.queryExecution().optimizedPlan().toString()
        join, refused = text.index("Join LeftOuter"), text.count("scalar-subquery")
        assert refused >= 2 and "scalar-subquery" in text[join:].split("Aggregate")[0], text
        assert out.agg(F.count_if("found")).first()[0] == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
