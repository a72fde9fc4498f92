"""The merge-on-read store: versions, tombstones, compaction, writers that meet."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gaugework.operators.filters import time_range
from gaugework.sources import samples as S
from gaugework.sources.store import SCHEMA, Store

T0 = datetime.datetime(2024, 3, 1)


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


def frame(spark, points):
    return spark.createDataFrame([(h, "cpu", at(t), float(v), "", seq) for h, t, v, seq in points], SCHEMA)


def values(df):
    return sorted((r.host_id, r.ts, r.value) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"{tmp_path}/store")


def test_days_that_become_empty(spark, store):
    store.upsert(frame(spark, [("a", 0, 1, 0), ("a", 1, 2, 1), ("a", 30, 3, 2)]))
    store.delete(spark.createDataFrame([("a", at(30))], "host_id string, ts timestamp_ntz"))
    assert values(store.read()) == [("a", at(0), 1), ("a", at(1), 2)]
    assert store.compact() == 1 and values(store.read()) == [("a", at(0), 1), ("a", at(1), 2)]
    store.delete(store.read().select("host_id", "ts"))
    assert values(store.read()) == [] and store.compact() == 1 and values(store.read()) == []
    store.upsert(frame(spark, [("a", 30, 9, 1)]))  # after the deletion, although its seq is smaller
    assert values(store.read()) == [("a", at(30), 9)]


def test_nothing_stored_and_rows_without_time(spark, store):
    assert values(store.read()) == [] and store.compact() == 0
    assert not store.upsert(frame(spark, [])) and store.versions() == []
    odd = spark.createDataFrame([(None, "cpu", at(1), 1.0, "", 1), ("b", "cpu", None, 2.0, "", None)], SCHEMA)
    store.upsert(odd)
    store.upsert(odd)
    assert sorted(r.value for r in store.read().collect()) == [1.0, 2.0]
    assert store.compact() == 2 and sorted(r.value for r in store.read().collect()) == [1.0, 2.0]
    assert [r.value for r in store.read(start=at(0)).collect()] == [1.0]


def test_against_a_plain_version(spark, store):
    rng, plain = random.Random(8), {}
    for turn in range(8):
        points = [(rng.choice("abc"), rng.randrange(60), rng.randrange(100), rng.randrange(1000)) for _ in range(25)]
        if turn % 3 == 2:
            gone = {(h, t) for h, t, *_ in points}
            store.delete(spark.createDataFrame([(h, at(t)) for h, t in gone], "host_id string, ts timestamp_ntz"))
            plain = {k: v for k, v in plain.items() if k not in gone}
        else:
            store.upsert(frame(spark, points))
            for h, t, v, seq in sorted(points, key=lambda p: (p[3], p[2])):
                if plain.get((h, t), (-1, 0))[0] <= seq:
                    plain[h, t] = (seq, v)
        if turn == 4:
            assert store.compact() > 0
        want = sorted((h, at(t), float(v)) for (h, t), (_, v) in plain.items())
        assert values(store.read()) == want
        ranged = store.read(("a", "b"), at(10), at(40))
        assert values(ranged) == [x for x in want if x[0] in "ab" and at(10) <= x[1] <= at(40)]
    assert store.compact() > 0 and values(store.read()) == want and store.compact() == 0


def test_versions_and_vacuum(spark, store):
    store.upsert(frame(spark, [("a", 0, 1, 0)]))
    store.upsert(frame(spark, [("a", 0, 2, 1), ("b", 30, 5, 1)]))
    old = store.read(version=1)
    assert store.compact() == 1 and store.versions() == [1, 2, 3]
    assert values(old) == [("a", at(0), 1)]  # an older version reads its own files
    assert store.vacuum(keep=3, hours=0) == 0 and store.vacuum(keep=1, hours=1) == 0
    store.upsert(frame(spark, [("a", 1, 1, 5)]))
    assert store.vacuum(keep=1, hours=0) == 1  # the first batch alone is named no more: the second still holds a day
    assert values(store.read()) == [("a", at(0), 2), ("a", at(1), 1), ("b", at(30), 5)]


def test_killed_writers_and_compactions_lose_nothing(spark, store, monkeypatch):
    store.upsert(frame(spark, [("a", 0, 1, 0)]))
    store.upsert(frame(spark, [("a", 0, 2, 1)]))

    def killed(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "commit", killed)
        for work in (store.compact, lambda: store.upsert(frame(spark, [("z", 0, 9, 9)])), lambda: store.delete(frame(spark, [("a", 0, 0, 0)]))):
            with pytest.raises(KeyboardInterrupt):
                work()
    assert values(store.read()) == [("a", at(0), 2)] and store.versions() == [1, 2]
    assert store.vacuum(keep=10, hours=0) == 3  # what the killed ones wrote
    assert values(store.read()) == [("a", at(0), 2)]


def test_writers_that_meet(spark, store, monkeypatch):
    """Another writer, and a deletion of the day, come between a compaction's reading and its commit."""
    store.upsert(frame(spark, [("a", 0, 1, 0), ("b", 30, 1, 0)]))
    store.upsert(frame(spark, [("a", 0, 2, 1), ("b", 30, 2, 1)]))
    other, commit = Store(spark, store.path), Store.commit

    def late(self, *a, **b):
        monkeypatch.setattr(Store, "commit", commit)
        other.upsert(frame(spark, [("a", 0, 7, 2), ("c", 0, 8, 0)]))
        other.delete(spark.createDataFrame([("a", at(0))], "host_id string, ts timestamp_ntz"))
        other.drop_dates((T0 + datetime.timedelta(days=1)).date()) if not b.get("quiet") else None
        other.upsert(frame(spark, [("a", 0, 4, 0)]))
        return commit(self, *a, **b)

    monkeypatch.setattr(Store, "commit", late)
    assert store.compact() == 2
    assert values(store.read()) == [("a", at(0), 4), ("b", at(30), 2)]
    taken = store.versions()[-1]
    assert not store._put(store.manifest(taken)) and store.versions()[-1] == taken  # a version is put once


def test_transactions_count_once(spark, store):
    assert store.upsert(frame(spark, [("a", 0, 1, 0)]), "job", 0)
    assert not store.upsert(frame(spark, [("a", 0, 5, 9)]), "job", 0)
    assert store.upsert(frame(spark, []), "job", 1) and not store.upsert(frame(spark, [("a", 0, 5, 9)]), "job", 1)
    assert store.upsert(frame(spark, [("a", 0, 6, 9)]), "other", 0) and values(store.read()) == [("a", at(0), 6)]


def test_what_is_read_and_written(spark, store):
    """A range reads its days alone; days of one batch are read without a shuffle; an upsert leaves other files as they are."""
    store.upsert(frame(spark, [("a", t, t, t) for t in range(0, 240, 5)]))
    own = store.read(("a",), at(24), at(47))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PushedFilters: [IsNotNull(ts), IsNotNull(host_id)" in plan
    assert {f.split("date=")[1][:10] for f in own.inputFiles()} == {"2024-03-02"}
    before = {p for p in (store._names("rows"))}
    store.upsert(frame(spark, [("a", 30, 1, 1000)]))
    new = set(store._names("rows")) - before
    assert len(new) == 1 and store._names("rows", *new)[-1:] and [n for n in store._names("rows", *new) if n.startswith("date=")] == ["date=2024-03-02"]
    assert "Exchange" in store.read()._jdf.queryExecution().executedPlan().toString()
    assert values(store.read()) == values(S.read_samples(spark, store.path)) == values(time_range(store.read(), at(0), at(999)))
    S.drop_old(spark, store.path, datetime.date(2024, 3, 9), 3)
    assert {r.d for r in store.read().select(F.to_date("ts").alias("d")).collect()} == {datetime.date(2024, 3, d) for d in (6, 7, 8, 9, 10)}
