"""Ingest keeps every sample, also several of one host, metric and second."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from gaugework import registry
from gaugework.plans.streams import finished_sink
from gaugework.sources import samples as S
from gaugework.sources.store import ARRIVAL, POINT, SCHEMA, Store
from gaugework.streaming import queries as Q
from tests.compare import difference

T0 = datetime.datetime(2024, 1, 1, 10)


def values(df):
    return sorted((r.host_id, r.seq, r.value) for r in df.collect())


def test_query_on_samples_of_one_second(spark, sf_dir, tmp_path):
    """Every fourth event has another one of its series in the same second."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    again = e.where("event_id % 4 = 1").withColumns({"event_id": F.col("event_id") + 100_001, "ts": F.date_trunc("second", "ts").cast("timestamp_ntz"), "value": F.round(F.col("value") + 1, 2)})
    e.unionByName(again).write.parquet(f"{tmp_path}/events.parquet")
    df = registry.queries()["stream_ingest"](spark, str(tmp_path))
    # the tables that DuckDB reads as files
    e.unionByName(again).coalesce(1).write.parquet(f"{tmp_path}/one")
    sql = registry.oracle_sql()["stream_ingest"].replace("FROM events", f"FROM read_parquet('{tmp_path}/one/*.parquet')")
    assert difference(df, sf_dir, sql) == ""


def test_messages_that_come_again(spark, tmp_path):
    """A second's samples in one batch and in two; a message that comes again is stored once; compaction and deletion keep the rest."""
    line = lambda seq, second, value: (seq, f'{{"host_id":"h","timestamp":{1704103200 + second},"metrics":{{"cpu":{value}}}}}', 0)
    for k, rows in enumerate([[line(0, 0, 1), line(1, 0, 2), line(2, 5, 3)], [line(3, 0, 4), line(1, 0, 2), line(4, 5, 5)]]):
        spark.createDataFrame(rows, "seq long, payload string, retries int").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(1.1)  # files are taken in the order of their times
    given = spark.readStream.schema("seq long, payload string, retries int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    path = f"{tmp_path}/store"
    finished_sink(given, Q.ingest_sink(path, f"{tmp_path}/dead", compact_every=100))
    want = [("h", k, k + 1.0) for k in range(5)]
    store = Store(spark, path)
    assert values(S.read_samples(spark, path)) == want and len(store.versions()) == 2
    assert values(S.merged(store.read())) == [want[3], want[4]]
    assert store.compact() == 1 and values(store.read()) == want
    store.delete(spark.createDataFrame([("h", T0)], "host_id string, ts timestamp_ntz"))
    assert values(store.read()) == [want[2], want[4]]
    finished_sink(given, Q.ingest_sink(f"{path}-points", f"{tmp_path}/dead-points", key=POINT))
    assert values(S.read_samples(spark, f"{path}-points")) == [want[3], want[4]]


def test_a_store_keeps_its_key(spark, tmp_path):
    frame = lambda *points: spark.createDataFrame([("h", "cpu", T0, float(v), "", seq) for v, seq in points], SCHEMA)
    path = f"{tmp_path}/s"
    S.write_samples(frame((1, 1), (2, 2)), path, key=ARRIVAL)
    S.write_samples(frame((9, 2), (3, 3)), path)  # as the store was made; the later row of seq 2 counts
    assert values(S.read_samples(spark, path)) == [("h", 1, 1.0), ("h", 2, 9.0), ("h", 3, 3.0)]
    for write in (lambda: S.write_samples(frame((1, 1)), path, key=POINT), lambda: Store(spark, path, key=("ts",))):
        with pytest.raises(ValueError):
            write()
    plain = Store(spark, f"{tmp_path}/p")
    plain.upsert(frame((1, 1), (2, 2)))
    with pytest.raises(ValueError):
        S.write_samples(frame((1, 1)), plain.path, key=ARRIVAL)
    assert values(plain.read()) == [("h", 2, 2.0)]
