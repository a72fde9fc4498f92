"""Topics: offsets, partitions, exactly once, restarts, writers that meet."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from gaugework.plans.streams import finished_sink
from gaugework.sources import messages as M
from gaugework.session import qualified


def made(spark, ids):
    return spark.createDataFrame([(f"k{i % 7}", f"v{i}") for i in ids], "key string, value string")


def values(df):
    return sorted(r.value.decode() for r in df.select("value").collect())


def topic(spark, path):
    return M.Topic(qualified(spark, path), "t")


@pytest.fixture
def path(spark, tmp_path):
    assert M.create_topic(spark, str(tmp_path), "t", 3) and not M.create_topic(spark, str(tmp_path), "t", 5)
    return str(tmp_path)


def test_offsets_are_gapless_and_keys_keep_their_partition(spark, path):
    for part in (range(0, 100), range(100, 130), range(0)):
        M.publish(made(spark, part), path, "t")
    rows = M.read_messages(spark, path, "t").collect()
    assert sorted(r.value.decode() for r in rows) == sorted(f"v{i}" for i in range(130))
    by = {}
    for r in rows:
        by.setdefault(r.partition, []).append(r.offset)
    assert len(by) > 1 and all(sorted(o) == list(range(len(o))) for o in by.values())
    assert all(len({r.partition for r in rows if r.key == k}) == 1 for k in {r.key for r in rows})
    first = {r.value: (r.partition, r.offset) for r in rows}
    assert all(first[f"v{i}".encode()][1] < first[f"v{j}".encode()][1] for i in range(100) for j in range(100, 130) if i % 7 == j % 7)
    assert all(r.timestamp is not None and r.topic == "t" for r in rows)


def test_given_offsets(spark, path):
    for k in range(5):
        M.publish(made(spark, range(20 * k, 20 * k + 20)), path, "t")
    rows = M.read_messages(spark, path, "t").collect()
    ends = topic(spark, path).last()["ends"]
    for a, z in (([5, 0, 7], ends), ([0, 3, 0], [11, 4, 0]), (ends, ends)):
        named = lambda o: json.dumps({str(p): x for p, x in enumerate(o)})
        a, z = ([min(x, e) for x, e in zip(o, ends)] for o in (a, z))
        got = M.read_messages(spark, path, "t", named(a), named(z))
        assert values(got) == sorted(r.value.decode() for r in rows if a[r.partition] <= r.offset < z[r.partition])
    with pytest.raises(ValueError):
        topic(spark, path).offsets('{"0": 10000}')
    with pytest.raises(ValueError):
        M.Topic(qualified(spark, path), "other").last()


def test_nulls_long_values_and_bytes(spark, path):
    rows = spark.createDataFrame([(None, "a"), ("k", None), (None, None), ("", ""), ("k", "x" * 3_000_000)], "key string, value string")
    M.publish(rows.withColumn("extra", F.lit(1)), path, "t")
    got = sorted((r.key, r.value) for r in M.read_messages(spark, path, "t").na.fill({}).collect() if r.key is not None and r.value is not None)
    assert got == [(b"", b""), (b"k", b"x" * 3_000_000)]
    assert M.read_messages(spark, path, "t").count() == 5


def test_a_transaction_counts_once(spark, path):
    for _ in range(2):
        M.publish(made(spark, range(10)), path, "t", "w", 4)
    M.publish(made(spark, range(10, 15)), path, "t", "w", 3)
    M.publish(made(spark, range(15, 20)), path, "t", "w", 5)
    assert values(M.read_messages(spark, path, "t")) == sorted([f"v{i}" for i in range(10)] + [f"v{i}" for i in range(15, 20)])
    own = topic(spark, path)
    named = {s[1] for n in range(own.last()["n"] + 1) for s in own.commit(n)["segments"]}
    assert {f.base_name for f in own.fs.get_file_info(M.pafs.FileSelector(f"{own.root}/segments"))} == named  # the rest is gone


def test_failed_tasks_leave_nothing(spark, path):
    bad = made(spark, range(10)).withColumn("value", F.when(F.col("value") == "v7", F.raise_error(F.lit("broken"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        M.publish(bad, path, "t")
    assert topic(spark, path).last()["n"] == 0 and M.read_messages(spark, path, "t").count() == 0


def test_writers_that_meet(spark, path):
    own = topic(spark, path)
    with ThreadPoolExecutor(6) as pool:
        assert all(pool.map(lambda k: own.append([(k % 3, f"s{k}", k + 1, 1)], f"t{k}", None, 0), range(12)))
    assert own.last()["n"] == 12 and sum(own.last()["ends"]) == sum(range(1, 13))
    spans = sorted((s[0], s[2], s[3]) for n in range(13) for s in own.commit(n)["segments"])
    for (p, base, rows), (q, after, _) in zip(spans, spans[1:]):
        assert p != q or base + rows == after


def copied(spark, path, out, starting):
    """One run of a stream from the topic to Parquet, to what is there by now."""
    rows = M.stream_messages(spark, path, "t", starting).writeStream.format("parquet").option("path", out)
    rows.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(M.SCHEMA).parquet(out)


def test_stream_goes_on_after_a_restart(spark, path):
    M.publish(made(spark, range(40)), path, "t")
    assert values(copied(spark, path, f"{path}/out", "earliest")) == sorted(f"v{i}" for i in range(40))
    M.publish(made(spark, range(40, 60)), path, "t")
    M.publish(made(spark, range(60, 75)), path, "t")
    for _ in range(2):
        assert values(copied(spark, path, f"{path}/out", "earliest")) == sorted(f"v{i}" for i in range(75))


def test_stream_from_given_offsets_and_the_latest(spark, path):
    M.publish(made(spark, range(40)), path, "t")
    assert copied(spark, path, f"{path}/late", "latest").count() == 0
    rows = M.read_messages(spark, path, "t").collect()
    got = copied(spark, path, f"{path}/given", '{"0": 2, "1": 3, "2": 1}')
    assert values(got) == sorted(r.value.decode() for r in rows if r.offset >= (2, 3, 1)[r.partition])
    M.publish(made(spark, range(40, 50)), path, "t")
    assert values(copied(spark, path, f"{path}/late", "latest")) == sorted(f"v{i}" for i in range(40, 50))


def test_published_stream_counts_once(spark, path, tmp_path):
    """A batch that is published but not noted by its query, as after a lost driver, isn't published again."""
    made(spark, range(30)).write.parquet(f"{tmp_path}/in")
    given = spark.readStream.schema("key string, value string").parquet(f"{tmp_path}/in")
    M.publish(made(spark, range(30)), path, "t", "copy", 0)
    finished_sink(given, M.publish_sink(path, "t", "copy"))
    assert values(M.read_messages(spark, path, "t")) == sorted(f"v{i}" for i in range(30))
