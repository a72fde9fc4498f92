import hashlib
import math
import random
import re
import zlib
from collections import Counter

from gaugework.llm import importance
from gaugework.llm.queries import op13_importance_resampling
from tests.compare import difference

SCHEMA = "doc_id long, text string, rank int, n string"


def features(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def brute(docs, target, longest, buckets, least, percent, seed):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log(((t[k] + 1) * (S + buckets)) / ((s[k] + 1) * (T + buckets))))
    out = []
    for i, text in docs:
        n, f = features(text, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def key(r):
    return [(x is None, x or 0) for x in r]


def test_against_counting(spark):
    rng = random.Random(3)
    words = ["Ab", "b", "çé", "Ñ9", "the", "x_y", "\x00q", "the-the", "L'été", "1", "東京"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "--", "　"]) for _ in range(n))
    docs = [(k, text(rng.choice([0, 1, 5, 19, 20, 21, 40, 300]))) for k in range(150)]
    docs += [(None, text(60)), (None, text(60)), (7, docs[7][1]), (7, text(90)), (200, None), (201, ""), (202, "..."), (203, "word " * 200_000)]
    docs += [(300, docs[40][1])] * 60  # a repeated row
    target = [text(30) for _ in range(20)] + [None, ""]
    for longest, percent in ((1, 10), (3, 50), (2, 100), (1, 0)):
        got = importance.resample(
            spark.createDataFrame([(*d, 1, "n") for d in docs], SCHEMA).repartition(5),
            spark.createDataFrame([(x,) for x in target], "text string"), longest, 97, 20, percent, 2024
        )
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, target, longest, 97, 20, percent, 2024), key=key)


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert importance.resample(docs, target).count() == 0
    one = spark.createDataFrame([(1, "a b " * 30, 0, "")], SCHEMA)
    assert [r.rank for r in importance.resample(one, target, percent=100).collect()] == [1]
    assert importance.resample(docs, one.select("text")).count() == 0


def test_query_against_sql(spark, sf_dir):
    from gaugework.llm.queries import oracle_sql

    assert difference(op13_importance_resampling(spark, sf_dir), sf_dir, oracle_sql()["op13_importance_resampling"]) == ""
