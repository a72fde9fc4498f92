import numpy as np
from pyspark.sql import functions as F

from gaugework.llm.nearest import nearest
from gaugework.llm.queries import op12_nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, rank int, at string"


def brute(rows, asked, k):
    """(query row, rank, vec_id, distance) of all valid rows of the most frequent length."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    lengths = sorted({len(v) for _, v in good}, key=lambda d: (-sum(len(v) == d for _, v in good), d))
    good = [(i, v) for i, v in good if len(v) == lengths[0]] if lengths else []
    out = []
    for a, (q, x) in enumerate(good):
        if q is not None and asked(q):
            far = sorted((float(np.sqrt(((x - v) ** 2).sum())), i is None, i or 0) for b, (i, v) in enumerate(good) if a != b)
            out += [(q, r + 1, None if none else i, d) for r, (d, none, i) in enumerate(far[:k])]
    return out


def rounded(rows):
    return sorted(((q, r, -1 if i is None else i, round(d, 9)) for q, r, i, d in rows), key=str)


def test_against_all_distances(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=12).tolist()) for k in range(700)]
    rows += [(1000 + k, rows[3][1]) for k in range(40)]  # copies: ties by vec_id
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, rows[3][1]), (None, rng.normal(size=12).tolist()), (2000, rng.normal(size=12).tolist())]
    rows += [(10, None), (20, []), (30, [0.0] * 12), (40, [1.0] * 11 + [None]), (50, [float("nan")] * 12), (60, [float("inf")] * 12), (70, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA).repartition(5)
    for width, size in ((3.0, 64 * 96), (3.0, 1 << 24)):
        got = nearest(df, F.col("vec_id") % 5 == 0, k=10, width=width, size=size)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert rounded(map(tuple, got.collect())) == rounded(brute(rows, lambda i: i % 5 == 0, 10))


def test_few_and_none(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nearest(empty, F.lit(True)).collect() == []
    two = spark.createDataFrame([(0, [1.0, 0.0], 0, ""), (1, [0.0, 2.0], 0, "")], SCHEMA)
    assert rounded(map(tuple, nearest(two, F.col("vec_id") == 0).collect())) == [(0, 1, 1, round(5**0.5, 9))]
    one = spark.createDataFrame([(0, [3.0, 4.0], 0, "")], SCHEMA)
    assert nearest(one, F.lit(True)).collect() == []
    assert nearest(two, F.lit(None).cast("boolean")).collect() == []


def test_bounds_leave_few_and_miss_none(spark):
    """Clustered and far from the origin: the centre is taken off, and the bounds alone find all neighbours."""
    rng = np.random.default_rng(1)
    rows = [(k, (100 + rng.normal(size=32) + 3 * (k % 7)).tolist()) for k in range(2000)]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    got = rounded(map(tuple, nearest(df, F.col("vec_id") % 50 == 0).collect()))
    want = rounded(brute(rows, lambda i: i % 50 == 0, 10))
    assert len(got) == len(want) and len(set(got) & set(want)) >= 0.99 * len(want)


def test_query_against_all_distances(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = rounded(map(tuple, op12_nearest_neighbours(spark, sf_dir).collect()))
    want = rounded(brute(rows, lambda i: i % 100 == 0, 10))
    assert len(got) == len(want) and len(set(got) & set(want)) >= 0.97 * len(want)
