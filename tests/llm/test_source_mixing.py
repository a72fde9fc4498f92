import re
import struct

import xxhash

from gaugework.llm import source_mixing

SCHEMA = "doc_id long, text string, source string, taken int"


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, total = {}, set(names), sum(sizes.values())
    while free:
        level = (total - sum(target.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        target |= {s: cap * sizes[s] for s in over}
        free -= over
    return target


def held(rows, got, tolerance):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + size(r[1])
    target = brute_targets(sizes)
    want = sorted((r[0], size(r[1]), sizes[r[2]]) for r in rows)
    assert sorted((g.doc_id, g.size, g.source_size) for g in got) == want
    assert all(0 <= g.taken <= 3 * g.size for g in got)
    of = {r[0]: r[2] for r in rows}
    taken = {}
    for g in got:
        assert abs(g.target - target[of[g.doc_id]]) < 1e-6 * max(1, g.target)
        taken[of[g.doc_id]] = taken.get(of[g.doc_id], 0) + g.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= tolerance * t + 64, (s, taken[s], t)


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA)
    got = source_mixing.mix_sources(df).collect()
    held(rows, got, 0.03)
    assert sorted(got) == sorted(source_mixing.mix_sources(df.repartition(3)).collect())


def test_caps_nulls_ties(spark):
    rows = [(i, "w " * (i % 7), "a") for i in range(40)] + [(100 + i, "v " * 500, "b") for i in range(30)] + [
        (200, None, None), (201, "x y z", None), (201, "x y z", None), (202, "", "c")
    ]
    got = source_mixing.mix_sources(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).collect()
    held(rows, got, 0.03)
    assert source_mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.taken for r in source_mixing.mix_sources(spark.createDataFrame([(1, None, None, 1)], SCHEMA)).collect()] == [0]


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 1000):
        rows = spark.range(n).select(F.col("id").alias("p"), F.lit(n).cast("long").alias("n"))
        p = source_mixing.permuted(rows, "p", "n", (F.lit(5), F.lit(0)))
        assert sorted(r.p for r in p.collect()) == list(range(n))


def hashed(*values):
    """Spark's xxhash64 of ints (4 bytes), longs as ("long", x) and strings."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v[1]) if isinstance(v, tuple) else struct.pack("<i", v)
        h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def brute_taken(rows, seed=20, block=32, per_shard=4096):
    """The mix slot by slot: {row: taken words}, and the slots that were settled. Fewer than 256 rows."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None] * any(r[2] is None for r in rows)
    place, total_of = {}, dict.fromkeys(names, 0)
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0], size(rows[k][1]))):
        place[k] = (total_of[rows[k][2]], total_of[rows[k][2]] + size(rows[k][1]))
        total_of[rows[k][2]] += size(rows[k][1])
    target = brute_targets(total_of)
    blocks = {s: -(-n // block) for s, n in total_of.items() if n}
    draws = {s: min(int(target[s] * blocks[s] / total_of[s] + 0.5), 3 * blocks[s]) for s in names if s in blocks}
    total = sum(draws.values())
    owner = [s for s in draws for _ in range(draws[s])]
    slots = {s: [] for s in draws}
    for k in range(total):
        slots[owner[hashed(seed, "draw", ("long", k)) % total]].append(k // per_shard)
    freed, have = [], {s: len(x) for s, x in slots.items()}
    for s in draws:
        x = max(0, have[s] - draws[s])
        freed += [k for k in range(have[s]) if x and (k + 1) * x // have[s] > k * x // have[s]]
    assert len(freed) == sum(max(0, draws[s] - have[s]) for s in draws)
    words = {}
    for s, n in draws.items():
        src = names.index(s)
        for slot in range(n):
            turn, i = divmod(slot, blocks[s])
            key = (seed, ("long", src), ("long", turn))
            for r in range(10):
                other = (hashed(*key, r) % blocks[s] - i) % blocks[s]
                i = other if hashed(*key, r, ("long", max(i, other))) & 1 else i
            for w in range(i * block, min((i + 1) * block, total_of[s])):
                words[s, w] = words.get((s, w), 0) + 1
    return {k: sum(words.get((rows[k][2], w), 0) for w in range(*place[k])) for k in range(len(rows))}, len(freed)


def test_taken_slot_by_slot(spark):
    rows = [(i, "w " * (37 * i % 211), "abcd"[i * i % 4]) for i in range(200)] + [(500, None, "a"), (501, "x " * 900, None)]
    want, moved = brute_taken(rows)
    got = source_mixing.mix_sources(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).collect()
    assert moved and sorted((r.doc_id, r.taken) for r in got) == sorted((rows[k][0], n) for k, n in want.items())


def test_counts_are_multinomial(spark):
    """Over shards and seeds the counts of a source have a multinomial's mean and variance; with one shard too."""
    share, total = {0: 0.5, 1: 0.3, 2: 0.2}, 40_000
    plan = spark.createDataFrame([(k, int(total * p)) for k, p in share.items()], "src long, draws long")
    for per_shard in (400, total):
        counts = {k: [] for k in share}
        for seed in range(3 if per_shard == 400 else 30):
            rows = source_mixing.drawn_counts(spark, plan, total, per_shard, seed, 4).collect()
            assert sum(r.n for r in rows) == total
            for r in rows:
                counts[r.src].append(r.n)
        for k, p in share.items():
            n, mean, spread = len(counts[k]), per_shard * p, (per_shard * p * (1 - p)) ** 0.5
            assert abs(sum(counts[k]) / n - mean) < 4 * spread / n**0.5
            assert 0.55 < (sum((x - mean) ** 2 for x in counts[k]) / n) ** 0.5 / spread < 1.5


def test_other_columns_of_any_name(spark):
    rows = [(i, f"{i} " * 90, "ab"[i % 2], i, {"k": i}, 1, 2, 3) for i in range(20)]
    names = "doc_id long, text string, source string, row long, size map<string,int>, copy int, hash int, times int"
    docs = spark.createDataFrame(rows, names)
    got = source_mixing.mix_documents(docs).collect()
    assert got and got[0].asDict().keys() == set(docs.columns)
    assert all(r.row == r.doc_id and r["size"] == {"k": r.doc_id} and (r.copy, r["hash"], r.times) == (1, 2, 3) for r in got)
    assert source_mixing.mix_sources(docs).count() == 20
