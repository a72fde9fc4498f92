import collections
import random

import xxhash

from gaugework.llm import simhash

LONG = "doc_id long, text string, lang string, fp int"


def brute_fp(text, words=3, seed=42):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + words]).encode(), seed) for k in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    """Of {doc: fingerprint}, by looking at every pair."""
    root = {f: f for f in fps.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    all_fps = sorted(root)
    for i, a in enumerate(all_fps):
        for b in all_fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = collections.defaultdict(lambda: 1 << 70)
    for d, f in fps.items():
        least[find(f)] = min(least[find(f)], d)
    return {d: least[find(f)] for d, f in fps.items()}


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: brute_fp(r.text) for r in docs.collect()}
    comp = brute_components(want)
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.fp & (1 << 64) - 1 == want[r.doc_id]
        assert r.component_id == comp[r.doc_id]


def test_hot_buckets_lose_no_link(spark):
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(3)]
    fps = {0}
    for c in centre:
        for _ in range(150):
            x = c
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << b
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = brute_components({f: f & (1 << 64) - 1 for f in signed})
    for bucket in (4, 256):
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, bucket)).collect()}
        got = {f: roots.get(f, f) for f in signed}
        groups = lambda m: {frozenset(x for x in m if m[x] == g) for g in m.values()}
        assert groups(got) == groups(want)


def test_edges(spark):
    rows = [
        (1, None, None, 1), (2, "", "en", 1), (3, " \t\n", "en", 1), (4, "one", "en", 1), (5, "ONE", "en", 1), (5, "ONE", "en", 1),
        (6, "a b", None, 2), (7, "x " * 50_000, None, 2)
    ]
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_components(spark.createDataFrame(rows, LONG)).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)} <= got
    assert simhash.simhash_components(spark.createDataFrame(rows, LONG)).count() == 8
    assert simhash.simhash_components(spark.createDataFrame([], LONG)).count() == 0
    kept = simhash.keep_one(spark.createDataFrame(rows, LONG))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7] and kept.columns == ["doc_id", "text", "lang", "fp"]
