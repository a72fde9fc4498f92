"""The near-duplicate stage goes by the method of op9: fingerprints, segments in one-wildcard variants, a look at the bits, components."""

import math
import random

import numpy as np
import pytest

from gaugework.llm import simhash
from tests.llm.test_near_copies import grams, jaccard, planted
from tests.llm.test_simhash import brute_fp


def rows_with_bits(spark, texts, longs):
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    return {r.row: r for r in simhash.near_rows(rows, 5, longs).collect()}


def test_first_bits_are_a_simhash_of_the_shingles(spark):
    rng = random.Random(1)
    texts = [" ".join(f"W{rng.randrange(10**6)}" for _ in range(n)) for n in (1, 4, 5, 6, 30, 300, 1000)] + [None, "", "\t a  B\n"]
    for k, r in rows_with_bits(spark, texts, 6).items():  # no shingle occurs twice in these texts
        assert len(r.bits) == 48 and int.from_bytes(r.bits[:8], "little") == brute_fp(texts[k], words=5) and r.n == len(grams(texts[k])) - (not (texts[k] or "").split())


def brute_meet(a, b, width, segments, most):
    """Two fingerprints as numbers: whether a segment differs by at most one bit and few of 128 bits do."""
    apart = a ^ b
    few = (apart & (1 << 128) - 1).bit_count() <= most
    return few and any((apart >> k * width & (1 << width) - 1).bit_count() <= 1 for k in range(segments))


@pytest.mark.parametrize("copies", [3, 400])
def test_who_meets_in_a_variant_shares_a_key(spark, copies):
    """Clusters at several distances and lone ones, as by all pairs; with 400 copies values have over 2^16 pairs."""
    rng, width, segments, most = random.Random(copies), 12, 11, 30
    fps = [rng.getrandbits(192) for _ in range(60)]
    for centre, share in ((rng.getrandbits(192), 0.02), (rng.getrandbits(192), 0.1), (rng.getrandbits(192), 0.2)):
        fps += [centre ^ sum(1 << k for k in range(192) if rng.random() < share) for _ in range(copies)]
    nodes = spark.createDataFrame([(k, bytearray(f.to_bytes(24, "little"))) for k, f in enumerate(fps)], "node long, bits binary")
    halves = simhash.segment_halves(nodes, width, segments, 5)
    keys, sizes = {}, {}
    for r in simhash.meetings(halves, width, most).collect():
        keys.setdefault(r.node, set()).add((r.band, r.key))
        sizes.setdefault((r.band, r.key), []).append(r.size)
    assert all(set(n) == {len(n)} for n in sizes.values())
    met = {(i, j) for i in range(len(fps)) for j in range(i) if brute_meet(fps[i], fps[j], width, segments, most)}
    assert met and all(keys.get(i, set()) & keys.get(j, set()) for i, j in met)
    assert set(keys) == {k for pair in met for k in pair}  # nobody else has a key


def test_cut_follows_rows_and_similarity():
    assert [simhash.cut(n, 0.8)[0] for n in (0, 1, 4096, 4097, 250_000, 15_000_000)] == [12, 12, 12, 14, 18, 24]
    for n in (1, 10_000, 10**7):
        for least in (0.7, 0.8, 0.9):
            width, segments = simhash.cut(n, least)
            p = math.acos(2 * least / (1 + least)) / math.pi
            meet = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
            assert (1 - meet) ** segments <= 0.0005 < (1 - meet) ** (segments - 1)
    assert simhash.cut(100, 1.0) == (12, 1)


def test_pairs_at_the_similarity_are_proposed(spark):
    """By the bits alone, before the texts decide, with the segments of a quarter of a million rows."""
    texts = [t for _, t, _ in planted(600)]
    width, segments = simhash.cut(250_000, 0.8)
    longs = -(-width * segments // 64)
    rows, most = rows_with_bits(spark, texts, longs), simhash.farthest(128, 0.8)
    near = [k for k in range(0, len(texts), 2) if jaccard(grams(texts[k]), grams(texts[k + 1])) >= 0.8]
    bits = {k: int.from_bytes(rows[k].bits, "little") for k in rows}
    found = [brute_meet(bits[k], bits[k + 1], width, segments, most) and (bits[k] ^ bits[k + 1]).bit_count() <= simhash.farthest(64 * longs, 0.8) for k in near]
    assert len(near) > 200 and np.mean(found) >= 0.999
