import hashlib
import itertools
import random

import numpy as np

from gaugework.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, fingerprint int, part string"


def brute(rows):
    """By one text at a time, in order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        a, b, c = (fp.sketches([t]) for t in (text, new, following))
        out.append((
            doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), float(fp.likeness(a, b)[0]),
            float(fp.likeness(a, c)[0])
        ))
    return out


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


def test_batches_change_nothing(monkeypatch):
    rng = random.Random(1)
    parts = [words(rng, rng.randint(0, 60)) + "z" * rng.randint(0, 30) for _ in range(200)]
    whole = fp.sketches(parts)
    assert (whole == np.vstack([fp.sketches([p]) for p in parts])).all()
    monkeypatch.setattr(fp, "PIECE", 500)
    assert (whole == fp.sketches(parts)).all()


def test_labels_differ_and_phrases_are_short():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, 5000).astype(np.uint64)
    x = x[np.append(True, np.diff(x.astype(np.int64)) != 0)]
    first = np.zeros(len(x), bool)
    first[[0, 700, 701]] = True
    label = fp.tossed(x, first)
    same = (label[1:] == label[:-1]) & ~first[1:]
    assert label.max() <= 5 and not same.any()


def test_equal_substrings_share_names_at_any_offset():
    rng = random.Random(3)
    shared = words(rng, 600)
    for shift in range(1, 12):
        a, b = "q" * shift + words(rng, 3) + shared, words(rng, 9) + shared + words(rng, 9)
        assert fp.likeness(fp.sketches([a]), fp.sketches([b]))[0] > 0.75
    a, b = words(rng, 600), words(rng, 600)
    assert fp.likeness(fp.sketches([a]), fp.sketches([b]))[0] < 0.1


def test_long_unrelated_texts_are_unlike():
    rng = np.random.default_rng(5)
    a, b = ("".join(map(chr, rng.integers(97, 123, 3_000_000))) for _ in range(2))
    assert fp.likeness(*fp.sketches([a, b])[:, None])[0] < 0.02


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(tuple(r) for r in fp.fingerprint_table(docs.repartition(5)).collect())
    assert got == sorted(brute(rows))
    long = [g for g in got if g[1] > 1000]
    assert np.mean([g[5] for g in long]) > 0.25 and np.mean([g[5] > g[6] for g in long]) > 0.9


def test_edges(spark):
    rows = [(1, None), (2, ""), (2, "ab"), (2, "ab"), (3, "a" * 5000), (4, "é"), (5, words(random.Random(4), 40_000)), (None, "x y")]
    got = [tuple(r) for r in fp.fingerprint_table(spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    one = [(9, "just this one")]
    assert [tuple(r) for r in fp.fingerprint_table(spark.createDataFrame([(*r, 1, "p") for r in one], SCHEMA)).collect()] == brute(one)
    assert fp.fingerprint_table(spark.createDataFrame([], SCHEMA)).count() == 0


MASK = (1 << 64) - 1


def plain_mix(x):
    x = (x + 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 29
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 32


def plain_power(k):
    return pow(0xD6E8FEB86659FD93, k, 1 << 64)


def plain_names(x):
    """One level for one text: runs, deterministic coin tossing, phrases that begin at local maxima, their names."""
    runs = [(c, len(list(g))) for c, g in itertools.groupby(x)]
    x = [plain_mix(c ^ (n * plain_power(1) & MASK)) if n > 1 else c for c, n in runs]
    label = x
    for _ in range(4):
        tossed = []
        for k, c in enumerate(label):
            differ = c ^ label[k - 1] if k else 1
            low = (differ & -differ).bit_length() - 1
            tossed.append(2 * low | (c >> low & 1))
        label = tossed
    assert all(0 <= c <= 5 for c in label) and all(a != b for a, b in zip(label, label[1:]))
    begins = [0] + [k for k in range(1, len(x) - 1) if label[k] > label[k - 1] and label[k] > label[k + 1]]
    phrases = [x[a:z] for a, z in zip(begins, [*begins[1:], len(x)])]
    return [plain_mix(sum(plain_mix(c) * plain_power(k) for k, c in enumerate(p)) & MASK) for p in phrases]


def plain_sketch(text, first_level=3):
    out, x, level = [0xFFFFFFFF] * 64, [ord(c) for c in text], 0
    while text:
        x, level = plain_names(x), level + 1
        if level >= first_level:
            for name in (plain_mix(c ^ level) for c in x):
                out[name >> 58] = min(out[name >> 58], name & 0xFFFFFFFF, 0xFFFFFFFE)
            if len(x) == 1:
                break
    return out


def test_parsing_symbol_by_symbol():
    rng = random.Random(9)
    texts = ["", "a", "aa", "ab" * 300, "a" * 500, "\U0001f600é" * 7, *("".join(rng.choices("abcdef gh", k=rng.randint(2, 700))) for _ in range(40))]
    got = fp.sketches(texts)
    want = [plain_sketch(t) for t in texts]
    assert got.tolist() == want
    for a, b in itertools.combinations(range(0, len(texts), 3), 2):
        some = [(x, y) for x, y in zip(want[a], want[b]) if (x, y) != (0xFFFFFFFF, 0xFFFFFFFF)]
        like = sum(x == y for x, y in some) / len(some) if some else 1.0
        assert abs(fp.likeness(got[[a]], got[[b]])[0] - like) < 1e-12
