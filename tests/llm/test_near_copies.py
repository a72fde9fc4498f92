"""keep_one against all pairs by exact five-word Jaccard similarity."""

import random

from gaugework.llm import simhash

SCHEMA = "doc_id long, text string, source string"


def grams(text):
    w = (text or "").encode().lower().split()  # ASCII letters and white space only
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def planted(n=120, size=200):
    """Originals, each with a copy in which some words are replaced, so that similarities are spread over 0.7 to 1."""
    rng, vocab, rows = random.Random(5), [f"w{i}" for i in range(5000)], []
    for k in range(n):
        w = rng.choices(vocab, k=size)
        rows.append((2 * k, " ".join(w), "a"))
        for at in rng.sample(range(size), k % 11):
            w[at] = rng.choice(vocab)
        rows.append((2 * k + 1, " ".join(w), "b"))
    return rows


def brute_kept(rows):
    sets, root = [grams(t) for _, t, _ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] & sets[j] and jaccard(sets[i], sets[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [rows[i][0] for i in range(len(rows)) if find(i) == i]


def test_planted_copies(spark):
    rows = planted()
    near = [jaccard(grams(a[1]), grams(b[1])) for a, b in zip(rows[::2], rows[1::2])]
    for low in (0.8, 0.85, 0.9, 0.95):
        assert any(low <= x < low + 0.05 for x in near)
    assert any(x < 0.8 for x in near)
    for options in ({}, {"bucket": 1}):
        got = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA), **options).collect())
        assert got == brute_kept(rows)


def test_rows_not_doc_ids_are_chosen(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [
        (1, one, "a"), (1, two, "a"), (2, two, "b"), (3, three, "a"), (3, three, "a"), (None, three, "a"), (None, "p q", None), (None, "p q", None),
        (None, "r s", None)
    ]
    got = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([("1", one), ("1", two), ("3", three), ("None", "p q"), ("None", "r s")])


def test_other_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(k, text if k < 3 else f"{k} {text}" * 2, None, k, {"n": k}, 1.5) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long, node map<string,int>, mins double")
    got = simhash.keep_one(docs).collect()
    assert got[0].asDict().keys() == set(docs.columns) and min(r.doc_id for r in got) == 0
    assert all(r.row == r.doc_id and r.node == {"n": r.doc_id} and r.mins == 1.5 for r in got) and len(got) < 5
    assert simhash.keep_one(docs.where("false")).count() == 0


def star(n, size=300, seed=1, first=0):
    """A text of many fillings: near the text with all blanks, not near each other."""
    rng, vocab = random.Random(seed), [f"v{seed}-{i}" for i in range(50_000)]
    template = rng.choices(vocab, k=size)
    rows = [(first, " ".join(template), "t")]
    for k in range(n):
        w = list(template)
        for at in rng.sample(range(size), 5):
            w[at] = rng.choice(vocab)
        rows.append((first + k + 1, " ".join(w), "v"))
    rng.shuffle(rows)
    return rows, template


def chain(n, seed, first, size=120):
    """Each text near the next only: a window that moves over a long text."""
    rng = random.Random(seed)
    long = [f"c{seed}-{rng.randrange(10**6)}" for _ in range(size + 8 * n)]
    return [(first + k, " ".join(long[8 * k : 8 * k + size]), "c") for k in range(n)]


def test_groups_that_fill_a_band(spark):
    """Stars of which most pairs are below 0.8, in bands that are larger than what is compared as pairs: no link is lost."""
    for n in (250, 1500):
        rows, _ = star(n)
        got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
        assert [r.doc_id for r in got] == [0], (n, len(got))


def test_hot_bands_in_small_tiles(spark):
    """Two stars that a chain joins, a star of its own, chains, and texts that share much below 0.8: as by all pairs."""
    one, template = star(90, seed=2)
    two, other = star(70, seed=3, first=1000)
    steps = [(2000 + k, " ".join(other[: 30 * k] + template[30 * k :]), "j") for k in range(1, 10)]
    loose = [(3000 + k, " ".join(template[:180] + [f"l{k}-{i}" for i in range(120)]), "l") for k in range(40)]
    rows = one + two + steps + loose + star(60, seed=4, first=4000)[0] + chain(30, 5, 5000) + chain(20, 6, 6000)
    for options in ({"bucket": 4, "tile": 16, "turns": 1}, {}):
        got = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA), **options).collect())
        assert got == sorted(brute_kept(sorted(rows))), options


def test_shared_numbers_and_spanning_links():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60 if k % 2 else 4000, rng.integers(0, 80)).astype(np.uint64)) for k in range(70)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = simhash.common(sets)
    assert all(got[i, j] == want[i][j] for i in range(70) for j in range(70) if i != j)
    assert simhash.common([]).shape == (0, 0)
    a, b = np.array([1, 2, 3, 1, 7]), np.array([2, 3, 1, 9, 7])
    assert simhash.spanning(a, b) == [0, 1, 3]
