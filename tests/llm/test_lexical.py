import math
import random
import re
from collections import Counter

import pytest

from gaugework.llm import lexical
from gaugework.llm.queries import op11_lexical_search, oracle_sql
from tests.compare import difference

DOCS, ITEMS = "doc_id long, text string, rank int, n string", "item_id long, text string, score string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    own = [x for x in own if x[2]]
    n, words = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        found = []
        for i, c, size in own:
            m = 100 - 25 + 25 * size * n // words
            score = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t, times in asked.items() if t in c
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows, bundle, most, owners", [(16, 3, 1_000_000, 4), (4096, 256, 40, 2), (7, 256, 1_000_000, 1)])
def test_against_counting(spark, rows, bundle, most, owners):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["the"] * 60 + ["Ñu", "été", "東京", "A1"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "_", "\x00", "　"]) for _ in range(n))
    docs = [(k, text(rng.choice([0, 1, 3, 30, 200]))) for k in range(120)]
    docs += [(None, text(50)), (3, docs[3][1]), (3, text(9)), (200, None), (201, ""), (202, "... --"), (203, "w1 the " * 100_000)]
    docs += [(300 + k, "w2 w3 the copy") for k in range(60)]
    items = [(k, text(rng.choice([1, 5, 40]))) for k in range(11)] + [(5, "w2 copy"), (5, "w2 copy"), (None, "w3 w3 W3"), (40, None), (41, ""), (42, "nowhere"), (43, "the")]
    got = lexical.search(
        spark.createDataFrame([(*d, 1, "") for d in docs], DOCS).repartition(5), spark.createDataFrame([(*i, "") for i in items], ITEMS),
        k=20, rows=rows, items_a_bundle=bundle, most=most, owners=owners
    )
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 20)


def test_empty_tables(spark):
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    docs, items = spark.createDataFrame([(1, "a b", 0, "")], DOCS), spark.createDataFrame([(1, "b", "")], ITEMS)
    assert lexical.search(no_docs, items).collect() == [] == lexical.search(docs, no_items).collect()
    assert lexical.search(spark.createDataFrame([(1, "...", 0, "")], DOCS), items).collect() == []
    assert lexical.search(docs, spark.createDataFrame([(1, "--", "")], ITEMS)).collect() == []


def test_query_against_sql(spark, sf_dir):
    assert difference(op11_lexical_search(spark, sf_dir), sf_dir, oracle_sql()["op11_lexical_search"]) == ""
