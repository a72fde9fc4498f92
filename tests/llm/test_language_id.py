import collections
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from gaugework.llm import language_id


def brute_grams(text, n):
    """Counts of windows of folded letters, a boundary at the ends at most."""
    folded, out = [""], []
    for c in text:
        c = c.lower()[0] if c.isalpha() else ""
        if c or folded[-1]:
            folded.append(c)
    if folded[-1]:
        folded.append("")
    for i in range(len(folded) - n + 1):
        w = folded[i : i + n]
        if all(w[1:-1]):
            out.append(tuple(w))
    return out


def test_grams():
    texts = ["", "ab", "Ab  c1d, été!", "?", "x" * 50, "...", "de la"]
    for n in (3, 4):
        h, owner = language_id.grams(texts, n)
        want = [g for t in texts for g in brute_grams(t, n)]
        assert np.bincount(owner, minlength=len(texts)).tolist() == [len(brute_grams(t, n)) for t in texts]
        assert len(set(h.tolist())) == len(set(want)) and len(h) == len(want)
        assert len(set(zip(h.tolist(), want))) == len(set(want))


def test_pieces_change_nothing(monkeypatch):
    text = "Lorem ipsum dolor, sit amet 12 consectetur. " * 30
    whole = [np.sort(language_id.grams([text], n)[0]) for n in (3, 4)]
    monkeypatch.setattr(language_id, "PIECE", 100)
    parts = list(language_id.pieces(text))
    assert "".join(parts) == text and len(parts) > 5
    for n, w in zip((3, 4), whole, strict=True):
        assert (np.sort(language_id.grams(parts, n)[0]) == w).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~out))
    rows = language_id.identify(docs, model).join(docs.select("doc_id", "lang", out.alias("out")), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows[:50]:
        assert r.out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    tested = [r for r in rows if r.out]
    right = sum(r.lang == r.lang_pred for r in tested)
    print("held-out accuracy", right, len(tested), [(r.doc_id, r.lang, r.lang_pred, r.score) for r in tested if r.lang != r.lang_pred][:20])
    assert right >= 0.97 * len(tested) and all(0 <= r.score <= 1 for r in rows)
    kept = language_id.drop_unidentified(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score int"
    rows = [
        (i, t, lang, 1) for i,
        (t, lang) in enumerate([("the cat and the dog", "en")] * 5 + [("le chat et le chien", "fr")] * 5 + [
            (None, "en"), ("", None), ("12 34 !", "fr"), ("the", None), ("Ω", None), ("the dog " * 200_000, None)
        ])
    ]
    df = spark.createDataFrame(rows, schema)
    got = [(r.lang_pred, r.score) for r in language_id.identify(df, language_id.fit(df)).orderBy("doc_id").collect()]
    assert {x for x, _ in got[:5]} == {"en"} and {x for x, _ in got[5:10]} == {"fr"}
    assert got[10:13] == [("und", 0.0)] * 3 and got[13][0] == got[15][0] == "en" and got[14][0] == "en" and got[14][1] < 0.1
    none = spark.createDataFrame([], schema)
    assert language_id.identify(none, language_id.fit(none)).count() == 0
    assert [r.lang_pred for r in language_id.identify(df, language_id.fit(none)).collect()] == ["und"] * len(rows)


def test_filter_against_sets(spark, sf_dir):
    """The bit-sliced filter's counts and decisions against sets of the n-grams themselves, which have no false positives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = docs.where(~language_id.held_out(docs["doc_id"]))
    model = language_id.fit(train, rows=10**9)
    parts = collections.defaultdict(dict)
    rows = [r for r in train.collect() if r.lang and r.text]
    for lang in {r.lang for r in rows}:
        for n in (3, 4):
            found = collections.Counter(g for r in rows if r.lang == lang for g in brute_grams(r.text, n))
            total = sum(found.values())
            for g, k in found.items():
                parts[g][lang] = k / total
    sets = collections.defaultdict(set)
    for g, by in parts.items():
        for lang, part in by.items():
            if part >= 1e-5 and part >= 0.25 * max(by.values()):
                sets[lang].add(g)
    texts = [r.text or "" for r in docs.collect()] + ["Das ist the end", "x", "12 34", ""]
    total, hits = model.counts(texts)
    for text, t, own, (lang, score) in zip(texts, total.tolist(), hits.tolist(), model.predict(texts), strict=True):
        grams = [g for n in (3, 4) for g in brute_grams(text, n)]
        assert t == len(grams)
        exact = {k: sum(g in sets[k] for g in grams) for k in model.languages}
        for k, n in zip(model.languages, own, strict=True):
            assert exact[k] <= n <= exact[k] + 3 + 0.001 * t
        if any(map(str.isalpha, text)):
            most = max(exact.values())
            assert exact[lang] >= most - 3 - 0.001 * t and abs(score - exact[lang] / max(1, t)) < 0.01 + 3 / max(1, t)
        else:
            assert (lang, score) == ("und", 0.0)


def test_rejected_documents(spark, sf_dir):
    """Planted rows that must go, among the table's, which must stay."""
    rng, docs = random.Random(4), spark.read.parquet(f"{sf_dir}/documents.parquet")
    noise = [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randint(3, 9))) for _ in range(60)) for _ in range(20)]
    planted = ["Это совсем другой язык и другие буквы", "这是另一种语言", "12345 67890 !!! ???", "", None, *noise]
    rows = [(10**9 + k, t, None, None, len(t or "")) for k, t in enumerate(planted)]
    model = language_id.fit(docs.where(~language_id.held_out(docs["doc_id"])))
    kept = language_id.drop_unidentified(docs.unionByName(spark.createDataFrame(rows, docs.schema)), model)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect())
