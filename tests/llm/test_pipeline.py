import collections

import public_tokenizers

import corpus_pipeline
from gaugework.llm.common import written
from gaugework.llm.queries import queries
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_packing import held
from tests.llm.test_source_mixing import brute_targets
from tests.llm.test_spans import brute_secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def test_every_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now, steps = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = now = written(stage(spark, now, sf_dir), name)
        assert name == "packing" or now.schema.names == docs.schema.names
    rows = {name: df.collect() for name, df in [("docs", docs), *steps.items()]}
    kept = {r.doc_id for r in rows["language"]}
    assert set(rows["language"]) <= set(rows["docs"]) and len(kept) >= 0.98 * len(rows["docs"])  # test_language_id plants what must go
    assert all(any(map(str.isalpha, r.text)) for r in rows["language"])
    in_order = sorted((r.doc_id, r.text, r.source) for r in rows["language"])
    assert sorted(r.doc_id for r in rows["near_dedup"]) == brute_kept(in_order)
    assert set(rows["near_dedup"]) <= set(rows["language"])
    before = {r.doc_id: r for r in rows["near_dedup"]}
    for r in rows["secrets"]:
        assert brute_secrets(r.text) == "" and (brute_secrets(before[r.doc_id].text) or "[SECRET]" in r.text or r == before[r.doc_id])
    assert len(rows["secrets"]) == len(rows["near_dedup"])
    clean, mixed = {r.doc_id: r for r in rows["secrets"]}, collections.Counter()
    sizes = collections.Counter()
    for r in rows["secrets"]:
        sizes[r.source] += len(words(r.text))
    for r in rows["mix"]:
        own = clean[r.doc_id]
        rest = iter(words(own.text))
        assert r.text == own.text or all(w in rest for w in words(r.text))  # drawn blocks, in their order
        assert r.n_chars == len(r.text) and r.source == own.source
        mixed[r.source] += len(words(r.text))
    for s, t in brute_targets(dict(sizes)).items():
        assert abs(mixed[s] - t) <= 0.05 * t + 64
    held([(r.doc_id, r.text) for r in rows["mix"]], rows["packing"], 4096)


def test_empty_and_odd(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "the cat sat", "en", "s", 11), (3, "the cat sat", "en", "s", 11),
        (None, "le chat", "fr", None, 7), (5, "w x y " * 20_000, None, "t", 120_000)
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() > 0


def test_every_operator_has_a_query(spark, sf_dir):
    assert [int(k[2:].split("_")[0]) for k in queries()] == list(range(1, 14))
    assert public_tokenizers.path("byte_bpe_50k.json")
