"""Random runs of letters only are secrets; words and identifiers of any length are none."""

import random
import string

import public_tokenizers

from gaugework.llm import secrets

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def found(run):
    return [s for part in secrets.all_spans(f"see {run} here", PATH) for s in part]


def test_letters():
    rng = random.Random(4)
    for letters, least in ((string.ascii_letters, 0.99), (string.ascii_uppercase, 0.99), (string.ascii_lowercase, 0.95)):
        runs = ["".join(rng.choices(letters, k=rng.randint(20, 64))) for _ in range(300)]
        assert sum(found(r) == [("random", 4, 4 + len(r))] for r in runs) >= least * len(runs)


def test_words():
    for run in (
        "internationalization", "getCurrentUserAccountSettings", "src/main/resources/application-settings", "Geschwindigkeitsbegrenzung",
        "a/b/c/d/e/f/g/h/i/j/k/l/m/n", "====================", "--------------------", "12345678901234567890"
    ):
        assert found(run) == [], run


def test_clean_documents(spark, sf_dir):
    import re

    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for kind, a, z in secrets.all_spans(r.text or "", PATH)[1]:
            assert re.search("[0-9]", r.text[a:z])
