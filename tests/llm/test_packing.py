import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gaugework.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def held(rows, got, capacity):
    t, want = Tokenizer.from_file(PATH), []
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want.append((doc_id, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(map(str, (tuple(g)[:5] for g in got))) == sorted(map(str, want))
    sequences = {}
    for g in got:
        sequences.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(w[3] for w in want) // capacity)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    n, least = held(rows, packing.pack_documents(docs, PATH, 4096).collect(), 4096)
    assert n <= least + 1
    n, least = held(rows, packing.pack_documents(docs, PATH, 100).collect(), 100)
    assert n <= least * 1.01 + 1


def test_edges(spark):
    schema = "doc_id long, text string, piece string, part int"
    rows = [(1, None), (1, None), (2, ""), (3, "a b c " * 3000), (4, "x"), (None, "y z")]
    held(rows, packing.pack_documents(spark.createDataFrame([(*r, "p", 1) for r in rows], schema), PATH, 64).collect(), 64)
    assert packing.pack_documents(spark.createDataFrame([], schema), PATH).count() == 0


def test_fullest_is_the_best_subset():
    rng = random.Random(5)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 60)
        counts = {x: items.count(x) for x in items}
        used = packing.fullest(counts, room)
        assert all(n <= counts[x] for x, n in used.items())
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= room)
        assert sum(x * n for x, n in used.items()) == best
