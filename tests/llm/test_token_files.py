import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gaugework.llm import token_files
from gaugework.llm.token_ids import TokenIds

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a", "a  b", "a   b", " a", "a ", "a \n b", "a\n\n b\tc", "x<|endoftext|> y", "x  <|endoftext|>", "it's we'll 'tis", "Éc ö 12 345 6789!",
    "\x1c a\x85b", "don 't", "é" * 300, "tab\t end", "a\nb", "a\n", "\nb", "ÀÖ ×÷ ß ÿ Ÿ", "nul\0 x", "naïve ½ ﬁ", "A1b22c", "é\u0301",
    "Ã\u0303 \u00c3x", "\u0083", "# $% &&&\n\nx"
]


@pytest.mark.parametrize("name,keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_memo_equals_plain_encoding(spark, sf_dir, name, keep):
    own, plain = TokenIds(public_tokenizers.path(name), keep, memo=50), Tokenizer.from_file(public_tokenizers.path(name))
    docs = ODD + [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    for at in range(0, len(docs), 7):
        for text, ids in zip(docs[at : at + 7], own.encode(docs[at : at + 7]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text[:80]


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (700, 1), (5000, 9), (3000, 50_257), (2000, 1 << 20)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        docs = token_files.pa.record_batch([token_files.pa.array([4, None]), token_files.pa.array([n // 2, n])], schema=token_files.DOCS)
        w, back = token_files.from_bytes(token_files.to_bytes(ids, docs))
        assert back == docs and (w.decode() == ids).all()
        for i in rng.integers(0, max(n, 1), 40).tolist() if n else []:
            assert w.access(i) == ids[i]
            places = np.flatnonzero(ids == ids[i])
            assert w.count(int(ids[i])) == len(places)
            assert w.count(int(ids[i]), i // 2, i) == (ids[i // 2 : i] == ids[i]).sum()
            k = int(rng.integers(0, len(places)))
            assert w.occurrence(int(ids[i]), k) == places[k]
            assert w.occurrence(int(ids[i]), len(places)) is None
        assert w.count(1 << 25) == 0


def brute(rows):
    t, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = token_files.token_table(docs.repartition(5), PATH, shard_tokens=20_000).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_edges(spark):
    schema = "doc_id long, text string, start int, part string"
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, None), (99, None)]
    got = token_files.token_table(spark.createDataFrame([(*r, 1, "p") for r in rows], schema), PATH, shard_tokens=5).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))
    assert token_files.token_table(spark.createDataFrame([], schema), PATH).count() == 0
