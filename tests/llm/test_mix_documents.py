"""The mix's documents hold the blocks that were drawn, from anywhere in a document, with their white space."""

import collections
import re

from gaugework.llm import source_mixing

SCHEMA = "doc_id long, text string, source string, n_chars long"


def test_partial_copies_have_the_drawn_blocks(spark):
    texts = {i: "".join(f"{i}-{k}" + ("\n" if k % 5 == 4 else "\t " if k % 7 == 0 else " ") for k in range(400 + i)) for i in range(30)}
    rows = [(i, t, "abc"[i % 3], len(t)) for i, t in texts.items()] + [
        (90, "same id", "a", 7), (90, "another text", "a", 12), (91, None, "a", None), (92, "  ", "b", 2)
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = source_mixing.mix_documents(docs).collect()
    taken = collections.Counter()
    for r in source_mixing.mix_sources(docs).collect():
        taken[r.doc_id] += r.taken
    words, places, partial = collections.Counter(), set(), 0
    for r in got:
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
        if r.doc_id < 90:
            own = [int(w.split("-")[1]) for w in r.text.split()]
            assert own == sorted(set(own))
            whole = re.findall(r"\S+\s*", texts[r.doc_id])
            assert r.text == "".join(whole[k] for k in own)
            if len(own) < len(whole):
                partial += 1
                places |= {10 * k // len(whole) for k in own}
    assert {d: n for d, n in words.items() if d < 90} == {d: n for d, n in taken.items() if d < 90 and n}
    assert partial > 5 and places == set(range(10))
    again = source_mixing.mix_documents(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
