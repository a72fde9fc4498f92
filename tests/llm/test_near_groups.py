"""What is left after the turns of the near-duplicate stage: no row for each pair of a group, and no table left behind by a stage."""

import os

import corpus_pipeline
from gaugework.llm import simhash
from gaugework.llm.common import MADE, written
from tests.llm.test_near_copies import SCHEMA, brute_kept, chain, star


def loose(n, first, shared=170):
    """Texts that share more than half of their words and are near copies of none: all meet, none links."""
    head = " ".join(f"h{first}-{i}" for i in range(shared))
    return [(first + k, f"{head} " + " ".join(f"x{first + k}-{i}" for i in range(240 - shared)), "l") for k in range(n)]


def test_pairs_of_a_group_are_no_rows(spark, monkeypatch):
    """Keys of up to 64 nodes too: pairs as rows are one a node and turn at most."""
    made, likely = [], simhash.likely

    def watched(pairs, *rest):
        made.append(pairs.count())
        return likely(pairs, *rest)

    monkeypatch.setattr(simhash, "likely", watched)
    rows = [r for k in range(4) for r in loose(50, 1000 * k, 190)] + chain(40, 3, 9000) + star(30, seed=8, first=10_000)[0]
    got = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute_kept(sorted(rows))
    assert len(made) == 2 and max(made) <= len(rows), made


def test_groups_are_whole_where_that_is_sent_less_often(spark):
    """Key 1 and 2 connect six nodes, key 3 has two; a row is node, band, key, root."""
    met = [(n, 0, 1, n) for n in (1, 2, 3, 4)] + [(n, 1, 2, n) for n in (4, 5, 6)] + [(n, 2, 3, n) for n in (8, 9)]
    met = spark.createDataFrame(met, "node long, band long, key long, root long")
    sizes = spark.createDataFrame([(n, 10) for n in range(10)], "node long, n long")
    rows = lambda *options: sorted(tuple(r) for r in simhash.in_groups(met, sizes, simhash.key_links(met), *options).collect())
    whole = [(n, -1, 1, n) for n in (1, 2, 3, 4, 5, 6)] + [(n, -1, 8, n) for n in (8, 9)]
    assert rows(1, 10) == sorted(whole) and rows(6, 4) == sorted(whole)
    assert rows(2, 4) == sorted([tuple(r) for r in met.where("key < 3").collect()] + whole[-2:])


def test_numbers_go_along_with_picked_rows(spark):
    rows = written(spark.range(0, 1000, 1, 4).selectExpr("id as x", "monotonically_increasing_id() as row"), "rows")
    ids = rows.where("x % 7 = 0").selectExpr("row", "x * 10 as node")
    got = simhash.picked(rows, ids)
    assert got.columns == ["x", "row", "node"] and sorted((r.x, r.node) for r in got.collect()) == [(x, 10 * x) for x in range(0, 1000, 7)]


def test_a_stage_removes_what_the_one_before_left(spark):
    rows = star(20, seed=5)[0] + loose(5, 500)
    there = lambda paths: [p for p in paths if os.path.isdir(p.removeprefix("file://"))]
    docs = written(spark.createDataFrame(rows, SCHEMA), "docs")
    first = len(MADE)
    lazy = corpus_pipeline.near_dedup(spark, docs, "")
    left = MADE[first:]
    assert there(left)
    corpus_pipeline.secrets(spark, lazy, "")  # its input is still to be read from them
    assert there(left) and lazy.count() == 6
    lazy = corpus_pipeline.near_dedup(spark, docs, "")
    left, out = there(MADE[first:])[-2:], written(lazy, "out")
    assert corpus_pipeline.secrets(spark, out, "").count() == 6 and not there(left)
