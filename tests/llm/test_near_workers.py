"""A task of the near-duplicate stage has one Python worker at most: an executor keeps all that it ever had at once."""

from gaugework.llm import simhash
from tests.llm.test_near_copies import SCHEMA, brute_kept, star


def workers(node):
    """The most Python functions that one stage of a plan runs in a task."""
    most = 0

    def inside(node):
        nonlocal most
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        below = sum(inside(node.children().apply(k)) for k in range(node.children().size()))
        own = below + any(x in node.nodeName() for x in ("Arrow", "Pandas", "Python"))
        most = max(most, own)
        return 0 if "Exchange" in node.nodeName() else own

    inside(node)
    return most


def plan(df):
    return df._jdf.queryExecution().executedPlan()


def test_one_python_function_a_stage(spark, monkeypatch):
    seen, write = {}, simhash.written

    def watched(df, tag):
        seen[tag] = max(seen.get(tag, 0), workers(plan(df)))
        return write(df, tag)

    monkeypatch.setattr(simhash, "written", watched)
    rows = star(90, seed=2)[0] + star(70, seed=3, first=1000)[0]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA), bucket=4, tile=16, turns=1)
    seen["kept"] = workers(plan(kept))
    assert {"near-marks", "near-met", "near-sets", "near-links"} <= seen.keys()  # keys over the bucket were there
    assert max(seen.values()) == 1, seen
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(sorted(rows))
    twice = spark.range(3).mapInArrow(lambda x: x, "id long").mapInArrow(lambda x: x, "id long")
    assert workers(plan(twice)) == 2 and workers(plan(twice.repartition(2).mapInArrow(lambda x: x, "id long"))) == 2
