"""Every query of the library's own operators against its SQL on the same tables."""

import pytest

from gaugework import registry
from tests.compare import difference

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
#: Queries of which the smallest tables have no rows.
EMPTY = {"scale_down_candidates"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        said = difference(df, sf_dir, ORACLES[name])
        assert said == "" or said == "no rows" and name in EMPTY
    else:
        assert df.count() >= 0 and df.columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())
