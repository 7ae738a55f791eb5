from __future__ import annotations

import pytest
from compare import duck, rows_of

from cuelake import catalog, oracles

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_its_sql(spark, name):
    mine, other = catalog.QUERIES[name](spark, SF).toPandas(), duck(SF, oracles.SQL[name])
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows_of(mine) == rows_of(other)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(oracles.SQL)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and "disposition" in out.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
