"""Every registered query of the reference's operators against its SQL; those without SQL must give rows."""

import pytest
from conftest import rows_of

from oddlens.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck, small):
    got = registry.QUERIES[name](spark, small).toPandas()
    assert len(got)
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["method", "logical", "overall", "structural", "mean_auroc"]
