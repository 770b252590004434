"""Every reference query against its SQL; those without SQL run and say that they round-trip."""

import pytest

from tessera.plans import catalog
from util import same


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, sf, name):
    same(catalog.QUERIES[name](spark, sf), duck, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows_only(spark, sf, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if "same" in got:
        assert got["same"].all()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
