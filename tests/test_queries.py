import pytest
from oracle import same_rows

from lexispan.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    same_rows(spark, sf_dir, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
