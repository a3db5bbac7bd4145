"""Every registered query against its SQL on the smallest tables."""

import pytest

from cadenza.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, same_as_sql):
    frame = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        same_as_sql(frame, ORACLE_SQL[name], SF)
    else:
        assert frame.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
