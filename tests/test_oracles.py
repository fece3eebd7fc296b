"""Every registered query of the engine runs, and agrees with its SQL where it has one."""

import pytest

from tomeflow.plans import registry

from .oracle import compare


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    if name in registry.ORACLE_SQL:
        assert compare(name, spark, sf_dir, registry.QUERIES[name], registry.ORACLE_SQL[name]) > 0
    else:
        assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
