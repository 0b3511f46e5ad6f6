"""Every query of the library against its SQL, on the smallest tables."""

import pytest

from tessera.plans import catalog
from tests.compare import duck_rows, spark_rows

catalog.load()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    names, rows = spark_rows(catalog.QUERIES[name](spark, sf_dir))
    if name in catalog.ORACLES:
        assert (names, rows) == duck_rows(duck.sql(catalog.ORACLES[name]))
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
