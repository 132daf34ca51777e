"""Every registered query against its SQL twin at the smallest size."""

import pytest

from recfeat.plans import catalog
from recfeat import plans  # noqa: F401

from . import duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf_dir, con):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLE:
        duck.compare(df, con, catalog.ORACLE[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
