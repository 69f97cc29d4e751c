"""Every registered query of the store against its SQL."""

import pytest

from palimpsest.plans import catalog
from tests.compare import assert_same, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf_dir, con):
    df = catalog.queries()[name](spark, sf_dir)
    assert_same(df, con, catalog.oracle_sql()[name])
