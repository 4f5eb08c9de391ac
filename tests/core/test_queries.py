"""Every query of the catalogue that has SQL, against DuckDB on the smallest tables."""

import os

import pytest

from tests.oracle import same
from tilewright import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, name):
    same(catalog.QUERIES[name](spark, FOLDER), catalog.ORACLES[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
