"""Every query of the subpackage runs on the smallest tables, and equals its SQL where there is one."""

import pytest
from helpers import assert_same

from loomgraph.llm import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SF_DIR), con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() >= 0
