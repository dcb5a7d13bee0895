"""Corpus queries that SQL can express, against that SQL."""

import pytest
from oracle import compare

from mergelens.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf, name):
    compare(spark, registry.queries()[name], registry.oracle_sql()[name], sf)
