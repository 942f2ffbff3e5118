"""Queries of the subpackage agree with their SQL on the smallest tables."""

import pytest

from tests.test_queries import DATA, compare, con  # noqa: F401
from tidewrack.llm import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, con, name):  # noqa: F811
    compare(spark, con, name, catalogue.ORACLE)
