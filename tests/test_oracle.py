"""Every query with SQL against DuckDB over the smallest tables."""

import pytest

from leafmark import plans, registry  # noqa: F401

from . import compare


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_agree(spark, small, name):
    assert compare.differences(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], small) == ""
