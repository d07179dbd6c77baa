"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from quillspark.plans import registry

from .oracle import DATA, difference

SF = "sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    assert difference(registry.QUERIES[name](spark, str(DATA / SF)), registry.ORACLE_SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    df = registry.QUERIES[name](spark, str(DATA / SF))
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
