"""Every query with SQL gives the SQL's rows."""

import pytest

from quillspark.plans import compare, registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows_agree(spark, data, duck, name):
    assert compare.differences(registry.QUERIES[name](spark, data), duck, registry.ORACLES[name]) == []


def test_every_query_is_registered():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["item_id", "rank", "doc_id", "side", "snippet", "position_ratio"]
