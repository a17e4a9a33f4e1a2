"""Every query of the block-log engine against DuckDB, or its own inverse where SQL has none."""

import pytest
from compare import differs

from ledgerstone import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    assert differs(spark, name, catalog.queries()[name], catalog.oracle_sql()[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs_where_sql_cannot(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["start_block", "num_blocks", "object_id", "object_offset"]
    assert set(e.oracle_sql()) <= set(e.queries())
