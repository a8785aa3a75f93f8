"""Every registered query with SQL gives the same rows as DuckDB; the others give rows."""

import pytest

from oracle import compare
from tidewatt.catalog import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, name):
    assert compare(spark, name, QUERIES[name], ORACLE[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"forecast_metadata", "residual_model", "feature_importance"}))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["event_type", "ts", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
