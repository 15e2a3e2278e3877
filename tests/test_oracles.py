"""Every query that has SQL against DuckDB, and every other one for rows and a stable schema."""

import pytest

from memloom import plans

SQL = plans.ORACLES | plans.registry.SMALL_ORACLES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(same_rows, name):
    same_rows(plans.QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    made = plans.QUERIES[name](spark, sf_dir)
    assert made.count() > 0 and len(made.columns) == len(set(made.columns))


def test_entry_has_stable_schema(spark):
    import __spark_entry__ as entry

    one, two = entry.entry(spark), entry.entry(spark)
    assert one.schema == two.schema and one.count() > 0


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
