"""Every registered query of the registry operators against its SQL, on the smallest tables."""

import pytest
from cairn import queries

import compare


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.SQL])
def test_equals_sql(spark, sf, name):
    assert compare.differs(name, spark, sf).startswith("equal")


def test_only_the_review_pairs_have_no_sql():
    """Their ratio isn't an SQL function; tests/test_service.py holds the query against brute force."""
    assert set(queries.QUERIES) - set(queries.SQL) == {"possible_same"}


def test_entry_has_a_flagship(spark):
    import __spark_entry__ as entry

    assert {"entity", "display_name", "n_records"} <= set(entry.entry(spark).columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())
