"""Every registered query against its SQL on the smallest tables."""

import pytest
from check_queries import compare, database

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, SF_DIR, name)[2] in (None, "no rows")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["drug", "reaction", "n_cases", "prr", "ror", "chi2", "is_signal", "masking_warning"]
    assert df.count() > 0


def test_every_query_has_its_sql():
    own = {q for q in entry.queries() if not q.startswith("op") and q != "pipeline"}  # those are tested against brute force
    assert own == set(entry.oracle_sql()) & own and set(entry.oracle_sql()) <= set(entry.queries())
