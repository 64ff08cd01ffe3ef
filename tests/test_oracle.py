"""Every registered query that has a twin, against DuckDB. An empty result is a failure."""

import check
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.01"


def names():
    llm = getattr(entry, "llm", None)
    return sorted(set(entry.oracle_sql()) - set(llm.ORACLES if llm else ()))


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", names())
def test_matches_sql(spark, con, name):
    message = check.compare(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name])
    assert message is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
