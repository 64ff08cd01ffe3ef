"""Registered queries of the corpus operators against their twins."""

import check
import pytest

import __spark_entry__ as entry
from plumbline.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert check.compare(QUERIES[name](spark, SF_DIR), check.connect(SF_DIR), ORACLES[name]) is None


def test_all_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and {*QUERIES, "pipeline"} <= set(entry.queries())
